"""Binary tiles: one row for each (beam, coarse channel, coarse time), its samples as one binary of nupfreq x nt_per_packet
bytes, time fastest. Bytes are parsed and built by numpy, a whole Arrow batch at a time; rows of single samples exist only
where a caller asks for them.

`tile` is the coarse time since time 0: ichunk * nt_coarse + it_coarse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Grid
from .downsample import check_shape

#: Samples whose float arrays exist at one time.
STEP_SAMPLES = 1 << 20

TILE = "scale double, offset double, data binary"
SAMPLE = "beam_id int, ifreq int, isample long, byte int, scale double, offset double"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of equal length as rows of bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) and (np.diff(bounds) != width).any():
        raise ValueError(f"a tile does not have {width} bytes")
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].reshape(-1, width) if len(column) else np.empty((0, width), np.uint8)


def binaries(rows: np.ndarray) -> pa.Array:
    """The inverse of matrix()."""
    rows = np.ascontiguousarray(rows, np.uint8)
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, STEP_SAMPLES // width)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def masked(data: np.ndarray) -> np.ndarray:
    return (data == 0) | (data == 255)


def quantised(values: np.ndarray, good: np.ndarray, scale: np.ndarray, offset: np.ndarray) -> np.ndarray:
    level = np.where(good, (values - offset[:, None]) / scale[:, None], 0.0)
    return np.floor(np.clip(level, 0.0, 255.0) + 0.5).astype(np.uint8)


def encode(values: DataFrame, grid: Grid, cutoff: float = 0.3) -> DataFrame:
    """values(keys..., intensity array<double>, weight array<double>), a row a tile, as (keys..., scale, offset, data)."""
    width, keys = grid.nupfreq * grid.nt_per_packet, [c for c in values.columns if c not in ("intensity", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, width):
            x, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("intensity", "weight"))
            good = w >= cutoff
            n = good.sum(axis=1)
            kept = np.where(good, x, 0.0)
            mean = kept.sum(axis=1) / np.maximum(n, 1)
            var = np.maximum(np.maximum((kept * kept).sum(axis=1) / np.maximum(n, 1) - mean * mean, 1e-5 * mean * mean), 0.0)
            scale = np.where((n == 0) | (var == 0), 1.0, np.sqrt(var) / 25.0)
            offset = np.where(n > 0, mean - 128.0 * scale, 0.0)
            data = quantised(x, good, scale, offset)
            data[n == 0] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(scale), pa.array(offset), binaries(data)], names=[*keys, "scale", "offset", "data"])

    return values.select(*keys, "intensity", "weight").mapInArrow(run, f"{_fields(values, keys)}, {TILE}")


def with_mask(tiles: DataFrame, keep: str) -> DataFrame:
    """tiles with `mask`, the packed bits of the boolean array `keep`, which goes: a bit a time, 1 for a good one, the first
    in the lowest bit. An array may hold several rows of times, one after the other, for finer channels."""
    kept = [c for c in tiles.columns if c != keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(keep).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), binaries(np.packbits(bits, axis=1, bitorder="little"))], names=[*kept, "mask"])

    return tiles.select(*kept, keep).mapInArrow(run, f"{_fields(tiles, kept)}, mask binary")


def _and_of_pairs() -> np.ndarray:
    """For each byte of eight bits, the four bits that are 1 where both of a pair are."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.packbits(bits[:, 0::2] & bits[:, 1::2], axis=1, bitorder="little")[:, 0]


PAIRED = _and_of_pairs()


def halved_masks(mask: np.ndarray) -> np.ndarray:
    """Packed masks (groups, 2 n, rows, bytes) at half the time resolution, (groups, n, rows, bytes): a bit is kept where
    both of its pair are. Bytes are looked up, never single bits."""
    g, s, r, n = mask.shape
    nibbles = PAIRED[mask].reshape(g, s // 2, 2, r, n).transpose(0, 1, 3, 2, 4).reshape(g, s // 2, r, n, 2)
    return nibbles[..., 0] | nibbles[..., 1] << 4


def unpacked(mask: np.ndarray, u: int, t: int) -> np.ndarray:
    """(tiles, u, t) booleans of packed masks (tiles, bytes), whose rows stand for equally many fine channels each."""
    bits = np.unpackbits(mask, axis=1, bitorder="little").reshape(len(mask), -1, t).astype(bool)
    if u % bits.shape[1]:
        raise ValueError(f"a mask of {bits.shape[1]} rows does not fit {u} channels")
    return np.repeat(bits, u // bits.shape[1], axis=1)


def decode(tiles: DataFrame, grid: Grid, prescale: float = 1.0, masked_by: str | None = None) -> DataFrame:
    """tiles(keys..., scale, offset, data) as (keys..., intensity array<float>, weight array<float>). masked_by: a column of
    packed masks, as with_mask() gives them; samples whose bit is 0 get weight 0, too."""
    width, keys = grid.nupfreq * grid.nt_per_packet, [c for c in tiles.columns if c not in ("scale", "offset", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, width):
            data = matrix(batch.column("data"), width)
            scale, offset = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32)[:, None] for c in ("scale", "offset"))
            intensity = (scale * np.float32(prescale)) * data + offset * np.float32(prescale)
            bad = masked(data)
            if masked_by:
                masks = batch.column(masked_by)
                bits = matrix(masks, len(masks[0].as_py())) if batch.num_rows else np.empty((0, 0), np.uint8)
                bad |= ~unpacked(bits, grid.nupfreq, grid.nt_per_packet).reshape(data.shape) if batch.num_rows else False
            weight = np.where(bad, np.float32(0), np.float32(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), lists(intensity), lists(weight)], names=[*keys, "intensity", "weight"])

    return tiles.mapInArrow(run, f"{_fields(tiles, keys)}, intensity array<float>, weight array<float>")


def samples(tiles: DataFrame, grid: Grid) -> DataFrame:
    """tiles(beam_id, coarse_freq_id, tile, scale, offset, data[, seen, binning]) as a row a sample, at fine channels
    coarse_freq_id * nupfreq + u. seen: a byte for each time of the tile; times where it is 0 give no rows."""
    u, t = grid.nupfreq, grid.nt_per_packet
    extra = [c for c in ("binning",) if c in tiles.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, u * t):
            n = batch.num_rows
            data = matrix(batch.column("data"), u * t)
            keep = np.repeat(matrix(batch.column("seen"), t)[:, None, :] > 0, u, axis=1).ravel() if "seen" in batch.schema.names else np.ones(n * u * t, bool)
            wide = lambda name, batch=batch: np.repeat(batch.column(name).to_numpy(zero_copy_only=False), u * t)[keep]  # noqa: B023, E731
            fine = np.tile(np.repeat(np.arange(u, dtype=np.int32), t), n)[keep]
            time = np.tile(np.arange(t, dtype=np.int64), n * u)[keep]
            columns = [wide("beam_id").astype(np.int32), wide("coarse_freq_id").astype(np.int32) * u + fine, wide("tile").astype(np.int64) * t + time, data.ravel()[keep].astype(np.int32), wide("scale"), wide("offset")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(wide(c)) for c in extra)], names=["beam_id", "ifreq", "isample", "byte", "scale", "offset", *extra])

    needed = ["beam_id", "coarse_freq_id", "tile", "scale", "offset", "data", *[c for c in ("seen", "binning") if c in tiles.columns]]
    return tiles.select(*needed).mapInArrow(run, ", ".join([SAMPLE, *(f"{c} int" for c in extra)]))


def halved(data: np.ndarray, scale: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tiles (groups, 2 n, u, t) at half the time resolution, (groups, n, u, t): pairs of samples are averaged, valid where
    both are; two tiles become one with its own scale and offset."""
    g, s, u, t = data.shape
    bad = masked(data)
    value = 0.5 * scale[..., None, None] * (data[..., 0::2].astype(np.int32) + data[..., 1::2]) + offset[..., None, None]
    good = ~(bad[..., 0::2] | bad[..., 1::2])
    joined = lambda x: x.reshape(g, s // 2, 2, u, t // 2).transpose(0, 1, 3, 2, 4).reshape(-1, u * t)
    value, good = joined(value), joined(good)
    n = np.maximum(good.sum(axis=1), 1)
    mean = np.where(good, value, 0.0).sum(axis=1) / n
    gap = np.where(good, value - mean[:, None], 0.0)
    var = (gap * gap).sum(axis=1) / n + 1e-10 * mean * mean
    scale = 0.04 * np.where(var > 0, np.sqrt(var), 1.0)
    offset = mean - 128.0 * scale
    data = np.where(good, quantised(value, good, scale, offset), 0).astype(np.uint8)
    return data.reshape(g, s // 2, u, t), scale.reshape(g, s // 2), offset.reshape(g, s // 2)


def pyramid(tiles: DataFrame, levels: int, grid: Grid) -> DataFrame:
    """Levels 1 to `levels` of repeated downsampling: (binning, beam_id, coarse_freq_id, tile, scale, offset, data, seen).

    One shuffle and one pass for all levels: 2^levels tiles that end up in one are dealt to a task together, in order of
    time; a task holds one such group, or as many as make STEP_SAMPLES. Missing tiles count as masked; `seen` tells the
    times that an input tile covers. Of repeated tiles the last in the order of (scale, offset, data) counts. Packed masks,
    in a column `mask`, go the same way beside the data: a bit stays where both of its pair are 1, and a missing tile's are 0.
    """
    check_shape(grid.nt_per_packet, grid.nt_per_chunk)
    u, t, span = grid.nupfreq, grid.nt_per_packet, 1 << levels
    per_step = max(1, STEP_SAMPLES // (span * u * t))
    keys = ["beam_id", "coarse_freq_id", "tile"]
    masks = ["mask"] if "mask" in tiles.columns else []
    if masks and t % 8:
        raise ValueError("masks need a multiple of 8 samples a tile")

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        beam, freq, tile = (table.column(k).to_numpy() for k in keys)
        group = tile // span
        change = np.flatnonzero((np.diff(beam) != 0) | (np.diff(freq) != 0) | (np.diff(group) != 0)) + 1
        starts = np.concatenate(([0], change))
        place, rows = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(tile))), matrix(table.column("data").combine_chunks(), u * t)
        bits = matrix(table.column("mask").combine_chunks(), len(table.column("mask")[0].as_py())) if masks else None
        for a in range(0, len(starts), per_step):
            b = min(a + per_step, len(starts))
            some = slice(starts[a], starts[b] if b < len(starts) else len(tile))
            at = place[some] - a, tile[some] % span
            data, scale, offset, seen = np.zeros((b - a, span, u, t), np.uint8), np.ones((b - a, span)), np.zeros((b - a, span)), np.zeros((b - a, span, t), np.uint8)
            data[at], scale[at], offset[at], seen[at] = rows[some].reshape(-1, u, t), table.column("scale").to_numpy()[some], table.column("offset").to_numpy()[some], 1
            if masks:
                mask = np.zeros((b - a, span, bits.shape[1] * 8 // t, t // 8), np.uint8)
                mask[at] = bits[some].reshape(-1, *mask.shape[2:])
            for level in range(1, levels + 1):
                data, scale, offset = halved(data, scale, offset)
                mask = halved_masks(mask) if masks else None
                seen = seen[..., 0::2].reshape(b - a, -1, t)
                g, s = np.nonzero(seen.any(axis=2))
                first = starts[a + g]
                columns = [np.full(len(g), 1 << level, np.int32), beam[first], freq[first], group[first] * (span >> level) + s, scale[g, s], offset[g, s]]
                packed = [binaries(mask[g, s].reshape(len(g), -1))] if masks else []
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binaries(data[g, s].reshape(-1, u * t)), binaries(seen[g, s]), *packed], names=["binning", *keys, "scale", "offset", "data", "seen", *masks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            beam, freq, tile = (table.column(k).to_numpy() for k in keys)
            last = np.flatnonzero((beam != beam[-1]) | (freq != freq[-1]) | (tile // span != tile[-1] // span))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held)

    typed = tiles.select(F.col("beam_id").cast("int"), F.col("coarse_freq_id").cast("int"), F.col("tile").cast("long"), F.col("scale").cast("double"), F.col("offset").cast("double"), "data", *masks)
    dealt = typed.repartition("beam_id", "coarse_freq_id", F.expr(f"tile div {span}")).sortWithinPartitions(*keys, "scale", "offset", "data")
    return dealt.mapInArrow(run, f"binning int, beam_id int, coarse_freq_id int, tile long, {TILE}, seen binary" + ", mask binary" * len(masks))


def with_tile(placed: DataFrame, grid: Grid) -> DataFrame:
    """placed(ichunk, it_coarse, ...) with the tile number."""
    return placed.withColumn("tile", F.col("ichunk") * grid.nt_coarse + F.col("it_coarse"))
