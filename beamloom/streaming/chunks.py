"""Streaming assembly: payloads to whole chunks, with two active chunks a beam in state; and a history that carries data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Grid, StreamConfig
from ..operators.assembly import first_window, window_path
from ..operators.packets import CHUNK_TILES, receive
from ..operators.tiles import halved
from .streams import needs_store

#: A channel's tiles of one chunk, one after the other.
STRIP = "scales binary, offsets binary, data binary, seen binary"


class Strip:
    """A channel's tiles of one chunk; what hasn't come is 0."""

    def __init__(self, grid: Grid, values: Sequence[bytes] | None = None):
        n, width = grid.nt_coarse, grid.nupfreq * grid.nt_per_packet
        if values is None:
            self.scales, self.offsets, self.data, self.seen = np.zeros(n), np.zeros(n), np.zeros((n, width), np.uint8), np.zeros(n, np.uint8)
        else:
            self.scales, self.offsets = (np.frombuffer(bytes(v), "<f8").copy() for v in values[:2])
            self.data, self.seen = np.frombuffer(bytes(values[2]), np.uint8).reshape(n, width).copy(), np.frombuffer(bytes(values[3]), np.uint8).copy()

    def packed(self) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in (self.scales.astype("<f8"), self.offsets.astype("<f8"), self.data, self.seen))


class ChunkAssembler(StatefulProcessor):
    """Per beam: the window and the strips of its two active chunks. A batch's packets go by arrival; each moves the window
    at most once, and a chunk that the window leaves is flushed whole. End-of-stream packets, or a quiet time, flush both.
    A chunk that is put in whole moves the window behind itself."""

    def __init__(self, config: StreamConfig, idle_ms: int | None = None):
        self.config, self.grid, self.idle = config, config.grid, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "active long, ended boolean")
        self.strips = handle.getMapState("strips", "ichunk long, coarse_freq_id int", STRIP)

    def _strip(self, ichunk: int, freq: int) -> Strip:
        key = (ichunk, freq)
        return Strip(self.grid, self.strips.getValue(key) if self.strips.containsKey(key) else None)

    def _flushed(self, beam: int, ichunk: int, fresh: dict[int, Strip]) -> pd.DataFrame:
        """All tiles of a chunk, which leaves the state; fresh: its strips that this batch has touched."""
        g = self.grid
        held = [key for key in self.strips.keys() if key[0] == ichunk]
        for key in held:
            fresh.setdefault(key[1], Strip(g, self.strips.getValue(tuple(key))))
            self.strips.removeKey(tuple(key))
        empty = Strip(g)
        every = [fresh.get(f, empty) for f in range(g.nfreq_coarse)]
        n = g.nt_coarse
        joined = lambda name: np.concatenate([getattr(s, name) for s in every])
        return pd.DataFrame({
            "beam_id": np.int32(beam), "ichunk": np.int64(ichunk), "coarse_freq_id": np.repeat(np.arange(g.nfreq_coarse, dtype=np.int32), n), "it_coarse": np.tile(np.arange(n, dtype=np.int32), g.nfreq_coarse),
            "scale": joined("scales"), "offset": joined("offsets"), "data": [row.tobytes() for s in every for row in s.data], "present": joined("seen") > 0,
        })

    def _end(self, beam: int, active: int | None) -> Iterator[pd.DataFrame]:
        """Both active chunks; later packets are not read."""
        if active is not None:
            for ichunk in (active, active + 1):
                yield self._flushed(beam, ichunk, {})
        self.window.update((active, True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, ended = self.window.get() if self.window.exists() else (None, False)
        frame = pd.concat(list(rows), ignore_index=True).sort_values("arrival_seq", kind="stable")
        if ended:
            return
        over = np.flatnonzero(frame["data"].isna().to_numpy())
        if len(over):
            frame = frame.iloc[: int(over[0])]
        if len(frame):
            seq, put = frame["arrival_seq"].to_numpy(), frame["inject"].to_numpy(bool)
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(put) != 0) | (put[1:] & (np.diff(seq) != 0))) + 1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(seq)]):
                active = yield from (self._injected if put[a] else self._packets)(key[0], frame.iloc[a:b], active)
            self.window.update((int(active), False))
        if len(over):
            yield from self._end(key[0], None if active is None else int(active))
        elif self.idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def _packets(self, beam: int, frame: pd.DataFrame, active: int | None) -> Iterator[pd.DataFrame]:
        """Packets in order: the chunks that the window leaves, and where it is then."""
        seq, chunk = frame["arrival_seq"].to_numpy(), frame["fpga_count"].to_numpy() // self.grid.counts_per_chunk
        first = np.concatenate(([0], np.flatnonzero(np.diff(seq)) + 1))  # a packet's channels come together
        began = first_window(int(chunk[0]), self.config.nt_align // self.grid.nt_per_chunk) if active is None else active
        at, active = window_path(chunk[first].astype(np.int64), began)
        at = np.repeat(at, np.diff(first, append=len(seq)))
        hit = (chunk >= at) & (chunk <= at + 1)
        # every hit of a chunk comes before the chunk is flushed, so chunks are taken one after the other
        touched = set(chunk[hit].tolist())
        for ichunk in [*range(began, active), *sorted(c for c in touched if c >= active)]:
            fresh = self._placed(frame[hit & (chunk == ichunk)], ichunk)
            if ichunk < active:
                yield self._flushed(beam, ichunk, fresh)
            else:
                for freq, strip in fresh.items():
                    self.strips.updateValue((ichunk, freq), strip.packed())
        return int(active)

    def _injected(self, beam: int, frame: pd.DataFrame, active: int | None) -> Iterator[pd.DataFrame]:
        """A whole chunk goes out, the window goes on behind it, and what was in the old one is lost."""
        ichunk = int(frame["fpga_count"].iloc[0]) // self.grid.counts_per_chunk
        for key in list(self.strips.keys()):
            self.strips.removeKey(tuple(key))
        yield self._flushed(beam, ichunk, self._placed(frame, ichunk))
        return ichunk + 1

    def _placed(self, rows: pd.DataFrame, ichunk: int) -> dict[int, Strip]:
        """The chunk's strips that rows, in order, touch: of several tiles for a place the last stands."""
        g, out = self.grid, {}
        if not len(rows):
            return out
        place = (rows["fpga_count"].to_numpy() // g.counts_per_sample - ichunk * g.nt_per_chunk) // g.nt_per_packet
        freqs, data = rows["coarse_freq_id"].to_numpy(), rows["data"].to_numpy()
        scale, offset = rows["scale"].to_numpy(), rows["offset"].to_numpy()
        where = freqs.astype(np.int64) * g.nt_coarse + place
        last = len(where) - 1 - np.unique(where[::-1], return_index=True)[1]
        for k in last.tolist():
            strip = out.get(int(freqs[k]))
            if strip is None:
                strip = out[int(freqs[k])] = self._strip(ichunk, int(freqs[k]))
            t = int(place[k])
            strip.scales[t], strip.offsets[t], strip.seen[t] = scale[k], offset[k], 1
            strip.data[t] = np.frombuffer(data[k], np.uint8)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        active, ended = self.window.get() if self.window.exists() else (None, False)
        if not ended:
            yield from self._end(key[0], active)

    def close(self) -> None:
        pass


def chunk_tile_stream(raw: DataFrame, config: StreamConfig, idle_ms: int | None = None, injected: DataFrame | None = None) -> DataFrame:
    """A stream of payloads, raw(arrival_seq, payload), to the tiles of flushed chunks, as packets.assembled_strict() gives
    them; rows of a batch go by arrival. idle_ms: a beam that no packet has reached for so long has ended. injected: a
    stream of whole chunks, (arrival_seq, beam_id, ichunk, coarse_freq_id, it_coarse, scale, offset, data), a number of
    arrival each, which go out as they are and move their beam's window behind themselves."""
    needs_store(raw)
    g = config.grid
    got = receive(raw, config, ends=config.accept_end_of_stream).withColumn("inject", F.lit(False))
    if injected is not None:
        count = (F.col("ichunk") * g.nt_per_chunk + F.col("it_coarse") * g.nt_per_packet) * g.counts_per_sample
        got = got.unionByName(injected.select("arrival_seq", "beam_id", "coarse_freq_id", count.cast("long").alias("fpga_count"), "scale", "offset", "data", F.lit(True).alias("inject")))
    return got.groupBy("beam_id").transformWithStateInPandas(ChunkAssembler(config, idle_ms), outputStructType=CHUNK_TILES, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")


class History(StatefulProcessor):
    """Per beam and channel: the strips that a telescoping history holds, level by level.

    Level l holds strips of 2^l chunks. When a level is full, its two oldest are merged and pushed up; the last level
    drops its oldest. What leaves the history is given out.
    """

    def __init__(self, grid: Grid, capacities: Sequence[int]):
        if any(c < 2 for c in capacities):
            raise ValueError("a ring capacity is below 2")
        self.grid, self.capacities = grid, tuple(capacities)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sizes = handle.getValueState("sizes", "oldest array<long>, sizes array<int>")
        self.strips = handle.getMapState("history", "level int, ichunk long", STRIP)

    def _pushed(self, level: int, ichunk: int, strip: tuple, oldest: list[int], sizes: list[int]) -> Iterator[tuple]:
        span = 1 << level
        if sizes[level] == self.capacities[level]:
            first = oldest[level]
            if level == len(self.capacities) - 1:
                yield first, span
                self.strips.removeKey((level, first))
                oldest[level], sizes[level] = first + span, sizes[level] - 1
            else:
                pair = [Strip(self.grid, self.strips.getValue((level, first + k * span))) for k in (0, 1)]
                for k in (0, 1):
                    self.strips.removeKey((level, first + k * span))
                oldest[level], sizes[level] = first + 2 * span, sizes[level] - 2
                yield from self._pushed(level + 1, first, self._merged(*pair).packed(), oldest, sizes)
        if not sizes[level]:
            oldest[level] = ichunk
        self.strips.updateValue((level, ichunk), strip)
        sizes[level] += 1

    def _merged(self, a: Strip, b: Strip) -> Strip:
        """Two strips at half the time resolution; missing tiles count as masked."""
        g, out = self.grid, Strip(self.grid)
        n, u, t = g.nt_coarse, g.nupfreq, g.nt_per_packet
        each = [np.concatenate([getattr(s, name) for s in (a, b)]) for name in ("data", "scales", "offsets", "seen")]
        data, scale, offset = halved(each[0].reshape(1, 2 * n, u, t), each[1][None], each[2][None])
        out.data, out.scales, out.offsets = data.reshape(n, u * t), scale[0], offset[0]
        out.seen = each[3].reshape(n, 2).max(axis=1)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.sizes.get() if self.sizes.exists() else None
        n = len(self.capacities)
        oldest, sizes = (list(held[0]), list(held[1])) if held is not None else ([0] * n, [0] * n)
        frame, gone = pd.concat(list(rows), ignore_index=True).sort_values(["ichunk", "it_coarse"], kind="stable"), []
        for ichunk, own in frame.groupby("ichunk", sort=True):
            strip = Strip(self.grid)
            at = own["it_coarse"].to_numpy()
            strip.scales[at], strip.offsets[at], strip.seen[at] = own["scale"].to_numpy(), own["offset"].to_numpy(), own["present"].to_numpy()
            strip.data[at] = np.frombuffer(b"".join(own["data"]), np.uint8).reshape(len(at), -1)
            gone += self._pushed(0, int(ichunk), strip.packed(), oldest, sizes)
        self.sizes.update((oldest, sizes))
        yield pd.DataFrame({"beam_id": np.int32(key[0]), "coarse_freq_id": np.int32(key[1]), "ichunk": pd.Series([i for i, _ in gone], dtype="int64"), "binning": pd.Series([b for _, b in gone], dtype="int32")})

    def close(self) -> None:
        pass


def history_stream(chunk_tiles: DataFrame, grid: Grid, capacities: Sequence[int]) -> DataFrame:
    """A stream of chunk_tile_stream()'s rows, whole chunks in a batch, into a history kept in state. The rows that come out,
    (beam_id, coarse_freq_id, ichunk, binning), are what has left it; history() reads what it holds."""
    needs_store(chunk_tiles)
    return chunk_tiles.groupBy("beam_id", "coarse_freq_id").transformWithStateInPandas(
        History(grid, capacities), outputStructType="beam_id int, coarse_freq_id int, ichunk long, binning int", outputMode="Append", timeMode="None"
    )


def history(spark: SparkSession, checkpoint: str, grid: Grid) -> DataFrame:
    """What the history of a stream with that checkpoint holds after its last batch, read from its state: (beam_id,
    coarse_freq_id, level, ichunk, binning, it_coarse, scale, offset, data, present)."""
    n, width = grid.nt_coarse, grid.nupfreq * grid.nt_per_packet
    held = spark.read.format("statestore").option("stateVarName", "history").load(checkpoint)
    rows = held.select("key.beam_id", "key.coarse_freq_id", "user_map_key.level", "user_map_key.ichunk", F.expr("cast(shiftleft(1, user_map_key.level) as int)").alias("binning"), "user_map_value.*")

    def run(batches):
        import pyarrow as pa

        from ..operators.tiles import binaries

        for batch in batches:
            keys = [pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("beam_id", "coarse_freq_id", "level", "ichunk", "binning")]
            joined = lambda name, kind, batch=batch: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
            columns = [*keys, pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(joined("scales", "<f8")), pa.array(joined("offsets", "<f8"))]
            columns += [binaries(joined("data", np.uint8).reshape(-1, width)), pa.array(joined("seen", np.uint8) > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["beam_id", "coarse_freq_id", "level", "ichunk", "binning", "it_coarse", "scale", "offset", "data", "present"])

    return rows.mapInArrow(run, "beam_id int, coarse_freq_id int, level int, ichunk long, binning int, it_coarse int, scale double, offset double, data binary, present boolean")
