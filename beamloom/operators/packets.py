"""Wire packets: parsing, validation classes, splitting by beam and channel, and building payloads.

Layout (little-endian): version u32, data bytes i16, counts per sample u16, count u64, beams, channels, upsampling and
samples u16 each; beam ids u16[b], channel ids u16[f], scales f32[b,f], offsets f32[b,f], data u8[b,f,u,t].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HEADER_BYTES, MAX_INPUT_PACKET, MAX_NT_PER_PACKET, MAX_OUTPUT_PACKET, PROTOCOL_VERSION, StreamConfig
from .assembly import assemble_strict
from .timeseries import explode_range, with_blocks
from .tiles import binaries, lists, matrix, with_tile

HEADER = np.dtype([("protocol_version", "<u4"), ("data_nbytes", "<i2"), ("fpga_counts_per_sample", "<u2"), ("fpga_count", "<u8"), ("nbeams", "<u2"), ("nfreq_coarse", "<u2"), ("nupfreq", "<u2"), ("ntsamp", "<u2")])

PACKET = (
    "arrival_seq long, nbytes int, protocol_version long, data_nbytes int, fpga_counts_per_sample int, fpga_count long, nbeams int, nfreq_coarse int, nupfreq int, ntsamp int, "
    "beam_ids array<int>, coarse_freq_ids array<int>, scales array<float>, offsets array<float>, data binary"
)


def _le(at: int, size: int) -> Column:
    """An unsigned little-endian number of payload bytes, by built-in functions."""
    digits = F.concat(*[F.hex(F.substring("payload", at + size - i, 1)) for i in range(size)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def parse_headers(raw: DataFrame) -> DataFrame:
    """raw(payload, ...) with the eight header fields; no Python. Fields that a short payload lacks are null."""
    has = F.length("payload") >= HEADER_BYTES
    fields, at = {}, 0
    for name in HEADER.names:
        size = HEADER[name].itemsize
        value = _le(at, size)
        if name == "data_nbytes":
            value = F.when(value >= 1 << 15, value - (1 << 16)).otherwise(value)
        fields[name] = F.when(has & (value <= F.lit(2**63 - 1)), value).cast("long")
        at += size
    return raw.withColumns(fields).withColumn("nbytes", F.length("payload"))


def expected_bytes(b="nbeams", f="nfreq_coarse", u="nupfreq", t="ntsamp") -> tuple[Column, Column]:
    """Bytes of the head (header and arrays) and of the data."""
    b, f, u, t = (F.col(x).cast("long") for x in (b, f, u, t))
    return HEADER_BYTES + 2 * b + 2 * f + 8 * b * f, b * f * u * t


def is_good(nfreq_coarse: int = 1024) -> Column:
    """Whether a packet is well-formed; columns as parse_headers() gives them and coarse_freq_ids where known."""
    head, data = expected_bytes()
    t, c = F.col("ntsamp"), F.col("fpga_counts_per_sample")
    good = (
        F.col("nbytes").between(HEADER_BYTES, MAX_INPUT_PACKET) & (F.col("protocol_version") == PROTOCOL_VERSION)
        & (t >= 1) & (t <= MAX_NT_PER_PACKET) & (F.expr("ntsamp & (ntsamp - 1)") == 0) & (c > 0)
        & (F.col("nbeams") > 0) & (F.col("nfreq_coarse") > 0) & (F.col("nupfreq") > 0)
        & (F.try_mod(F.col("fpga_count").cast("long"), (c * t).cast("long")) == 0)
        & (F.col("nbytes") == head + data) & (F.col("data_nbytes") == data) & F.forall("coarse_freq_ids", lambda x: x < nfreq_coarse)
    )
    return F.coalesce(good, F.lit(False))


def classify(packets: DataFrame, config: StreamConfig) -> DataFrame:
    """packets with packet_class: end_of_stream, bad, stream_mismatch, beam_id_mismatch or good. strict: mismatches raise."""
    g = config.grid
    fits = (F.col("nbeams") == len(config.beam_ids)) & (F.col("nupfreq") == g.nupfreq) & (F.col("ntsamp") == g.nt_per_packet) & (F.col("fpga_counts_per_sample") == g.counts_per_sample)
    known = F.forall("beam_ids", lambda x: x.isin(*config.beam_ids))
    mismatch = lambda name: F.raise_error(F.lit(name)).cast("string") if config.strict else F.lit(name)
    kind = (
        F.when(F.col("nbytes") == HEADER_BYTES, "end_of_stream").when(~is_good(g.nfreq_coarse), "bad")
        .when(~fits, mismatch("stream_mismatch")).when(~known, mismatch("beam_id_mismatch")).otherwise("good")
    )
    return packets.withColumn("packet_class", kind)


def parse(raw: DataFrame) -> DataFrame:
    """raw(arrival_seq, payload) to whole packets, in no order. Payloads of one length and shape are one matrix of bytes, whose
    columns are their arrays. Malformed ones have empty arrays."""
    fields = [part.split() for part in PACKET.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}
    names, types = [n for n, _ in fields], [kinds[k] for _, k in fields]

    def group(seq: np.ndarray, payload: pa.Array, length: int, head: np.ndarray | None, b: int, f: int) -> pa.RecordBatch:
        n, at = len(seq), HEADER_BYTES + 2 * b + 2 * f + 8 * b * f
        if head is None:
            numbers = [pa.nulls(n, k) for k in types[2:10]]
        else:  # a field beyond a long is null
            numbers = [pa.array(head[c].astype(np.int64) if c != "fpga_count" else head[c], mask=head[c] >= 1 << 63 if c == "fpga_count" else None).cast(k) for c, k in zip(HEADER.names, types[2:10])]
        if head is None or length < at:
            arrays = [pa.array([[]] * n, k) for k in types[10:14]] + [pa.array([b""] * n, pa.binary())]
        else:
            rows = matrix(payload, length)
            part = lambda start, size, kind: rows[:, start : start + size].copy().view(kind)
            begin = HEADER_BYTES + 2 * b + 2 * f
            columns = [(HEADER_BYTES, 2 * b, "<u2", np.int32), (HEADER_BYTES + 2 * b, 2 * f, "<u2", np.int32), (begin, 4 * b * f, "<f4", np.float32), (begin + 4 * b * f, 4 * b * f, "<f4", np.float32)]
            arrays = [lists(part(start, size, kind).astype(to)) for start, size, kind, to in columns] + [binaries(rows[:, at:])]
        return pa.RecordBatch.from_arrays([pa.array(seq), pa.array(np.full(n, length, np.int32)), *numbers, *arrays], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, seq = batch.column("payload"), batch.column("arrival_seq").to_numpy()
            lengths = pa.compute.binary_length(payload).to_numpy()
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                if length < HEADER_BYTES:
                    yield group(seq[at], payload.take(pa.array(at)), length, None, 0, 0)
                    continue
                head = matrix(pa.compute.binary_slice(payload.take(pa.array(at)), 0, HEADER_BYTES), HEADER_BYTES).copy().view(HEADER)[:, 0]
                shape = head["nbeams"].astype(np.int64) << 16 | head["nfreq_coarse"]
                for s in np.unique(shape).tolist():
                    own = shape == s
                    yield group(seq[at[own]], payload.take(pa.array(at[own])), length, head[own], s >> 16, s & 0xFFFF)

    return raw.select("arrival_seq", "payload").mapInArrow(run, PACKET)


def split_beams(packets: DataFrame) -> DataFrame:
    """One row a (packet, beam): its slices of scales, offsets and data."""
    per = F.expr("nfreq_coarse * nupfreq * ntsamp")
    df = packets.select("*", F.posexplode("beam_ids").alias("ibeam", "beam_id"))
    return df.withColumns({
        "scales": F.slice("scales", F.expr("ibeam * nfreq_coarse + 1"), F.col("nfreq_coarse")), "offsets": F.slice("offsets", F.expr("ibeam * nfreq_coarse + 1"), F.col("nfreq_coarse")),
        "data": F.substring(F.col("data"), F.col("ibeam") * per + 1, per),
    }).drop("beam_ids", "ibeam")


def split_channels(beam_packets: DataFrame) -> DataFrame:
    """One row a tile: (arrival_seq, beam_id, coarse_freq_id, fpga_count, scale, offset, data)."""
    df = beam_packets.select("*", F.posexplode("coarse_freq_ids").alias("i", "coarse_freq_id"))
    per = F.expr("nupfreq * ntsamp")
    return df.select("arrival_seq", "beam_id", "coarse_freq_id", "fpga_count", "fpga_counts_per_sample", "nupfreq", "ntsamp",
                     F.element_at("scales", F.col("i") + 1).alias("scale"), F.element_at("offsets", F.col("i") + 1).alias("offset"), F.substring(F.col("data"), F.col("i") * per + 1, per).alias("data"))


TILES = "arrival_seq long, beam_id int, coarse_freq_id int, fpga_count long, scale double, offset double, data binary"


#: Payload bytes that are taken at a time.
STEP_BYTES = 1 << 22


def receive(raw: DataFrame, config: StreamConfig, ends: bool = False) -> DataFrame:
    """raw(arrival_seq, payload) to the tiles of its good packets' known beams: (arrival_seq, beam_id, coarse_freq_id,
    fpga_count, scale, offset, data). Headers are judged by built-in functions. Good packets of one length have equally
    many channels, so those of a batch are one matrix of bytes, whose columns are the packets' arrays.

    A packet with an unknown beam is good; that beam's part is left out, or an error with a strict configuration. ends: an
    end-of-stream packet is a row without data for each beam.
    """
    judged = classify(with_channels(parse_headers(raw)), config)
    kinds = ["good", "beam_id_mismatch", *(["end_of_stream"] if ends else [])]
    wanted = judged.filter(F.col("packet_class").isin(*kinds)).select("arrival_seq", "payload")
    known, names = np.array(sorted(config.beam_ids)), [p.split()[0] for p in TILES.split(", ")]
    beams, size = len(config.beam_ids), config.grid.nupfreq * config.grid.nt_per_packet

    def of_length(seq: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        n, length = rows.shape
        if length == HEADER_BYTES:
            columns = [np.repeat(seq, beams), np.tile(known.astype(np.int32), n)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.nulls(n * beams, k) for k in (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))], names=names)
        f = (length - HEADER_BYTES - 2 * beams) // (2 + 8 * beams + beams * size)
        part = lambda at, width, kind: rows[:, at : at + width].copy().view(kind)
        at = HEADER_BYTES + 2 * beams + 2 * f
        ids, channels = part(HEADER_BYTES, 2 * beams, "<u2").astype(np.int32), part(HEADER_BYTES + 2 * beams, 2 * f, "<u2").astype(np.int32)
        scale, offset = (part(at + 4 * beams * f * k, 4 * beams * f, "<f4").astype(float).ravel() for k in (0, 1))
        keep = np.repeat(np.isin(ids, known), f, axis=1).ravel()
        count = part(8, 8, "<u8").astype(np.int64).ravel()
        columns = [np.repeat(seq, beams * f), np.repeat(ids, f, axis=1).ravel(), np.repeat(channels[:, None, :], beams, axis=1).ravel(), np.repeat(count, beams * f), scale, offset]
        data = rows[:, at + 8 * beams * f :].reshape(-1, size)
        return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), binaries(data[keep])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("payload")).to_numpy()
            step = max(1, STEP_BYTES // max(1, int(lengths.max(initial=1))))
            for a in range(0, batch.num_rows, step):
                seq, payload, own = batch.column("arrival_seq")[a : a + step].to_numpy(), batch.column("payload")[a : a + step], lengths[a : a + step]
                for length in np.unique(own).tolist():
                    at = np.flatnonzero(own == length)
                    yield of_length(seq[at], matrix(payload.take(pa.array(at)), length))

    return wanted.mapInArrow(run, TILES)


def with_channels(headers: DataFrame) -> DataFrame:
    """headers(payload, nbeams, ...) with beam_ids and coarse_freq_ids, by built-in functions; empty where the packet is too
    short or has too many to be good."""
    def ids(count: Column, at: Column) -> Column:
        fits = (F.col("nbytes") >= at + 2 * count) & (count > 0) & (count <= MAX_INPUT_PACKET // 2)
        each = F.transform(F.sequence(F.lit(0), F.when(fits, count - 1).otherwise(0).cast("int")), lambda i: F.conv(F.concat(F.hex(F.substring(F.col("payload"), (at + 2 * i + 2).cast("int"), F.lit(1))), F.hex(F.substring(F.col("payload"), (at + 2 * i + 1).cast("int"), F.lit(1)))), 16, 10).cast("int"))
        return F.when(fits, each).otherwise(F.array().cast("array<int>"))

    b, f = (F.coalesce(F.col(c), F.lit(0)) for c in ("nbeams", "nfreq_coarse"))
    return headers.withColumn("beam_ids", ids(b, F.lit(HEADER_BYTES))).withColumn("coarse_freq_ids", ids(f, HEADER_BYTES + 2 * b))


def place_tiles(tiles: DataFrame, nt_per_chunk: int = 1024) -> DataFrame:
    """The last tile written to each (beam, chunk, channel, coarse time)."""
    isample = F.expr("fpga_count div fpga_counts_per_sample")
    keyed = tiles.withColumn("ichunk", F.expr(f"fpga_count div fpga_counts_per_sample div {nt_per_chunk}")).withColumn("it_coarse", (isample % nt_per_chunk / F.col("ntsamp")).cast("int"))
    last = F.max_by(F.struct("scale", "offset", "data"), "arrival_seq").alias("tile")
    return keyed.groupBy("beam_id", "ichunk", "coarse_freq_id", "it_coarse").agg(last).select("beam_id", "ichunk", "coarse_freq_id", "it_coarse", "tile.*")


def assembled(raw: DataFrame, config: StreamConfig) -> DataFrame:
    """The receive path: payloads to placed tiles (beam_id, ichunk, coarse_freq_id, it_coarse, tile, scale, offset, data)."""
    g = config.grid
    got = receive(raw, config).withColumns({"fpga_counts_per_sample": F.lit(g.counts_per_sample), "ntsamp": F.lit(g.nt_per_packet)})
    return with_tile(place_tiles(got, g.nt_per_chunk), g)


#: What the strict receive path makes of a flushed chunk: every tile of it, those that never came with scale, offset and bytes 0.
CHUNK_TILES = "beam_id int, ichunk long, coarse_freq_id int, it_coarse int, scale double, offset double, data binary, present boolean"


def assembled_strict(raw: DataFrame, config: StreamConfig, ranges: int | None = None) -> DataFrame:
    """The receive path with the two-chunk window of strict assembly: payloads to the whole chunks that a beam's window
    flushes, in the form of CHUNK_TILES.

    A packet's channels reach a beam together: they move its window once, and are placed if they lie in it. Of several
    tiles for a place the last stands. Every chunk from the first window to the last is flushed, also those that nothing
    came for; what comes after the first end-of-stream packet isn't read, if the configuration takes those for the end.
    """
    g = config.grid
    got = receive(raw, config, ends=config.accept_end_of_stream)
    got = got.withColumn("packet_chunk", F.expr(f"fpga_count div {g.counts_per_chunk}"))
    if config.accept_end_of_stream:
        end = got.filter(F.col("data").isNull()).agg(F.min("arrival_seq").alias("_end"))
        got = got.join(end, F.col("_end").isNotNull() & (F.col("arrival_seq") >= F.col("_end")), "left_anti").filter(F.col("data").isNotNull())
    sent = got.groupBy("beam_id", "arrival_seq").agg(F.min("packet_chunk").alias("packet_chunk"))
    verdicts = assemble_strict(sent.select("beam_id", F.col("arrival_seq").alias("arrival"), F.col("arrival_seq").alias("event_id"), "packet_chunk"), config.nt_align // g.nt_per_chunk, ranges)
    hits = verdicts.filter("hit").select("beam_id", F.col("event_id").alias("arrival_seq"))
    placed = place_tiles(got.join(hits, ["beam_id", "arrival_seq"]).withColumns({"fpga_counts_per_sample": F.lit(g.counts_per_sample), "ntsamp": F.lit(g.nt_per_packet)}), g.nt_per_chunk)
    every = explode_range(verdicts.groupBy("beam_id").agg(F.min("active").alias("a"), (F.max("active") + 1).alias("b")), F.col("a"), F.col("b"), "ichunk")
    every = every.select("beam_id", "ichunk", F.explode(F.sequence(F.lit(0), F.lit(g.nfreq_coarse - 1))).alias("coarse_freq_id"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(g.nt_coarse - 1))).alias("it_coarse"))
    none = F.lit(bytes(g.nupfreq * g.nt_per_packet))
    return every.join(placed, ["beam_id", "ichunk", "coarse_freq_id", "it_coarse"], "left").select(
        "beam_id", "ichunk", "coarse_freq_id", "it_coarse", F.coalesce("scale", F.lit(0.0)).alias("scale"), F.coalesce("offset", F.lit(0.0)).alias("offset"),
        F.coalesce("data", none).alias("data"), F.col("data").isNotNull().alias("present"),
    )


def build_payload(version: int, counts_per_sample: int, fpga_count: int, beam_ids, freq_ids, scales, offsets, data) -> bytes:
    data = np.asarray(data, np.uint8)
    b, f, u, t = data.shape
    head = np.array([(version, data.size, counts_per_sample, fpga_count, b, f, u, t)], HEADER)
    return b"".join([head.tobytes(), np.asarray(beam_ids, "<u2").tobytes(), np.asarray(freq_ids, "<u2").tobytes(), np.asarray(scales, "<f4").tobytes(), np.asarray(offsets, "<f4").tobytes(), data.tobytes()])


END_OF_STREAM = np.array([(PROTOCOL_VERSION, 0, 0, 0, 0, 0, 0, 0)], HEADER).tobytes()


def packetize(tiles: DataFrame, nt_per_packet: int, counts_per_sample: int, nfreq_per_packet: int, nupfreq: int) -> DataFrame:
    """(fpga_count, ifreq_outer, payload): tiles(beam_id, coarse_freq_id, itile, scale, offset, data) grouped to packets.

    A packet has every beam, nfreq_per_packet channels and one tile of time; its size is bounded by the wire format.
    """
    group = tiles.withColumn("ifreq_outer", F.expr(f"coarse_freq_id div {nfreq_per_packet}")).groupBy("itile", "ifreq_outer")
    parts = group.agg(F.sort_array(F.collect_list(F.struct("beam_id", "coarse_freq_id", "scale", "offset", "data"))).alias("tiles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for itile, outer, rows in zip(*(c.to_pylist() for c in batch.columns)):
                beams, freqs = sorted({r["beam_id"] for r in rows}), sorted({r["coarse_freq_id"] for r in rows})
                if len(rows) != len(beams) * len(freqs):
                    raise ValueError("a packet needs each of its channels for each of its beams")
                data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8).reshape(len(beams), len(freqs), nupfreq, nt_per_packet)
                count = itile * nt_per_packet * counts_per_sample
                size = HEADER_BYTES + 2 * (len(beams) + len(freqs)) + 8 * len(rows) + data.size
                if size > MAX_OUTPUT_PACKET:
                    raise ValueError(f"a packet of {size} bytes is longer than {MAX_OUTPUT_PACKET}")
                out.append((count, outer, build_payload(PROTOCOL_VERSION, counts_per_sample, count, beams, freqs, [r["scale"] for r in rows], [r["offset"] for r in rows], data)))
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["fpga_count", "ifreq_outer", "payload"])

    return parts.select(F.col("itile").cast("long"), F.col("ifreq_outer").cast("long"), "tiles").mapInArrow(run, "fpga_count long, ifreq_outer long, payload binary")


#: A sender repeats its last packet, since any one may get lost.
END_REPEATS = 5


def with_end(sent: DataFrame, repeats: int = END_REPEATS) -> DataFrame:
    """sent(send_order, payload) and end-of-stream packets after the last."""
    last = sent.agg(F.coalesce(F.max("send_order"), F.lit(-1)).alias("last"))
    ends = last.select("last", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("k")).select((F.col("last") + F.col("k")).cast("long").alias("send_order"), F.lit(END_OF_STREAM).alias("payload"))
    return sent.select(F.col("send_order").cast("long"), "payload").unionByName(ends)


def until_end(classified: DataFrame, config: StreamConfig, order: str = "arrival_seq") -> DataFrame:
    """Packets before the first end-of-stream packet, where the configuration takes those for the end; else all."""
    if not config.accept_end_of_stream:
        return classified
    end = classified.filter(F.col("packet_class") == "end_of_stream").agg(F.min(order).alias("_end"))
    return classified.join(end, F.col("_end").isNotNull() & (F.col(order) >= F.col("_end")), "left_anti")


#: A stream that has fallen behind may send so much of the target interval apart until it has caught up.
CATCH_UP = 0.8


def send_times(sent: DataFrame, stream: str, target_gbps: float, blocks: int | None = None) -> DataFrame:
    """sent(stream, send_order, ready_us, nbytes) with send_us, when a throttled sender sends each packet.

    A packet goes when it is ready, not before what the stream has sent so far takes at the target rate, and CATCH_UP of
    its predecessor's own time after that. With D the sum of those times, the last rule is a running maximum of times less
    D, so no packet waits for its predecessor's row. Sums and maxima run within blocks of a stream; what a block adds to
    those after it is a row of a small table.
    """
    cut = with_blocks(sent, stream, "send_order", blocks).repartition(stream, "block")
    inside = Window.partitionBy(stream, "block").orderBy("send_order")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(stream).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = (F.lit(CATCH_UP * 8e-3) * F.col("nbytes") / F.lit(target_gbps)).cast("long")
    cut = cut.withColumn("_own", own)
    sums = cut.groupBy(stream, "block").agg(F.sum("nbytes").alias("_bytes"), F.sum("_own").alias("_times"))
    sums = sums.select(stream, "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_bytes", "_times")))
    df = cut.join(sums, [stream, "block"])
    df = df.withColumn("_d", F.col("_times") + F.coalesce(F.sum("_own").over(before), F.lit(0))).withColumn("_sent", F.col("_bytes") + F.coalesce(F.sum("nbytes").over(before), F.lit(0)))
    total = (F.lit(8e-3) * F.col("_sent") / F.lit(target_gbps)).cast("long")
    df = df.withColumn("_slack", F.greatest(F.col("ready_us"), total) - F.col("_d"))
    most = df.groupBy(stream, "block").agg(F.max("_slack").alias("_slack")).select(stream, "block", F.max("_slack").over(earlier).alias("_most"))
    df = df.withColumn("_run", F.max("_slack").over(upto)).join(most, [stream, "block"])
    return df.select(*sent.columns, (F.col("_d") + F.greatest("_run", "_most")).alias("send_us"))
