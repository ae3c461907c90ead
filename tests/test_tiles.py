import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beamloom.config import Grid, StreamConfig
from beamloom.operators import assembly, codec, downsample, monitor, packets, tiles
from beamloom.operators.packets import END_OF_STREAM, build_payload
from beamloom.operators.ranges import ranged

GRID = Grid(nupfreq=2, nt_per_packet=8, counts_per_sample=384, nfreq_coarse=16, nt_per_chunk=64)


def random_tiles(seed, beams=(0, 3), channels=(0, 5), times=range(0, 40)):
    rng = np.random.default_rng(seed)
    return [(b, f, t, float(rng.uniform(0.5, 2)), float(rng.uniform(-3, 3)), bytes(np.clip(rng.integers(-25, 281, 16), 0, 255).astype(np.uint8))) for b in beams for f in channels for t in times if rng.random() < 0.8]


TILES = "beam_id int, coarse_freq_id int, tile long, scale double, offset double, data binary"


def rounded(rows):
    return collections.Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def test_matrix_and_binaries():
    rows = np.arange(60, dtype=np.uint8).reshape(10, 6)
    column = tiles.binaries(rows)
    assert column.to_pylist() == [bytes(r) for r in rows] and np.array_equal(tiles.matrix(column.slice(3, 4), 6), rows[3:7])
    assert tiles.matrix(pa.array([], pa.binary()), 6).shape == (0, 6)
    with pytest.raises(ValueError):
        tiles.matrix(pa.array([b"abc", b"ab"]), 3)


def test_encode_and_decode_are_those_of_samples(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(i % 3, 2, 16).tolist() if i % 7 else [0.0] * 16, rng.choice([0.1, 0.3, 0.9], 16).tolist() if i % 5 else [0.0] * 16) for i in range(60)]
    values = spark.createDataFrame(rows, "k int, intensity array<double>, weight array<double>").repartition(3)
    got = tiles.encode(values, GRID)
    long = values.select("k", F.arrays_zip("intensity", "weight").alias("z")).select("k", F.posexplode("z").alias("i", "z")).select("k", "i", "z.*")
    want = {(r.k, r.i): (r.byte, round(r.scale, 9), round(r.offset, 9)) for r in codec.encode(long, ["k"]).collect()}
    found = {(r.k, i): (b, round(r.scale, 9), round(r.offset, 9)) for r in got.collect() for i, b in enumerate(r.data)}
    assert found == want
    for r in tiles.decode(got, GRID, prescale=1.5).join(got.select("k", "scale", "offset", "data"), "k").collect():
        assert np.allclose(r.intensity, 1.5 * (r.scale * np.frombuffer(r.data, np.uint8) + r.offset), rtol=1e-5, atol=1e-5)
        assert r.weight == [0.0 if b in (0, 255) else 1.0 for b in r.data]


@pytest.mark.parametrize("step", [1 << 20, 50])
def test_pyramid_is_that_of_samples(spark, monkeypatch, step):
    monkeypatch.setattr(tiles, "STEP_SAMPLES", step)
    rows = random_tiles(1)
    df = spark.createDataFrame(rows, TILES).repartition(5)
    samples = tiles.samples(df, GRID)
    assert rounded(samples.collect()) == rounded((b, 2 * f + i // 8, 8 * t + i % 8, x, s, o) for b, f, t, s, o, d in rows for i, x in enumerate(d))
    columns = ["binning", "beam_id", "ifreq", "isample", "byte", "scale", "offset"]
    want = downsample.pyramid(samples, 3, nt_per_packet=8, nupfreq=2).select(columns)
    got = tiles.samples(tiles.pyramid(df, 3, GRID), GRID).select(columns)
    assert rounded(got.collect()) == rounded(want.collect())
    assert tiles.pyramid(df.limit(0), 2, GRID).collect() == []
    with pytest.raises(ValueError):
        tiles.pyramid(df, 1, Grid(nupfreq=2, nt_per_packet=1, counts_per_sample=384))


CONFIG = StreamConfig(beam_ids=(1, 2), grid=GRID)


def stream(seed=0):
    rng = np.random.default_rng(seed)
    raw, want = [], {}
    for k in range(60):
        beams, freqs = [(1, 2), (2, 1), (2, 9), (7, 8)][k % 4], rng.permutation(16)[:3].tolist()
        count = int(rng.integers(0, 30)) * 384 * 8
        data, scale, offset = rng.integers(0, 256, (2, 3, 2, 8)), rng.random((2, 3)).astype(np.float32), rng.random((2, 3)).astype(np.float32)
        version = 2 if k % 13 == 7 else 1
        body = build_payload(version, 384, count, beams, freqs, scale, offset, data)
        if k % 11 == 5:
            body = body[:-1]
        elif k % 17 == 4:
            body = build_payload(version, 384, count, beams, freqs, scale, offset, data[:, :, :1])
        elif k % 19 == 6:
            body = build_payload(version, 384, count, beams, [16, *freqs[1:]], scale, offset, data)
        elif version == 1:
            for i, b in enumerate(beams):
                for j, f in enumerate(freqs):
                    if b in (1, 2):
                        want[b, count // 384 // 64, f, count // 384 % 64 // 8] = (float(scale[i, j]), float(offset[i, j]), data[i, j].astype(np.uint8).tobytes())
        raw.append((k, body))
    return [*raw, (100, END_OF_STREAM), (101, b"short"), (102, b"")], want


def test_receive_path(spark):
    raw, want = stream()
    df = spark.createDataFrame(raw, "arrival_seq long, payload binary").repartition(4)
    got = packets.assembled(df, CONFIG).collect()
    assert {(r.beam_id, r.ichunk, r.coarse_freq_id, r.it_coarse): (r.scale, r.offset, bytes(r.data)) for r in got} == want and len(got) == len(want)
    assert all(r.tile == r.ichunk * 8 + r.it_coarse for r in got)
    kinds = collections.Counter(r.packet_class for r in packets.classify(packets.with_channels(packets.parse_headers(df)), CONFIG).collect())
    assert kinds["end_of_stream"] == 1 and set(kinds) == {"good", "bad", "stream_mismatch", "beam_id_mismatch", "end_of_stream"}
    strict = StreamConfig(beam_ids=(1, 2), grid=GRID, strict=True)
    with pytest.raises(Exception, match="mismatch"):
        packets.assembled(df, strict).collect()
    assert packets.assembled(df.limit(0), CONFIG).collect() == []


def test_end_of_stream(spark):
    raw, _ = stream()
    df = packets.classify(packets.with_channels(packets.parse_headers(spark.createDataFrame([*raw, (103, raw[0][1])], "arrival_seq long, payload binary"))), CONFIG)
    assert {r.arrival_seq for r in packets.until_end(df, CONFIG).collect()} == set(range(60))
    assert packets.until_end(df, StreamConfig(beam_ids=(1, 2), grid=GRID, accept_end_of_stream=False)).count() == 64
    sent = packets.with_end(spark.createDataFrame([(5, b"x")], "send_order long, payload binary"))
    assert sorted((r.send_order, bytes(r.payload)) for r in sent.collect()) == [(5, b"x"), *((i, END_OF_STREAM) for i in range(6, 11))]


def test_window_and_queue_paths():
    rng = random.Random(4)
    for _ in range(200):
        chunks = np.array([rng.choice([rng.randint(0, 9), rng.randint(0, 60), 10**9]) for _ in range(rng.randint(0, 300))], np.int64)
        active, want = 3, []
        for p in chunks.tolist():
            active += p >= active + 2
            want.append(active)
        at, last = assembly.window_path(chunks, 3)
        assert at.tolist() == want and last == (want[-1] if want else 3)


@pytest.mark.parametrize("rows", [1, 2])
def test_masks_through_the_pyramid(spark, rows):
    """Packed masks beside the data, bit by bit against plain pairs; decoding with them."""
    rng = random.Random(rows)
    made = {(b, t): [[rng.random() < 0.8 for _ in range(8)] for _ in range(rows)] for b in range(2) for t in range(21) if rng.random() < 0.8}
    table = [(b, 0, t, 2.0, 1.0, bytes(rng.choice([0, 255, *range(100, 120)]) for _ in range(16)), [x for row in keep for x in row]) for (b, t), keep in made.items()]
    df = tiles.with_mask(spark.createDataFrame(table, f"{TILES}, keep array<boolean>").repartition(3), "keep")
    bit = lambda b, row, at: (b, at // 8) in made and made[b, at // 8][row][at % 8]
    got = tiles.pyramid(df, 3, GRID).collect()
    assert {r.binning for r in got} == {2, 4, 8}
    for r in got:
        want = [all(bit(r.beam_id, row, (r.tile * 8 + i) * r.binning + k) for k in range(r.binning)) for row in range(rows) for i in range(8)]
        assert [bool(x) for x in np.unpackbits(np.frombuffer(bytes(r["mask"]), np.uint8), bitorder="little")] == want
    for r in tiles.decode(df, GRID, masked_by="mask").collect():
        data = next(x[5] for x in table if (x[0], x[2]) == (r.beam_id, r.tile))
        assert r.weight == [float(data[f * 8 + i] not in (0, 255) and made[r.beam_id, r.tile][f * rows // 2][i]) for f in range(2) for i in range(8)]
    plain = {(r.binning, r.beam_id, r.tile): (r.scale, r.offset, bytes(r.data)) for r in tiles.pyramid(df.drop("mask"), 3, GRID).collect()}
    assert {(r.binning, r.beam_id, r.tile): (r.scale, r.offset, bytes(r.data)) for r in got} == plain
    assert tiles.pyramid(df.limit(0), 2, GRID).collect() == [] and tiles.decode(df.limit(0), GRID, masked_by="mask").collect() == []


def walked(log, capacity):
    """order -> (size, dropped) of one queue, list by list."""
    size, out = 0, {}
    for order, put in sorted(log):
        dropped = put and size == capacity
        size = min(capacity, size + 1) if put else max(0, size - 1)
        out[order] = (size, dropped)
    return out


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_bounded_queue(spark, ranges):
    rng = random.Random(1)
    log = [(q, i * 3 + q, rng.random() < 0.6) for q in range(3) for i in range(400)] + [(9, 5, True), (10, 5, False)]
    df = spark.createDataFrame(log, "queue int, order long, put boolean").repartition(4)
    got = assembly.bounded_queue(df, 5, ranges).collect()
    assert len(got) == len(log)
    for q in {q for q, _, _ in log}:
        assert {r.order: (r.size, r.dropped) for r in got if r.queue == q} == walked([x[1:] for x in log if x[0] == q], 5)
    assert assembly.bounded_queue(df.limit(0), 5, ranges).collect() == []


def test_a_queue_is_many_tasks(spark):
    """One queue over many ranges and Arrow batches; no task reads more than a few ranges' share of its rows."""
    rng = random.Random(2)
    puts = [rng.random() < (0.8 if i // 3000 % 2 else 0.3) for i in range(30_000)]
    df = spark.createDataFrame(list(enumerate(puts)), "order long, put boolean").select(F.lit(4).alias("queue"), "order", "put")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        found = assembly.bounded_queue(df, 50, 12).persist()
        assert {r.order: (r.size, r.dropped) for r in found.collect()} == walked(list(enumerate(puts)), 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    steps = df.withColumns({"move": F.lit(1).cast("long"), "low": F.lit(0).cast("long"), "high": F.lit(50).cast("long")})
    rows, totals = ranged(steps, ["queue", "order"], assembly.clamp_prefixes("queue", ["order", "put"], 50, True), f"queue int, range int, order long, put boolean, {assembly.CLAMP}", 12)
    sizes = [r["count"] for r in rows.groupBy("range").count().collect()]
    assert len(sizes) == totals.count() == 12 and max(sizes) < 3 * 30_000 / 12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(-3, 3), st.integers(0, 4), st.integers(0, 4)), max_size=40), st.integers(0, 8))
def test_composed_clamps(steps, x):
    first = [k for k, s in enumerate(steps) if s[0] or k == 0]
    starts = np.array([max(f for f in first if f <= k) for k in range(len(steps))], int)
    low, high = (np.array([f(s[2], s[3]) for s in steps], np.int64) for f in (min, max))
    got = assembly.clamps(np.array([s[1] for s in steps], np.int64), low, high, starts)
    for k in range(len(steps)):
        want = x
        for i in range(starts[k], k + 1):
            want = min(high[i], max(low[i], want + steps[i][1]))
        assert min(got[2][k], max(got[1][k], x + got[0][k])) == want


def counter_packets(rng):
    """(rows, schema) of packet headers of all classes, some dropped by the receive queue."""
    rows = []
    for i in range(500):
        beams = rng.choice([[1, 2], [2, 1], [1, 9], [8, 9]])
        nup, chunk = rng.choice([2, 2, 2, 2, 3]), i // 20 + rng.choice([0, 0, 0, 1, -1, 40])
        data = 2 * 3 * nup * 8
        rows.append((i, 24 if i % 50 == 3 else 24 + 4 + 6 + 48 + data, rng.choice([1] * 9 + [2]), data, 384, max(0, chunk) * 64 * 384, 2, 3, nup, 8, beams, [0, 1, 2], rng.random() < 0.1))
    return rows, "arrival long, nbytes int, protocol_version long, data_nbytes int, fpga_counts_per_sample long, fpga_count long, nbeams int, nfreq_coarse int, nupfreq int, ntsamp int, beam_ids array<int>, coarse_freq_ids array<int>, dropped boolean"


def test_counters_against_a_loop(spark):
    rows, names = counter_packets(random.Random(2))
    config = StreamConfig(beam_ids=(1, 2), grid=GRID, nt_align=128, ring_capacity=3)
    got = monitor.stream_counters(spark.createDataFrame(rows, names).repartition(4), config, F.expr("n div 2")).first().asDict()
    want = collections.Counter({"count_bytes_received": sum(r[1] for r in rows), "count_packets_received": len(rows)})
    windows = {}
    for _, nbytes, version, _, _, count, _, _, nup, _, beams, _, dropped in rows:
        if dropped:
            want["count_packets_dropped"] += 1
        elif nbytes == 24:
            want["count_packets_endofstream"] += 1
        elif version != 1:
            want["count_packets_bad"] += 1
        elif nup != 2:
            want["count_stream_mismatch"] += 1
        else:
            want["count_packets_good"] += 1
            for b in beams:
                if b not in (1, 2):
                    want["count_beam_id_mismatch"] += 1
                    continue
                p = count // 384 // 64
                first, active = windows.get(b, (-(-p // 2) * 2, -(-p // 2) * 2))
                active += p >= active + 2
                windows[b] = first, active
                want["count_assembler_hits" if active <= p <= active + 1 else "count_assembler_misses"] += 1
    for first, active in windows.values():
        n = active + 2 - first
        want["count_assembler_queued"] += n
        want["count_assembler_drops"] += max(0, n - n // 2 - 3)
    assert got == {k: want[k] for k in got} and len(got) == 12
