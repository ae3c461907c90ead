import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.config import Grid, StreamConfig
from beamloom.operators import assembly, packets, ring, tiles
from beamloom.operators.packets import END_OF_STREAM, build_payload
from beamloom.streaming import chunks, streams

GRID = Grid(nupfreq=2, nt_per_packet=4, counts_per_sample=384, nfreq_coarse=3, nt_per_chunk=16)
RAW = "arrival_seq long, payload binary"
PUT = "arrival_seq long, beam_id int, ichunk long, coarse_freq_id int, it_coarse int, scale double, offset double, data binary"


def payloads(seed, count=260, beams=(1, 4), lost=0.2):
    """(arrival_seq, payload): some lost, some late, early, twice or from far ahead, some bad; the end comes twice."""
    rng, out = random.Random(seed), []
    r = np.random.default_rng(seed)
    for k in range(count):
        if rng.random() < lost:
            continue
        slot = max(0, k // 3 + rng.choice([0] * 12 + [1, 3, -2, -9, 30, 400]))
        freqs = rng.choice([[0], [1, 2], [2], [0, 1, 2]])
        shape = (len(beams), len(freqs))
        payload = build_payload(1, 384, slot * 4 * 384, beams, freqs, r.uniform(1, 2, shape), r.uniform(-1, 1, shape), r.integers(0, 256, (*shape, 2, 4)))
        if rng.random() < 0.05:
            payload = payload[:-1] if rng.random() < 0.5 else b"\x02" + payload[1:]
        out.append((k, payload))
    return [*out, (count, END_OF_STREAM), (count + 1, END_OF_STREAM), (count + 2, out[-1][1])]


def plain_chunks(rows, config):
    """Packet by packet: (beam, ichunk, channel, coarse time) -> (scale, offset, data) or nothing, of each flushed chunk."""
    windows, out, g = {}, {}, config.grid

    def flush(beam):
        ichunk, held, after = windows[beam]
        assert (beam, ichunk) not in {key[:2] for key in out}
        for f in range(g.nfreq_coarse):
            for t in range(g.nt_coarse):
                out[beam, ichunk, f, t] = held.get((f, t))
        windows[beam] = [ichunk + 1, after, {}]

    for _, payload in sorted(rows, key=lambda r: r[0]):
        if payload == END_OF_STREAM:
            break
        if isinstance(payload, tuple):  # a chunk put in whole
            beam, ichunk, held = payload
            windows[beam] = [ichunk, held, {}]
            flush(beam)
            windows[beam] = [ichunk + 1, {}, {}]
            continue
        h = np.frombuffer(payload[:24], packets.HEADER, 1)[0]
        b, f = int(h["nbeams"]), int(h["nfreq_coarse"])
        if h["protocol_version"] != 1 or len(payload) != 24 + 2 * b + 2 * f + 8 * b * f + b * f * 8:
            continue
        beams, freqs = np.frombuffer(payload, "<u2", b, 24).tolist(), np.frombuffer(payload, "<u2", f, 24 + 2 * b).tolist()
        floats = np.frombuffer(payload, "<f4", 2 * b * f, 24 + 2 * b + 2 * f).reshape(2, b, f).astype(float)
        data = payload[24 + 2 * b + 2 * f + 8 * b * f :]
        sample = int(h["fpga_count"]) // 384
        chunk, t = sample // g.nt_per_chunk, sample % g.nt_per_chunk // g.nt_per_packet
        for i, beam in enumerate(beams):
            align = config.nt_align // g.nt_per_chunk
            if beam not in windows:
                windows[beam] = [-(-chunk // align) * align if align else chunk, {}, {}]
            if chunk >= windows[beam][0] + 2:
                flush(beam)
            if chunk - windows[beam][0] in (0, 1):
                for j, freq in enumerate(freqs):
                    at = (i * f + j) * 8
                    windows[beam][1 + chunk - windows[beam][0]][freq, t] = (floats[0, i, j], floats[1, i, j], data[at : at + 8])
    for beam in list(windows):
        flush(beam), flush(beam)
    return out


def as_plain(rows):
    out = {}
    for r in rows:
        value = (r.scale, r.offset, bytes(r.data))
        assert r.present or value == (0.0, 0.0, bytes(8))
        key = (r.beam_id, r.ichunk, r.coarse_freq_id, r.it_coarse)
        assert key not in out
        out[key] = value if r.present else None
    return out


@pytest.mark.parametrize("align, ranges", [(0, None), (48, 6)])
def test_strict_receive_path(spark, align, ranges):
    config = StreamConfig(beam_ids=(1, 4), grid=GRID, nt_align=align)
    rows = payloads(3)
    raw = spark.createDataFrame(rows, RAW).repartition(3)
    got = packets.assembled_strict(raw, config, ranges)
    assert as_plain(got.collect()) == plain_chunks(rows, config)
    assert packets.assembled_strict(raw.limit(0), config).collect() == []
    last = packets.assembled_strict(spark.createDataFrame(rows[:-3], RAW), config)  # a stream without an end
    assert as_plain(last.collect()) == plain_chunks(rows[:-3], config)


def run(stream, folder, mode="parquet"):
    query = stream.writeStream.format(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)


def test_streamed_chunks_equal_the_batch_path_across_a_restart(spark, tmp_path):
    streams.use_state_store(spark)
    config = StreamConfig(beam_ids=(1, 4), grid=GRID, nt_align=16)
    rows = payloads(5)
    cut = [rows[:70], rows[70:90], rows[90:200], rows[200:]]
    write = lambda part: spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for parts in (cut[:2], cut[2:]):  # the query ends in between and goes on from its checkpoint
        for part in parts:
            write(part)
            time.sleep(0.05)
        run(chunks.chunk_tile_stream(read(), config), tmp_path)
    got = as_plain(spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == plain_chunks(rows, config)
    whole = spark.createDataFrame(rows, RAW)
    assert got == as_plain(packets.assembled_strict(whole, config).collect())
    flushed = spark.read.parquet(f"{tmp_path}/out").select("beam_id", "ichunk").distinct()
    assert {(r.beam_id, r.ichunk) for r in assembly.dense_chunks(flushed).collect()} == {(r.beam_id, r.ichunk) for r in flushed.collect()}  # no chunk is left out
    write([(9999, rows[0][1])])
    before = len(got)
    run(chunks.chunk_tile_stream(read(), config), tmp_path)  # after the end, packets are not read
    assert spark.read.parquet(f"{tmp_path}/out").count() == before
    last = spark.read.format("statestore").option("stateVarName", "strips").load(f"{tmp_path}/cp")
    assert last.count() == 0


def test_chunks_put_into_a_stream(spark, tmp_path):
    """Chunks that come whole go out, and the window goes on behind them; also the first of a beam."""
    streams.use_state_store(spark)
    config, rng = StreamConfig(beam_ids=(1, 4), grid=GRID), random.Random(9)
    rows = [(2 * seq, p) for seq, p in payloads(9, 150)]
    puts = [(2 * at + 1, (beam, ichunk, {(f, t): (1.5, float(at), bytes(rng.randrange(256) for _ in range(8))) for f in range(3) for t in range(4)})) for at, beam, ichunk in ((40, 1, 9), (41, 1, 12), (80, 4, 30), (110, 1, 50))]
    for part, (a, b) in enumerate(((0, 81), (81, 163), (163, 10**6))):
        spark.createDataFrame([r for r in rows if a <= r[0] < b], RAW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        whole = [(seq, beam, c, f, t, *v) for seq, (beam, c, held) in puts if a <= seq < b for (f, t), v in held.items()]
        spark.createDataFrame(whole, PUT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/put")
        read = lambda schema, name: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        run(chunks.chunk_tile_stream(read(RAW, "in"), config, injected=read(PUT, "put")), tmp_path)  # a batch a part
    got = as_plain(spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == plain_chunks([*rows, *puts], config)
    assert all(got[beam, c, f, t] == v for _, (beam, c, held) in puts for (f, t), v in held.items())


def test_starting_twice_is_starting_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    writer = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp")
    first = streams.started(writer(), "once")
    try:
        assert streams.started(writer(), "once").id == first.id and first.isActive
    finally:
        first.stop()
    again = streams.started(writer(), "once")
    assert again.runId != first.runId
    again.stop()


def test_a_quiet_beam_is_flushed(spark, tmp_path):
    streams.use_state_store(spark)
    config = StreamConfig(beam_ids=(1, 4), grid=GRID)
    rows = [r for r in payloads(6, 30) if r[1] != END_OF_STREAM][:20]
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = chunks.chunk_tile_stream(spark.readStream.schema(RAW).parquet(f"{tmp_path}/in"), config, idle_ms=500)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(processingTime="1 second").start()
    want, began = plain_chunks(rows, config), time.time()
    try:
        while time.time() - began < 90:
            time.sleep(2)
            if query.recentProgress and spark.read.schema(packets.CHUNK_TILES).parquet(f"{tmp_path}/out").count() >= len(want):
                break
    finally:
        query.stop()
    assert as_plain(spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_history_with_data(spark, tmp_path):
    """The strips in state are those of the pyramid at the places that the closed form names."""
    streams.use_state_store(spark)
    capacities, n, rng = (2, 3, 2), 21, np.random.default_rng(4)
    rows = []
    for beam, first in ((1, 6), (4, 4)):
        for c in range(first, first + n):
            for f in range(2):
                for t in range(GRID.nt_coarse):
                    there = rng.random() < 0.9
                    rows.append((beam, c, f, t, float(rng.uniform(1, 2)) if there else 0.0, float(rng.uniform(-1, 1)) if there else 0.0, rng.integers(0, 256, 8, dtype=np.uint8).tobytes() if there else bytes(8), bool(there)))
    df = spark.createDataFrame(rows, packets.CHUNK_TILES)
    for a, b in ((0, 9), (9, 11), (11, 40)):
        df.filter((F.col("ichunk") >= a) & (F.col("ichunk") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
        run(chunks.history_stream(spark.readStream.schema(packets.CHUNK_TILES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), GRID, capacities), tmp_path)
    beams = spark.createDataFrame([(1, 6, n), (4, 4, n)], "beam_id int, first_ichunk long, n long")
    places = {(r.beam_id, r.level, r.ichunk, r.binning) for r in ring.contents(beams, capacities).collect()}
    found = chunks.history(spark, f"{tmp_path}/cp", GRID)
    assert {(r.beam_id, r.level, r.ichunk, r.binning) for r in found.collect()} == places
    placed = tiles.with_tile(df.filter("present").drop("present"), GRID)
    want = {(r.beam_id, r.coarse_freq_id, r.binning, r.tile): (r.scale, r.offset, bytes(r.data)) for r in tiles.pyramid(placed, 2, GRID).collect()}
    want |= {(r.beam_id, r.coarse_freq_id, 1, r.tile): (r.scale, r.offset, bytes(r.data)) for r in placed.collect()}
    seen = 0
    for r in found.collect():
        if r.present:
            key = (r.beam_id, r.coarse_freq_id, r.binning, r.ichunk * GRID.nt_coarse // r.binning + r.it_coarse)
            assert want[key] == (pytest.approx(r.scale), pytest.approx(r.offset), bytes(r.data))
            seen += 1
    assert seen > 50
    gone = {(r.beam_id, r.ichunk, r.binning) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert gone == {(b, first + 4 * j, 4) for b, first in ((1, 6), (4, 4)) for j in range(16) if first + 4 * j < min(i for x, lv, i, _ in places if x == b and lv == 2)}
