import socket
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from beamloom.config import Grid, StreamConfig
from beamloom.operators import packets as pk
from beamloom.sources import chunk_files as cf
from beamloom.sources import chunk_source as cs
from beamloom.sources import udp


@pytest.mark.parametrize("n", [0, 1, 7, 8, 64, 8191, 8192, 8200, 20001])
def test_bitshuffle(n):
    data = np.random.default_rng(n).integers(0, 40, n, dtype=np.uint8).tobytes()
    packed = cf.bitshuffle_compress(data)
    assert cf.bitshuffle_decompress(packed, n) == data
    from_bits = [[(data[i] >> k) & 1 for i in range(8)] for k in range(8)] if n >= 8 else []
    if n >= 8:
        assert cf.bit_transpose(data[:8]) == bytes(sum(b << i for i, b in enumerate(row)) for row in from_bits)


def chunk(seed, mask=False):
    rng = np.random.default_rng(seed)
    c = dict(beam_id=seed, nupfreq=2, nt_per_packet=16, counts_per_sample=400, nt_coarse=4, nscales=8, ndata=512, fpga_begin=400 * seed << 33, fpga_n=25600, binning=1)
    c |= dict(scales=rng.random(8).astype("<f4").tobytes(), offsets=rng.random(8).astype("<f4").tobytes(), data=rng.integers(0, 3 if seed % 2 else 256, 512, dtype=np.uint8).tobytes())
    return c | dict(frame0_nano=-5 + seed, nrfifreq=2 if mask else 0, has_rfi_mask=mask, rfi_mask=b"\xaa" * 16 if mask else b"")


def test_chunk_files(spark, tmp_path):
    chunks = [chunk(s, s == 2) for s in range(5)]
    for c in chunks:
        for compress in (False, True):
            back = cf.unpack_chunk(cf.pack_chunk(c, compress))
            assert {k: back[k] for k in c} == c
    for i, c in enumerate(chunks):
        (tmp_path / f"c{i}.msg").write_bytes(cf.pack_chunk(c, i % 2 == 0))
    old = cf._pack([*[cf.TITLE, 1, 0, 512], *[chunks[0][k] for k in cf.FIELDS[4:17]]])
    (tmp_path / "old.msg").write_bytes(old)
    got = cf.read_chunk_files(spark, str(tmp_path)).collect()
    assert len(got) == 6 and sorted(bytes(r.data) for r in got) == sorted([c["data"] for c in chunks] + [chunks[0]["data"]])
    cf.write_chunk_table(spark.createDataFrame(got, cf.CHUNK), f"{tmp_path}/out", compress=True)
    again = cf.parse_payloads(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    with pytest.raises(ValueError):
        cf.pack_chunk(chunk(1) | {"nrfifreq": 4})
    for bad in (old[:200], cf._pack(["x", 2]), cf._pack([cf.TITLE, 3])):
        with pytest.raises((ValueError, IndexError)):
            cf.unpack_chunk(bad)


def payload(rng, beams=(1, 2), freqs=(5, 1000), nup=2, nt=16, fcps=384, **change):
    data = rng.integers(0, 256, (len(beams), len(freqs), nup, nt))
    scales = rng.random((len(beams), len(freqs)))
    return pk.build_payload(change.get("version", 1), fcps, change.get("count", fcps * nt * 3), beams, freqs, scales, -scales, data)


def test_parse_classify_and_split(spark):
    rng = np.random.default_rng(1)
    good = payload(rng)
    cases = [
        (good, "good"), (pk.END_OF_STREAM, "end_of_stream"), (good[:-1], "bad"), (b"", "bad"), (good[:23], "bad"), (good[:40], "bad"), (payload(rng, version=2), "bad"),
        (payload(rng, freqs=(5, 1024)), "bad"), (payload(rng, count=384 * 16 * 3 + 1), "bad"), (payload(rng, nt=12, count=0), "bad"), (payload(rng, fcps=0), "bad"),
        (payload(rng, nup=4), "stream_mismatch"), (payload(rng, beams=(1, 2, 3)), "stream_mismatch"), (payload(rng, beams=(1, 7)), "beam_id_mismatch"), (payload(rng, count=1 << 63), "bad"),
    ]
    raw = spark.createDataFrame([(i, bytearray(p)) for i, (p, _) in enumerate(cases)], "arrival_seq long, payload binary")
    config = StreamConfig((1, 2), Grid(nupfreq=2, nt_per_packet=16, counts_per_sample=384))
    parsed = pk.parse(raw)
    got = {r.arrival_seq: r.packet_class for r in pk.classify(parsed, config).collect()}
    assert got == {i: c for i, (_, c) in enumerate(cases)}
    fields = ["protocol_version", "data_nbytes", "fpga_counts_per_sample", "fpga_count", "nbeams", "nfreq_coarse", "nupfreq", "ntsamp", "nbytes"]
    native = {r.arrival_seq: [r[f] for f in fields] for r in pk.parse_headers(raw).collect()}
    assert native == {r.arrival_seq: [r[f] for f in fields] for r in parsed.collect()}
    tiles = pk.split_channels(pk.split_beams(pk.classify(parsed, config).filter("packet_class = 'good'"))).collect()
    data = np.frombuffer(good[-128:], np.uint8).reshape(2, 2, 32)
    assert {(r.beam_id, r.coarse_freq_id): bytes(r.data) for r in tiles} == {(b, f): data[i, j].tobytes() for i, b in enumerate((1, 2)) for j, f in enumerate((5, 1000))}
    strict = StreamConfig((1, 2), Grid(nupfreq=2, nt_per_packet=16, counts_per_sample=384), strict=True)
    with pytest.raises(Exception, match="stream_mismatch|beam_id_mismatch"):
        pk.classify(parsed, strict).collect()
    placed = pk.place_tiles(spark.createDataFrame([(2, 1, 5, 384 * 16 * 65, 384, 2, 16, 1.0, 0.0, b"b"), (1, 1, 5, 384 * 16 * 65, 384, 2, 16, 2.0, 0.0, b"a")],
        "arrival_seq long, beam_id int, coarse_freq_id int, fpga_count long, fpga_counts_per_sample int, nupfreq int, ntsamp int, scale double, offset double, data binary")).collect()
    assert [(r.ichunk, r.it_coarse, r.scale) for r in placed] == [(1, 1, 1.0)]


def test_udp_source(spark, tmp_path):
    spark.dataSource.register(udp.UdpPackets)
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    log, stop = udp.PacketLog(f"file:{tmp_path}/log"), threading.Event()
    worker = threading.Thread(target=udp.receive, args=(probe, log, stop))
    worker.start()
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for i in range(20):
        out.sendto(bytes([i]) * 30, ("127.0.0.1", port))
    deadline = time.monotonic() + 20
    while udp.PacketLog(f"file:{tmp_path}/log").next < 20 and time.monotonic() < deadline:
        time.sleep(0.1)
    stop.set()
    worker.join()
    stream = spark.readStream.format("udp_packets").option("folder", f"file:{tmp_path}/log").load()
    query = stream.writeStream.format("memory").queryName("udp_rows").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("udp_rows").orderBy("arrival_seq").collect()
    assert [r.arrival_seq for r in rows] == list(range(20)) and sorted(bytes(r.payload)[0] for r in rows) == list(range(20))
    assert {r.sender_ip for r in rows} == {udp.ip_number("127.0.0.1")}


def packets_from(a, n):
    return [(10**6 + i, udp.ip_number("10.0.0.1"), 5, bytes([i % 256]) * 20) for i in range(a, a + n)]


def test_the_log_stays_bounded_and_loses_nothing(spark, tmp_path):
    """Batches of limited size, restarts in between; the folder holds only what is still to be read."""
    spark.dataSource.register(udp.UdpPackets)
    folder, want, seen = f"file:{tmp_path}/log", [], []
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1000")
    for turn in range(3):
        log = udp.PacketLog(folder)
        for _ in range(34):  # parts of 5 rows
            log.append(packets_from(len(want), 5))
            want += range(len(want), len(want) + 5)
        stream = spark.readStream.format("udp_packets").option("folder", folder).option("maxRowsPerTrigger", 17).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
            seen += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        finally:
            query.stop()
        held = [f for f in (tmp_path / "log").iterdir()]
        assert len(held) <= 4 + 2 + 4 and sum(n for _, n in udp.PacketLog(folder).parts()) <= 17 + 5  # the last batch is committed with the next one
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.arrival_seq for r in rows) == want and max(seen) <= 17 and len(seen) >= 30
    assert all(bytes(r.payload) == bytes([r.arrival_seq % 256]) * 20 for r in rows)


def test_lists_are_dropped_and_counted_when_too_many_rows_wait(tmp_path):
    log = udp.PacketLog(f"file:{tmp_path}/log", capacity=12)
    for k in range(4):
        log.append(packets_from(5 * k, 5))
    assert log.parts() == [(0, 5), (5, 5)] and log.mark("dropped") == 10 and log.next == 10
    log.trim(7)
    assert log.parts() == [(5, 5)] and log.mark("trimmed") == 5
    log.append(packets_from(50, 5))
    again = udp.PacketLog(f"file:{tmp_path}/log", capacity=12)
    assert again.parts() == [(5, 5), (10, 5)] and again.next == 15 and again.mark("dropped") == 10
    again.trim(15)
    assert again.parts() == [] and udp.PacketLog(f"file:{tmp_path}/log").next == 15
    with pytest.raises(ValueError):
        udp.PacketLog(f"{tmp_path}/log")


def test_reading_takes_only_the_arrays_that_are_asked_for(spark, tmp_path, monkeypatch):
    sizes = {}
    for i in range(12):
        c = chunk(i % 4) | {"fpga_begin": 25600 * i, "data": np.random.default_rng(i).integers(0, 256, 40_000, dtype=np.uint8).tobytes(), "ndata": 40_000}
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub" / f"c{i}.msg").write_bytes(cf.pack_chunk(c))
        sizes[i] = (tmp_path / "sub" / f"c{i}.msg").stat().st_size
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.msg").write_bytes(b"no chunk")
    read = []
    monkeypatch.setattr(cs, "fetched", lambda file, size, at: read.append(size) or file.read_at(size, at))

    def taken(filters=(), **options):
        reader = cs.FilteringReader({"path": f"file:{tmp_path}", **options})
        left = list(reader.pushFilters(list(filters)))
        read.clear()
        found = [b for p in reader.partitions() for batch in reader.read(p) for b in zip(batch.column("beam_id").to_pylist(), batch.column("fpga_begin").to_pylist())]
        return found, sum(read), left

    every, total, _ = taken()
    assert len(every) == 12 and total == sum(sizes.values())
    for kind in ({"beams": "2"}, {"filters": [EqualTo(("beam_id",), 2), EqualTo(("data",), b"")]}):
        found, size, left = taken(**kind)
        assert sorted(found) == [(2, 25600 * i) for i in (2, 6, 10)] and len(left) == len(kind.get("filters", [0])) - 1
        assert size == sum(sizes[i] for i in (2, 6, 10)) + 9 * cf.HEAD_BYTES
    found, _, _ = taken(fpga=f"{25600 * 3 + 1},{25600 * 5}")
    assert sorted(found) == [(0, 25600 * 4), (3, 25600 * 3)]
    assert {(r.beam_id, r.fpga_begin) for r in cf.read_chunk_files(spark, str(tmp_path), beams=[1], fpga=(0, 25600 * 6)).collect()} == {(1, 25600), (1, 25600 * 5)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = cf.read_chunk_files(spark, str(tmp_path)).filter("beam_id = 3 AND fpga_begin > 100000")
        assert {r.fpga_begin for r in pushed.collect()} == {25600 * 7, 25600 * 11}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = [(f"/a/c{i}.msg", cf.pack_chunk(chunk(i)), i) for i in range(40)]
    df = spark.createDataFrame(rows, "filename string, payload binary, k int").repartition(6)
    broken = df.withColumn("payload", F.when(F.col("k") == 33, F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="no"):
        cf.write_chunk_files(broken, str(tmp_path / "out"))
    # tasks that were still running when the job was given up may leave files below _temporary, which no reader takes
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file() and not any(part.startswith("_temporary") for part in p.parts)]
    assert left == [] and (not (tmp_path / "out").exists() or cf.read_chunk_files(spark, str(tmp_path / "out")).collect() == [])
    done = cf.write_chunk_files(df, str(tmp_path / "out"))
    assert {(r.k, r.status) for r in done.collect()} == {(i, "SUCCEEDED") for i in range(40)}
    assert sorted(p.name for p in (tmp_path / "out" / "a").iterdir()) == sorted(f"c{i}.msg" for i in range(40))
    other = df.withColumn("payload", F.when(F.col("k") < 3, F.lit(b"x")).otherwise(F.col("payload")))
    assert {r.k for r in cf.write_chunk_files(other, str(tmp_path / "out")).filter("status = 'FAILED'").collect()} == {0, 1, 2}
    assert (tmp_path / "out" / "a" / "c0.msg").read_bytes() == rows[0][1]
    assert cf.write_chunk_files(df.limit(0), str(tmp_path / "out")).collect() == []
