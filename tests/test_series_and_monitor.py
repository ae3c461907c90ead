import random

import pytest
from pyspark.sql import functions as F

from beamloom.functions import scalars
from beamloom.operators import archive, monitor, packets, timeseries
from beamloom.operators.ranges import indexed
from beamloom.sources.intensity import acquisition, checked_intensity, read_intensity


def test_time_axis_with_gaps(spark):
    rng = random.Random(2)
    steps = [rng.choice([1, 1, 1, 5, 30]) for _ in range(60)]
    times, at = [], 0
    for s in steps:
        at += s
        times.append(("f", 1.328 + at * 1e-3 + rng.uniform(-4e-6, 4e-6)))
    df = spark.createDataFrame(times, "file string, t double")
    got = timeseries.time_axis(df, "file", "t").orderBy("it_file").collect()
    want = [sum(steps[1 : i + 1]) for i in range(60)]
    assert [r.it_logical for r in got] == want
    even = spark.createDataFrame([("f", float(x)) for x in (0, 1, 2, 4)], "file string, t double")
    assert timeseries.time_axis(even, "file", "t", strict=True).count() == 4
    odd = spark.createDataFrame([("f", float(x)) for x in (0, 1, 2.4)], "file string, t double")
    with pytest.raises(Exception, match="uneven"):
        timeseries.time_axis(odd, "file", "t", strict=True).collect()


def test_unpolarized_and_gaps_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(f, t, p, rng.uniform(-5, 5), rng.choice([0.0, 0.5, 1.0])) for f in range(3) for t in (0, 1, 2, 5, 9) for p in (0, 1)]
    df = spark.createDataFrame(rows, "freq int, t int, pol int, intensity double, weight double")
    got = {(r.freq, r.t): (r.intensity, r.weight) for r in timeseries.unpolarized(df, ["freq", "t"]).collect()}
    for f in range(3):
        for t in (0, 1, 2, 5, 9):
            own = [(x, w) for a, b, _, x, w in rows if (a, b) == (f, t)]
            w = sum(w for _, w in own)
            assert got[f, t] == pytest.approx((sum(x * w for x, w in own) / w if w else 0.0, w))
    axis = timeseries.time_axis(df, "freq", "t")
    dense = timeseries.fill_gaps(axis, df, "freq", "t", "weight")
    assert dense.count() == 30 and dense.filter("present").count() == 15
    assert timeseries.time_range(dense, 2, 4, "freq").count() == 12 and timeseries.time_range(dense, 6, 4, "freq").count() == 12
    with pytest.raises(ValueError):
        timeseries.time_range(dense, -1, 4, "freq")
    with pytest.raises(Exception, match="ends before"):
        timeseries.time_range(dense, 8, 4, "freq").collect()
    assert sorted(map(tuple, timeseries.gap_filled(df, "freq", "t", "weight").collect())) == sorted(map(tuple, dense.collect()))
    bad = df.withColumn("weight", F.col("weight") - 0.1)
    with pytest.raises(Exception, match="negative"):
        timeseries.check_weights(bad).collect()


def test_axes_appends_and_files(spark, tmp_path):
    axis = timeseries.frequency_axis(spark, 8, 800.0, 400.0)
    ok = timeseries.check_frequencies(axis).first()
    assert (ok.nfreq, ok.lo_mhz, ok.hi_mhz, ok.increasing, ok.even) == (8, 400.0, 800.0, False, True)
    bent = axis.withColumn("freq_hz", F.col("freq_hz") + F.when(F.col("ifreq") == 3, 1e4).otherwise(0))
    assert not timeseries.check_frequencies(bent).first().even
    for pols, sound in ((["XX"], True), (["XX", "YY"], True), (["XX", "XX"], False), (["XY"], False), ([], False)):
        assert timeseries.check_polarisations(spark.createDataFrame([(p,) for p in pols], "pol string")).first().sound is sound
    appends = spark.createDataFrame([("f", 0, 10, 5, 1.0), ("f", 1, 15, 5, 6.0), ("f", 2, 18, 5, 9.0), ("f", 3, 30, 5, 21.5)], "file string, seq int, ipos int, nt int, t0 double")
    assert [r.status for r in timeseries.check_appends(appends, "file", 1.0).orderBy("seq").collect()] == ["ok", "ok", "overlap", "drift"]
    acquisition(spark, nfreq=4, nt=50).write.parquet(f"{tmp_path}/a")
    df = read_intensity(spark, f"{tmp_path}/a")
    s = timeseries.file_summary(df.withColumn("one", F.lit(1)), "one", 4, 2, time="it_file").first()
    assert (s.wsum, s.frac_ungapped, s.frac_unmasked, s.all_zero) == (400.0, 1.0, 1.0, False)
    rolled = archive.roll_over(df, "file", F.col("it_file"), F.lit(7), 1.0, per_file=16, block=8)
    assert {r.file_name for r in rolled.select("file_name").distinct().collect()} == {"00000007.h5", "00000023.h5", "00000039.h5", "00000055.h5"}
    archive.write_rolled(rolled, f"{tmp_path}/r")
    archive.decompress(spark, f"{tmp_path}/r", f"{tmp_path}/plain")
    assert spark.read.parquet(f"{tmp_path}/plain").count() == 400


def test_blocks_hold_equal_shares_beside_an_outlier(spark):
    """One time far off, and a third of all rows at one time, leave no block over twice its share of the distinct times."""
    rng = random.Random(3)
    times = sorted(rng.sample(range(200_000), 20_000))
    rows = [("f", float(t)) for t in times] + [("f", 1e9)] + [("f", float(times[777]))] * 10_000 + [("g", 5.0)]
    df = spark.createDataFrame(rows, "file string, t double").repartition(6)
    cut = timeseries.with_blocks(df.distinct(), "file", "t", 64)
    sizes = {(r.file, r.block): r["count"] for r in cut.groupBy("file", "block").count().collect()}
    assert sum(sizes.values()) == 20_002 and max(sizes.values()) <= 2 * 20_001 / 64 and len({b for f, b in sizes if f == "f"}) >= 60
    order = cut.filter("file = 'f'").orderBy("t").select("block").collect()
    assert [r.block for r in order] == sorted(r.block for r in order)
    axis = {(r.file, r.time): (r.it_file, r.it_logical, r.dt) for r in timeseries.time_axis(df, "file", "t").collect()}
    dt = min(b - a for a, b in zip(times, times[1:]))
    assert axis == {("f", float(t)): (i, round((t - times[0]) / dt), dt) for i, t in enumerate([*times, 10**9])} | {("g", 5.0): (0, 0, None)}


@pytest.mark.parametrize("blocks", [1, 3, 64])
def test_appends_over_blocks(spark, blocks):
    rng, rows, at, want = random.Random(blocks), [], 100, {}
    for k in range(200):
        step = rng.choice([0, 0, 0, 7, -2])
        begin, n = at + step, rng.randint(1, 9)
        t0 = None if k and rng.random() < 0.3 else 5.0 + (begin - rows[0][2] if rows else 0) * 0.5 + (0.3 if rng.random() < 0.1 and k else 0.0)
        rows.append(("s", 3 * k, begin, n, t0))
        expected = 5.0 + (begin - rows[0][2]) * 0.5
        want[3 * k] = "overlap" if k and begin < at else "drift" if t0 is not None and abs(t0 - expected) > 0.005 else "ok"
        at = begin + n
    df = spark.createDataFrame([*rows, ("one", 0, 5, 2, 1.0)], "file string, seq int, ipos int, nt int, t0 double").repartition(3)
    got = timeseries.check_appends(df, "file", 0.5, blocks).collect()
    assert {r.seq: r.status for r in got if r.file == "s"} == want and [r.status for r in got if r.file == "one"] == ["ok"]
    assert all(r.t0 is not None for r in got)


def dealt_anew(spark, n, *columns):
    """(id, *columns) of n rows which every run deals to tasks anew, and no step uses what another has read: as several
    executors do when tasks end in another order or are run again."""

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rng.integers(0, 1 << 30, b.num_rows))], ["id", "at"])

    session = spark.newSession()
    session.conf.set("spark.sql.exchange.reuse", "false")
    return session.range(n).mapInArrow(deal, "id long, at long").repartition(8, "at").selectExpr("'s' AS name", "id", *columns)


def test_q42_appends_have_one_status_however_rows_are_dealt(spark):
    df = dealt_anew(spark, 400_000, "id AS seq", "id * 4 AS ipos", "if(id % 1000 = 999, 5, 4) AS nt", "id * 4 + if(id % 90 = 1, 0.5D, 0D) AS t0")
    got = {(r.status, r.wanted): r["count"] for r in timeseries.check_appends(df, "name", 1.0).withColumn("wanted", F.expr("if(id > 0 AND id % 1000 = 0, 'overlap', if(id % 90 = 1, 'drift', 'ok'))")).groupBy("status", "wanted").count().collect()}
    assert got and all(a == b for a, b in got), got


def test_q68_inferred_times_overlap_nowhere_however_rows_are_dealt(spark):
    df = dealt_anew(spark, 400_000, "id AS seq", "id * 3 AS ipos", "1 AS nt", "if(id % 10 = 0, id * 1.5D + if(id % 90 = 0 AND id > 0, 0.4D, 0D), NULL) AS t0")
    got = timeseries.check_appends(df, "name", 0.5).withColumn("wanted", F.expr("if(seq % 90 = 0 AND seq > 0, 'drift', 'ok')")).withColumn("late", F.col("t0") - F.col("seq") * 1.5)
    counts = {(r.status, r.wanted, round(r.late, 6)): r["count"] for r in got.groupBy("status", "wanted", F.round("late", 6).alias("late")).count().collect()}
    assert counts == {("ok", "ok", 0.0): 400_000 - 4_444, ("drift", "drift", 0.4): 4_444}


def test_q78_places_on_the_axis_however_rows_are_dealt(spark):
    n = 400_000
    data = dealt_anew(spark, n, "int(id % 2) AS ifreq", "if(id % 2 = 0, 'XX', 'YY') AS pol", "id * 0.5D AS time", "1D AS weight").withColumnRenamed("name", "file")
    freqs = data.sparkSession.createDataFrame([("s", 0, 8e8), ("s", 1, 6e8)], "file string, ifreq int, freq_hz double")
    got = checked_intensity(data, freqs).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("it_logical") != F.col("id")).alias("wrong"), F.max("it_logical").alias("last")).first()
    assert (got.n, got.wrong, got.last) == (n, 0, n - 1)


@pytest.mark.parametrize("blocks", [1, 5, 64])
def test_send_times_over_blocks(spark, blocks):
    rng = random.Random(blocks)
    ready, rows = 0, []
    for k in range(300):
        ready += rng.choice([0, 10, 500, 4000])
        rows.append((1, k, ready, rng.randint(300, 8000)))
    gbps, sent, total, now = 1e-2, {}, 0, 0
    for _, k, r, n in rows:
        now = max(r, int(8e-3 * total / gbps), now + int(0.8 * 8e-3 * before / gbps) if k else 0)
        sent[k], total, before = now, total + n, n
    df = spark.createDataFrame([*rows, (2, 0, 7, 100)], "stream int, send_order int, ready_us long, nbytes int").repartition(4)
    got = packets.send_times(df, "stream", gbps, blocks).collect()
    assert {r.send_order: r.send_us for r in got if r.stream == 1} == sent and [r.send_us for r in got if r.stream == 2] == [7]


def test_global_index_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.randrange(400) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    got = indexed(df, ["v", "i"], "at", 9)
    assert got.columns == ["v", "i", "at"]
    assert {r.i: r["at"] for r in got.collect()} == {i: k for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    files = [df.filter("v < 5"), df.filter("v = 400"), df.filter("v >= 390")]
    joined = timeseries.concat_files(files, ["v", "i"]).orderBy("it_global").collect()
    assert [r.it_global for r in joined] == list(range(len(joined)))
    assert [(r.file, r.v, r.i) for r in joined] == sorted((f, v, i) for i, v in enumerate(values) for f in (0, 2) if (v < 5 if f == 0 else v >= 390))


def test_asof_and_history(spark):
    rng = random.Random(1)
    history = sorted(rng.sample(range(1000), 40))
    probes = [rng.randint(-50, 1100) for _ in range(300)]
    h = spark.createDataFrame([(t, t * 2) for t in history], "t long, v long")
    p = spark.createDataFrame([(x,) for x in probes], "x long")
    got = sorted((r.x, r.t, r.v) for r in monitor.asof(p, h, "x", "t", "v").collect() if r.t is not None)
    last = lambda x: max((t for t in history if t <= x), default=None)
    assert got == sorted((x, last(x), 2 * last(x)) for x in probes if last(x) is not None)
    assert monitor.asof(p, h.limit(0), "x", "t", "v").filter("t is not null").count() == 0
    assert {r.t for r in monitor.bounded_history(h, "t", 3).collect()} == set(history[-3:])
    assert monitor.newest(h, "t").first().t == history[-1]
    snaps = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (2, "b", 4), (3, "a", 9)], "t int, sender string, total long")
    assert sorted((r.t, r.sender, r.delta) for r in monitor.rate_differences(snaps).collect()) == [(1, "a", 5), (2, "a", 4), (2, "b", 4), (3, "a", 0)]
    counted = monitor.event_counters(spark.createDataFrame([("good", 9), ("bad", 1)], "packet_class string, nbytes int"))
    assert monitor.statistics_map(counted).first().statistics["count_bytes_received"] == 10
    assert monitor.target_gbps(8496, 1024, 4, 16 * 384) == pytest.approx(1.10625)


def test_range_begins_with_the_period_that_contains_its_start(spark):
    rates = spark.createDataFrame([(10, "a", 1), (20, "a", 2), (20, "b", 4), (40, "b", 8), (50, "a", 16)], "start_us long, sender string, n long")
    got = lambda start, end: {(r.sender, r.n, r.period_us) for r in monitor.rates_in_range(rates, start, end, 10).collect()}
    assert got(25, 45) == {("a", 2, 20), ("b", 12, 20)}
    assert got(35, 39) == {("a", 2, 10), ("b", 4, 10)}  # the last entry before a gap
    assert got(20, 40) == {("a", 2, 20), ("b", 12, 20)}
    assert got(9, 45) == set()
    assert got(0, 15) == {("a", 16, 10)}


def test_archive_rules(spark):
    requests = spark.createDataFrame(
        [(1, 0, 7, "/a/x", 1, True, False), (2, 0, 7, "/a/x", 3, False, False), (3, 0, 7, "/a/y", 2, False, False), (4, 0, 8, "/q/z", 3, False, False)],
        "request_id int, beam_id int, ichunk int, filename string, priority int, need_rfi_mask boolean, has_rfi_mask boolean",
    ).withColumn("fpga_begin", F.col("ichunk") * 10)
    routed = archive.route(requests, ["/a", "/b"])
    assert {r.request_id: r.device_name for r in routed.collect()} == {1: "/a", 2: "/a", 3: "/a", 4: None}
    done = archive.deduplicate(routed.filter("device_name is not null"))
    assert {r.request_id: r.action for r in done.collect()} == {2: "write", 3: "link", 1: "skip"}
    assert [r.request_id for r in archive.write_order(requests).collect()] == [2, 4, 3, 1]
    assert archive.next_write(requests).first().request_id == 2
    for bad in ([], ["/a", "/ab"]):
        with pytest.raises(ValueError):
            archive.route(requests, bad)
    assert archive.unknown_beams(spark.createDataFrame([(0,), (9,)], "beam_id int"), requests).collect()[0].beam_id == 9


# Texts of the cast table.
INT_OK = {"0": 0, "-0": 0, "12": 12, "-123": -123, " \t 1234  \n\t": 1234}
INT_BAD = ["", "  ", "oops", " oops ", "1234abc", "1234 abc", "0.1", "99999999999", "- 1", "1\x00"]
REAL_OK = {"1.23": 1.23, "-1.23e-5": -1.23e-5, "-5": -5.0, ".23": 0.23, "-.034e3": -34.0, "  0.03e20  ": 0.03e20}
REAL_BAD = ["", "  ", "oops", " oops ", "5x", "-1.3e20x", "5d", "inf", "nan", "1e400", "."]


def test_lexical_cast(spark):
    def cast(texts, kind):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        return {r.t: r.v for r in df.select("t", scalars.lexical_cast("t", kind).alias("v")).collect()}

    assert cast(INT_OK, "int") == INT_OK and cast(INT_OK, "bigint") == INT_OK
    assert set(cast(INT_BAD, "int").values()) == {None}
    assert cast(["0", "65535", "-1", "65536"], "uint16") == {"0": 0, "65535": 65535, "-1": None, "65536": None}
    assert cast(REAL_OK, "double") == REAL_OK and set(cast(REAL_BAD, "double").values()) == {None}
    assert cast(["t", "TRUE", "F", "False", "False2", " t", "y", "1"], "boolean") == {"t": True, "TRUE": True, "F": False, "False": False, "False2": None, " t": None, "y": None, "1": None}


def test_scalars(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 64, 65, 1 << 40)], "n long")
    got = [(r.a, r.b, r.c) for r in df.select(scalars.is_power_of_two("n").alias("a"), scalars.round_down_to_power_of_two("n").alias("b"), scalars.ceil_div("n", 4).alias("c")).collect()]
    assert got == [(True, 1, 1), (True, 2, 1), (False, 2, 1), (True, 64, 16), (False, 64, 17), (True, 1 << 40, 1 << 38)]
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(scalars.is_power_of_two("id")).collect()
    one = spark.range(1).select(
        scalars.sender_name(scalars.sender_key(F.lit(0xC0A80102), F.lit(6677))).alias("name"), scalars.sanitize(F.lit("/a-b/c")).alias("flat"), scalars.clamp(F.lit(300), 0, 255).alias("clamped"),
        scalars.filename("b(BEAM)_(CHUNK)_(STREAM)(BINNING)(FPGA0)(FPGAN)", *[F.lit(x) for x in (1, 123456, 7, 2, 4, 10, 20)]).alias("file"), scalars.compressed_bound(F.lit(8192 + 19)).alias("bound"),
        scalars.chunk_time(F.lit(400), F.lit(10**9)).alias("t"), scalars.array_text(F.array(F.lit(1), F.lit(2))).alias("list"), scalars.product(F.array(F.lit(2.0), F.lit(4.0))).alias("p"), scalars.total(F.array(F.lit(2.0), F.lit(4.0))).alias("s"),
        scalars.json_integer(F.lit('{"frame0_nano": 12}'), "frame0_nano").alias("j"), scalars.json_integer(F.lit('{"frame0_nano": "x"}'), "frame0_nano").alias("j2"),
    ).first()
    assert one.name == "192.168.1.2:6677" and one.flat == "_a_b_c" and one.clamped == 255
    assert one.file == "b123456_00000007_10400000000001000000020"
    assert one.bound == 8192 + 8192 // 255 + 16 + 4 + 16 + 16 // 255 + 16 + 4 + 3
    assert one.t == pytest.approx(1 + 400 * 2.56e-6) and (one.list, one.p, one.s, one.j, one.j2) == ("[1 2]", 8.0, 6.0, 12, None)
