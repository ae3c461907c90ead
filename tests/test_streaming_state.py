import random
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from beamloom.config import Grid, StreamConfig
from beamloom.operators import monitor
from beamloom.streaming import state, streams
from test_tiles import counter_packets


def in_parts(spark, rows, schema, cuts, folder):
    """A stream of rows, a file for each part."""
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)


def test_rate_history_in_state(spark, tmp_path):
    """What the state holds are the rates of a stream's newest periods; it answers as-of questions; the rest has been given out."""
    streams.use_state_store(spark)
    config = StreamConfig(beam_ids=(1,), packet_count_period_usec=1000, max_packet_history=7)
    rng, schema = random.Random(1), "stream long, sender long, us long"
    rows = [(s, rng.randrange(3), k * 90 + rng.choice([0, 0, 40, -900, -5000])) for k in range(300) for s in (5, 6)]
    rows = [r for r in rows if r[2] >= 0]
    stream = in_parts(spark, rows, schema, [100, 110, 333], f"{tmp_path}/in")
    run(state.rate_history_stream(stream, config), tmp_path)
    table = spark.createDataFrame(rows, schema)
    held = state.rate_history_state(spark, f"{tmp_path}/cp")
    for s in (5, 6):
        want = {tuple(r) for r in monitor.rate_history(table.filter(F.col("stream") == s), "us", config).collect()}
        assert {(r.start_us, r.sender, r.n) for r in held.filter(F.col("stream") == s).collect()} == want
        newest = sorted({w[0] for w in want})
        totals = held.filter(F.col("stream") == s).groupBy("start_us").agg(F.sum("n").alias("n"))
        probe = spark.createDataFrame([(newest[3] + 1,), (newest[0] - 1,)], "at long")
        assert {(r["at"], r.start_us) for r in monitor.asof(probe, totals, "at", "start_us", "n").collect()} == {(newest[3] + 1, newest[3]), (newest[0] - 1, None)}
    gone = spark.read.parquet(f"{tmp_path}/out").groupBy("stream").agg(F.count_distinct("start_us").alias("n")).collect()
    assert {r.stream for r in gone} == {5, 6} and all(r.n > 10 for r in gone)


def test_requests_wait_for_their_masks(spark, tmp_path):
    streams.use_state_store(spark)
    rng, asked, filled, want, waiting, have = random.Random(2), [], [], [], {}, set()
    for seq in range(400):
        chunk = (rng.randrange(2), 100 * rng.randrange(60))
        if rng.random() < 0.3:
            filled.append((seq, *chunk))
            if chunk not in have:
                have.add(chunk)
                want += [(*chunk, r, f"c{r}", r % 4, "QUEUED", seq) for r in waiting.pop(chunk, [])]
        else:
            need = rng.random() < 0.7
            asked.append((seq, *chunk, seq, f"c{seq}", seq % 4, need))
            late = need and chunk not in have
            want.append((*chunk, seq, f"c{seq}", seq % 4, "AWAITING_RFI" if late else "QUEUED", seq))
            if late:
                waiting.setdefault(chunk, []).append(seq)
    cut = lambda rows: [sum(r[0] < at for r in rows) for at in (90, 200, 210)]
    requests = in_parts(spark, asked, "seq long, beam_id int, fpga_begin long, request_id long, filename string, priority int, need_rfi_mask boolean", cut(asked), f"{tmp_path}/r")
    masks = in_parts(spark, filled, "seq long, beam_id int, fpga_begin long", cut(filled), f"{tmp_path}/m")
    run(state.write_request_stream(requests, masks), tmp_path)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want) and {r[5] for r in got} == {"AWAITING_RFI", "QUEUED"}
    left = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/cp")
    assert {r[0] for r in left.select("user_map_key.request_id").collect()} == {r for rs in waiting.values() for r in rs}


def test_counters_are_observed_in_the_pass(spark, tmp_path):
    """A batch's and a stream's counters, taken while the packets go elsewhere, are those of stream_counters."""
    rows, schema = counter_packets(random.Random(2))
    config = StreamConfig(beam_ids=(1, 2), grid=Grid(nupfreq=2, nt_per_packet=8, counts_per_sample=384, nfreq_coarse=16, nt_per_chunk=64))
    table = spark.createDataFrame(rows, schema)
    want = monitor.stream_counters(table, config, F.lit(0)).first().asDict()
    seen = Observation("packets")
    monitor.observed_counters(table, config, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {k: want[k] for k in seen.get} and len(seen.get) == 8
    counters = streams.Counters("packets")
    spark.streams.addListener(counters)
    try:
        stream = in_parts(spark, rows, schema, [100, 220], f"{tmp_path}/in")
        run(monitor.observed_counters(stream, config, "packets").select("arrival", "packet_class"), tmp_path)
        until = time.time() + 20
        while counters.totals.get("count_packets_received", 0) < len(rows) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals == seen.get
