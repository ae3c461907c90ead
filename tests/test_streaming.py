import random

import pytest
from pyspark.sql import functions as F

from beamloom.operators import assembly
from beamloom.sources.telemetry import telemetry
from beamloom.streaming import streams

SF = "/root/testdata/sf0.001"


def test_strict_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(b, b * 1000 + k, k, k // 6 + rng.choice([0, 0, -3, 1, 40])) for b in range(3) for k in range(60)]
    df = spark.createDataFrame(rows, "beam_id int, event_id long, arrival long, packet_chunk long")
    for part in range(3):  # each file a batch; arrival order continues over batches
        df.filter((F.col("arrival") >= part * 20) & (F.col("arrival") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError):
        streams.assemble_stream(stream)
    streams.use_state_store(spark)
    query = streams.assemble_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.event_id, r.active, r.hit) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.event_id, r.active, r.hit) for r in assembly.assemble_strict(df).collect()}


def test_rates_and_chunks_stream_equal_batch(spark, tmp_path):
    samples = telemetry(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "sender", "beam_id", "intensity")
    samples.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(samples.schema).parquet(f"{tmp_path}/in")
    for name, make in (("rates", lambda df: streams.rate_stream(df, "1 day")), ("chunks", streams.chunk_stream)):
        out = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        out.awaitTermination(120)
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(samples).collect()))


def test_archive_stream(spark, tmp_path):
    rows = spark.createDataFrame([(b, c) for b in range(3) for c in (2, 1)], "beam_id int, ichunk long")
    rows.write.parquet(f"{tmp_path}/in")
    streams.archive_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), [0, 2], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.beam_id, r.ichunk) for r in kept.collect()} == {(b, c) for b in (0, 2) for c in (1, 2)}
    assert [r.ichunk for r in streams.in_chunk_order(kept, 2)] == [1, 2]


@pytest.mark.parametrize("n", [1])
def test_entry(spark, n):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["beam_id", "ichunk", "n_samples", "n_unmasked", "mean", "worst_error"] and out.count() > 0
