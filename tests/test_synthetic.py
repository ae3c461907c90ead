import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom.functions import scalars
from beamloom.operators import codec, monitor, timeseries
from beamloom.sources import synthetic


def test_analytic_round_trip(spark):
    df = spark.range(4 * 8 * 64).select((F.col("id") % 4).alias("beam_id"), F.expr("id div 4 % 8").alias("ifreq"), F.expr("id div 32").alias("isample"))
    df = synthetic.analytic(df).withColumn("tile", F.expr("isample div 16"))
    cutoff = 0.45
    out = codec.decode(codec.encode(df, ["beam_id", "ifreq", "tile"], cutoff)).collect()
    for r in out:
        assert r.intensity == pytest.approx(np.sin(0.823 * r.beam_id + 1.319 * r.ifreq + 1.023 * r.isample))
        if r.decoded_weight:
            assert r.weight >= cutoff * 0.99999 and abs(r.decoded - r.intensity) <= 0.021
        else:
            assert r.weight <= cutoff * 1.00001


def test_generators(spark):
    s = synthetic.random_samples(spark, 2, 4, 256, seed=3)
    share = s.filter(codec.is_masked()).count() / s.count()
    assert s.count() == 2048 and 0.1 < share < 0.25
    log = synthetic.injected_packets(spark, [(7, 100), (7, 20), (8, 3)], 5)
    assert {r.sender: r.n for r in monitor.sender_counts(log).collect()} == {7: 2, 8: 1}
    masked = codec.decode(s.withColumn("keep", F.col("isample") % 2 == 0), keep="keep")
    assert masked.filter("isample % 2 = 1 and decoded_weight > 0").count() == 0
    found = spark.range(1).select(scalars.find_channel(F.array(F.lit(5), F.lit(9)), F.lit(9)).alias("a"), scalars.find_channel(F.array(F.lit(5)), F.lit(9)).alias("b")).first()
    assert tuple(found) == (1, -1)


def test_append(spark, tmp_path):
    samples = spark.createDataFrame([("f", 1.0), ("f", 0.0)], "file string, weight double")
    good = spark.createDataFrame([("f", 0, 0, 5, 0.0), ("f", 1, 5, 5, 5.0)], "file string, seq int, ipos int, nt int, t0 double")
    for _ in range(2):
        timeseries.append_intensity(samples, good, f"{tmp_path}/a", "file", 1.0)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4
    with pytest.raises(ValueError, match="overlap"):
        timeseries.append_intensity(samples, good.withColumn("ipos", F.col("ipos") - F.col("seq")), f"{tmp_path}/a", "file", 1.0)
    with pytest.raises(Exception, match="negative"):
        timeseries.append_intensity(samples.withColumn("weight", F.lit(-1.0)), good, f"{tmp_path}/a", "file", 1.0)
