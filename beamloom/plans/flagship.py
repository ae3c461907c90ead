"""The flagship query: telemetry through chunk keys, encoding and decoding to a summary of each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec
from ..sources.telemetry import telemetry

TILE = ["beam_id", "ichunk", "freq"]


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(beam_id, ichunk, n_samples, n_unmasked, mean, worst_error). One shuffle: rows are dealt by chunk, which both the
    encoder's tiles and the summary are grouped by."""
    samples = telemetry(spark, sf_dir).repartition("beam_id", "ichunk")
    decoded = codec.decode(codec.encode(samples, TILE))
    good = F.col("decoded_weight") > 0
    return decoded.groupBy("beam_id", "ichunk").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(good).alias("n_unmasked"), F.round(F.avg(F.when(good, F.col("decoded"))), 6).alias("mean"),
        F.round(F.max(F.when(good, F.abs(F.col("decoded") - F.col("intensity")))), 6).alias("worst_error"),
    )
