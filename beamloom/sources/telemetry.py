"""The event table as a beam telemetry stream: samples with beam, channel, time, weight, sender and arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

US = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
CHANNELS = "map('click', 0, 'error', 1, 'purchase', 2, 'signup', 3, 'view', 4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str, nt_per_chunk: int = 1024, nt_per_packet: int = 16) -> DataFrame:
    """One row a sample. arrival orders rows as they came: every 50th is three chunks late; every 997th is far ahead."""
    events = table(spark, sf_dir, "events").withColumn("us", F.expr(US)).withColumn("tick", F.expr("us div 60000000"))
    chunk = F.expr(f"tick div {nt_per_chunk}")
    return events.select(
        "event_id", "us", "tick", "ts", "props",
        F.col("user_id").alias("sender"),
        F.expr("cast(user_id % 8 as int)").alias("beam_id"),
        F.expr(f"{CHANNELS}[event_type]").alias("freq"),
        F.expr("cast(event_id % 2 as int)").alias("pol"),
        F.col("value").alias("intensity"),
        F.expr("cast((event_id * 37) % 100 as double) / cast(100 as double)").alias("weight"),
        chunk.alias("ichunk"),
        F.expr(f"cast((tick % {nt_per_chunk}) div {nt_per_packet} as int)").alias("it_coarse"),
        F.expr("us * 25 div 64").alias("fpga"),
        F.expr(f"tick + if(event_id % 50 = 0, {3 * nt_per_chunk}, 0)").alias("arrival"),
        F.when(F.expr("event_id % 997 = 0"), chunk + 100).otherwise(chunk).alias("packet_chunk"),
    )


def vector_samples(spark: SparkSession, sf_dir: str, beams: int = 5) -> DataFrame:
    """Embeddings as series of 64 samples each: (beam_id, ifreq, isample, intensity, weight); every 17th sample has weight 0."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.select(
        F.expr(f"cast(vec_id % {beams} as int)").alias("beam_id"), F.lit(0).alias("ifreq"), F.expr("vec_id * 64 + i").alias("isample"),
        F.col("x").cast("double").alias("intensity"), F.expr("if((vec_id * 64 + i) % 17 = 0, 0.0D, 1.0D)").alias("weight"),
    )
