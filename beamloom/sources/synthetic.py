"""Generated inputs: injected packet log rows, random tiles with masked bytes, analytic intensities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Grid
from ..operators.tiles import binaries


def injected_packets(spark: SparkSession, senders: list[tuple[int, int]], recv_us: int) -> DataFrame:
    """Packet log rows (recv_us, sender, nbytes) as if a packet of so many bytes had come from each (sender, nbytes)."""
    return spark.createDataFrame([(recv_us, s, n) for s, n in senders], "recv_us long, sender long, nbytes int")


def random_bytes(seed: int) -> Column:
    """Uniform over -25..280 and clamped, so about a tenth of the bytes is masked at either end."""
    return F.least(F.greatest(F.floor(F.rand(seed) * 306) - 25, F.lit(0)), F.lit(255)).cast("int")


def random_samples(spark: SparkSession, beams: int, nfreq: int, nt: int, nt_per_packet: int = 16, seed: int = 0) -> DataFrame:
    """Encoded samples (beam_id, ifreq, isample, byte, scale, offset) with random bytes."""
    isample = F.expr(f"id div {beams * nfreq}")
    tile = F.expr(f"id div {beams * nfreq} div {nt_per_packet}")
    df = spark.range(beams * nfreq * nt)
    return df.select(
        (F.col("id") % beams).cast("int").alias("beam_id"), F.expr(f"cast(id div {beams} % {nfreq} as int)").alias("ifreq"), isample.alias("isample"), random_bytes(seed).alias("byte"),
        (1 + tile % 3).cast("double").alias("scale"), (tile % 5 - 2).cast("double").alias("offset"),
    )


def random_tiles(spark: SparkSession, beams: int, chunks: int, grid: Grid, seed: int = 0) -> DataFrame:
    """Whole chunks of random tiles: (beam_id, coarse_freq_id, tile, scale, offset, data), about a tenth of the bytes masked."""
    per, width = grid.nscales, grid.nupfreq * grid.nt_per_packet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            rng = np.random.default_rng([seed, int(i[0])]) if len(i) else None
            data = np.clip(rng.integers(-25, 281, (len(i), width)), 0, 255) if len(i) else np.empty((0, width))
            chunk, place = i // (per * beams), i % per
            columns = [(i // per % beams).astype(np.int32), (place // grid.nt_coarse).astype(np.int32), chunk * grid.nt_coarse + place % grid.nt_coarse, 1.0 + i % 3, (i % 5 - 2).astype(float)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binaries(data)], names=["beam_id", "coarse_freq_id", "tile", "scale", "offset", "data"])

    return spark.range(beams * chunks * per).mapInArrow(run, "beam_id int, coarse_freq_id int, tile long, scale double, offset double, data binary")


def analytic(df: DataFrame) -> DataFrame:
    """df(beam_id, ifreq, isample) with an intensity and a weight that follow from the indices alone."""
    beam, freq, it = (F.col(c).cast("double") for c in ("beam_id", "ifreq", "isample"))
    return df.withColumn("intensity", F.sin(0.823 * beam + 1.319 * freq + 1.023 * it)).withColumn("weight", 0.6 + 0.4 * F.sin(1.328 * beam + 2.382 * freq + 0.883 * it))
