"""Affine 8-bit encoding and decoding of samples, tile by tile.

Bytes 0 and 255 are masked. A tile's scale is a 25th of its standard deviation, its offset puts the mean at byte 128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _good(cutoff: float) -> Column:
    return F.col("weight") >= F.lit(cutoff)


def _moments(cutoff: float, over=None) -> list[Column]:
    good = _good(cutoff)
    sums = [F.count_if(good), F.sum(F.when(good, F.col("intensity"))), F.sum(F.when(good, F.col("intensity") * F.col("intensity")))]
    return [(s.over(over) if over is not None else s).alias(n) for s, n in zip(sums, ("n_good", "s1", "s2"))]


def _scaled(df: DataFrame) -> DataFrame:
    """mean, var, scale and offset from n_good, s1, s2. Without good samples the scale is 1 and the offset 0; a tile
    whose good samples are all 0 gets scale 1 and offset -128, so that its byte 128 decodes to 0."""
    some = F.col("n_good") > 0
    df = df.withColumn("mean", F.when(some, F.col("s1") / F.col("n_good")))
    spread = F.col("s2") / F.col("n_good") - F.col("mean") * F.col("mean")
    df = df.withColumn("var", F.when(some, F.greatest(spread, F.lit(1e-5) * F.col("mean") * F.col("mean"), F.lit(0.0))))
    scale = F.when(~some, 1.0).when(F.col("var") == 0, 1.0).otherwise(F.sqrt("var") / 25.0)
    df = df.withColumn("scale", scale)
    return df.withColumn("offset", F.when(some, F.col("mean") - 128.0 * F.col("scale")).otherwise(0.0)).drop("s1", "s2")


def tile_stats(samples: DataFrame, tile: list[str], cutoff: float = 0.3) -> DataFrame:
    """n_good, mean, var, scale and offset for each tile; one aggregate, combined before the shuffle."""
    return _scaled(samples.groupBy(*tile).agg(*_moments(cutoff)))


def encode(samples: DataFrame, tile: list[str], cutoff: float = 0.3) -> DataFrame:
    """Samples with their tile's scale and offset and their byte; one shuffle by tile."""
    scaled = _scaled(samples.select("*", *_moments(cutoff, Window.partitionBy(*tile))))
    level = F.when(_good(cutoff), (F.col("intensity") - F.col("offset")) / F.col("scale")).otherwise(0.0)
    byte = F.floor(F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")
    return scaled.withColumn("byte", F.when(F.col("n_good") > 0, byte).otherwise(0)).drop("n_good", "mean", "var")


def is_masked(byte: str | Column = "byte") -> Column:
    return (F.col(byte) if isinstance(byte, str) else byte).isin(0, 255)


def decode(encoded: DataFrame, prescale: float = 1.0, keep: str | None = None) -> DataFrame:
    """decoded = scale * byte + offset, times prescale; decoded_weight 0 where masked. Masked samples keep their value.

    keep (an extension): a boolean column of an interference mask; samples where it is false get weight 0, too.
    """
    value = (F.col("scale") * F.col("byte") + F.col("offset")) * F.lit(prescale)
    masked = is_masked() if keep is None else is_masked() | ~F.col(keep)
    return encoded.withColumn("decoded", value).withColumn("decoded_weight", F.when(masked, 0.0).otherwise(1.0))


def decode_subset(encoded: DataFrame, t0: int, nt: int, total: int | None = None) -> DataFrame:
    """Decoded samples of [t0, t0 + nt); the range must lie in [0, total)."""
    if t0 < 0 or nt <= 0 or (total is not None and t0 + nt > total):
        raise ValueError(f"samples {t0} to {t0 + nt} are not in range")
    return decode(encoded.filter((F.col("isample") >= t0) & (F.col("isample") < t0 + nt)))
