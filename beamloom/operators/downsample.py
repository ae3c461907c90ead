"""Mask-propagating downsampling by two in time, with requantisation, and multi-resolution pyramids of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codec import is_masked


def check_shape(nt_per_packet: int, nt_per_chunk: int = 1024) -> None:
    if nt_per_packet % 2 or nt_per_chunk % (2 * nt_per_packet):
        raise ValueError("packets must have an even number of samples, and chunks an even number of packets")


def pair_average(encoded: DataFrame, nt_per_packet: int = 16, nupfreq: int = 1) -> DataFrame:
    """(beam_id, coarse, tile, ifreq, isample, value, valid): averages of sample pairs, valid where both samples are.

    encoded(beam_id, ifreq, isample, byte, scale, offset). Rows are dealt by output tile once; the tile is among the
    grouping keys, so neither this aggregate nor the windows of downsample() shuffle again.
    """
    check_shape(nt_per_packet)
    keyed = encoded.select(
        "beam_id", F.expr(f"cast(ifreq div {nupfreq} as int)").alias("coarse"), F.expr(f"isample div {2 * nt_per_packet}").alias("tile"),
        "ifreq", F.expr("isample div 2").alias("isample"), "byte", "scale", "offset",
    ).repartition("beam_id", "coarse", "tile")
    pairs = keyed.groupBy("beam_id", "coarse", "tile", "ifreq", "isample").agg(
        F.sum("byte").alias("total"), F.count(F.lit(1)).alias("n"), F.max(is_masked().cast("int")).alias("masked"), F.max("scale").alias("scale"), F.max("offset").alias("offset")
    )
    value = F.lit(0.5) * F.col("scale") * F.col("total") + F.col("offset")
    valid = (F.col("n") == 2) & (F.col("masked") == 0)
    return pairs.select("beam_id", "coarse", "tile", "ifreq", "isample", value.alias("value"), valid.alias("valid"))


def tile_scales(pairs: DataFrame) -> DataFrame:
    """Pairs with n, mean, var, scale and offset of their output tile; the variance in a second pass over the tile."""
    tile = Window.partitionBy("beam_id", "coarse", "tile")
    good = F.when(F.col("valid"), F.col("value"))
    df = pairs.withColumn("n", F.count(good).over(tile)).withColumn("mean", F.coalesce(F.sum(good).over(tile), F.lit(0.0)) / F.greatest(F.col("n"), F.lit(1)))
    gap = F.when(F.col("valid"), (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
    df = df.withColumn("var", F.coalesce(F.sum(gap).over(tile), F.lit(0.0)) / F.greatest(F.col("n"), F.lit(1)) + F.lit(1e-10) * F.col("mean") * F.col("mean"))
    rms = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)
    df = df.withColumn("scale", F.lit(0.04) * rms)
    return df.withColumn("offset", F.col("mean") - 128.0 * F.col("scale"))


def downsample(encoded: DataFrame, nt_per_packet: int = 16, nupfreq: int = 1) -> DataFrame:
    """encoded at half the time resolution: (beam_id, ifreq, isample, byte, scale, offset); one shuffle."""
    scaled = tile_scales(pair_average(encoded, nt_per_packet, nupfreq))
    level = F.least(F.greatest((F.col("value") - F.col("offset")) / F.col("scale"), F.lit(0.0)), F.lit(255.0))
    byte = F.when(F.col("valid"), F.floor(level + 0.5).cast("int")).otherwise(0)
    return scaled.select("beam_id", "ifreq", "isample", byte.alias("byte"), "scale", "offset")


def pyramid(encoded: DataFrame, levels: int, nt_per_packet: int = 16, nupfreq: int = 1) -> DataFrame:
    """Levels 1 to `levels` of repeated downsampling, with a column binning = 2^level."""
    parts, now = [], encoded
    for level in range(1, levels + 1):
        now = downsample(now, nt_per_packet, nupfreq)
        parts.append(now.withColumn("binning", F.lit(1 << level)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def downsample_mask(bits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, isample, bit): AND of adjacent bits; a missing neighbour counts as 0."""
    halves = bits.groupBy(*keys, F.expr("isample div 2").alias("isample"))
    return halves.agg(((F.count_if("bit") == 2)).alias("bit"))


def pack_bits(bits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ibyte, packed): eight bits a byte, least significant first."""
    value = F.expr("shiftleft(cast(bit as int), cast(isample % 8 as int))")
    return bits.groupBy(*keys, F.expr("isample div 8").alias("ibyte")).agg(F.bit_or(value).alias("packed"))


def unpack_bits(packed: DataFrame) -> DataFrame:
    """The inverse of pack_bits(): a row a bit, isample and bit."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = packed.withColumn("i", bit)
    return rows.withColumn("isample", F.col("ibyte") * 8 + F.col("i")).withColumn("bit", F.expr("bit_get(packed, i) = 1")).drop("ibyte", "packed", "i")


def mask_bits(mask: Column, length: int) -> Column:
    """Booleans of a packed binary mask, least significant bit first."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.getbit(F.conv(F.hex(mask.substr((i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long"), (i % 8).cast("int")) == 1)
