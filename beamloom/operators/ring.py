"""The telescoping history of a beam: what is where after n pushes, in closed form; no state, no simulation.

Level l holds chunks of 2^l pushes. When a level is full, its two oldest chunks are merged and pushed up; the last
level drops its oldest. After n pushes, level l has merged m_l pairs: m_l = max(0, (p_l - c_l + 1) div 2), p_(l+1) = m_l.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOWNSTREAM = 1


def pushes(chunks: DataFrame) -> DataFrame:
    """(beam_id, first_ichunk, n): chunks are contiguous, so a beam's pushes follow from its first and last."""
    df = chunks.groupBy("beam_id").agg(F.min("ichunk").alias("first_ichunk"), F.max("ichunk").alias("last"))
    return df.select("beam_id", "first_ichunk", (F.col("last") - F.col("first_ichunk") + 1).alias("n"))


def _levels(n: Column, capacities: Sequence[int]) -> list[tuple[Column, Column]]:
    """(first resident, pushes) of each level."""
    out, p = [], n
    for level, c in enumerate(capacities):
        if level == len(capacities) - 1:
            out.append((F.greatest(F.lit(0), p - c), p))
        else:
            m = F.greatest(F.lit(0), F.floor((p - c + 1) / 2))
            out.append((2 * m, p))
            p = m
    return out


def contents(beams: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """(beam_id, level, ichunk, binning) of every resident chunk; beams as pushes() gives them."""
    if any(c < 2 for c in capacities):
        raise ValueError("a ring capacity is below 2")
    levels = [F.struct(F.lit(i).alias("level"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for i, (lo, hi) in enumerate(_levels(F.col("n"), capacities))]
    df = beams.select("beam_id", "first_ichunk", F.explode(F.array(*levels)).alias("at")).filter("at.hi > at.lo")
    df = df.withColumn("j", F.explode(F.sequence("at.lo", F.col("at.hi") - 1)))
    binning = F.expr("shiftleft(1L, at.level)")
    return df.select("beam_id", "at.level", (F.col("first_ichunk") + F.col("j") * binning).alias("ichunk"), binning.cast("int").alias("binning"))


def with_bounds(resident: DataFrame, counts_per_chunk: int) -> DataFrame:
    return resident.withColumn("fpga_begin", F.col("ichunk") * counts_per_chunk).withColumn("fpga_end", (F.col("ichunk") + F.col("binning")) * counts_per_chunk)


def level_stats(resident: DataFrame, counts_per_chunk: int) -> DataFrame:
    """(beam_id, level, n, fpga_min, fpga_max) for each level with chunks."""
    df = with_bounds(resident, counts_per_chunk)
    return df.groupBy("beam_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min("fpga_begin").alias("fpga_min"), F.max("fpga_end").alias("fpga_max"))


def ring_stats(resident: DataFrame, beams: DataFrame, capacities: Sequence[int], consumed: Column, counts_per_chunk: int) -> DataFrame:
    """Per beam: chunks ready for the consumer, capacity, elements, bounds, and the next chunk's count."""
    totals = with_bounds(resident, counts_per_chunk).groupBy("beam_id").agg(
        F.count(F.lit(1)).alias("ntotal"), F.min("fpga_begin").alias("fpga_min"), F.max("fpga_end").alias("fpga_max")
    )
    df = beams.join(totals, "beam_id").withColumn("consumed", consumed)
    ready = F.least(F.col("n") - F.col("consumed"), F.lit(capacities[0]))
    return df.select("beam_id", ready.alias("n_ready"), F.lit(sum(capacities)).alias("capacity"), "ntotal", "fpga_min", "fpga_max",
                     ((F.col("first_ichunk") + F.col("n")) * counts_per_chunk).alias("fpga_next"))


def snapshot(resident: DataFrame, beams: DataFrame, consumed: Column, counts_per_chunk: int, fpga_min: int = 0, fpga_max: int = 0) -> DataFrame:
    """Resident chunks that overlap the FPGA range (0: unbounded, the maximum included) with their location bit."""
    df = with_bounds(resident, counts_per_chunk)
    if fpga_min:
        df = df.filter(F.col("fpga_end") > fpga_min)
    if fpga_max:
        df = df.filter(F.col("fpga_begin") <= fpga_max)
    df = df.join(beams.select("beam_id", "first_ichunk", consumed.alias("consumed")), "beam_id")
    waiting = (F.col("level") == 0) & (F.col("ichunk") - F.col("first_ichunk") >= F.col("consumed"))
    where = F.when(waiting, F.lit(DOWNSTREAM)).otherwise(F.expr("shiftleft(1, level + 1)"))
    return df.select("beam_id", "level", "ichunk", "binning", "fpga_begin", "fpga_end", where.alias("location"))


def requested(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """Snapshot chunks for requests(beam_id, position), in the requests' order; an unknown beam has no chunk but a row."""
    lists = snapshots.groupBy("beam_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("fpga_begin").alias("fpga_first"))
    return requests.join(lists, "beam_id", "left").select("position", "beam_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "fpga_first")


def find_chunk(resident: DataFrame, wanted: DataFrame, counts_per_chunk: int, top_level: bool = False) -> DataFrame:
    """wanted(beam_id, fpga_begin) with the coarsest resident chunk that begins there (the finest with top_level).

    status: found, past (from the end on: not assembled yet) or gone.
    """
    df = with_bounds(resident, counts_per_chunk)
    ends = df.groupBy("beam_id").agg(F.max("fpga_end").alias("end"))
    pick = F.min_by if top_level else F.max_by
    found = df.groupBy("beam_id", "fpga_begin").agg(F.max("level").alias("level"), pick("ichunk", "level").alias("ichunk"), pick("binning", "level").alias("binning"))
    out = wanted.join(ends, "beam_id", "left").join(found, ["beam_id", "fpga_begin"], "left")
    status = F.when(F.col("ichunk").isNotNull(), "found").when(F.col("fpga_begin") >= F.col("end"), "past").otherwise("gone")
    return out.select("beam_id", "fpga_begin", "ichunk", "binning", status.alias("status"))


def dropped(beams: DataFrame, consumed: Column, capacity: int) -> DataFrame:
    """Chunks that a consumer which lags by more than the capacity loses."""
    return beams.select("beam_id", "n", consumed.alias("consumed"), F.greatest(F.lit(0), F.col("n") - consumed - capacity).cast("long").alias("dropped"))


def contiguity(resident: DataFrame) -> DataFrame:
    """Chunks whose successor in the level doesn't follow them: none in a sound ring."""
    level = Window.partitionBy("beam_id", "level").orderBy("ichunk")
    df = resident.withColumn("next", F.lead("ichunk").over(level))
    return df.filter(F.col("next").isNotNull() & (F.col("next") != F.col("ichunk") + F.col("binning")))


def can_downsample(chunks: DataFrame) -> DataFrame:
    """chunks(beam_id, ichunk, binning, mask_ready[, nupfreq, nrfifreq, nt_per_packet]) with whether each may be merged with
    its beam's next one: consecutive, of the same shape as far as it is told, and with masks that are ready where there are
    any (nrfifreq over 0, or not told)."""
    order = Window.partitionBy("beam_id", "binning").orderBy("ichunk")
    shape = F.struct("binning", *[c for c in ("nupfreq", "nrfifreq", "nt_per_packet") if c in chunks.columns])
    maskless = F.col("nrfifreq") == 0 if "nrfifreq" in chunks.columns else F.lit(False)
    df = chunks.withColumn("_next", F.lead(F.struct("ichunk", shape.alias("shape"), "mask_ready")).over(order))
    ready = maskless | (F.col("mask_ready") & F.col("_next.mask_ready"))
    fits = (F.col("_next.ichunk") == F.col("ichunk") + F.col("binning")) & (F.col("_next.shape") == shape) & ready
    return df.withColumn("mergeable", F.coalesce(fits, F.lit(False))).drop("_next")


def next_chunk(resident: DataFrame, beams: DataFrame, consumed: Column, counts_per_chunk: int) -> DataFrame:
    """(beam_id, ichunk, fpga_begin, waiting): the oldest chunk at full resolution that each beam's consumer hasn't taken, and
    how many wait; null where none does. What fell off the full-resolution level meanwhile is skipped."""
    df = beams.select("beam_id", (F.col("first_ichunk") + consumed).alias("_from")).join(resident.filter("level = 0").select("beam_id", "ichunk"), "beam_id", "left")
    waits = F.col("ichunk") >= F.col("_from")
    df = df.groupBy("beam_id").agg(F.min(F.when(waits, F.col("ichunk"))).alias("ichunk"), F.count_if(waits).alias("waiting"))
    return df.select("beam_id", "ichunk", (F.col("ichunk") * counts_per_chunk).alias("fpga_begin"), "waiting")


def statistics(resident: DataFrame, beams: DataFrame, capacities: Sequence[int], consumed: Column, counts_per_chunk: int) -> DataFrame:
    """(beam_id, name, value): the state of each beam's ring under its monitoring names, over all and for levels from 1 on;
    0 where a level is empty."""
    overall = ring_stats(resident, beams, capacities, consumed, counts_per_chunk)
    names = {"fpga_next": "fpga_next", "n_ready": "n_ready", "capacity": "capacity", "ntotal": "ntotal", "fpga_min": "fpga_min", "fpga_max": "fpga_max"}
    pairs = [F.struct(F.lit(f"ringbuf_{k}").alias("name"), F.col(c).cast("long").alias("value")) for k, c in names.items()]
    pairs.append(F.struct(F.lit("ringbuf_nlevels").alias("name"), F.lit(len(capacities)).cast("long").alias("value")))
    out = overall.select("beam_id", F.explode(F.array(*pairs)).alias("at")).select("beam_id", "at.*")
    every = beams.select("beam_id", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(c).cast("long").alias("capacity")) for i, c in enumerate(capacities)])).alias("at")).select("beam_id", "at.*")
    levels = every.filter("level > 0").join(level_stats(resident, counts_per_chunk), ["beam_id", "level"], "left")
    value = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    pairs = [F.struct(F.format_string(f"ringbuf_{k}_level%d", "level").alias("name"), value(c).alias("value")) for k, c in (("capacity", "capacity"), ("ntotal", "n"), ("fpga_min", "fpga_min"), ("fpga_max", "fpga_max"))]
    return out.unionByName(levels.select("beam_id", F.explode(F.array(*pairs)).alias("at")).select("beam_id", "at.*"))
