"""Gappy intensity series: time and frequency axes, dense re-indexing, polarisation averages, file summaries, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder, written
from .ranges import indexed


def _assert(holds: Column, message: str) -> Column:
    """True, or an error when it runs."""
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def block_count(df: DataFrame) -> int:
    """Blocks that a series is cut into: as the job has shuffle partitions, twice over, and 64 at least."""
    return max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_blocks(df: DataFrame, key: str, order: str, blocks: int | None = None) -> DataFrame:
    """df with `block`, a number that rises with `order` within each key. Bounds are quantiles of the key's rows, so blocks
    hold about as many each however the values lie; a value is in one block. The lookup is a binary search.

    Quantiles of long series are approximate and depend on the order in which tasks are merged, so bounds are written once:
    every later step means the same blocks, also when tasks are run again."""
    blocks = blocks or block_count(df)
    shares = [i / blocks for i in range(1, blocks)]
    bounds = df.groupBy(F.col(key).alias("_k")).agg(F.percentile_approx(F.col(order).cast("double"), shares, 8 * blocks).alias("_bounds"))
    bounds = written(bounds, new_folder(df.sparkSession, "bounds"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(blocks.bit_length()))])
    value = F.col(order).cast("double")
    beyond = lambda at: (at <= F.size("_bounds")) & (F.try_element_at("_bounds", at) < value)
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(beyond(at + step), at + step).otherwise(at))
    return df.join(bounds, F.col(key) == F.col("_k")).withColumn("block", found).drop("_k", "_bounds")


def time_axis(times: DataFrame, key: str, time: str, strict: bool = False, blocks: int | None = None, value: str | None = None) -> DataFrame:
    """(key, it_file, time, dt, nstep, it_logical[, value]) of the distinct times of each series.

    dt is the least step; each step is rounded to whole dt, their running sum is the index without gaps. strict: steps
    that are beyond 1e6 dt or a hundredth of dt off, and indices beyond 1e8, are errors. value: a column whose sums over
    the rows of a time are carried along.

    Series are cut into blocks of about as many times each (with_blocks), so one long series is many tasks: windows run
    within blocks, and what a block needs from those before it comes from a table with a row a block. Rows of one time meet
    first, in partial aggregates.
    """
    carried = [value] if value else []
    axis = times.select(F.col(key), F.col(time).cast("double").alias("time"), *carried)
    single = axis.groupBy(key, "time").agg(F.sum(value).alias(value)) if value else axis.distinct()
    df = with_blocks(single, key, "time", blocks).repartition(key, "block")  # one exchange serves the windows, the sums and one side of the joins below
    inside = Window.partitionBy(key, "block").orderBy("time")
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("local", F.row_number().over(inside) - 1).withColumn("previous", F.lag("time").over(inside))

    ends = df.groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.min(F.col("time") - F.col("previous")).alias("inner"))
    ends = ends.select(key, "block", "first", "inner", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.max("last").over(earlier).alias("t_before"))
    dt = F.min(F.least("inner", F.col("first") - F.col("t_before"))).over(Window.partitionBy(key))
    ends = ends.select(key, "block", "n_before", "t_before", dt.alias("dt"))
    df = df.join(ends, [key, "block"])
    df = df.select(key, "block", "time", *carried, "dt", (F.col("n_before") + F.col("local")).cast("int").alias("it_file"), (F.col("time") - F.coalesce("previous", "t_before")).alias("step"))
    df = df.withColumn("nstep", F.coalesce(F.floor(F.col("step") / F.col("dt") + 0.5), F.lit(0)).cast("long"))

    sums = df.groupBy(key, "block").agg(F.sum("nstep").alias("s"))
    sums = sums.select(key, "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s_before"))
    running = F.sum("nstep").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("running", running).join(sums, [key, "block"]).withColumn("it_logical", F.col("s_before") + F.col("running"))
    if strict:
        fits = (F.col("dt") > 0) & (F.col("nstep") <= 1_000_000) & (F.abs(F.col("step") - F.col("nstep") * F.col("dt")) <= 0.01 * F.col("dt"))
        df = df.filter(_assert(F.coalesce(fits, F.lit(True)), "uneven time axis")).filter(_assert(F.col("it_logical") <= 100_000_000, "time axis too long"))
    return df.select(key, "it_file", "time", "dt", "nstep", "it_logical", *carried)


#: Rows that one array is exploded to, at most.
EXPLODED = 4096


def explode_range(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """df with a row for each whole number from first to last, in column `name`; none where last is below first. Ranges are
    exploded block by block, so no array is longer than EXPLODED, or than the number of blocks."""
    low, high = f"_{name}_low", f"_{name}_high"
    df = df.withColumn(low, first.cast("long")).withColumn(high, last.cast("long")).filter(F.col(high) >= F.col(low))
    df = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(high) - F.col(low)) / EXPLODED))))
    begin = F.col(low) + F.col("_block") * EXPLODED
    df = df.withColumn(name, F.explode(F.sequence(begin, F.least(F.col(high), begin + (EXPLODED - 1)))))
    return df.drop(low, high, "_block")


def _dense(placed: DataFrame, key: str, value: str) -> DataFrame:
    """placed(key, nstep, _at, _v) on the dense axis: every row of the axis brings the gap before it along, so no dense axis
    has to be made and joined."""
    dense = explode_range(placed, F.col("_at") - F.greatest(F.col("nstep"), F.lit(1)) + 1, F.col("_at"), "it_logical")
    found = F.when(F.col("it_logical") == F.col("_at"), F.col("_v"))
    return dense.select(key, "it_logical", F.coalesce(found, F.lit(0.0)).alias(value), found.isNotNull().alias("present"))


def fill_gaps(axis: DataFrame, values: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, it_logical, value, present) on the dense axis, 0 where the file has a gap, for values whose axis is known."""
    summed = values.groupBy(F.col(key).alias("_k"), F.col(time).cast("double").alias("_t")).agg(F.sum(value).alias("_v"))
    placed = axis.join(summed, (F.col(key) == F.col("_k")) & (F.col("time") == F.col("_t")), "left").select(key, "nstep", F.col("it_logical").alias("_at"), "_v")
    return _dense(placed, key, value)


def gap_filled(values: DataFrame, key: str, time: str, value: str, strict: bool = False, blocks: int | None = None) -> DataFrame:
    """fill_gaps() on the values' own axis, in whose first aggregate they are summed: no second shuffle, no join."""
    axis = time_axis(values, key, time, strict, blocks, value)
    return _dense(axis.select(key, "nstep", F.col("it_logical").alias("_at"), F.col(value).alias("_v")), key, value)


def unpolarized(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, intensity, weight): the weighted mean over polarisations, 0 without weight, and the sum of weights."""
    df = samples.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("intensity")).alias("wi"), F.sum("weight").alias("weight"))
    mean = F.when(F.col("weight") > 0, F.col("wi") / F.col("weight")).otherwise(0.0)
    return df.select(*keys, mean.alias("intensity"), "weight")


def time_range(dense: DataFrame, t0: int, nt: int, key: str) -> DataFrame:
    """Rows of [t0, t0 + nt) of each series, which must lie within it; that it doesn't is an error when it runs, for a series
    that ends before. A dense series' last row tells its length."""
    if nt <= 0 or t0 < 0:
        raise ValueError(f"times {t0} to {t0 + nt} are no range")
    ends = dense.groupBy(key).agg((F.max("it_logical") + 1).alias("_n"))
    whole = ends.filter(_assert(F.col("_n") >= t0 + nt, f"a series ends before time {t0 + nt}")).select(key)
    return dense.filter((F.col("it_logical") >= t0) & (F.col("it_logical") < t0 + nt)).join(whole, key)


def check_weights(samples: DataFrame) -> DataFrame:
    """samples; a negative weight is an error when it runs."""
    return samples.filter(_assert(F.coalesce(F.col("weight") >= 0, F.lit(True)), "negative weight"))


def file_summary(samples: DataFrame, key: str, nfreq: int, npol: int, time: str = "tick") -> DataFrame:
    """(key, wsum, wmax, frac_ungapped, frac_unmasked, all_zero); the time axis is counted in whole steps of 1."""
    df = samples.groupBy(key).agg(
        F.sum("weight").alias("wsum"), F.max("weight").alias("wmax"), F.count_distinct(time).alias("nt"), (F.max(time) - F.min(time) + 1).alias("nt_logical")
    )
    unmasked = F.when(F.col("wmax") > 0, F.col("wsum") / F.col("wmax") / (nfreq * npol * F.col("nt"))).otherwise(0.0)
    return df.select(key, "wsum", "wmax", (F.col("nt") / F.col("nt_logical")).alias("frac_ungapped"), unmasked.alias("frac_unmasked"), (F.col("wmax") <= 0).alias("all_zero"))


def channel_means(samples: DataFrame, key: str = "freq") -> DataFrame:
    """(key, mean, mean_weight, empty) of each channel."""
    df = samples.groupBy(key).agg(F.sum(F.col("weight") * F.col("intensity")).alias("wi"), F.sum("weight").alias("w"), F.avg("weight").alias("mean_weight"))
    return df.select(key, F.when(F.col("w") > 0, F.col("wi") / F.col("w")).alias("mean"), "mean_weight", (F.col("w") <= 0).alias("empty"))


def channel_frequency(ifreq: Column, nfreq: Column, f0_mhz: float, f1_mhz: float) -> Column:
    """In Hz, from f0 towards f1, which the axis stops one channel short of."""
    return F.lit(1e6) * (ifreq * F.lit(f1_mhz) + (nfreq - ifreq) * F.lit(f0_mhz)) / nfreq


def frequency_axis(spark, nfreq: int, f0_mhz: float, f1_mhz: float) -> DataFrame:
    """(ifreq, freq_hz) of a whole axis."""
    return spark.range(nfreq).select(F.col("id").alias("ifreq"), channel_frequency(F.col("id"), F.lit(nfreq), f0_mhz, f1_mhz).alias("freq_hz"))


def check_frequencies(axis: DataFrame, *keys: str) -> DataFrame:
    """A row for each of the keys, or one: (nfreq, lo_mhz, hi_mhz, increasing, even); the upper end is one channel beyond the
    last. A frequency axis has some thousands of channels at most, so each is one array."""
    df = axis.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ifreq", "freq_hz"))).alias("f"))
    first, last = (F.coalesce(F.try_element_at("f", F.lit(i))["freq_hz"], F.lit(0.0)) for i in (1, -1))
    df = df.select(*keys, "f", F.size("f").cast("long").alias("nfreq"), first.alias("first"), last.alias("last"))
    df = df.withColumn("step", (F.col("last") - F.col("first")) / F.greatest(F.lit(1), F.col("nfreq") - 1))
    gap = F.array_max(F.transform("f", lambda x: F.abs(x["freq_hz"] - F.col("first") - x["ifreq"] * F.col("step"))))
    even = (F.col("nfreq") >= 2) & (F.col("first") != F.col("last")) & (gap <= 1e-6 * F.abs(F.col("last") - F.col("first")))
    beyond = F.col("last") + F.col("step")
    return df.select(
        *keys, "nfreq", (F.least("first", beyond) / 1e6).alias("lo_mhz"), (F.greatest("first", beyond) / 1e6).alias("hi_mhz"), (F.col("last") > F.col("first")).alias("increasing"), F.coalesce(even, F.lit(False)).alias("even")
    )


def check_polarisations(axis: DataFrame, *keys: str) -> DataFrame:
    """A row for each of the keys, or one: whether there are one or two polarisations, XX or YY, none twice."""
    df = axis.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pol").alias("distinct"), F.count_if(F.coalesce(~F.col("pol").isin("XX", "YY"), F.lit(True))).alias("other"))
    return df.select(*keys, "n", (F.col("n").between(1, 2) & (F.col("n") == F.col("distinct")) & (F.col("other") == 0)).alias("sound"))


def check_appends(appends: DataFrame, key: str, dt: float, blocks: int | None = None) -> DataFrame:
    """appends(key, seq, ipos, nt, t0) with a status: overlap, drift beyond a hundredth of dt, or ok. A null t0 is taken
    from the series' first append, which must have one, and ipos.

    A series is cut into blocks of its sequence: the append before the first of a block is the last of those before it,
    which a table with a row a block knows.
    """
    start = appends.groupBy(key).agg(F.min_by(F.struct("t0", "ipos"), "seq").alias("_start"))
    cut = with_blocks(appends, key, "seq", blocks).repartition(key, "block")
    end = F.col("ipos") + F.col("nt")
    last = cut.groupBy(key, "block").agg(F.max_by(end, "seq").alias("_end"))
    last = last.select(key, "block", F.lag("_end").over(Window.partitionBy(key).orderBy("block")).alias("_carried"))
    df = cut.withColumn("_before", F.lag(end).over(Window.partitionBy(key, "block").orderBy("seq"))).join(last, [key, "block"]).join(start, key)
    expected = F.col("_start.t0") + (F.col("ipos") - F.col("_start.ipos")) * dt
    df = df.withColumn("end_before", F.coalesce("_before", "_carried")).withColumn("t0", F.coalesce("t0", expected)).withColumn("_expected", expected)
    status = F.when(F.col("ipos") < F.col("end_before"), "overlap").when(F.abs(F.col("t0") - F.col("_expected")) > 0.01 * dt, "drift").otherwise("ok")
    return df.select(*appends.columns, "end_before", status.alias("status"))


def append_intensity(samples: DataFrame, appends: DataFrame, path: str, key: str, dt: float, compression: str = "zstd") -> None:
    """Append samples(key, weight, ...) below path, once their appends(key, seq, ipos, nt, t0) are in order: an overlap, a
    drift or a negative weight is an error and nothing is written."""
    wrong = check_appends(appends, key, dt).filter("status <> 'ok'").limit(1).collect()
    if wrong:
        raise ValueError(f"append {wrong[0]['seq']} of {wrong[0][key]}: {wrong[0]['status']}")
    check_weights(samples).write.mode("append").option("compression", compression).partitionBy(key).parquet(path)


def concat_files(files: list[DataFrame], order: list[str]) -> DataFrame:
    """Files one after the other along time, with a global index; files go by their place in the list, rows by order. Spark
    sorts all rows in ranges, which cut files where they are long; an index is a place in a range plus the rows before it."""
    parts = files[0].withColumn("file", F.lit(0))
    for i, f in enumerate(files[1:], 1):
        parts = parts.unionByName(f.withColumn("file", F.lit(i)))
    return indexed(parts, ["file", *order], "it_global")
