"""Intensity files as Parquet: reading with their axes checked, acquisitions of many files, generated ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.timeseries import _assert, check_appends, check_frequencies, check_polarisations, check_weights, time_axis
from .shared import children

PER_FILE = 16384
#: A sequence number below all others.
BEFORE_ALL = -(1 << 60)


def read_intensity(spark: SparkSession, path: str) -> DataFrame:
    """(file, ifreq, pol, it_file, time, intensity, weight) of all files below a path, whatever their weights' type."""
    df = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    return df.select("file", "ifreq", "pol", "it_file", F.col("time").cast("double"), F.col("intensity").cast("float"), F.col("weight").cast("float"))


def checked_intensity(data: DataFrame, freqs: DataFrame) -> DataFrame:
    """data as read_intensity() gives it with `it_logical`, its place on its file's time axis without gaps.

    Running it is an error where a file's frequencies(file, ifreq, freq_hz) aren't at least two evenly spaced ones, its
    polarisations aren't one or two of XX and YY, its times are uneven, or a weight is negative.
    """
    sound = check_frequencies(freqs, "file").select("file", "even").join(check_polarisations(data.select("file", "pol").distinct(), "file").select("file", "sound"), "file", "full")
    ok = _assert(F.coalesce("even", F.lit(False)), "uneven or missing frequencies") & _assert(F.coalesce("sound", F.lit(False)), "odd polarisations")
    files = data.select("file").distinct().join(sound, "file", "left").filter(ok).select("file")
    times = time_axis(data.select("file", "time"), "file", "time", strict=True).select("file", "time", "it_logical")
    return check_weights(data).join(files, "file").join(times, ["file", "time"])


def read_acquisition(spark: SparkSession, folder: str) -> DataFrame:
    """The files of an acquisition, which are named by eight digits, one after the other in the order of their names, with
    `it_global`, the place of a time over all files. Bases are sums over files, so no sort spans them."""
    data = read_intensity(spark, folder).filter(F.col("file").rlike(r"^[0-9]{8}[^0-9]?"))
    sizes = data.groupBy("file").agg((F.max("it_file") + 1).alias("nt"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    bases = sizes.select("file", F.coalesce(F.sum("nt").over(earlier), F.lit(0)).alias("base"))
    return data.join(bases, "file").withColumn("it_global", F.col("base") + F.col("it_file")).drop("base")


class SeriesFile:
    """Series that are appended to, below a path, with where each ended remembered between calls.

    A call brings a batch of appends with their samples. They are checked against the position and the time at which each
    series began and ended so far, a table with a row a series, and not against all earlier appends. Samples are written
    first, to the batch's own folder, then the new positions, which makes the batch count; a batch that has been counted
    isn't taken again, and what a call that died has left is overwritten by the next.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, dt: float):
        self.spark, self.path, self.key, self.dt = spark, path.rstrip("/"), key, dt

    def batches(self) -> list[str]:
        """Names of the batches that count, in their order."""
        found = [n for n in children(self.spark, f"{self.path}/positions") if "_SUCCESS" in children(self.spark, f"{self.path}/positions/{n}")]
        return [n.split("-", 1)[1] for n in sorted(found)]

    def _positions(self, names: list[str]) -> DataFrame | None:
        """(key, first_ipos, first_t0, last_seq, last_end) after the batches."""
        return self.spark.read.parquet(f"{self.path}/positions/{len(names) - 1:09d}-{names[-1]}") if names else None

    def append(self, samples: DataFrame, appends: DataFrame, batch: str, compression: str = "zstd") -> bool:
        """Take samples(key, weight, ...) of appends(key, seq, ipos, nt, t0) in; false if the batch counts already. An append
        that overlaps, drifts or comes before the last, or a negative weight, is an error and nothing counts."""
        names, key = self.batches(), self.key
        if batch in names:
            return False
        before, now = self._positions(names), appends.select(key, *(F.col(c).cast("long").alias(c) for c in ("seq", "ipos", "nt")), F.col("t0").cast("double").alias("t0"))
        every = now.withColumn("known", F.lit(False))
        if before is not None:
            old = now.join(before, key).filter("seq <= last_seq").select(key, "seq").limit(1).collect()
            if old:
                raise ValueError(f"append {old[0]['seq']} of {old[0][key]} comes before the last")
            mine = before.join(now.select(key).distinct(), key, "left_semi")
            none = F.lit(0).cast("long").alias("nt")
            first = mine.select(key, F.lit(BEFORE_ALL).alias("seq"), F.col("first_ipos").alias("ipos"), none, F.col("first_t0").alias("t0"), F.lit(True).alias("known"))
            last = mine.select(key, F.col("last_seq").alias("seq"), F.col("last_end").alias("ipos"), none, F.lit(None).cast("double").alias("t0"), F.lit(True).alias("known"))
            every = every.unionByName(first).unionByName(last)
        checked = check_appends(every, key, self.dt)
        wrong = checked.filter("NOT known AND status <> 'ok'").limit(1).collect()
        if wrong:
            raise ValueError(f"append {wrong[0]['seq']} of {wrong[0][key]}: {wrong[0]['status']}")
        check_weights(samples).write.mode("overwrite").option("compression", compression).parquet(f"{self.path}/data/{batch}")
        begin = F.min_by(F.struct("ipos", "t0"), "seq").alias("begin")
        end = F.max_by(F.struct("seq", (F.col("ipos") + F.col("nt")).alias("end")), "seq").alias("end")
        fresh = checked.groupBy(key).agg(begin, end).select(key, F.col("begin.ipos").alias("first_ipos"), F.col("begin.t0").alias("first_t0"), F.col("end.seq").alias("last_seq"), F.col("end.end").alias("last_end"))
        rest = before.join(fresh.select(key), key, "left_anti") if before is not None else None
        (fresh if rest is None else fresh.unionByName(rest)).write.mode("overwrite").parquet(f"{self.path}/positions/{len(names):09d}-{batch}")
        return True

    def samples(self) -> DataFrame | None:
        """What the counted batches have brought; nothing before the first."""
        names = self.batches()
        return self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in names]) if names else None


#: Times of a folder of a time-ordered layout.
PER_BLOCK = 4096


def write_time_ordered(data: DataFrame, path: str, index: str = "it_global", per_block: int = PER_BLOCK) -> None:
    """data as a table in the order of time: a folder for each `per_block` times (column it_block), rows sorted in its files,
    so that readers of a range of times open its folders, and in their files only the row groups that meet it."""
    blocks = data.withColumn("it_block", F.expr(f"{index} div {per_block}"))
    blocks.repartitionByRange("it_block", index).sortWithinPartitions("it_block", index).write.partitionBy("it_block").parquet(path)


def time_chunks(data: DataFrame, ntime: int, index: str = "it_global", per_block: int | None = None) -> Iterator[DataFrame]:
    """A cursor: data of `ntime` times after the other, the last with what is left. Each is a filter on the index. per_block:
    data has been read from a time-ordered layout with so many times a folder; then a step reads only its folders, and
    all steps together read the data once."""
    if ntime <= 0:
        raise ValueError("a chunk needs times")
    last = data
    if per_block is not None:
        last = data.filter(F.col("it_block") == F.lit(data.agg(F.max("it_block")).first()[0]))
    end = last.agg(F.max(index)).first()[0]
    for at in range(0, 0 if end is None else end + 1, ntime):
        part = data.filter((F.col(index) >= at) & (F.col(index) < at + ntime))
        yield part if per_block is None else part.filter(F.col("it_block").between(at // per_block, (at + ntime - 1) // per_block))


def acquisition(spark: SparkSession, nfreq: int = 128, npol: int = 2, nt: int = 1000, dt: float = 512 * 2048 / 800e6, tsys: float = 25.0, seed: int = 0) -> DataFrame:
    """Gaussian noise around a system temperature, every sample with full weight."""
    df = spark.range(nfreq * npol * nt).withColumn("noise", F.randn(seed))
    it = F.expr(f"id div {nfreq * npol}")
    return df.select(
        (F.col("id") % nfreq).cast("int").alias("ifreq"), F.when(F.expr(f"id div {nfreq} % {npol} = 0"), "XX").otherwise("YY").alias("pol"), it.alias("it_file"),
        (it * dt).alias("time"), (tsys * (1 + 0.01 * F.col("noise"))).cast("float").alias("intensity"), F.lit(1.0).cast("float").alias("weight"),
    )
