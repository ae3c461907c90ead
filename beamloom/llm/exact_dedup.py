"""Exact deduplication with a log-structured merge index of digests. DataFrame operations only.

How the method maps to Spark: a memtable is the map-side partial aggregate of one input partition (digest -> smallest
id, count; bounded, it spills). Flushing a batch writes its memtables as one run of digests, sorted within files, beside
a Bloom filter of the run. Runs lie in a shared folder and are found there again, so later batches extend an index.
Compaction is tiered by size: FAN runs of one tier become one run, which keeps the smallest identifier of each digest.
A lookup goes from the newest run to the oldest; digests that a run's filter doesn't know aren't joined with it.
A run names the batches it holds. A batch that is there isn't flushed again, so a job that died after a flush may be
run again with the same batch name.

A digest that more than one row hit is then verified on bytes: the hit rows are grouped by (digest, text), so rows count
as equal only where their texts are. Only texts that a filter of the hits lets through are shuffled, and copies collapse
in the partial aggregate before, so a group with a third of all rows arrives as one row a task.

Defined results: a null text is empty; a null id takes part, never wins against another id, and a group of null ids
has keep_id null and kept true; rows repeated with the same id count in group_size and are all kept; very long texts are
hashed and compared whole; ties go to the smallest id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, child_names, new_path, release, scratch, whole_text, written
from .filters import bounded, build, free_name, maybe_in, without, words_for

#: Digest of the normalised text. Tests pass a weak one to reach the byte verification.
SHA256 = lambda text: F.unhex(F.sha2(text.cast("binary"), 256))

#: So many runs of one size tier are merged into one of a higher tier.
FAN = 4
#: Batches that a call deals its rows to, by a hash of the row: enough for a compaction, and a run that it leaves newer.
BATCHES = FAN + 1

ENTRIES = "digest binary, keep_id long, group_size long"


def normalised(text: str | Column = "text") -> Column:
    """Each run of white space becomes one space; nothing is trimmed."""
    return F.regexp_replace(whole_text(text), WS, " ")


class Run:
    """Entries of the batches first to last, their filter and the batches' names."""

    def __init__(self, spark: SparkSession, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last
        self.entries = spark.read.schema(ENTRIES).parquet(f"{path}/entries")
        self.filter = spark.read.schema("word long, bits long").parquet(f"{path}/filter")
        self.rows = self.entries.count()
        self.batches = spark.read.schema("batch string").parquet(f"{path}/batches")

    @property
    def tier(self) -> int:
        return int(math.log(max(1, self.rows), FAN))

    def find(self, digests: DataFrame) -> DataFrame:
        """The run's entries for those of digests(digest) that its filter may hold."""
        asked = maybe_in(digests, digests["digest"], self.filter, words_for(self.rows))
        return self.entries.join(asked, "digest", "left_semi")


class DigestIndex:
    """Digest runs below a shared folder. A run counts once its filter, which is written last, is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = []
        for name in child_names(spark, path):
            first, last = map(int, name.split("-")[1:3])
            if "_SUCCESS" in child_names(spark, f"{path}/{name}/filter"):
                found.append((last - first, first, last, name))
        self.runs: list[Run] = []  # oldest first
        for _, first, last, name in sorted(found, reverse=True):  # what a merged run covers is left over from a lost compaction
            if not any(r.first <= first and last <= r.last for r in self.runs):
                self.runs.append(Run(spark, f"{path}/{name}", first, last))
        self.runs.sort(key=lambda r: r.first)

    def _write(self, entries: DataFrame, batches: DataFrame, first: int, last: int) -> Run:
        path = f"{self.path}/run-{first}-{last}-{uuid.uuid4().hex[:8]}"
        batches.coalesce(1).write.parquet(f"{path}/batches")
        entries.sortWithinPartitions("digest").write.option("compression", "zstd").parquet(f"{path}/entries")
        written_ = self.spark.read.schema(ENTRIES).parquet(f"{path}/entries")
        build(written_, "digest", words_for(written_.count())).write.option("compression", "zstd").parquet(f"{path}/filter")
        return Run(self.spark, path, first, last)

    def holds(self, batch: str) -> bool:
        """Whether a run has taken the batch in."""
        return any(not run.batches.filter(F.col("batch") == batch).isEmpty() for run in self.runs)

    def flush(self, keyed: DataFrame, batch: str | None = None) -> None:
        """Memtables of keyed(doc_id, digest) to one more run; then compaction, as far as tiers are full.

        batch: the rows' name. Nothing happens if a run has them already; without a name, rows count each time.
        """
        batch = batch or uuid.uuid4().hex
        if self.holds(batch):
            return
        number = self.runs[-1].last + 1 if self.runs else 0
        memtables = keyed.groupBy("digest").agg(F.min(F.col("doc_id").cast("long")).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        self.runs.append(self._write(memtables, self.spark.range(1).select(F.lit(batch).alias("batch")), number, number))
        while len(self.runs) >= FAN and len({r.tier for r in self.runs[-FAN:]}) == 1:
            self.compact(FAN)

    def compact(self, newest: int) -> None:
        """The newest so many runs become one."""
        old = self.runs[-newest:]
        merged, batches = old[0].entries, old[0].batches
        for run in old[1:]:
            merged, batches = merged.unionByName(run.entries), batches.unionByName(run.batches)
        merged = merged.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        self.runs[-newest:] = [self._write(merged, batches, old[0].first, old[-1].last)]
        release(self.spark, [r.path for r in old])

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size) over all runs for the distinct digests(digest) that are in any."""
        parts = [run.find(digests) for run in reversed(self.runs)]
        if not parts:
            return self.spark.createDataFrame([], ENTRIES)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found if len(parts) == 1 else found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _verified(rows: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, texts, keep_id, group_size) of rows(doc_id, text, digest) whose digest entries has hit more than once, and
    (digest, text, keep_id, group_size) of the digests with several texts.

    Partial aggregates collapse the copies of a text where they are; what the filter lets through by chance is a group of
    one and goes afterwards.
    """
    table, words = bounded(entries.filter("group_size > 1"), "digest")
    first = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    texts = maybe_in(rows, rows["digest"], table, words).groupBy("digest", "text").agg(*first)
    checked = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    checked = written(checked.filter("group_size > 1"), "verified")
    shared = checked.filter("texts > 1").select("digest")
    return checked, rows.join(shared, "digest", "left_semi").groupBy("digest", "text").agg(*first)


def _tag(doc_id: Column, text: Column) -> Column:
    """A row's id and a hash of its raw text: rows that share both are repeated rows."""
    return F.struct(doc_id.cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))


def _grouped(docs: DataFrame, digest, batches: int, index_path: str | None, earlier: DataFrame | None, batch: str | None) -> DataFrame:
    """(doc_id, tag, keep_id, group_size, digest) for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"), _tag(F.col("doc_id"), F.col("text")).alias("tag"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    batch = batch or uuid.uuid4().hex
    names = [f"{batch}:{k}" for k in range(batches)]
    with scratch(spark) as keep:
        index = DigestIndex(spark, index_path or new_path(spark, "index"))
        own = spark.createDataFrame([(n,) for n in names], "batch string")
        if earlier is None and any(not run.batches.join(own, "batch", "left_anti").isEmpty() for run in index.runs):
            raise ValueError("the index holds earlier batches: hand over their documents for the byte verification")
        dealt = F.pmod(F.xxhash64("tag"), F.lit(batches)).cast("int").alias("batch")
        keyed = written(rows.select("doc_id", "tag", "digest", dealt), "digests", by=("batch",))
        for k, name in enumerate(names):
            index.flush(keyed.filter(F.col("batch") == k), name)
        entries = written(index.lookup(keyed.select("digest").distinct()), "entries")
        known = rows.select("doc_id", "text", "digest")
        if earlier is not None:
            old = earlier.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"))
            known = known.unionByName(old.withColumn("digest", digest(F.col("text"))))
        verified, classes = _verified(known, entries)
        collided = not verified.filter("texts > 1").isEmpty()
        keep += [keyed, entries, verified]

    groups = entries.filter("group_size = 1").unionByName(verified.filter("texts = 1").select("digest", "keep_id", "group_size"))
    result = keyed.select("doc_id", "tag", "digest").join(groups, "digest")
    if collided:  # different texts under one digest: those rows are matched on their bytes
        apart = rows.join(verified.filter("texts > 1").select("digest"), "digest", "left_semi")
        result = result.unionByName(apart.join(classes, ["digest", "text"]).select("digest", "doc_id", "tag", "keep_id", "group_size"))
    return result.select("doc_id", "tag", "keep_id", "group_size", "digest")


def exact_dedup(docs: DataFrame, digest=SHA256, batches: int = BATCHES, index_path: str | None = None, earlier: DataFrame | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row of docs(doc_id, text).

    batches: runs that the input is flushed in, dealt by a hash of the row, as arriving batches would be. index_path: an
    index that docs are added to and looked up in, with what earlier calls put there; it must be kept by the caller.
    earlier: the documents of those calls, for the byte verification; an index that holds other batches is refused
    without them. batch: a name of docs; a call that is run again under its name doesn't count its rows twice.
    """
    found = _grouped(docs, digest, batches, index_path, earlier, batch)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat an earlier text; one row stays even where whole rows, id included, are repeated.

    Only rows that may be copies are shuffled; the columns of docs stay, whatever their names. Nulls, empty and very long
    texts, ties and empty tables are as in exact_dedup().
    """
    found = _grouped(docs, SHA256, BATCHES, None, None, None).filter("group_size > 1")
    decided = written(found.select("tag", "doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")), "decided")
    again = decided.filter("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    again = written(decided.filter("kept").join(again, decided["doc_id"].eqNullSafe(again["doc_id"]) & (decided["digest"] == again["digest"]), "left_semi").select("tag").distinct(), "again")
    tag = _tag(F.col("doc_id"), F.col("text"))
    dropped = decided.filter("NOT kept").select(F.col("tag").alias("key"))
    if again.isEmpty():
        return without(docs, tag, dropped.distinct())
    name = free_name(docs, "__digest")
    once = docs.join(again, tag == again["tag"], "left_semi").withColumn(name, SHA256(normalised())).dropDuplicates(["doc_id", name]).drop(name)
    return without(docs, tag, dropped.unionByName(again.select(F.col("tag").alias("key"))).distinct()).unionByName(once)
