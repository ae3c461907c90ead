"""Long sequences cut into ranges: Spark sorts rows by key and order, and each task's part of a key is a range of it.

A rule that depends on all earlier rows of a key would put the key into one task. Instead each range is summarised as a
function from the state it begins with to the state it ends with; the summaries, one row a range, are chained, and rows
take the state that their range really begins with. The ranges are Spark's own sorted partitions, written once, so that
every later step means the same ranges, also when tasks are run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder, written

SUMMARY = "__summary"


def ranged(rows: DataFrame, order: Sequence[str], run: Callable, schema: str, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, summaries): what run(batches) makes of rows in order, with the column `range`; its schema has the column
    SUMMARY, which tells the two apart. ranges: their number; by default Spark's number of shuffle partitions."""
    dealt = rows.repartitionByRange(*((ranges,) if ranges else ()), *order).sortWithinPartitions(*order)
    made = dealt.withColumn("range", F.spark_partition_id()).mapInArrow(run, f"{schema}, {SUMMARY} boolean")
    path = new_folder(rows.sparkSession, "ranges")
    table = written(made, path, by=(SUMMARY,))
    return table.filter(~F.col(SUMMARY)).drop(SUMMARY), table.filter(SUMMARY).drop(SUMMARY)


def changes(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1)) if len(keys) else np.empty(0, np.int64)


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of the batches with one value of the keys each, and whether it is the first of that value."""
    now = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = np.unique(np.concatenate([changes(c) for c in columns]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            own = tuple(c[a] for c in columns)
            yield batch.slice(a, b - a), own != now
            now = own


def indexed(df: DataFrame, order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """df with `name`, the place of each row in the order of all; of equal rows, any goes first. Ranges are Spark's sorted
    partitions, written once; their sizes are a table with a row a range."""
    dealt = df.repartitionByRange(*((ranges,) if ranges else ()), *order).sortWithinPartitions(*order)
    id_ = F.monotonically_increasing_id()  # a partition's number and the place in it
    made = dealt.withColumn(name, id_).select("*", F.shiftright(F.col(name), 33).alias("_range"))
    table = written(made.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1))), new_folder(df.sparkSession, "indexed"))
    sizes = table.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.join(sizes.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_before") + F.col(name)).drop("_range", "_before")
