"""Shared plumbing of the corpus operators: shared scratch tables, run-time settings, label access."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every corpus operator, as a Java/RE2/Python character class.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_tables: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary one if
    Spark runs in one process, as in tests; an error on a cluster, whose machines don't share such a folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_own_checkpoint_folder", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        context._own_checkpoint_folder = folder
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered by table_paths()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd", by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder, in a folder for each value of `by`, and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).options(**options).partitionBy(*by).parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """The path goes with the application."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def table_paths(spark: SparkSession) -> list[str]:
    """Paths that new_path() gave in this application."""
    return list(_tables.get(spark.sparkContext.applicationId, []))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a path; none where there is no such path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables. Only for callers that have already saved every result which reads them."""
    jvm = spark.sparkContext._jvm
    known = _tables.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in known:
            known.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables that are written inside the block, but those which frames put into the yielded list read."""
    before, keep = set(table_paths(spark)), []
    yield keep
    files = [f for df in keep for f in df.inputFiles()]
    named = {path.rpartition("/")[2] for path in table_paths(spark) if path not in before}
    kept = {name for name in named if any(f"/{name}/" in f for f in files)}
    release(spark, [p for p in table_paths(spark) if p not in before and p.rpartition("/")[2] not in kept])


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for eager work inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: For eager steps whose rows hold texts: Arrow batches of a bounded number of rows, on both sides of the pipe.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: A Python worker takes this many bytes of a batch at a time, one row at least.
SLICE_BYTES = 1 << 20


def sliced(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of its text column, so that copies and arrays made of them stay small."""
    if not batch.num_rows:
        yield batch
        return
    ends = pa.compute.cumulative_sum(pa.compute.binary_length(batch.column(text)).fill_null(0).cast(pa.int64())).to_numpy()
    at = 0
    while at < len(ends):
        to = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lean(work: Callable, text: int = 1) -> Callable:
    """work(batches) over slices of the batches; free memory goes back to the system when a task has ended, since idle
    Python workers live on beside the executor's later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(part for batch in batches for part in sliced(batch, text))
        returned()

    return run


def returned() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_bucket(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the decimal id, modulo the number of folds; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
