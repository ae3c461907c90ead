"""Folders and files that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; below a temporary one only where that is unset and Spark runs in one
    process, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: df as a Parquet table at path, read back; the table goes with the application at the latest."""
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a path; none where there is no such path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def qualified(spark: SparkSession, path: str) -> str:
    """path as Spark takes it: with the scheme of the default file system, where it has none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that has a scheme (see qualified()), and the path on it."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"{path} has no scheme, so machines may disagree where it is")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path)))


def put_file(files: fs.FileSystem, path: str, data: bytes) -> bool:
    """A new file, which appears whole; true also where it is there already with the same bytes, as after a task that was
    run again, false where it has others."""
    if files.get_file_info(path).type != fs.FileType.NotFound:
        with files.open_input_stream(path) as f:
            return f.read() == data
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(part := f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part") as f:
        f.write(data)
    files.move(part, path)
    return True
