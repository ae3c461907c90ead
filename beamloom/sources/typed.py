"""Tables whose columns are checked before they are read, and codecs that may be missing."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Parquet codecs that Spark brings along.
CODECS = frozenset({"uncompressed", "snappy", "gzip", "zstd", "lz4", "lz4_raw"})
OFF, SILENT, WARN, MANDATORY = range(4)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The named columns of a Parquet table in their types; an error at once where one is missing or has another type."""
    df, wanted = spark.read.parquet(path), StructType.fromDDL(schema)
    for f in wanted:
        if not has_column(df, f.name):
            raise ValueError(f"{path} has no column {f.name}")
        if df.schema[f.name].dataType != f.dataType:
            raise ValueError(f"{path}: column {f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*wanted.names)


def codec(name: str, level: int = MANDATORY) -> str:
    """The codec to write with: none at level OFF; where the named one isn't there, none at SILENT and, with a warning, at
    WARN, and an error at MANDATORY."""
    if level == OFF or name in CODECS:
        return "uncompressed" if level == OFF else name
    if level == MANDATORY:
        raise ValueError(f"no codec {name}")
    if level == WARN:
        warnings.warn(f"no codec {name}, writing without compression", stacklevel=2)
    return "uncompressed"
