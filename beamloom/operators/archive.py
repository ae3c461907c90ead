"""Planning of archival writes: order, duplicates, status, routing, streaming to files, roll-over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_order(requests: DataFrame) -> DataFrame:
    """requests by priority, highest first, then by time; ties by file name."""
    return requests.orderBy(F.desc("priority"), "fpga_begin", "filename")


def next_write(requests: DataFrame) -> DataFrame:
    """The request to be written next, of those that don't wait for a mask."""
    return write_order(requests.filter(~(F.col("need_rfi_mask") & ~F.col("has_rfi_mask")))).limit(1)


def deduplicate(requests: DataFrame, chunk: Sequence[str] = ("beam_id", "ichunk")) -> DataFrame:
    """requests with an action: write, link (the device has the chunk under another name) or skip (same chunk and name)."""
    order = [F.desc("priority"), "fpga_begin", "filename", "request_id"]
    same_name = F.row_number().over(Window.partitionBy(*chunk, "filename").orderBy(*order))
    same_chunk = F.row_number().over(Window.partitionBy(*chunk, "device_name").orderBy(*order))
    df = requests.withColumn("_name", same_name).withColumn("_chunk", same_chunk)
    return df.withColumn("action", F.when(F.col("_name") > 1, "skip").when(F.col("_chunk") > 1, "link").otherwise("write")).drop("_name", "_chunk")


def status() -> Column:
    """Status of a request with columns need_rfi_mask, has_rfi_mask, attempted, exists_already, action."""
    waits = F.col("need_rfi_mask") & ~F.col("has_rfi_mask")
    return F.when(~F.col("attempted") & waits, "AWAITING_RFI").when(~F.col("attempted"), "QUEUED").when(F.col("exists_already") & (F.col("action") != "skip"), "FAILED").otherwise("SUCCEEDED")


def check_devices(names: Sequence[str]) -> None:
    """No device's name may begin with another's."""
    if not names:
        raise ValueError("no output device")
    ordered = sorted(names)
    for a, b in zip(ordered, ordered[1:]):
        if b.startswith(a):
            raise ValueError(f"device name {a!r} is the beginning of {b!r}")


def route(requests: DataFrame, devices: Sequence[str]) -> DataFrame:
    """requests with the device whose name their file name begins with; null if there is none.

    The few checked names become one expression: no join.
    """
    check_devices(devices)
    device = F.lit(None).cast("string")
    for name in devices:
        device = F.when(F.startswith("filename", F.lit(name)), F.lit(name)).otherwise(device)
    return requests.withColumn("device_name", device)


def stream_to_files(chunks: DataFrame, beams: DataFrame) -> DataFrame:
    """Write requests for every chunk of the listed beams(beam_id, pattern, priority, need_rfi_mask); others have none."""
    return chunks.join(beams, "beam_id")


def unknown_beams(beams: DataFrame, known: DataFrame) -> DataFrame:
    return beams.join(known.select("beam_id").distinct(), "beam_id", "left_anti")


def roll_over(samples: DataFrame, key: str, index: Column, start: Column, dt: float, per_file: int = 16384, block: int = 256) -> DataFrame:
    """samples with their file's number and name (whole seconds since the acquisition began, eight digits) and block."""
    number = F.floor(index / per_file)
    seconds = F.floor(start + number * per_file * dt)
    return samples.withColumn("file_number", number).withColumn("file_name", F.format_string("%08d.h5", seconds)).withColumn("block", F.floor(index % per_file / block))


def write_rolled(rolled: DataFrame, path: str, codec: str = "zstd") -> None:
    """Roll-over files as partitions, one writer a file."""
    rolled.repartition("file_number").write.partitionBy("file_number").option("compression", codec).mode("append").parquet(path)


def decompress(spark, source: str, target: str) -> None:
    """Copy a table without compression."""
    spark.read.parquet(source).write.option("compression", "uncompressed").parquet(target)
