"""Structured Streaming forms: strict assembly with arrival-driven state, watermark chunks, packet rates, archiving."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators.assembly import first_window, watermark_chunks, window_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    """Set the state store of the session's later queries to one with column families."""
    spark.conf.set(STORE_SETTING, STATE_STORE)


def needs_store(df: DataFrame) -> None:
    if df.sparkSession.conf.get(STORE_SETTING) != STATE_STORE:
        raise ValueError(f"set {STORE_SETTING} to {STATE_STORE}")


class StrictAssembler(StatefulProcessor):
    """Per beam, the active window carries over from batch to batch; state is one number."""

    def __init__(self, align_chunks: int = 0):
        self.align = align_chunks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "active long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.active.get() if self.active.exists() else None
        active = held[0] if held is not None else None
        frame = pd.concat(list(rows)).sort_values(["arrival", "event_id"], kind="stable")
        chunks = frame["packet_chunk"].to_numpy()
        at, active = window_path(chunks, first_window(int(chunks[0]), self.align) if active is None else active)
        self.active.update((int(active),))
        yield pd.DataFrame({"beam_id": key[0], "event_id": frame["event_id"].to_numpy(), "packet_chunk": chunks, "active": at, "hit": (chunks >= at) & (chunks <= at + 1)})

    def close(self) -> None:
        pass


def assemble_stream(packets: DataFrame, align_chunks: int = 0) -> DataFrame:
    """Verdicts of a stream of packets(beam_id, event_id, arrival, packet_chunk); rows of a batch go by arrival. The session
    needs a state store with column families: use_state_store(spark)."""
    needs_store(packets)
    needed = packets.select("beam_id", "event_id", "arrival", "packet_chunk")
    return needed.groupBy("beam_id").transformWithStateInPandas(
        StrictAssembler(align_chunks), outputStructType="beam_id int, event_id long, packet_chunk long, active long, hit boolean", outputMode="Append", timeMode="None"
    )


def chunk_stream(samples: DataFrame, delay: str = "1024 minutes", duration: str = "1024 minutes") -> DataFrame:
    """Event-time chunks; late samples beyond the delay are dropped and counted by Spark's progress metrics."""
    return watermark_chunks(samples, delay, duration)


def rate_stream(packets: DataFrame, period: str = "1 second", delay: str = "10 seconds", time: str = "ts") -> DataFrame:
    """(window, sender, n): packets of each sender in each period."""
    return packets.withWatermark(time, delay).groupBy(F.window(time, period), "sender").agg(F.count(F.lit(1)).alias("n"))


def started(writer: DataStreamWriter, name: str) -> StreamingQuery:
    """The running query of that name, or a new one: starting twice is starting once."""
    spark = SparkSession.active()
    running = [q for q in spark.streams.active if q.name == name]
    return running[0] if running else writer.queryName(name).start()


def archive_stream(chunks: DataFrame, beams: list[int], path: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write every finished chunk of the listed beams below path; batches are idempotent by their number."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch.filter(F.col("beam_id").isin(*beams))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Counters(StreamingQueryListener):
    """Sums of what queries observe under a name (see monitor.observed_counters), batch after batch, without another scan.
    spark.streams.addListener() takes it."""

    def __init__(self, name: str):
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for k, v in (row.asDict() if row is not None else {}).items():
            self.totals[k] = self.totals.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def in_chunk_order(chunks: DataFrame, beam_id: int) -> Iterator:
    """A beam's finished chunks one after the other, fetched partition by partition."""
    return chunks.filter(F.col("beam_id") == beam_id).orderBy("ichunk").toLocalIterator()
