"""Keyed state of streams: the newest periods of packet rates, and write requests that wait for their masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import StreamConfig
from .streams import needs_store

RATES = "stream long, start_us long, sender long, n long"


class RateHistory(StatefulProcessor):
    """Per stream: the counts of each sender in each of the newest `keep` periods. Periods that leave are given out."""

    def __init__(self, period_us: int, keep: int):
        self.period, self.keep = period_us, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.starts = handle.getValueState("starts", "starts array<long>")
        self.periods = handle.getMapState("periods", "start_us long", "senders array<long>, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r.assign(start=r["us"] // self.period * self.period).groupby(["start", "sender"]).size() for r in rows]).groupby(level=[0, 1]).sum()
        held = self.starts.get()[0] if self.starts.exists() else []
        every = sorted({*held, *fresh.index.get_level_values(0).tolist()})
        kept, gone = every[-self.keep :], every[: -self.keep]
        left: list[tuple] = []
        for start in gone:
            known = self.periods.getValue((start,)) if self.periods.containsKey((start,)) else None
            if known is not None:  # a period that came too late was never held
                left += [(key[0], start, s, n) for s, n in zip(*known)]
                self.periods.removeKey((start,))
        for start, counts in fresh.groupby(level=0):
            if kept and start >= kept[0]:
                known = dict(zip(*self.periods.getValue((start,)))) if self.periods.containsKey((start,)) else {}
                for (_, sender), n in counts.items():
                    known[int(sender)] = known.get(int(sender), 0) + int(n)
                self.periods.updateValue((int(start),), (list(known), list(known.values())))
        self.starts.update(([int(s) for s in kept],))
        columns = list(zip(*left)) or [()] * 4
        yield pd.DataFrame({c: pd.Series(v, dtype=np.int64) for c, v in zip(("stream", "start_us", "sender", "n"), columns)})

    def close(self) -> None:
        pass


def rate_history_stream(packets: DataFrame, config: StreamConfig) -> DataFrame:
    """A stream of packets(stream, sender, us) into a history kept in state, as long as the configuration says; out come
    (stream, start_us, sender, n) of periods that have left it. rate_history_state() reads the others."""
    needs_store(packets)
    needed = packets.select(*(F.col(c).cast("long").alias(c) for c in ("stream", "sender", "us")))
    return needed.groupBy("stream").transformWithStateInPandas(RateHistory(config.packet_count_period_usec, config.max_packet_history), outputStructType=RATES, outputMode="Append", timeMode="None")


def rate_history_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(stream, start_us, sender, n) that the history of a stream with that checkpoint holds after its last batch."""
    held = spark.read.format("statestore").option("stateVarName", "periods").load(checkpoint)
    each = F.explode(F.arrays_zip("user_map_value.senders", "user_map_value.counts")).alias("x")
    return held.select(F.col("key.stream").alias("stream"), F.col("user_map_key.start_us").alias("start_us"), each).select("stream", "start_us", F.col("x.senders").alias("sender"), F.col("x.counts").alias("n"))


STATUSES = "beam_id int, fpga_begin long, request_id long, filename string, priority int, status string, seq long"


class WaitingWrites(StatefulProcessor):
    """Per chunk: whether its mask has come, and the requests that wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mask = handle.getValueState("mask", "filled boolean")
        self.waiting = handle.getMapState("waiting", "request_id long", "filename string, priority int, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        filled, out = self.mask.exists(), []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.kind == "mask":
                if not filled:
                    filled = True
                    self.mask.update((True,))
                    held = sorted(((k[0], tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: (x[1][2], x[0]))
                    for request, (filename, priority, _) in held:
                        out.append((request, filename, priority, "QUEUED", r.seq))
                        self.waiting.removeKey((request,))
            elif r.need_rfi_mask and not filled:
                self.waiting.updateValue((int(r.request_id),), (r.filename, int(r.priority), int(r.seq)))
                out.append((int(r.request_id), r.filename, int(r.priority), "AWAITING_RFI", r.seq))
            else:
                out.append((int(r.request_id), r.filename, int(r.priority), "QUEUED", r.seq))
        if out:
            request, filename, priority, status, seq = zip(*out)
            yield pd.DataFrame({"beam_id": np.int32(key[0]), "fpga_begin": np.int64(key[1]), "request_id": request, "filename": filename, "priority": np.array(priority, np.int32), "status": status, "seq": seq})

    def close(self) -> None:
        pass


def write_request_stream(requests: DataFrame, masks: DataFrame) -> DataFrame:
    """Statuses of a stream of requests(seq, beam_id, fpga_begin, request_id, filename, priority, need_rfi_mask), joined with
    a stream of chunks whose masks have been filled, masks(seq, beam_id, fpga_begin), as both arrive: a request that needs
    a mask is AWAITING_RFI until its chunk's has come, then QUEUED, in the order in which requests came; others are QUEUED
    at once. seq orders what arrives in one batch."""
    needs_store(requests)
    asked = requests.select("seq", "beam_id", "fpga_begin", F.lit("request").alias("kind"), "request_id", "filename", "priority", "need_rfi_mask")
    both = asked.unionByName(masks.select("seq", "beam_id", "fpga_begin", F.lit("mask").alias("kind")), allowMissingColumns=True)
    typed = both.withColumns({"beam_id": F.col("beam_id").cast("int"), "fpga_begin": F.col("fpga_begin").cast("long"), "seq": F.col("seq").cast("long"), "need_rfi_mask": F.coalesce("need_rfi_mask", F.lit(False))})
    return typed.groupBy("beam_id", "fpga_begin").transformWithStateInPandas(WaitingWrites(), outputStructType=STATUSES, outputMode="Append", timeMode="None")
