"""Event counters, per-sender packet rates and their history."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import StreamConfig
from ..sources.shared import new_folder, written
from .assembly import assemble_strict
from .packets import classify
from .timeseries import explode_range

#: Classes of packets in the order in which they are counted.
CLASSES = ("good", "bad", "end_of_stream", "stream_mismatch", "beam_id_mismatch")


def event_counters(classified: DataFrame, nbytes: str = "nbytes") -> DataFrame:
    """One row of counters over classified packets; partial sums meet in one small row a task."""
    counts = [F.count_if(F.col("packet_class") == c).alias(f"count_packets_{c}") for c in CLASSES]
    return classified.agg(F.coalesce(F.sum(nbytes), F.lit(0)).alias("count_bytes_received"), F.count(F.lit(1)).alias("count_packets_received"), *counts)


def sender_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("sender").agg(F.count(F.lit(1)).alias("n"))


def rates_per_period(packets: DataFrame, us: str, period_us: int) -> DataFrame:
    """(start_us, sender, n): packets of each sender in each period that has any. The plain count is the difference of
    two snapshots of cumulative counts, so no snapshot is kept."""
    return packets.groupBy((F.expr(f"{us} div {period_us}") * period_us).alias("start_us"), "sender").agg(F.count(F.lit(1)).alias("n"))


def rate_history(packets: DataFrame, us: str, config: StreamConfig) -> DataFrame:
    """Rates of a stream's periods; as many of the newest as its configuration keeps."""
    return bounded_history(rates_per_period(packets, us, config.packet_count_period_usec), "start_us", config.max_packet_history)


def rate_differences(snapshots: DataFrame) -> DataFrame:
    """snapshots(t, sender, total) with what each sender sent since its last snapshot; a new sender sent all of it."""
    before = F.lag("total").over(Window.partitionBy("sender").orderBy("t"))
    return snapshots.withColumn("delta", F.col("total") - F.coalesce(before, F.lit(0)))


def rates_in_range(rates: DataFrame, start_us: int, end_us: int, period_us: int) -> DataFrame:
    """(sender, n, period_us) over the periods from the last that starts at or before `start_us` to the last that starts
    at or before `end_us`. Nothing where the start precedes all periods; start 0: the newest period only."""
    if start_us == 0:
        inside = newest(rates, "start_us")
    else:
        first = rates.filter(F.col("start_us") <= start_us).agg(F.max("start_us")).scalar()
        inside = rates.filter((F.col("start_us") >= first) & (F.col("start_us") <= end_us))
    periods = inside.select("start_us").distinct().agg(F.count(F.lit(1))).scalar()
    return inside.groupBy("sender").agg(F.sum("n").alias("n")).withColumn("period_us", (periods * period_us).cast("long"))


def asof(probes: DataFrame, history: DataFrame, at: str, key: str, value: str) -> DataFrame:
    """probes(at) with the key and value of the last history entry whose key is at most `at`; null if there is none. Of
    entries with one key the greatest value counts.

    Union and a running last() in ranges of the axis, which are Spark's own sorted partitions; each range starts from the
    last entry of the ranges before it, so no row meets all others. Equal probes are one row with a number until the end, so
    a time that is asked for often is no task of its own.
    """
    asked = probes.groupBy(F.col(at).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    known = history.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_t")).agg(F.max(value).alias("_value"))
    entries = known.select("_t", F.struct(F.col("_t").alias("k"), F.col("_value").alias("v")).alias("_v"), F.lit(0).cast("long").alias("_n"))
    both = entries.unionByName(asked.withColumn("_v", F.lit(None).cast(entries.schema["_v"].dataType)))
    table = written(both.repartitionByRange("_t", "_n").withColumn("_r", F.spark_partition_id()), new_folder(probes.sparkSession, "asof"))
    last = table.filter("_n = 0").groupBy("_r").agg(F.max("_v").alias("_last"))
    carried = table.select("_r").distinct().join(last, "_r", "left")
    carried = carried.select("_r", F.max("_last").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    order = Window.partitionBy("_r").orderBy("_t", "_n").rowsBetween(Window.unboundedPreceding, 0)
    found = table.withColumn("_f", F.last("_v", ignorenulls=True).over(order)).filter("_n > 0").join(F.broadcast(carried), "_r")  # a row a range
    hit = F.coalesce("_f", "_carry")
    return explode_range(found, F.lit(1), F.col("_n"), "_k").select(F.col("_t").alias(at), hit["k"].alias(key), hit["v"].alias(value))


def bounded_history(rates: DataFrame, key: str, keep: int) -> DataFrame:
    """The rows of the newest `keep` distinct keys; the oldest go first. A top-k, not a sort of all."""
    newest = rates.select(key).distinct().orderBy(F.desc(key)).limit(keep)
    return rates.join(newest, key, "left_semi")


def newest(rates: DataFrame, key: str) -> DataFrame:
    return bounded_history(rates, key, 1)


def judged_packets(packets: DataFrame, config: StreamConfig) -> DataFrame:
    """packets(nbytes, beam_ids, ..., dropped) with their class; one that the receive queue dropped has none."""
    return classify(packets, replace(config, strict=False)).withColumn("packet_class", F.when(~F.col("dropped"), F.col("packet_class")))


def packet_counters(config: StreamConfig) -> list[Column]:
    """Aggregates of the counters that judged_packets() alone decide."""
    good = F.col("packet_class").isin("good", "beam_id_mismatch")
    unknown = F.size(F.filter("beam_ids", lambda b: ~b.isin(*config.beam_ids)))
    of = lambda kind: F.count_if(F.col("packet_class") == kind)
    return [
        _total("nbytes").alias("count_bytes_received"), F.count(F.lit(1)).alias("count_packets_received"), F.count_if(good).alias("count_packets_good"), of("bad").alias("count_packets_bad"),
        F.count_if("dropped").alias("count_packets_dropped"), of("end_of_stream").alias("count_packets_endofstream"), _total(F.when(good, unknown)).alias("count_beam_id_mismatch"), of("stream_mismatch").alias("count_stream_mismatch"),
    ]


def _total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def observed_counters(packets: DataFrame, config: StreamConfig, observation: Observation | str) -> DataFrame:
    """judged_packets(), whose counters Spark takes on the way while something else consumes the rows: an Observation tells
    those of a batch; under a name, streams.Counters gathers those of a stream."""
    return judged_packets(packets, config).observe(observation, *packet_counters(config))


def stream_counters(packets: DataFrame, config: StreamConfig, consumed: Column) -> DataFrame:
    """One row of the twelve counters of a stream, from packets(arrival, nbytes, beam_ids, fpga_count, ..., dropped).

    A packet that the receive queue dropped is received, no more. Good packets include those with unknown beams, which
    count once a beam; each known beam's part is a hit or a miss of strict assembly. A beam's chunks are queued from its
    first window to its last, which the end of the stream flushes; chunks that wait longer than the ring's capacity for a
    consumer that has taken `consumed` (a column over beam_id and n) are dropped. Eight of the counters are observed in the
    pass that hands packets to assembly.
    """
    g, seen = config.grid, Observation()
    judged = observed_counters(packets, config, seen)
    good = F.col("packet_class").isin("good", "beam_id_mismatch")
    parts = judged.filter(good).select("arrival", F.expr(f"fpga_count div {g.counts_per_sample} div {g.nt_per_chunk}").alias("packet_chunk"), F.explode("beam_ids").alias("beam_id"))
    parts = parts.filter(F.col("beam_id").isin(*config.beam_ids)).select("beam_id", F.col("arrival").alias("event_id"), "arrival", "packet_chunk")
    parts = written(parts, new_folder(parts.sparkSession, "parts"))  # the one pass over packets; the observation is there then
    verdicts = assemble_strict(parts, config.nt_align // g.nt_per_chunk)
    beams = verdicts.groupBy("beam_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), (F.max("active") + 2 - F.min("active")).alias("n"))
    lost = F.greatest(F.lit(0), F.col("n") - consumed - config.ring_capacity)
    second = beams.agg(_total("hits").alias("count_assembler_hits"), _total("misses").alias("count_assembler_misses"), _total(lost).cast("long").alias("count_assembler_drops"), _total("n").alias("count_assembler_queued"))
    return second.select(*[F.lit(v).cast("long").alias(k) for k, v in seen.get.items()], *second.columns)


def fpga_maxima(verdicts: DataFrame, counts_per_chunk: int, consumed: Column) -> DataFrame:
    """(beam_id, max_fpga_flushed, max_fpga_retrieved) while a stream runs: chunks before the window are flushed; a consumer
    has taken `consumed` of them (a column over beam_id and n, the flushed ones). 0 where there is none."""
    df = verdicts.groupBy("beam_id").agg(F.max("active").alias("active"), F.min("active").alias("first")).withColumn("n", F.col("active") - F.col("first"))
    taken = F.least(F.greatest(consumed, F.lit(0)), F.col("n"))
    end = lambda n, at: F.when(n > 0, at * counts_per_chunk).otherwise(0).cast("long")
    return df.select("beam_id", end(F.col("n"), F.col("active")).alias("max_fpga_flushed"), end(taken, F.col("first") + taken).alias("max_fpga_retrieved"))


def bounds(packets: DataFrame, fpga: str = "fpga") -> DataFrame:
    """(beam_id, first_fpga, max_fpga)."""
    return packets.groupBy("beam_id").agg(F.min(fpga).alias("first_fpga"), F.max(fpga).alias("max_fpga"))


def stream_totals(chunks: DataFrame, beams: DataFrame, nbytes: Column) -> DataFrame:
    """(chunks, bytes) of the beams that stream to files."""
    return chunks.join(beams, "beam_id", "left_semi").agg(F.count(F.lit(1)).alias("streaming_chunks"), F.coalesce(F.sum(nbytes), F.lit(0)).alias("streaming_bytes"))


def gbps(nbytes: Column, us: Column) -> Column:
    return F.lit(8e-3) * nbytes / us


def target_gbps(packet_bytes: int, nfreq_coarse: int, nfreq_per_packet: int, counts_per_packet: int, dt_fpga: float = 2.56e-6) -> float:
    """The rate at which packets must leave to keep up with real time."""
    return 8e-9 * packet_bytes * (nfreq_coarse / nfreq_per_packet) / (counts_per_packet * dt_fpga)


def statistics_map(counters: DataFrame) -> DataFrame:
    """One row: a map of counter names to values."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for c in counters.columns]
    return counters.select(F.map_from_entries(F.array(*pairs)).alias("statistics"))
