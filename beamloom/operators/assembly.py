"""Assembly of packets into per-beam time chunks: windows driven by arrival order, late and missing data, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grid
from ..sources.shared import new_folder, written
from .ranges import SUMMARY, changes, groups, ranged
from .timeseries import explode_range


def chunk_keys(samples: DataFrame, grid: Grid, fpga: str = "fpga") -> DataFrame:
    """samples with the chunk, sample and coarse time of their FPGA count."""
    isample = F.expr(f"{fpga} div {grid.counts_per_sample}")
    return samples.withColumns(
        {"isample": isample, "ichunk": F.expr(f"{fpga} div {grid.counts_per_sample} div {grid.nt_per_chunk}"), "it_coarse": F.expr(f"cast(({fpga} div {grid.counts_per_sample}) % {grid.nt_per_chunk} div {grid.nt_per_packet} as int)")}
    )


def chunk_table(keyed: DataFrame, grid: Grid) -> DataFrame:
    """One row for each (beam_id, ichunk) with samples, and the chunk's derived bounds."""
    per = grid.counts_per_chunk
    return keyed.groupBy("beam_id", "ichunk").agg(F.count(F.lit(1)).alias("n_samples")).select(
        "beam_id", "ichunk", "n_samples", (F.col("ichunk") * grid.nt_per_chunk).alias("isample_begin"),
        (F.col("ichunk") * per).alias("fpga_begin"), ((F.col("ichunk") + 1) * per).alias("fpga_end"),
    )


def first_window(ichunk: int, align: int) -> int:
    """The first active chunk: the first packet's, rounded up to a multiple of `align` chunks."""
    return -(-ichunk // align) * align if align else ichunk


def window_path(chunks: np.ndarray, active: int) -> tuple[np.ndarray, int]:
    """The active chunk at each packet, and after the last. Between two moves of the window nothing changes, so the
    next packet that moves it is searched for in growing steps."""
    at, i, n = np.empty(len(chunks), np.int64), 0, len(chunks)
    while i < n:
        if chunks[i] >= active + 2:
            active += 1
        end, step = i + 1, 16
        while end < n:
            ahead = np.flatnonzero(chunks[end : end + step] >= active + 2)
            if len(ahead):
                end += int(ahead[0])
                break
            end, step = min(n, end + step), step * 4
        at[i:end] = active
        i = end
    return at, active


def injected_path(chunks: np.ndarray, active: int, injected: np.ndarray) -> tuple[np.ndarray, int]:
    """window_path() where some rows aren't packets but chunks put in whole: each leaves the window just behind itself."""
    puts = np.flatnonzero(injected)
    if not len(puts):
        return window_path(chunks, active)
    at, i = np.empty(len(chunks), np.int64), 0
    for k in puts.tolist():
        at[i:k], _ = window_path(chunks[i:k], active)
        active = at[k] = chunks[k] + 1
        i = k + 1
    at[i:], active = window_path(chunks[i:], int(active))
    return at, active


def entered(chunks: np.ndarray, leave: int) -> int:
    """The largest active chunk before the packets from which the window ends at `leave`: the rule, backwards."""
    back, i, n = chunks[::-1], 0, len(chunks)
    while i < n:
        step = 16
        while i < n:
            ahead = np.flatnonzero(back[i : i + step] >= leave + 2)
            if len(ahead):
                i += int(ahead[0]) + 1
                leave -= 1
                break
            i, step = i + step, step * 4
    return leave


def clamps(moves: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps x -> min(high, max(low, x + move)) put together from the start of each row's run to the row, by doubling.

    Such functions are closed under composition: the earlier (d, l, h) and the later (D, L, H) make
    (d + D, min(H, max(L, l + D)), min(H, max(L, h + D))).
    """
    d, l, h = moves.astype(np.int64), low.astype(np.int64), high.astype(np.int64)  # noqa: E741
    at, shift = np.arange(len(d)), 1
    while len(d) and shift <= int((at - starts).max()):
        own = np.flatnonzero(at - shift >= starts)
        D, L, H = d[own], l[own], h[own]
        before = own - shift
        dn, ln, hn = d[before] + D, np.minimum(H, np.maximum(L, l[before] + D)), np.minimum(H, np.maximum(L, h[before] + D))
        d[own], l[own], h[own] = dn, ln, hn
        shift *= 2
    return d, l, h


CLAMP = "move long, low long, high long"


def clamp_prefixes(key: str, columns: Sequence[str], capacity: int, summaries: bool) -> Callable:
    """A function of batches(key, range, columns..., move, low, high) in order: each row with the steps of its key's rows
    before it in the task, as one step; and, if summaries are wanted, a row for all rows of the key and range."""
    kinds = [pa.from_numpy_dtype(np.int64)] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carry = None, (0, 0, capacity)
        names = [key, "range", *columns, "move", "low", "high", *([SUMMARY] if summaries else [])]

        def total(batch: pa.RecordBatch) -> pa.RecordBatch:
            one = [pa.array([now[0]], batch.column(key).type), pa.array([now[1]], batch.column("range").type), *(pa.nulls(1, batch.column(c).type) for c in columns)]
            return pa.RecordBatch.from_arrays([*one, *(pa.array([x], k) for x, k in zip(carry, kinds)), pa.array([True])], names=names)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            first = changes(keys)
            starts = np.repeat(first, np.diff(first, append=len(keys)))
            steps = [batch.column(c).to_numpy() for c in ("move", "low", "high")]
            done = np.array(clamps(*steps, starts))
            own = slice(0, int(first[1]) if len(first) > 1 else len(keys))
            if now is not None and keys[0] == now[0]:  # the key goes on from the batch before
                d, lo, hi = done[:, own].copy()
                done[:, own] = carry[0] + d, np.minimum(hi, np.maximum(lo, carry[1] + d)), np.minimum(hi, np.maximum(lo, carry[2] + d))
            elif now is not None and summaries:
                yield total(batch)
            before = np.empty_like(done)
            before[:, 1:] = done[:, :-1]
            before[:, first] = np.array([[0], [0], [capacity]])
            if now is not None and keys[0] == now[0]:
                before[:, 0] = carry
            arrays = [*(batch.column(c) for c in (key, "range", *columns)), *(pa.array(x) for x in before)]
            if summaries:
                arrays.append(pa.array(np.zeros(len(keys), bool)))
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            ranges = batch.column("range").to_numpy()
            if summaries and len(first) > 1:  # keys that end inside the batch
                ends = first[1:] - 1
                one = [batch.column(key).take(pa.array(ends)), batch.column("range").take(pa.array(ends)), *(pa.nulls(len(ends), batch.column(c).type) for c in columns)]
                yield pa.RecordBatch.from_arrays([*one, *(pa.array(x[ends]) for x in done), pa.array(np.ones(len(ends), bool))], names=names)
            now, carry, last = (keys[-1], ranges[-1]), tuple(int(x) for x in done[:, -1]), batch
        if now is not None and summaries:
            yield total(last)

    return run


def bounded_queue(log: DataFrame, capacity: int, ranges: int | None = None) -> DataFrame:
    """log(queue, order, put) of packet lists put into and taken from bounded queues, with the size after each step and
    whether a list was dropped, whole, because its queue was full.

    A put is x -> min(capacity, x + 1), a get x -> max(0, x - 1): steps whose composition is three numbers. Each range of
    a queue is one such step, the ranges are chained, and a row's size follows from its range's first size and the steps
    before it in the range. So a queue is as many tasks as it has ranges.
    """
    needed = log.select(F.col("queue").cast("int").alias("queue"), F.col("order").cast("long").alias("order"), "put")
    steps = needed.withColumns({"move": F.when(F.col("put"), 1).otherwise(-1).cast("long"), "low": F.lit(0).cast("long"), "high": F.lit(capacity).cast("long")})
    run = clamp_prefixes("queue", ["order", "put"], capacity, True)
    rows, summaries = ranged(steps, ["queue", "order"], run, f"queue int, range int, order long, put boolean, {CLAMP}", ranges)
    chained = summaries.select("queue", "range", "move", "low", "high").repartition("queue").sortWithinPartitions("queue", "range")
    chained = chained.mapInArrow(clamp_prefixes("queue", [], capacity, False), f"queue int, range int, {CLAMP}")
    sized = lambda x: F.least("high", F.greatest("low", x + F.col("move")))
    entries = chained.select("queue", "range", sized(F.lit(0)).alias("entry"))
    found = rows.join(entries, ["queue", "range"]).withColumn("before", sized(F.col("entry")))
    size = F.when(F.col("put"), F.least(F.lit(capacity), F.col("before") + 1)).otherwise(F.greatest(F.lit(0), F.col("before") - 1))
    return found.select("queue", "order", "put", size.cast("long").alias("size"), (F.col("put") & (F.col("before") == capacity)).alias("dropped"))


#: A range's window is guessed from so many of its first packets, and its summary holds from so many chunks before on.
LOOK, BEHIND = 64, 1024
RANGED = "beam_id int, range int, place long, event_id long, packet_chunk long, inject boolean, active long, first long, leave long, low long, high long"
#: Windows below and above all others.
ANY = 1 << 60


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the window as it is if a range's guess is right, and the range's summary: its first packet's chunk, the
    guess (as `active`), the window it leaves, and the windows to enter with from which it leaves the same."""
    names = [x.split()[0] for x in RANGED.split(", ")] + [SUMMARY]

    def row(beam, number, parts, puts, guess) -> pa.RecordBatch:
        chunks, injected = np.concatenate(parts), np.concatenate(puts)
        leave = injected_path(chunks, guess, injected)[1]
        if injected.any():  # whatever it is entered with
            low, high = -ANY, ANY
        else:
            same = lambda at: window_path(chunks, at)[1] == leave
            low, fails = (guess - BEHIND, guess - BEHIND - 1) if same(guess - BEHIND) else (guess, guess - BEHIND)
            while low - fails > 1:  # the rule is monotone: the smallest window that leaves the same
                at = (low + fails) // 2
                low, fails = (at, fails) if same(at) else (low, at)
            high = entered(chunks, leave)
        values = [beam, number, None, None, None, None, guess, int(chunks[0]), int(leave), low, high]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(values, kinds)), pa.array([True])], names=names)

    now, parts, puts, place, guess, active = None, [], [], 0, 0, 0
    for part, first in groups(batches, "beam_id", "range"):
        chunks, injected = part.column("packet_chunk").to_numpy(), part.column("inject").to_numpy(zero_copy_only=False)
        if first:
            if now is not None:
                yield row(*now, parts, puts, guess)
            now, parts, puts, place = (part.column("beam_id")[0].as_py(), part.column("range")[0].as_py()), [], [], 0
            guess = active = int(np.median(chunks[:LOOK])) - 1
        at, active = injected_path(chunks, active, injected)
        n, none = len(chunks), pa.nulls(len(chunks), pa.int64())
        parts.append(chunks), puts.append(injected)
        yield pa.RecordBatch.from_arrays([part.column("beam_id"), part.column("range"), pa.array(np.arange(place, place + n)), part.column("event_id"), part.column("packet_chunk"), part.column("inject"), pa.array(at), *[none] * 4, pa.array(np.zeros(n, bool))], names=names)
        place += n
    if now is not None:
        yield row(*now, parts, puts, guess)


def _again(rows: DataFrame, entries: DataFrame, verdicts: bool) -> DataFrame:
    """The ranges of entries(beam_id, range, entry) once more, from the window told: rows, or what they leave."""
    needed = rows.select("beam_id", "range", "place", "event_id", "packet_chunk", "inject").join(entries, ["beam_id", "range"])
    dealt = needed.repartition("beam_id", "range").sortWithinPartitions("beam_id", "range", "place")
    names = ["beam_id", "event_id", "packet_chunk", "inject", "range", "place", "entry"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = 0
        for part, first in groups(batches, "beam_id", "range"):
            injected = part.column("inject").to_numpy(zero_copy_only=False)
            at, active = injected_path(part.column("packet_chunk").to_numpy(), part.column("entry")[0].as_py() if first else active, injected)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(at)], names=[*names, "active"])

    again = dealt.mapInArrow(run, "beam_id int, event_id long, packet_chunk long, inject boolean, range int, place long, entry long, active long")
    if verdicts:
        return again.select("beam_id", "event_id", "packet_chunk", "inject", "active")
    left = again.groupBy("beam_id", "range").agg(F.first("entry").alias("low"), F.max_by("active", "place").alias("leave"))
    return left.select("beam_id", "range", "leave", "low", F.col("low").alias("high"))


def _chained(summaries: DataFrame, align_chunks: int) -> DataFrame:
    """summaries with `entry`, the window that each range begins with, if those before it leave what they say."""
    order = Window.partitionBy("beam_id").orderBy("range")
    first = F.ceil(F.col("first") / align_chunks) * align_chunks if align_chunks else F.col("first")
    return summaries.withColumn("entry", F.coalesce(F.lag("leave").over(order), first.cast("long")))


def assemble_strict(packets: DataFrame, align_chunks: int = 0, ranges: int | None = None) -> DataFrame:
    """A verdict for each of packets(beam_id, event_id, arrival, packet_chunk): (beam_id, event_id, packet_chunk, active, hit).

    Two chunks, a and a + 1, are active. A packet from a + 2 on moves the window by one chunk exactly, however far ahead
    it is, and is tested again; a packet outside the window misses, so a rogue packet can't throw a stream off.

    The rule depends on every earlier packet of the beam. A beam is cut into ranges of its packets in order (Spark's
    sorted partitions); each is played from a guessed window, and summarised by what it leaves and by the windows from
    which it leaves the same: the rule is monotone, and paths that meet stay together. Ranges are chained by their
    summaries; one whose window lies outside is played from there, until all agree, and rows are played again only where
    the guess was wrong. A packet far ahead of its stream can cost further rounds, one for each range that it upsets.

    Rows whose column `inject` is true are no packets but chunks put in whole, packet_chunk their number: the window goes on
    behind them, at the next chunk and the one after, and what was in the old one is lost. Their hit is null.
    """
    puts = F.coalesce(F.col("inject"), F.lit(False)) if "inject" in packets.columns else F.lit(False)
    needed = packets.select(F.col("beam_id").cast("int").alias("beam_id"), "arrival", F.col("event_id").cast("long").alias("event_id"), F.col("packet_chunk").cast("long").alias("packet_chunk"), puts.alias("inject"))
    rows, found = ranged(needed, ["beam_id", "arrival", "event_id", "packet_chunk"], _paths, RANGED, ranges)
    spark = packets.sparkSession
    table = lambda df: written(df, new_folder(spark, "windows"))
    told = ["beam_id", "range", "first", "guess", "leave", "low", "high"]
    found = found.withColumnRenamed("active", "guess").select(*told)
    while True:
        chained = table(_chained(found, align_chunks))
        outside = chained.filter("entry < low OR entry > high")
        if outside.isEmpty():
            break
        again = _again(rows, outside.select("beam_id", "range", "entry"), False)
        kept = chained.join(outside.select("beam_id", "range"), ["beam_id", "range"], "left_anti").select(*told)
        found = table(kept.unionByName(outside.select("beam_id", "range", "first", "guess").join(again, ["beam_id", "range"]).select(*told)))
    wrong = chained.filter("entry <> guess").select("beam_id", "range", "entry")
    right = rows.join(wrong, ["beam_id", "range"], "left_anti").select("beam_id", "event_id", "packet_chunk", "inject", "active")
    every = right.unionByName(_again(rows, wrong, True))
    inside = F.when(~F.col("inject"), F.col("packet_chunk").between(F.col("active"), F.col("active") + 1))
    return every.select("beam_id", "event_id", "packet_chunk", "active", inside.alias("hit"))


def assembly_summary(verdicts: DataFrame, counts_per_chunk: int) -> DataFrame:
    """(beam_id, active, hits, misses, final_fpga): both active chunks are flushed at the end of a stream."""
    df = verdicts.groupBy("beam_id").agg(F.max("active").alias("active"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return df.withColumn("final_fpga", (F.col("active") + 2) * counts_per_chunk)


def last_write_wins(packets: DataFrame, tile: list[str], value: str) -> DataFrame:
    """The value of the packet that came last for each tile; combined before the shuffle."""
    return packets.groupBy(*tile).agg(F.max_by(value, F.struct("arrival", "event_id")).alias(value))


def dense_chunks(chunks: DataFrame) -> DataFrame:
    """(beam_id, ichunk, present): every chunk between a beam's first and last; missing ones are empty, not absent."""
    bounds = chunks.groupBy("beam_id").agg(F.min("ichunk").alias("a"), F.max("ichunk").alias("b"))
    every = explode_range(bounds, F.col("a"), F.col("b"), "ichunk").select("beam_id", "ichunk")
    seen = chunks.select("beam_id", "ichunk", F.lit(True).alias("present")).distinct()
    return every.join(seen, ["beam_id", "ichunk"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def inject_chunks(chunks: DataFrame, extra: DataFrame) -> DataFrame:
    """Chunks with already assembled ones put in; where both have a chunk, the injected one stands."""
    fresh = chunks.join(extra.select("beam_id", "ichunk"), ["beam_id", "ichunk"], "left_anti")
    return fresh.unionByName(extra)


def watermark_chunks(samples: DataFrame, delay: str, duration: str = "1024 minutes", time: str = "ts") -> DataFrame:
    """The idiomatic mode: tumbling event-time chunks with a watermark, for batch and streaming tables alike."""
    return samples.withWatermark(time, delay).groupBy(F.window(time, duration), "beam_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("intensity").alias("total")
    )
