"""Best-fit-decreasing packing of token pieces into fixed-capacity sequences.

Lengths are whole numbers up to the capacity, so the packing of any number of pieces follows from the histogram of
their lengths alone. The driver gets that histogram (at most `capacity` rows, whatever the input) and plays best-fit
decreasing on it: a segment tree over remaining capacities finds the tightest open bin in logarithmic time, and equal
pieces that would repeat the same step are placed together. The plan is a list of rank intervals per length, of a size
bounded by the capacity. Executors then place every piece by its rank among the pieces of its length; ranks come from
per-task counters and a prefix sum over (task, length) counts, so no group meets in one task.

Defined results: a null or empty text still gives its end token; a very long one is cut into pieces of the capacity and a
last one; repeated rows and ids are packed as separate pieces; ties of length go by task and place in it; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, settings, written
from .tokens import CACHE_BYTES, ID, token_rows


class CapacityTree:
    """Segment tree over remaining capacities 0..top; a leaf holds the groups of equal open bins with that much room."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = np.zeros(2 * self.size, np.int64)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += change
            node >>= 1

    def push(self, room: int, first: int, bins: int) -> None:
        if room > 0 and bins > 0:
            self.groups[room].append((first, bins))
            self._add(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.groups[room].pop()

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least `need` that an open bin has."""
        node = self.size + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset of the first), and the bins used."""
    tree, plan, opened = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                bins = -(-left // (capacity // length))
                tree.push(capacity, opened, bins)
                opened += bins
                continue
            first, bins = tree.pop(room)
            each, at = room // length, capacity - room
            full = min(bins, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, at))
                left, rank = left - full * each, rank + full * each
                tree.push(room - each * length, first, full)
            rest = bins - full
            if rest and left:  # fewer pieces than one more bin takes
                plan.append((length, rank, rank + left, first + full, left, at))
                tree.push(room - left * length, first + full, 1)
                first, rest, left = first + 1, rest - 1, 0
            tree.push(room, first + full, rest)
    return np.array(sorted(plan), np.int64).reshape(-1, 6), opened


def cut_pieces(docs: DataFrame, spec: str, capacity: int, end_id: int, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Token pieces of docs: (doc_id, piece, start, length, ids_crc32, part, rank). rank: among the task's equal lengths."""

    def work(encoded) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for ids, tokens in encoded:
            rows = []
            for doc_id, data in zip(ids, tokens):
                for piece, at in enumerate(range(0, len(data), capacity * ID.itemsize)):
                    some = data[at : at + capacity * ID.itemsize]
                    length = len(some) // ID.itemsize
                    rows.append((doc_id, piece, at // ID.itemsize, length, zlib.crc32(some), part, int(seen[length])))
                    seen[length] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return token_rows(docs, spec, end_id, work, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long", cache_bytes)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(length, part, rank, ...) with sequence_id and offset; part and rank are as cut_pieces() gives them."""
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    keys = [f"{c}" for c in pieces.columns if c != "rank"]
    # bases grow with the tasks, so they aren't broadcast; pieces are narrow rows, dealt by task and length
    ranked = pieces.join(bases.hint("merge"), ["length", "part"]).select(*keys, (F.col("base") + F.col("rank")).alias("rank"))
    # (length, rank) pairs in one ascending number, so that one binary search finds a piece's interval
    span = int(max(histogram.values(), default=0)) + 1
    starts = plan[:, 0] * span + plan[:, 1]

    def work(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(starts, length * span + rank, side="right") - 1]
            turn = rank - row[:, 1]
            names = [*batch.schema.names, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row[:, 3] + turn // row[:, 4]), pa.array(row[:, 5] + turn % row[:, 4] * length)], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(work, f"{kinds}, sequence_id long, offset long").drop("part", "rank")


def pack_documents(docs: DataFrame, spec: str, capacity: int = 2048, end_id: int = 0, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with settings(docs.sparkSession, **SMALL_BATCHES):
        pieces = written(cut_pieces(docs, spec, capacity, end_id, cache_bytes), "pieces")
    placed = place(pieces, capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
