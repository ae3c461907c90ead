"""Vector code compression: integer product codes, whose nearest entries are found by partial distances.

A component x becomes the integer floor(SCALE * x). Vectors are cut into PARTS equal consecutive parts, and each part
position has a codebook of ENTRIES vectors: at first that part of the smallest ids' vectors, then, in each of ROUNDS
rounds, the floored means of the parts that lie nearest. All of it is integers, so results don't depend on partitions.

The nearest entry (squared Euclidean distance, ties to the lower index) is found for many parts at once. Dimensions go
in descending variance of the codebook. After each one the entry with the smallest partial distance is completed, which
may lower the best complete distance of its part; pairs whose partial distance strictly exceeds that are dropped by a
mask. What is left at the end has complete distances.

Spark reads the vectors once a round; a task sends a sum for each entry and position, so a round's result has ENTRIES
rows for each dimension, whatever the number of vectors. Only those, the first ENTRIES vectors and the number of vectors
of each length reach the driver.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those whose length
isn't the commonest of those that PARTS divides (of equally common lengths the smaller one); zero vectors do take part;
huge components are exact, and distances beyond the largest long count as that; null ids come last and are coded;
vectors of one id are in the order of their components; with fewer than ENTRIES vectors codebooks are smaller; repeated
rows are coded each; null labels are one label; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returned, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared with a codebook at a time.
BLOCK = 2048
MOST = (1 << 63) - 1
LIMB = 32


@dataclasses.dataclass(frozen=True)
class Codebooks:
    """books[part, entry, position]: integers, of Python where they don't fit into 64 bits."""

    books: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimal integers."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.ravel()).encode()).hexdigest()


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as Python integers where distances could pass 64 bits."""
    if x.size and np.abs(x).max() * SCALE > small(x.shape[-1]):
        out = np.empty(x.shape, object)
        out.ravel()[:] = [math.floor(v * SCALE) if abs(v) < 1 << 52 else int(v) * SCALE for v in x.ravel().tolist()]
        return out
    return np.floor(x * SCALE).astype(np.int64)


def small(dimensions: int) -> int:
    """Components up to this have distances and sums of them within 64 bits."""
    return math.isqrt((1 << 58) // max(1, dimensions)) - 1


def by_variance(book: np.ndarray) -> list[int]:
    """Dimensions of a codebook in descending variance of its entries; ties to the lower one."""
    spread = [len(book) * sum(int(v) ** 2 for v in book[:, d]) - sum(map(int, book[:, d])) ** 2 for d in range(book.shape[1])]
    return sorted(range(len(spread)), key=lambda d: (-spread[d], d))


def nearest_entries(x: np.ndarray, book: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry for each row of x, by partial distances in the order of dimensions."""
    first = x[:, order[0], None] - book[None, :, order[0]]
    partial = first * first
    guess = partial.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(partial <= best[:, None])
    partial = partial[row, entry]
    for k, d in enumerate(order[1:], 1):
        step = x[row, d] - book[entry, d]
        partial = partial + step * step
        if k < len(order) - 1:  # complete the most promising entry of each row
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            low = np.minimum.reduceat(partial, starts)
            at = _firsts(row, partial == low[row])
            best = np.minimum(best, ((x - book[entry[at]]) ** 2).sum(axis=1))
        keep = partial <= best[row]
        row, entry, partial = row[keep], entry[keep], partial[keep]
    low = np.minimum.reduceat(partial, np.flatnonzero(np.diff(row, prepend=-1)))
    return entry[_firsts(row, partial == low[row])], low


def _firsts(row: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The first place of each row at which the mask holds; every row has one, so rows count from 0 without gaps."""
    at = np.flatnonzero(mask.astype(bool))
    return at[np.flatnonzero(np.diff(row[at], prepend=-1))]


def assigned(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances) of rows of integers, a column for each part."""
    parts, _, width = books.books.shape
    large = x.dtype == object or books.books.dtype == object
    codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), object if large else np.int64)
    for p in range(parts):
        book, own = books.books[p], x[:, p * width : (p + 1) * width]
        if large:
            book, own = book.astype(object), own.astype(object)
        codes[:, p], far[:, p] = nearest_entries(own, book, by_variance(book))
    return codes, far


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the integers of their vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, integers(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))


def usable(vectors: DataFrame, parts: int) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.filter(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label, vector.alias("vector"))
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("vector")).count().collect()}
    common = min(lengths, key=lambda n: (-lengths[n], n), default=parts)
    return rows.filter(F.size("vector") == common)


def _totals(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """Sums of the parts nearest to each entry by position, and their number in the last place: one aggregate."""
    parts, entries, width = books.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), object)
        for _, x in _blocks(batches, "vector"):
            codes, _ = assigned(x, books)
            for p in range(parts):
                own = np.zeros((entries, width + 1), x.dtype)
                np.add.at(own[:, :width], codes[:, p], x[:, p * width : (p + 1) * width])
                own[:, width] = np.bincount(codes[:, p], minlength=entries)
                sums[p] = sums[p] + own.astype(object)
        slots, limbs, values = [], [], []
        for slot, value in enumerate(sums.ravel()):
            rest, sign, limb = abs(int(value)), -1 if value < 0 else 1, 0
            while rest:  # limbs of 32 bits, so that Spark's sums of longs are exact
                slots.append(slot), limbs.append(limb), values.append(sign * (rest & ((1 << LIMB) - 1)))
                rest, limb = rest >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["slot", "limb", "value"])
        returned()

    out = np.zeros((parts, entries, width + 1), object)
    for r in rows.select("vector").mapInArrow(run, "slot int, limb int, value long").groupBy("slot", "limb").agg(F.sum("value").alias("value")).collect():
        out.ravel()[r["slot"]] += r["value"] << (LIMB * r["limb"])
    return out


def _held(books: np.ndarray) -> np.ndarray:
    """64-bit integers where distances to all entries fit."""
    books = books.astype(object)
    dimensions = books.shape[0] * books.shape[2]
    return books.astype(np.int64) if all(abs(v) <= small(dimensions) for v in books.ravel()) else books


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of usable(); none without rows."""
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    if not seeds:
        return None
    x = integers(np.array([r["vector"] for r in seeds], float))
    books = Codebooks(_held(x.reshape(len(x), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        totals = _totals(rows, books)
        new = books.books.astype(object)
        for p, e in zip(*np.nonzero(totals[:, :, -1])):
            new[p, e] = [s // totals[p, e, -1] for s in totals[p, e, :-1]]
        books = Codebooks(_held(new))
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) for each row of usable()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, "vector"):
            codes, far = assigned(x, books)
            written_ = codes.astype(np.uint8).tobytes().hex()
            size = 2 * codes.shape[1]
            names = [written_[k * size : (k + 1) * size] for k in range(len(codes))]
            errors = [min(MOST, int(e)) for e in far.sum(axis=1)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(names, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])
        returned()

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "vector").mapInArrow(run, f"id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, column: str = "code") -> DataFrame:
    """codes with the column `decoded`: the vector that each code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if c is None else [float(v) / SCALE for p, e in enumerate(bytes.fromhex(c)) for v in books.books[p, e]] for c in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, "decoded"])

    return codes.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in codes.schema)}, decoded array<double>")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every usable row of vectors(vec_id, embedding, label).

    code: an entry for each part, two hexadecimal digits each. error: the sum of the parts' squared distances;
    label_error: the sum over all rows of the label.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    rows = usable(vectors, parts)
    books = train(rows, parts, entries, rounds)
    spark = vectors.sparkSession
    if books is None:
        label = rows.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    codes = written(encode(rows, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = codes.join(sums, codes["label"].eqNullSafe(sums["of"]))
    return joined.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
