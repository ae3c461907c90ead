"""Nearest neighbours by a block matrix join: int8 tiles bound distances, survivors are recomputed, heaps are merged.

Vectors are packed in blocks of rows; a block holds its vectors rounded to int8 with one scale each. Query blocks and
candidate blocks meet on a grid of tasks: a cell takes one group of query blocks and one group of candidate blocks, so
a query travels once a column and a candidate once a row of the grid. In a cell, the product of two int8 tiles gives
the distance of the rounded vectors (exact in float32 while 127^2 * dim < 2^24; wider vectors are multiplied in
float64). By the triangle inequality the true distance differs by at most the two rounding errors, which are stored.
Pairs whose lower bound exceeds the query's k-th distance so far are dropped; the others are recomputed in double
precision on the original vectors, component by component in order. Each query keeps a heap of k in a cell; the cells'
heaps, k rows each, merge by query.

Defined results: a row takes no part if its id is null or its vector is null, empty, zero or holds a null or non-finite
component; vectors are near only to those of the same length; rows that repeat an id are candidates each, none of them
for their own id, and of a query that is repeated the smallest vector asks; ties go to the smaller id; extra columns
are ignored; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settings, written

BLOCK_ROWS = 2048
#: Rows of the query groups and of the candidate groups that meet in a cell, about.
CELL_QUERIES, CELL_CANDIDATES = 4096, 16384


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, vector array<double>) of rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0))


SCHEMA = "dim int, ids binary, vectors binary"


def packed(rows: DataFrame) -> DataFrame:
    """Blocks (dim, ids, vectors) of at most BLOCK_ROWS rows of (id, vector), made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), BLOCK_ROWS):
                    some = own[at : at + BLOCK_ROWS]
                    matrix = values[offsets[some][:, None] + np.arange(dim)]
                    if sum(len(i) for i, _ in held.get(dim, [])) + len(some) > BLOCK_ROWS:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids[some], matrix))
        for dim in list(held):
            yield block(dim)

    return rows.select("id", "vector").mapInArrow(run, SCHEMA)


class Tile:
    """A block of vectors with their int8 roundings and the lengths of the rounding errors."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        top = np.abs(self.vectors).max(axis=1, initial=0)
        self.scale = np.maximum(top / 127, np.finfo(float).tiny)
        rounded = np.rint(self.vectors / self.scale[:, None])
        self.codes = rounded.astype(np.int8)
        back = rounded * self.scale[:, None]
        self.error = np.sqrt(((self.vectors - back) ** 2).sum(axis=1))
        self.square = (back**2).sum(axis=1)
        self.wide = 127 * 127 * dim >= 1 << 24

    def lower(self, other: Tile) -> np.ndarray:
        """Lower bounds of the distances of this tile's rows to the other's."""
        kind = np.float64 if self.wide else np.float32
        product = (self.codes.astype(kind) @ other.codes.astype(kind).T).astype(np.float64)
        square = self.square[:, None] + other.square - 2 * product * self.scale[:, None] * other.scale
        slack = 1e-9 * (self.square[:, None] + other.square)  # rounding of this very sum
        with np.errstate(invalid="ignore", over="ignore"):
            low = np.sqrt(np.maximum(square - slack, 0)) - (self.error[:, None] + other.error) * (1 + 1e-9)
        return np.where(np.isnan(low), -np.inf, low)  # components so large that squares overflow: no bound


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in the order of components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        gap = a[:, i] - b[:, i]
        total += gap * gap
    return np.sqrt(total)


class Heaps:
    """The k nearest candidates of each row of a query tile: max-heaps of (-distance, -id)."""

    def __init__(self, tile: Tile, k: int):
        self.tile, self.k = tile, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in tile.ids]
        self.limit = np.full(len(tile.ids), np.inf)

    def meet(self, other: Tile) -> None:
        low = self.tile.lower(other)
        low[self.tile.ids[:, None] == other.ids] = np.inf
        if np.isinf(self.limit).any():  # a first k each, so that bounds can drop the rest
            near = np.argpartition(low, min(self.k, low.shape[1] - 1), axis=1)[:, : self.k]
            rows = np.repeat(np.arange(len(low)), near.shape[1])
            self._offer(rows, near.ravel(), low, other)
            low[rows, near.ravel()] = np.inf
        rows, columns = np.nonzero(low <= self.limit[:, None])
        order = np.argsort(low[rows, columns], kind="stable")
        for at in range(0, len(order), 1 << 16):
            part = order[at : at + (1 << 16)]
            part = part[low[rows[part], columns[part]] <= self.limit[rows[part]]]
            self._offer(rows[part], columns[part], low, other)

    def _offer(self, rows: np.ndarray, columns: np.ndarray, low: np.ndarray, other: Tile) -> None:
        real = low[rows, columns] < np.inf
        rows, columns = rows[real], columns[real]
        distances = exact(self.tile.vectors[rows], other.vectors[columns])
        hopeful = distances <= self.limit[rows]
        for row, distance, candidate in zip(rows[hopeful].tolist(), distances[hopeful].tolist(), other.ids[columns[hopeful]].tolist()):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, (-distance, -candidate))
            elif (-distance, -candidate) > heap[0]:
                heapq.heapreplace(heap, (-distance, -candidate))
            if len(heap) == self.k:
                self.limit[row] = -heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, float]]:
        for query, heap in zip(self.tile.ids.tolist(), self.heaps):
            yield from ((query, -i, -d) for d, i in heap)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows to each row for which is_query holds of column `id`."""
    rows = usable(vectors, id_column, vector_column)
    queries = rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    candidates = written(packed(rows), "candidates")
    asked = written(packed(queries), "queries")
    size = F.sum(F.octet_length("ids") / 8)
    n_queries, n_candidates = (int(t.agg(size).first()[0] or 0) for t in (asked, candidates))
    down, across = max(1, -(-n_queries // CELL_QUERIES)), max(1, -(-n_candidates // CELL_CANDIDATES))

    key = F.xxhash64("ids", "vectors")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.select(F.pmod(key, F.lit(down)).cast("int").alias("r"), every(across).alias("c"), F.lit(0).alias("side"), "dim", "ids", "vectors")
    met = candidates.select(every(down).alias("r"), F.pmod(key, F.lit(across)).cast("int").alias("c"), F.lit(1).alias("side"), "dim", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, heaps = None, []

        def found() -> Iterator[pa.RecordBatch]:
            for h in heaps:
                if rows := list(h.rows()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r, c, side, dim, ids, data in zip(*(x.to_pylist() for x in batch.columns)):
                if (r, c) != cell:
                    yield from found()
                    cell, heaps = (r, c), []
                tile = Tile(dim, ids, data)
                if side == 0:
                    heaps.append(Heaps(tile, k))
                else:
                    for h in heaps:
                        if h.tile.vectors.shape[1] == dim:
                            h.meet(tile)
        yield from found()

    grid = dealt.unionByName(met).repartition(down * across, "r", "c").sortWithinPartitions("r", "c", "side")
    with settings(vectors.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):  # a row is a block of vectors
        partial = written(grid.mapInArrow(run, "query_id long, vec_id long, score double"), "nearest")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
