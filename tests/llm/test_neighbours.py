import math

import numpy as np
from pyspark.sql import functions as F

from beamloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int"


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute(rows, k):
    use = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in use:
        if q % 10 == 0:
            near = sorted((distance(a.tolist(), b.tolist()), i) for i, b in use if i != q and len(b) == len(a))
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def test_against_brute_force(spark, monkeypatch):
    for block, cells in ((2048, (4096, 16384)), (16, (8, 40))):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        monkeypatch.setattr(neighbours, "CELL_QUERIES", cells[0])
        monkeypatch.setattr(neighbours, "CELL_CANDIDATES", cells[1])
        rng = np.random.default_rng(block)
        rows = [(i, (rng.normal(size=12) * 10.0 ** rng.integers(-3, 3)).tolist()) for i in range(300)]
        rows += [(i, [1.0] * 12) for i in range(300, 360)] + [(i, [2.0, float(i)]) for i in (400, 401, 402)]
        rows += [(500, None), (510, [0.0] * 12), (520, [1.0] * 11 + [None]), (530, [float("nan")] * 12), (540, [1.0] * 11 + [float("inf")]), (550, []), (None, [1.0] * 12), (560, [3.0] * 5)]
        docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
        got = {}
        for r in neighbours.nearest(docs, F.col("id") % 10 == 0, k=7).orderBy("query_id", "rank").collect():
            assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
            got[r.query_id].append((r.vec_id, r.score))
        assert got == {q: v for q, v in brute(rows, 7).items() if v}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = (neighbours.Tile(9, np.arange(40).tobytes(), (rng.normal(size=(40, 9)) * s).tobytes()) for s in (1, 50))
    true = np.sqrt(((a.vectors[:, None] - b.vectors) ** 2).sum(axis=2))
    assert (a.lower(b) <= true).all() and (a.lower(b) > true - 2 * (a.error[:, None] + b.error) - 1e-9).all()


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) * 10.0 ** (160 if i % 3 else -300)).tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(df, F.col("id") == 0, k=50).collect()
    want = sorted((distance(rows[0][1], v), i) for i, v, _ in rows if i)
    assert [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == want


def test_few_rows_and_repeats(spark):
    rows = spark.createDataFrame([(0, [1.0, 1.0], 0), (0, [3.0, 1.0], 0), (5, [1.0, 2.0], 0), (5, [1.0, 4.0], 0)], SCHEMA)
    got = [tuple(r) for r in neighbours.nearest(rows, F.col("id") % 10 == 0).collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 5, 3.0)]
    assert neighbours.nearest(rows.limit(0), F.col("id") % 10 == 0).collect() == []
