import collections
import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from beamloom.llm import vector_codes as vc


def brute(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error, digest) of rows(vec_id, vector, label), in Python integers."""
    fits = lambda v: v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)
    rows = [r for r in rows if fits(r[1])]
    lengths = collections.Counter(len(r[1]) for r in rows)
    common = min(lengths, key=lambda n: (-lengths[n], n))
    rows = [r for r in rows if len(r[1]) == common]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = common // parts
    whole = lambda x: math.floor(x * 256) if abs(x) < 2**50 else int(x) * 256
    cut = [[tuple(map(whole, v[p * width : (p + 1) * width])) for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda c, p: min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[near(c, p)].append(c[p])
            new.append([tuple(sum(x) // len(own[e]) for x in zip(*own[e])) if e in own else b for e, b in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = [[near(c, p) for p in range(parts)] for c in cut]
    errors = [min(2**63 - 1, sum(far(c[p], books[p][e]) for p, e in enumerate(code))) for c, code in zip(cut, codes)]
    totals = collections.Counter()
    for r, e in zip(rows, errors):
        totals[r[2]] += e
    return collections.Counter((r[0], bytes(code).hex(), e, min(2**63 - 1, totals[r[2]]), digest) for r, code, e in zip(rows, codes, errors))


SCHEMA = "vec_id long, embedding array<float>, label int, code int, error int"


def run(spark, rows, parts, entries, rounds):
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA).repartition(4)
    got = vc.compress(table, parts, entries, rounds)
    return collections.Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    spread = lambda: float(np.float32(rng.choice([rng.gauss(0, 0.4), rng.randint(-3, 3) / 256, 0.0])))
    rows = [(rng.randrange(150), [spread() for _ in range(8)], rng.choice([None, 1, 1, 1, 2])) for _ in range(300)]
    rows += [(5, [0.0] * 8, 1)] * 40 + [(None, [1.0] * 8, None), (None, [-0.001] * 8, 7)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * 8, 1), (1003, [None] * 8, 1), (1004, [float("inf")] * 8, 1), (1005, [1.0] * 4, 1), (1006, [1.0] * 7, 1)]
    for parts, entries, rounds in ((4, 16, 2), (1, 64, 3), (8, 5, 1)):
        assert run(spark, rows, parts, entries, rounds) == brute(rows, parts, entries, rounds)
    assert run(spark, [], 4, 16, 2) == {} and run(spark, rows[-7:-2], 4, 16, 2) == {}
    assert run(spark, rows[:3], 4, 16, 2) == brute(rows[:3], 4, 16, 2)


def test_huge_components_are_exact(spark):
    far = [float(np.float32(x)) for x in (3e38, -3e38, 1e12, 3.3e7, -2.0**20, 0.1, 0.0, 5.0)]
    rng = random.Random(4)
    rows = [(i, [rng.choice(far) for _ in range(8)], i % 3) for i in range(60)]
    assert run(spark, rows, 4, 8, 2) == brute(rows, 4, 8, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.integers(1, 40), st.integers(0, 10**6), st.sampled_from([2, 50, 10**6]))
def test_partial_distances_find_the_nearest_entry(width, entries, count, seed, spread):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-spread, spread, (count, width)), rng.integers(-spread, spread, (entries, width))
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    for dtype in (np.int64, object):
        entry, distance = vc.nearest_entries(x.astype(dtype), book.astype(dtype), vc.by_variance(book))
        assert entry.tolist() == far.argmin(axis=1).tolist() and distance.tolist() == far.min(axis=1).tolist()


def test_dimensions_in_descending_variance_and_decoding(spark):
    assert vc.by_variance(np.array([[0, 5, 1], [0, 9, 1], [0, 0, 3]])) == [1, 2, 0]
    rows = [(i, [i / 256, 1.0, -1.0, 0.5], 0) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = vc.usable(table, 2)
    books = vc.train(usable, 2, 6, 2)
    got = {r.id: r.decoded for r in vc.decode(vc.encode(usable, books), books).collect()}
    assert got == {i: v for i, v, _ in rows}  # as many entries as vectors: nothing is lost
