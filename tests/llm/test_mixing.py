import collections
import math
import random
import re
import struct

import duckdb
import pytest
import xxhash

from beamloom.llm import mixing, queries


def exponent(tokens, entropy_share, repeats):
    """By plain bisection."""
    total = sum(tokens)
    p = [t / total for t in tokens if t]

    def weights(x):
        z = sum(q**x for q in p)
        return [q**x / z for q in p]

    entropy = lambda x: -sum(w * math.log(w) for w in weights(x))

    def most(x):
        passes = [w / q for w, q in zip(weights(x), p)]
        return max(passes) / min(passes)

    def bisect(holds):
        low, high = 0.0, 1.0
        if holds(1.0):
            return 1.0
        for _ in range(60):
            low, high = ((low + high) / 2, high) if holds((low + high) / 2) else (low, (low + high) / 2)
        return low

    x = bisect(lambda v: entropy(v) >= entropy_share * math.log(len(p)))
    return max(x, bisect(lambda v: most(v) > repeats))


def corpus(seed, rows=900):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        source = rng.choice(["big"] * 14 + ["b", "c", "c", None])
        out.append((i, rng.choice([" ", "\n"]).join(["w"] * rng.choice([0, 1, 5, 60])), source, "k"))
    return [*out, (rows, None, "void", "k"), (rows + 1, "", "void", "k")]


@pytest.mark.parametrize("entropy_share, repeats", [(0.9, 4.0), (0.99, 2.5), (0.2, 4.0)])
def test_plan(spark, monkeypatch, entropy_share, repeats):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 3)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(4)
    plan = mixing.mix_plan(docs, entropy_share=entropy_share, toward_uniform=None, repeats=repeats, block_tokens=500).collect()
    tokens = collections.Counter()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    for i, _, s, _ in rows:
        tokens[s] += words[i]
    x = exponent(list(tokens.values()), entropy_share, repeats)
    total = sum(tokens.values())
    power = {s: (t / total) ** x for s, t in tokens.items() if t}
    least = min(power[s] / tokens[s] for s in power)
    for s in tokens:
        mine = [r for r in plan if r.source == s]
        passes = power[s] / tokens[s] / least if s in power else 1.0
        assert all(math.isclose(r.passes, passes, rel_tol=1e-6) for r in mine)
        count = collections.Counter(r.doc_id for r in mine)
        assert {i for i, _, t, _ in rows if t == s} == set(count)
        assert all(math.floor(passes + 1e-6) <= c <= math.ceil(passes - 1e-6) for c in count.values())
        at = 0
        for r in sorted(mine, key=lambda r: (r.copy, r.position_tokens, r.n_tokens)):
            assert r.n_tokens == words[r.doc_id] and r.position_tokens == at
            if r.weight:
                assert r.block == int(at / (r.weight * 500))
            at += r.n_tokens
        assert passes * tokens[s] - 1e-3 <= at < passes * tokens[s] + 60
    mixed = mixing.mix(docs, entropy_share=entropy_share, toward_uniform=None, repeats=repeats)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter(r.doc_id for r in plan)


def drawn(seed, copy, doc_id, size):
    """The permutation key by the plain hash library: each value's bytes, seeded with the hash of those before."""
    h = 42
    for kind, value in (("<i", seed), ("<i", copy), ("<q", doc_id), ("<i", size)):
        h = xxhash.xxh64(struct.pack(kind, value), h).intdigest()
    return h >> 24


def brute_plan(rows, toward_uniform, repeats, fewest, blocks=64, seed=7):
    """(doc_id, source, n_tokens, copy, block, position_tokens) of rows(doc_id, text, source) in plain Python."""
    by = collections.defaultdict(list)
    for i, text, source in rows:
        by[source].append((i, len((text or "").encode()), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    tokens = {s: sum(d[2] for d in docs) for s, docs in by.items()}
    known = {s: t for s, t in tokens.items() if t}
    total, most = sum(known.values()), math.log(len(known))
    natural = -sum(t / total * math.log(t / total) for t in known.values())
    x = exponent(list(known.values()), (natural + toward_uniform * (most - natural)) / most, repeats)
    power = {s: (t / total) ** x for s, t in known.items()}
    z, least = sum(power.values()), min(power[s] / (known[s] / total) for s in known)
    budget, out = fewest / least * z * total, []
    for s, docs in by.items():
        weight = power[s] / z if s in power else 0.0
        passes = budget * weight / tokens[s] if s in power else 1.0
        passes, at = (round(passes) if abs(passes - round(passes)) < 1e-9 else passes), 0
        for copy in range(math.ceil(passes)):
            for i, size, n in sorted(docs, key=lambda d: (drawn(seed, copy, d[0], d[1]), *d)):
                if copy < math.floor(passes) or at < passes * tokens[s]:
                    out.append((i, s, n, copy, math.floor(at * blocks / (passes * tokens[s])) if weight else 0, at))
                at += n
    return x, collections.Counter(out)


def test_the_registered_query_against_brute_force(spark):
    """Exponent, passes, permutations and blocks of every document of the smallest table, each row exactly."""
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM read_parquet('{sf}/documents.parquet')").fetchall()
    x, want = brute_plan(rows, 0.5, 4.0, 1.5)
    got = collections.Counter(tuple(r)[:6] for r in queries.op10_temperature_mixing(spark, sf).collect())
    assert 0 < x < 0.99 and got == want
    assert {r[0] for r in got} == {r[0] for r in rows} and max(r[3] for r in got) >= 1 and {r[4] for r in got} >= set(range(60))


@pytest.mark.parametrize("toward, fewest", [(0.25, 1.0), (0.9, 2.0)])
def test_brute_force_plans(spark, monkeypatch, toward, fewest):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 4)
    rows = [(i, t, s) for i, t, s, _ in corpus(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    _, want = brute_plan(rows, toward, 4.0, fewest)
    assert collections.Counter(tuple(r)[:6] for r in mixing.mix_plan(docs, toward_uniform=toward, fewest=fewest).collect()) == want
    assert collections.Counter(r.doc_id for r in mixing.mix(docs, toward_uniform=toward, fewest=fewest).collect()) == sum((collections.Counter({r[0]: n}) for r, n in want.items()), collections.Counter())


def test_repeated_rows_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(1, "a b c", "big")] * 400 + [(i, "a b" * (1 + i % 3), "big") for i in range(2, 90)] + [(i, "x", "small") for i in range(90, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.mix_plan(docs).collect()
    for s in ("big", "small"):
        at = 0
        for r in sorted((r for r in plan if r.source == s), key=lambda r: (r.copy, r.position_tokens)):
            assert r.position_tokens == at
            at += r.n_tokens
    first = collections.Counter(r.doc_id for r in plan if r.copy == 0)
    assert first[1] == 400 and all(first[i] == 1 for i in range(2, 120))
    assert collections.Counter(r.doc_id for r in mixing.mix(docs).collect()) == collections.Counter(r.doc_id for r in plan)


def test_budget_below_the_corpus(spark):
    docs = spark.createDataFrame([(i, "a b c d", "x" if i % 3 else "y") for i in range(300)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, entropy_share=None, toward_uniform=None, repeats=None, budget=400).collect()
    assert 400 <= sum(r.n_tokens for r in plan) < 410
    assert len({r.doc_id for r in plan}) == len(plan)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.n_tokens) for r in mixing.mix_plan(docs).collect() if r.doc_id) == [(1, 2), (1, 2)]
    assert len(mixing.mix(docs).collect()) == 3
    assert mixing.mix_plan(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []
