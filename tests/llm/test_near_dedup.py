import collections
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from beamloom.llm import near_dedup
from beamloom.llm.components import components, rounds
from beamloom.llm.shingles import shingle_sets, word_hashes
from tests_llm_support import WORDS, brute_components, plain_sets


def planted(seed, count=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéA") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    bases, rows = [[word() for _ in range(rng.choice([2, 3, 8, 40, 150, 400]))] for _ in range(25)], []
    for i in range(count):
        words = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(1, 90))]
        for _ in range(rng.choice([0, 0, 1, 2, 5, 10])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage
        rows.append((i * 7 % count, rng.choice([" ", "\n", " \t "]).join(words)))
    return [*rows, (count, ""), (count + 1, None), (count + 2, " \n"), (count + 3, "One"), (count + 4, "one "), (count + 5, "é É")]


def test_sets_and_words():
    texts = ["", " ", "a", "A b", "b a", "a b c", "x" * 70000 + " y", "é﻿ z z z z", "one two\x0bthree\x1cfour", " lead trail ", "w " * 300000, "\x00 \x00\x00"]
    sets = list(shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in sets] == [len(plain_sets(t, 3)) for t in texts]
    assert [len(w) for w in word_hashes(pa.array(texts))] == [len(WORDS.findall(t)) for t in texts]
    assert np.array_equal(list(shingle_sets(pa.array(["zz", "A B c"]).slice(1), 3))[0], list(shingle_sets(pa.array(["a  b C"]), 3))[0])


def test_against_all_pairs(spark, monkeypatch):
    for seed, k, (num, den), block in [(1, 3, (85, 100), 1024), (2, 5, (80, 100), 7)]:
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
        rows = planted(seed)
        docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n int").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, k, (num, den)).collect()}
        assert got == brute_components(rows, k, num, den)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (3, "A  b c d"), (None, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 1, None, True)] * 2 + [(4, 1, 3, False)] * 2 + [(3, 1, 3, True), (9, 0, 9, True)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_rows_that_repeat_an_id_are_one_node(spark):
    x, y = "a b c d e f g", "q r s t u v w"
    rows = [(5, x), (5, y), (3, y), (9, x), (3, None), (20, "z z y"), (20, ""), (21, ""), (30, x + " h i j k l m n"), (30, "o p q"), (8, "o p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: c for i, (_, c) in brute_components(rows, 3, 85, 100).items()}
    assert want[9] == want[5] == 3 and want[30] == 8
    got = collections.Counter((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, 3, (85, 100)).collect())
    assert got == collections.Counter((i, want[i]) for i, _ in rows)
    left = near_dedup.drop_near_copies(docs.withColumn("key", F.lit(1)).withColumn("kept", F.lit(False)), 3, (85, 100))
    assert left.columns == ["doc_id", "text", "key", "kept"]
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter((i, t) for i, t in rows if want[i] == i)
    rows = [(i // 2, t) for i, t in planted(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: c for i, (_, c) in brute_components(rows, 3, 85, 100).items()}
    got = collections.Counter((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, 3, (85, 100)).collect())
    assert got == collections.Counter((i, want[i]) for i, _ in rows)


def test_blocks_pair_all_sizes_that_can_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    rng = random.Random(3)
    rows = [(i, i, rng.choice([1, 2, 3, 5, 8, 13, 14, 15, 16, 40, 41]), [0] * near_dedup.COORDINATES, [7]) for i in range(120)]
    found = spark.createDataFrame(rows, "node long, tag long, n long, sig array<int>, prefix array<long>")
    cells = collections.defaultdict(list)
    for r in near_dedup.blocked(found, 85, 100).collect():
        cells[r.i, r.j].append((r.own, r.node, r.n))
        assert r.own in (r.i, r.j)
    met = {frozenset((a, b)) for (i, j), c in cells.items() for p, a, _ in c for q, b, _ in c if a != b and {p, q} == {i, j}}
    size = {r[0]: r[2] for r in rows}
    must = {frozenset((a, b)) for a in size for b in size if a != b and min(size[a], size[b]) * 100 >= 85 * max(size[a], size[b])}
    assert must <= met and len(met) < 120 * 119 / 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 120), (120, 110), (200, 200), (300, 50), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 110: 100, 120: 100, 300: 50, 301: 50, 50: 50}


def test_components_of_long_chains_take_few_rounds(spark):
    """Shuffled chains, whose labels walk one edge a round unless nodes are contracted; and a hub that ranks low itself."""
    rng = random.Random(8)
    for size in (1000, 4000):
        ids = rng.sample(range(10 * size), size)
        chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
        assert len(rounds(chain)) <= 25
        assert {tuple(r) for r in components(chain).collect()} == {(i, min(ids)) for i in ids}
    hub = spark.range(1, 2000).select(F.col("id").alias("a"), F.lit(5000).cast("long").alias("b"))
    assert len(rounds(hub)) <= 5 and {r.component for r in components(hub).collect()} == {1}
    assert components(hub.limit(0)).collect() == [] and components(hub.select("a", F.col("a").alias("b"))).collect() == []


def test_threshold():
    assert near_dedup.match_threshold(32, 0.85) == 16
