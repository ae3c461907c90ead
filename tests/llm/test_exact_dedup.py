import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from beamloom.llm import exact_dedup as ed
from beamloom.llm import filters
from beamloom.llm.common import new_path


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep] += 1
    return out


def rows_of(seed):
    rng = random.Random(seed)
    texts = ["", None, " ", "\t", "a b", "a  b", "a\nb", " a b", "é", "e", "x" * 50000, "a b"]
    rows = [(i * 3 % 200, rng.choice(texts)) for i in range(200)] + [(500 + i, f"only {i}") for i in range(50)]
    return [*rows, (5, "again"), (5, "again"), (None, "a b"), (None, "none"), (None, "none")]


def test_against_brute_force_and_a_weak_digest(spark):
    rows = rows_of(1)
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, digest int, keep_id int").repartition(5)
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    for digest in (ed.SHA256, weak):
        found = ed.exact_dedup(docs, digest).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute(rows)
    assert ed.exact_dedup(docs.limit(0)).collect() == []


def test_drop_copies_keeps_one_of_each_text(spark):
    rows = rows_of(2)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, digest int").repartition(5)
    kept = ed.drop_copies(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert kept.columns == docs.columns
    assert collections.Counter(norm(r.text) for r in kept.collect()) == {norm(t): 1 for _, t in rows}


def entries_of(found):
    return sorted((bytes(r.digest), r.keep_id, r.group_size) for r in found.collect())


def test_runs_are_looked_up_extended_and_compacted(spark):
    path = new_path(spark, "index")
    index = ed.DigestIndex(spark, path)
    total = collections.defaultdict(list)
    for batch in range(ed.FAN + 2):
        rows = [(batch * 10 + i, f"{(batch * 3 + i) % 11}".encode()) for i in range(9)]
        for i, d in rows:
            total[d].append(i)
        index = ed.DigestIndex(spark, path)  # as a later application finds it
        assert len(index.runs) == (batch if batch < ed.FAN else 1 + batch - ed.FAN)
        index.flush(spark.createDataFrame(rows, "doc_id long, digest binary"))
        asked = spark.createDataFrame([(d,) for d in {*total, b"none"}], "digest binary")
        assert entries_of(index.lookup(asked)) == sorted((d, min(i), len(i)) for d, i in total.items())
    assert [(r.first, r.last) for r in index.runs] == [(0, ed.FAN - 1), (ed.FAN, ed.FAN), (ed.FAN + 1, ed.FAN + 1)]
    assert index.runs[0].find(spark.createDataFrame([(b"none",)], "digest binary")).count() == 0
    # what a lost compaction leaves beside its result doesn't count twice
    index._write(index.runs[1].entries, index.runs[1].batches, ed.FAN, ed.FAN + 1)
    assert [(r.first, r.last) for r in ed.DigestIndex(spark, path).runs] == [(0, ed.FAN - 1), (ed.FAN, ed.FAN + 1)]


def test_a_third_batch_meets_the_first_two(spark):
    rows = [r for r in rows_of(3) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old, new = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    path = new_path(spark, "index")
    first = ed.exact_dedup(old, index_path=path)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in first.collect()) == brute([r for r in rows if r[0] % 3])
    want = collections.Counter({k: n for k, n in brute(rows).items() if k[0] % 3 == 0})
    found = ed.exact_dedup(new, index_path=path, batches=1, earlier=old).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == want
    # once more under the same name, as after a job that died: nothing counts twice
    names = ("late", "late", "later")
    for name in names:
        again = ed.exact_dedup(new, index_path=path, batches=1, earlier=docs, batch=name)
        total = {r.doc_id: r.group_size for r in again.collect()}
    assert sum(r.batches.count() for r in ed.DigestIndex(spark, path).runs) == ed.BATCHES + 3
    assert total[next(r.doc_id for r in found)] >= 1
    with pytest.raises(ValueError):
        ed.exact_dedup(new, index_path=path, batches=1)


def test_a_repeated_flush_and_a_dead_job(spark):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    path = new_path(spark, "index")
    for _ in range(2):
        got = ed.exact_dedup(docs, index_path=path, batch="monday").collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute(rows)
    index = ed.DigestIndex(spark, path)
    assert index.holds("monday:0") and not index.holds("tuesday:0")


def test_the_call_deals_rows_to_batches_and_compacts(spark, monkeypatch):
    merges, lookups = [], []
    compact, lookup = ed.DigestIndex.compact, ed.DigestIndex.lookup
    monkeypatch.setattr(ed.DigestIndex, "compact", lambda self, newest: merges.append([r.rows for r in self.runs[-newest:]]) or compact(self, newest))
    monkeypatch.setattr(ed.DigestIndex, "lookup", lambda self, digests: lookups.append([r.rows for r in self.runs]) or lookup(self, digests))
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    found = ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute(rows)
    assert len(merges) == 1 and len(merges[0]) == ed.FAN and min(merges[0]) > 100
    assert len(lookups[0]) == 2 and min(lookups[0]) > 100


def test_drop_copies_with_clashing_columns(spark):
    rows = rows_of(4)
    names = "doc_id long, text string, digest int, tag int, __key int, __digest int, keep_id int, word int, bits int, `a.b` int, group_size int"
    docs = spark.createDataFrame([(i, t, *range(9)) for i, t in rows], names).repartition(3)
    kept = ed.drop_copies(docs)
    assert kept.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert collections.Counter(norm(r.text) for r in kept.collect()) == {norm(t): 1 for _, t in rows}
    assert ed.drop_copies(docs.limit(0)).collect() == []


@pytest.mark.parametrize("most", [filters.MOST_WORDS, 1, 64])
def test_filters_never_lose_a_key(spark, monkeypatch, most):
    monkeypatch.setattr(filters, "MOST_WORDS", most)
    rows = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("key"), F.lit("x").alias("__key"))
    dropped = spark.range(0, 3000, 5).select(F.col("id").alias("key"))
    table, words = filters.bounded(dropped, "key")
    passed = {r.key for r in filters.maybe_in(rows, F.col("key"), table, words).collect()}
    assert {i for i in range(0, 3000, 5) if i % 7} <= passed
    if most > 64:
        assert len(passed) < 600 + 0.05 * 2400
    left = filters.without(rows, F.col("key"), dropped)
    want = collections.Counter(i if i % 7 else None for i in range(3000) if i % 7 == 0 or i % 5)
    assert collections.Counter(r.key for r in left.collect()) == want and left.columns == rows.columns
