import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from beamloom.llm import quality


def corpus(n=500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([20, 90, 400]))]
        good = rng.random() < 0.7
        text = " ".join(words).capitalize() + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(words[:1] * len(words))])
        docs.append((i, text, 0.5))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_filter(spark):
    rows, marks = corpus()
    rows += [(1000, "", 0.1), (1001, None, 0.1), (None, rows[0][1], 0.1), (5, rows[5][1], 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([*marks, (2000, 1), (3, None), (4, 7)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_density_difference_is_that_of_full_covariances():
    rng = np.random.default_rng(1)
    x = [rng.normal(c, 1 + c, (200, 3)) for c in (0, 1)]
    model = quality.Discriminant(np.array([200.0, 200]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.2, 0.1, 1.5)
    own = [np.cov(v.T, bias=True) for v in x]
    pooled = (own[0] + own[1]) / 2
    at, logs = rng.normal(0, 2, 3), []
    for c in (0, 1):
        cov = 0.8 * own[c] + 0.2 * pooled + 0.1 * np.diag(np.diag(pooled))
        gap = at - x[c].mean(0)
        logs.append(-0.5 * (gap @ np.linalg.solve(cov, gap) + np.linalg.slogdet(cov)[1]))
    assert model.score(at[None])[0] == pytest.approx(1 / (1 + np.exp(-(logs[1] - logs[0]) / 1.5)))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (None, None, 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, labels).collect()] == [0.5, 0.5]
    assert quality.classify(docs.limit(0), labels).collect() == [] and quality.keep_good(docs.limit(0), labels).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.predicted for r in quality.classify(docs, one).collect()] == [1, 1]
    assert quality.statistics_of(pa.array(["", " \n", "é" * 600000])).shape == (3, len(quality.NAMES))
