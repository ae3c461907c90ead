import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from beamloom.llm import toxicity

BAD = ["grumblor", "vexnik", "ploth"]


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([30, 80, 200]))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 12) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD).capitalize() + rng.choice(["", ",", "!"])
        docs.append((i, " ".join(words), True))
        labels.append((i, int(toxic)))
    return docs, labels


def test_finds_toxic_documents_and_grades_them(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame([*rows, (900, None, True), (901, "", True), (None, "vexnik ploth grumblor " * 6, True)], "doc_id long, text string, toxic boolean").repartition(3)
    labels = spark.createDataFrame([m for m in marks if m[0] % 4] + [(1, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 3
    by = {r.doc_id: r for r in got}
    held = [(by[i], y) for i, y in marks if i % 4 == 0]
    assert np.mean([r.toxic == bool(y) for r, y in held]) > 0.97
    assert all(0 <= r.severity <= toxicity.GRADES and 0 <= r.grade <= toxicity.GRADES and r.toxic == (r.probability >= 0.5) for r in got)
    assert by[None].severity > 2 and not by[900].toxic and by[900].severity == by[901].severity
    few, many = "ee tao " * 60 + "vexnik vexnik", "ee tao " * 60 + "vexnik ploth grumblor " * 5
    again = spark.createDataFrame([*rows, (1, few, True), (2, many, True)][-2:] + rows, "doc_id long, text string, toxic boolean")
    scores = [r.severity for r in toxicity.score_toxicity(again, labels).collect() if r.doc_id in (1, 2)]
    assert max(scores) > min(scores)


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [(r.severity, r.toxic) for r in toxicity.score_toxicity(docs, labels).collect()] == [(0.0, False)]
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []


def test_gradient_reaches_the_likelihoods_maximum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grades = np.digitize(2 * x + rng.logistic(size=3000), [-1.0, 0.5, 2.0])
    w, theta = toxicity.fit_ordinal(np.arange(3000), np.zeros(3000, int), x, grades, 1, decay=0.0, steps=800)
    assert abs(w[0] - 2) < 0.25 and np.allclose(theta, [-1, 0.5, 2], atol=0.25)


def test_only_near_copies_count_as_one(spark, monkeypatch):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(4000)]
    smallest = names[int(np.argmin([w[0].view(np.int64) for w in toxicity.word_hashes(pa.array(names), toxicity.NOT_LETTER)]))]
    texts = [" ".join([smallest, *rng.sample(names, 60)]) for _ in range(60)]  # unrelated but for one word
    texts += [texts[0], texts[1] + " " + names[0], texts[2].upper(), "", "  ", "12 34"]  # three copies, two without words, numbers only
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 or i >= 60)) for i in range(len(texts))], "doc_id long, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, columns, values, grades, features: fitted.append(len(grades)) or (np.zeros(features), np.zeros(max(grades))))
    toxicity.train(docs, labels)
    # a clean text and its toxic copy both stay: ids 0 and 60, 2 and 62; 1 and 61 are one; 63 and 64 are one
    assert fitted == [60 + 2 + 0 + 1 + 1]


def test_words_that_one_class_never_has_enter_the_vocabulary(spark):
    """However few documents the other class has."""
    rng = random.Random(7)
    names = ["".join(rng.choice("etaoin") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join([*rng.sample(names, 40), *(["vexnik"] * 2 if i < 5 else [])]) for i in range(87)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 11)) for i in range(87)], "doc_id long, toxic int")
    word = next(toxicity.word_hashes(pa.array(["vexnik"]), toxicity.NOT_LETTER)).view(np.int64)[0]
    assert word in toxicity.train(docs, labels).vocabulary.hashes
    one = lambda ones, docs, toxic, clean: spark.range(1).select(toxicity.root_g(F.lit(ones), F.lit(docs), toxic, clean)).first()[0]
    assert one(320, 320, 2000, 200) > toxicity.LEAST_Z and one(320, 352, 2000, 200) < 1e-6
    table = np.array([[5, 7], [6, 69]])
    expected = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
    assert abs(one(5, 12, 11, 76) - np.sqrt(2 * (table * np.log(table / expected)).sum())) < 1e-9


def test_a_very_long_text_is_scored_whole(spark):
    """Insults at the end of a text of some megabytes count as they do in a short one."""
    words, rng = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], random.Random(3)
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" vexnik ploth" if i % 4 == 0 else "")) for i in range(120)]
    long, short = " ".join(["zzz"] * 900_000) + " vexnik ploth", "zzz vexnik ploth"
    docs = spark.createDataFrame([*rows, (1000, long), (1001, short), (1002, long[:-13])], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[1000].severity == got[1001].severity and got[1000].toxic and not got[1002].toxic
