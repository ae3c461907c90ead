import collections
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beamloom.llm import languages as lg
from beamloom.llm import queries
from tests_llm_support import WORDS

SYLLABLES = {"aa": ["tion", "the", "ing", "er"], "bb": ["schk", "ung", "keit", "ß"], "cc": ["ción", "ñor", "que"], "dd": ["при", "вет", "ская"]}


def text_in(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def training(seed=1, rows=200):
    rng = random.Random(seed)
    return [(i, text_in(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(1, 60)), lang) for i in range(rows)]


def plain_grams(word):
    """Grams of orders 1 to 3 of a lower-cased word, with the edges of its letter runs."""
    out = [[], [], []]
    padded = [c if c.isalpha() else "" for c in word] + [""]
    before, before2 = "", ""
    for c in padded:
        if c or before:
            out[0].append(c), out[1].append(before + "|" + c), out[2].append((before2 if before else "") + "|" + before + "|" + c)
        before2, before = before, c
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n\tßñ1.-при 世İ"), max_size=25), min_size=1, max_size=6))
def test_words_and_grams_of_texts(texts):
    texts = [t.lower() for t in texts]
    got, plain = lg.words_of(texts), [(k, m) for k, t in enumerate(texts) for m in WORDS.finditer(t)]
    assert list(zip(got.text, got.begin, got.end)) == [(k, m.start(), m.end()) for k, m in plain]
    assert got.letters.tolist() == [sum(c.isalpha() for c in m[0]) for _, m in plain]
    first = [next((c for c in m[0] if c.isalpha()), None) for _, m in plain]
    assert [lg.NAMES[s] for s, c in zip(got.script, first) if c] == [next((n for n, a, b in lg.SCRIPTS if a <= ord(c) <= b), "other") for c in first if c]
    for k in range(3):  # equal grams have equal buckets, and as many as the plain ones lie in each word
        seen = collections.defaultdict(set)
        for w, (_, m) in enumerate(plain):
            own = got.buckets[k][got.of == w]
            assert len(own) == len(plain_grams(m[0])[k])
            for g, b in zip(plain_grams(m[0])[k], own):
                seen[g].add(int(b))
        assert all(len(b) == 1 for b in seen.values())


def plain_viterbi(scores, switch):
    value, back = list(scores[0]), []
    for row in scores[1:]:
        best = max(range(len(value)), key=lambda k: (value[k], -k))
        back.append([k if value[k] >= value[best] - switch else best for k in range(len(value))])
        value = [max(value[k], value[best] - switch) + row[k] for k in range(len(value))]
    at = max(range(len(value)), key=lambda k: (value[k], -k))
    out = [at]
    for step in reversed(back):
        out.append(at := step[at])
    return out[::-1]


def worth(scores, labels, switch):
    return sum(s[k] for s, k in zip(scores, labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(0, 10**6), st.sampled_from([0.0, 1.0, 3.0]), st.sampled_from([1, 64, 1 << 20]))
def test_viterbi_is_the_best_labelling(languages, sizes, seed, switch, table):
    rng, before = np.random.default_rng(seed), lg.TABLE
    scores = rng.integers(-6, 1, (sum(sizes), languages)).astype(float)
    try:
        lg.TABLE = table
        got, at = lg.viterbi(scores, np.array(sizes), switch), 0
    finally:
        lg.TABLE = before
    for n in sizes:
        own, at = slice(at, at + n), at + n
        if n:
            assert got[own].tolist() == plain_viterbi(scores[own].tolist(), switch)
            assert worth(scores[own], got[own], switch) == worth(scores[own], plain_viterbi(scores[own].tolist(), switch), switch)


def test_model_and_scores_by_plain_counts(spark):
    """The model's logarithms and word scores, from grams counted one by one."""
    rows = [(1, "tion ing", "aa"), (2, "Ung tion", "bb"), (3, None, "aa"), (4, "x", None), (5, "при", "dd"), (6, "ing", "aa")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, place int").repartition(3)
    model = lg.train(docs)
    assert model.names == ("aa", "bb", "dd")
    counts = {lang: [collections.Counter(g for _, t, own in rows if own == lang and t for w in t.lower().split() for g in plain_grams(w)[k]) for k in range(3)] for lang in model.names}
    word = "tiong"

    def log(lang, k, gram):
        own = counts[lang][k]
        return math.log((own[gram] + lg.SMOOTHING) / (sum(own.values()) + lg.SMOOTHING * lg.BUCKETS))

    plain = {lang: sum(log(lang, k, g) for k in range(3) for g in plain_grams(word)[k]) / 3 for lang in ("aa", "bb")}
    got = dict(zip(model.names, model.scores(lg.words_of([word]))[0]))
    assert got["aa"] - got["bb"] == pytest.approx(plain["aa"] - plain["bb"], abs=1e-4)
    assert got["dd"] == pytest.approx(min(got["aa"], got["bb"]) - lg.NARROWED)  # its letters are of another script
    assert model.scores(lg.words_of(["12 ..."])).tolist() == [[0.0] * 3] * 2


def test_spans_of_mixed_texts(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame(training(), "doc_id long, text string, lang string").repartition(4)
    model = lg.train(docs)
    mixed, want = [], {}
    for i in range(20):
        langs = rng.sample(list(SYLLABLES), 3)
        parts = [text_in(rng, lang, rng.randint(8, 90)) for lang in langs]
        text, want[i] = (" 12 " if langs[0] == "dd" else " İ 12 ") + " \n".join(parts), langs
        mixed.append((i, text, 0))
    table = spark.createDataFrame([*mixed, (99, None, 0), (98, " 12", 0)], "doc_id long, text string, lang int")
    got = collections.defaultdict(list)
    for r in lg.spans(table, model).orderBy("doc_id", "start").collect():
        got[r.doc_id].append(r)
    assert set(got) == set(range(20)) and [[r.lang for r in got[i]] for i in range(20)] == [want[i] for i in range(20)]
    for i, text, _ in mixed:
        cut = [text[r.start : r.end] for r in got[i]]
        assert re.split(r"\s+", " ".join(cut)) == text.split()


def test_predictions_and_odd_rows(spark):
    rng = random.Random(6)
    rows = training(2)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 ;", "zz"), (903, "y" * 700_000, None), (904, text_in(rng, "cc", 60_000), None), (None, text_in(rng, "dd", 3), None), (905, "世界", None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in (*rows, *odd, odd[4])], "doc_id long, text string, lang string, score int, held_out int").repartition(3)
    found = lg.identify(docs).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in (*rows, *odd, odd[4]))
    got = {r.doc_id: r for r in found}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) > 0.97 * len(rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[904].lang_pred == "cc" and got[None].lang_pred == "dd" and got[905].lang_pred in {*SYLLABLES, "zz"}
    assert all(0 <= r.score <= 1 for r in found) and got[904].score > 0.9
    assert lg.identify(docs.limit(0)).collect() == []
    untaught = docs.withColumn("lang", docs["lang"].substr(100, 0)).filter("lang <> ''")
    assert {r.lang_pred for r in lg.predict(docs, lg.train(untaught)).collect()} == {"und"}


def test_registered_query_on_held_out_documents(spark):
    """Held-out accuracy; a held-out row's own language changes nothing."""
    sf = "/root/testdata/sf0.001"
    told = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_language_spans(spark, sf).collect()
    held = [r for r in got if r.held_out and told[r.doc_id] is not None]
    assert len(held) > 30 and np.mean([r.lang_pred == told[r.doc_id] for r in held]) > 0.95
