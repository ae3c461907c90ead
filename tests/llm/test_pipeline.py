import collections
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from beamloom.llm import mixing, quality
from tests_llm_support import brute_components, exact_keepers

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 7)))
    docs, labels = [], []
    bases = [[word() for _ in range(rng.choice([40, 150, 900]))] for _ in range(60)]
    for i in range(300):
        words = list(rng.choice(bases)) if rng.random() < 0.6 else [word() for _ in range(rng.choice([30, 200]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = word()
        good = rng.random() < 0.8
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i * 7 % 300, text.replace(" ", "\n", rng.choice([0, 2])), "en", "big" if rng.random() < 0.6 else rng.choice(["b", "c"]), len(text)))
        if rng.random() < 0.6:
            labels.append((docs[-1][0], int(good)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    rows = {d[0]: d for d in corpus(spark, tmp_path)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert k == 4 or docs.columns == columns
    ids = {name: collections.Counter(r.doc_id for r in found) for name, found in seen.items()}

    scored = quality.classify(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert ids["quality"] == {r.doc_id: 1 for r in scored if r.predicted}
    assert 0.6 * len(rows) < len(ids["quality"]) < 0.95 * len(rows)
    assert set(ids["exact_copies"]) == exact_keepers({i: rows[i][1] for i in ids["quality"]})
    labels = brute_components([(i, rows[i][1]) for i in ids["exact_copies"]], 5, 80, 100)
    assert set(ids["near_copies"]) == {i for i, (_, c) in labels.items() if i == c}
    plan = mixing.mix_plan(spark.read.parquet(f"{tmp_path}/near_copies")).collect()
    assert ids["source_mix"] == collections.Counter(r.doc_id for r in plan) and set(ids["source_mix"]) == set(ids["near_copies"])
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(n * (len(whole.encode(rows[i][1], add_special_tokens=False).ids) + 1) for i, n in ids["source_mix"].items())
    assert sum(r.length for r in seen["packing"]) == tokens
    filled = collections.Counter()
    for r in seen["packing"]:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-tokens // 2048) + 1
    assert all(r.text == rows[r.doc_id][1] for name in list(seen)[:4] for r in seen[name])

    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert collections.Counter(map(key, run)) == collections.Counter(map(key, seen["packing"]))


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x y", None, None, 3)]
    for name, rows in (("none", []), ("odd", odd)):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert re.fullmatch(r"\[\]|.+", str(docs.collect()))
        assert (docs.count() > 0) == bool(rows)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"word{i % 5000} stays." for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Some words of a text without id."), (None, None), (4, long), (5, long), (6, long + " more"), (7, "Some words."), (7, "Some words."), (7, "Other words."), (8, "x" * 700_000)]
    rows += [(100 + i, f"A plain text of number {i} and nothing else, which says {i * 7}.") for i in range(30)]
    extra = ["key", "tag", "hash", "score", "kept", "component", "rows", "copy", "digest", "__key", "__copy", "__whole", "__source", "__word", "__bits", "batch", "node", "x y", "part", "rank", "length"]
    data = [(i, t, "en", ("a", "b", None)[k % 3], len(t or ""), *[k] * len(extra)) for k, (i, t) in enumerate(rows)]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{e}` int" for e in extra]]
    docs = spark.createDataFrame(data, ", ".join(names)).repartition(3)
    spark.createDataFrame([(100 + i, 1) for i in range(25)] + [(1, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(path := f"{tmp_path}/{empty}-{name}")
            now = spark.read.parquet(path)
            left = collections.Counter(r.doc_id for r in now.select("doc_id").collect())
            if name == "exact_copies" and not empty:
                # one of all blank or empty texts, which is one text here apart from the blank one; one of the long ones; one of id 7's two equal ones
                assert left[5] == 0 and left[4] == left[6] == 1 and left[7] == 2 and left[2] == 0 and left[1] == left[3] == 1 and left[None] == 1
            if name == "near_copies" and not empty:
                assert left[6] == 0 and left[4] == 1 and left[1] == left[3] == 1
        assert (now.count() == 0) == empty
