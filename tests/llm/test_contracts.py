"""The registered queries on the smallest tables: columns, types, every row, and brute force where SQL has no form."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from beamloom.llm import quality, queries, toxicity
from beamloom.llm.shingles import word_hashes
from tests_llm_support import brute_components, plain_secrets
from tools.compare import plain

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_block_matrix_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_ordinal_toxicity": "doc_id bigint, severity double, grade int, probability double, toxic boolean",
    "op4_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_quality_discriminant": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_huffman_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op8_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_temperature_mixing": "doc_id bigint, source string, n_tokens bigint, copy int, block bigint, position_tokens bigint",
    "op13_language_spans": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op11_partial_distance_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall())


@pytest.fixture(scope="module")
def token_ids(texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: whole.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def run(spark, name):
    df = queries.queries()[name](spark, SF)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert {**kinds, **dict(c.split() for c in COLUMNS[name].split(", "))} == kinds
    return df.collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = db.sql(queries.oracle_sql()[name])
    rows = run(spark, name)
    assert sorted((tuple(plain(r[c]) for c in found.columns) for r in rows), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op2_secret_scan", "op3_ordinal_toxicity", "op5_quality_discriminant", "op13_language_spans"])
def test_one_row_a_document(spark, texts, name):
    assert sorted(r.doc_id for r in run(spark, name)) == sorted(texts)


def test_secrets(spark):
    """Against plain expressions over whole strings, digest and counts included; the smallest tables have no secrets."""
    more = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.op2_secret_scan(spark, more).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{more}/documents.parquet')").fetchall())
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 5
    for i, t in texts.items():
        base, r = plain_secrets(t or ""), rows[i]
        counts = [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")] == (joined.split(",") if joined else [])


def test_quality_scores(spark, texts):
    """The registered scores are those of class moments and densities worked out by whole matrices."""
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{SF}/labels.parquet') WHERE quality IN (0, 1)").fetchall())
    ids = sorted(texts)
    x = dict(zip(ids, quality.statistics_of(pa.array([texts[i] or "" for i in ids]))))
    train = [i for i in marks if zlib.crc32(str(i).encode()) % 5]
    own = [np.array([x[i] for i in train if marks[i] == c]) for c in (0, 1)]
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in own) / len(train)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    parts = []
    for v in own:
        shrunk = (0.9 * np.cov(v.T, bias=True) + 0.1 * pooled) / np.outer(scale, scale) + 0.05 * np.eye(len(scale))
        parts.append((v.mean(axis=0), np.linalg.inv(shrunk), np.log(len(v) / len(train)) - np.linalg.slogdet(shrunk)[1] / 2))
    for r in run(spark, "op5_quality_discriminant"):
        logs = [p[2] - 0.5 * ((x[r.doc_id] - p[0]) / scale) @ p[1] @ ((x[r.doc_id] - p[0]) / scale) for p in parts]
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 2, -500, 500))), abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_statistics_of_a_text():
    """The first statistics, counted plainly."""
    text = "Ab cd! cd\n\nXy, 12 é\n"
    got = dict(zip(quality.NAMES, quality.statistics_of(pa.array([text]))[0]))
    words = text.split()
    want = {"chars": np.log1p(len(text)), "upper": np.sqrt(2 / 9), "lower": np.sqrt(6 / len(text)), "digit": np.sqrt(2 / len(text)), "line_ends": np.sqrt(3 / len(text)),
            "exclaims": np.sqrt(1 / len(text)), "word_length": np.log1p(sum(map(len, words)) / len(words)), "distinct_lines": 1.0}
    assert {k: pytest.approx(got[k]) for k in want} == want


def test_toxicity_scores(spark, texts):
    """The registered severities are those of the model's weights over bags of words counted plainly."""
    model = toxicity.train(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    place = {int(h): k for k, h in enumerate(model.vocabulary.hashes)}
    code = lambda w: int(next(word_hashes(pa.array([w]), toxicity.NOT_LETTER)).view(np.int64)[0])
    for r in run(spark, "op3_ordinal_toxicity"):
        counts = collections.Counter(re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in texts[r.doc_id] or "")))
        linear = sum(model.weights[place[h]] * np.log1p(n) for w, n in counts.items() if (h := code(w)) in place)
        assert r.severity == pytest.approx((1 / (1 + np.exp(-(linear - model.thresholds)))).sum(), abs=1e-9)


def test_toxicity_training(spark, texts):
    """Training once more in plain Python: copies, bags, ranking, grades; and a fit of another kind, which does hardly better."""
    marks = dict(duckdb.sql(f"SELECT doc_id, toxic FROM read_parquet('{SF}/labels.parquet') WHERE toxic IN (0, 1)").fetchall())
    own = [(i, texts[i]) for i in sorted(marks) if i in texts]
    groups = {(c if n else None, marks[i]): i for i, (n, c) in reversed(brute_components(own, 3, 85, 100).items())}
    bags = {i: collections.Counter(re.findall(r"[a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in texts[i] or ""))) for i in groups.values()}
    n = [sum(marks[i] == k for i in bags) for k in (0, 1)]
    docs, ones = collections.Counter(w for b in bags.values() for w in b), collections.Counter(w for i, b in bags.items() for w in b if marks[i])

    def statistic(w):
        cells = [(ones[w], docs[w], n[1]), (docs[w] - ones[w], docs[w], n[0]), (n[1] - ones[w], sum(n) - docs[w], n[1]), (n[0] - docs[w] + ones[w], sum(n) - docs[w], n[0])]
        return max(0.0, 2 * sum(x * np.log(x * sum(n) / (row * column)) for x, row, column in cells if x)) ** 0.5

    chosen = sorted(w for w in docs if docs[w] >= toxicity.LEAST_DOCS and statistic(w) >= toxicity.LEAST_Z)
    odds = {w: np.log((ones[w] + 0.5) / (n[1] + 1)) - np.log((docs[w] - ones[w] + 0.5) / (n[0] + 1)) for w in chosen}
    code = lambda w: int(next(word_hashes(pa.array([w]), toxicity.NOT_LETTER)).view(np.int64)[0])
    model = toxicity.train(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))
    place = {int(h): k for k, h in enumerate(model.vocabulary.hashes)}
    assert 3 < len(chosen) <= toxicity.VOCABULARY and set(place) == {code(w) for w in chosen}
    assert all(model.vocabulary.odds[place[code(w)]] == pytest.approx(odds[w]) for w in chosen)

    hits = {i: sum(b[w] for w in chosen if odds[w] > toxicity.INDICATIVE) for i, b in bags.items()}
    cuts = sorted(set(np.quantile([hits[i] for i in bags if marks[i]], [1 / 3, 2 / 3])))
    raw = {i: 1 + sum(c < hits[i] for c in cuts) if marks[i] else 0 for i in bags}
    grade = np.array([sorted(set(raw.values())).index(raw[i]) for i in bags])
    x = np.array([[np.log1p(b[w]) for w in chosen] for b in bags.values()])

    def loss(w, theta):
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        below = lambda e: 1 / (1 + np.exp(-np.clip(e - x @ w, -60, 60)))
        return -np.mean(np.log(np.maximum(below(edges[grade + 1]) - below(edges[grade]), 1e-12))) + 2.5e-5 * w @ w

    size, top = len(chosen), grade.max()
    assert len(model.thresholds) == top
    cut = lambda p: (p[:size], p[size] + np.concatenate([[0], np.cumsum(np.exp(p[size + 1 :]))]))
    p, step = np.concatenate([np.zeros(size), [1.0], np.zeros(top - 1)]), 1.0
    for _ in range(400):  # steepest descent with numeric gradients
        gradient = np.array([(loss(*cut(p + e)) - loss(*cut(p - e))) / 2e-5 for e in 1e-5 * np.eye(len(p))])
        while step > 1e-9 and loss(*cut(p - step * gradient)) > loss(*cut(p)) - 0.1 * step * gradient @ gradient:
            step /= 2
        p, step = p - step * gradient, 2 * step
    fitted = loss(model.weights[[place[code(w)] for w in chosen]], model.thresholds)
    assert fitted <= 1.05 * loss(*cut(p)) and fitted < 0.9 * loss(np.zeros(size), np.log((np.arange(top) + 1.0) / (top - np.arange(top))))


def test_near_duplicates(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op4_minhash_near_dedup")}
    assert got == brute_components(list(texts.items()), 3, 85, 100)


def test_token_files(spark, token_ids):
    got, start = {r.doc_id: tuple(r) for r in run(spark, "op6_huffman_token_files")}, 0
    for i, ids in sorted(token_ids.items()):
        data = np.array([*ids, 1], "<u4")
        assert got.pop(i) == (i, start, len(data), zlib.crc32(data.tobytes()))
        start += len(data)
    assert not got


def test_packing(spark, token_ids):
    got = run(spark, "op8_best_fit_packing")
    want = {(i, k, at): zlib.crc32(np.array([*ids, 0], "<u4")[at : at + 2048].tobytes()) for i, ids in token_ids.items() for k, at in enumerate(range(0, len(ids) + 1, 2048))}
    assert {(r.doc_id, r.piece, r.start): r.ids_crc32 for r in got} == want
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (s2, o2, _) in zip(spots, spots[1:]):
        assert o + n <= 2048 and o2 == (o + n if s2 == s else 0)


def test_mixing(spark, texts):
    got = run(spark, "op10_temperature_mixing")
    assert {r.doc_id for r in got} == set(texts)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert all(r.n_tokens == words[r.doc_id] for r in got)
