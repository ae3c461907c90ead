import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from beamloom.llm import token_files as tf
from beamloom.llm.tokens import tokenizer_spec

PATH = public_tokenizers.path("word_bpe_49k.json")


def huffman_cost(counts):
    import heapq

    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_code_lengths(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, [2, 5, 1000, 10**6][seed % 4], rng.integers(2, 400))
    counts[:2] = 1
    lengths = tf.code_lengths(counts, 16)
    assert (lengths > 0).tolist() == (counts > 0).tolist() and lengths.max() <= 16
    assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
    if lengths.max() < 16:
        assert int((lengths * counts).sum()) == huffman_cost(counts)
    tight = tf.code_lengths(2 ** np.arange(20), 6)
    assert tight.max() == 6 and sum(2.0 ** -int(n) for n in tight) == 1


def test_block_round_trip(monkeypatch):
    monkeypatch.setattr(tf, "CHECKPOINT", 5)
    rng = np.random.default_rng(0)
    docs = [np.minimum(rng.geometric(0.05, n), 299).astype("<u4") for n in (0, 1, 4, 5, 6, 400, 0, 33)]
    lengths = tf.code_lengths(np.bincount(np.concatenate(docs), minlength=300))
    codes = tf.canonical_codes(lengths)
    parts = tf.encode(docs, lengths, codes)
    for d, (code, marks) in zip(docs, parts):
        alone, own = tf.encode([d], lengths, codes)[0]
        bits = "".join(f"{codes[i]:0{lengths[i]}b}" for i in d.tolist())
        assert code == alone == int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")
        assert marks.tolist() == own.tolist() == [sum(int(lengths[i]) for i in d[:k].tolist()) for k in range(0, len(d), 5)]
    names = [None, 5, 6, 7, 8, 9, -1, 2**62]
    payload = tf.pack_block(names, [len(d) for d in docs], [p[0] for p in parts], [p[1] for p in parts])
    back, tokens, ids = tf.unpack_block(payload, tf.decoding_table(lengths))
    assert back == names and tokens.tolist() == [len(d) for d in docs]
    assert np.array_equal(ids, np.concatenate(docs))


def test_more_ids_than_short_codes():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 9, 70_000)
    lengths = tf.code_lengths(counts)
    assert lengths.max() == 17 and lengths.min() > 0
    ids = rng.integers(0, 70_000, 5000).astype("<u4")
    code, marks = tf.encode([ids], lengths, tf.canonical_codes(lengths))[0]
    assert np.array_equal(tf.unpack_block(tf.pack_block([1], [len(ids)], [code], [marks]), tf.decoding_table(lengths))[2], ids)


def test_a_repeated_id_is_split_over_files(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_TOKENS", 400)
    docs = spark.createDataFrame([(7, " ".join(["the"] * (i % 9) + [f"x{i}"])) for i in range(300)] + [(8, "z")], "doc_id long, text string").repartition(3)
    files = tf.write_token_files(docs, tokenizer_spec(PATH), end_id=1)
    assert files.blocks().select("file").distinct().count() > 2
    got = sorted(tuple(r)[1:3] for r in files.digests().collect())
    assert [a for a, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))] and got[-1][1] < 10
    assert [n for _, n in got[:-1]] == sorted(n for _, n in got[:-1])


def test_files(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_TOKENS", 3000)
    rng = random.Random(2)
    texts = ["", None, "a", "été 日本 <|endoftext|>", " \n"] + [" ".join(rng.choice(["the", "Onin.", "x9", "tion"]) for _ in range(rng.choice([3, 50, 2500]))) for _ in range(40)]
    rows = [(i * 17 % 45 if i != 4 else None, t, 0) for i, t in enumerate(texts)]
    rows.append((1000, "the Onin. " * (tf.BLOCK_TOKENS // 3), 0))  # longer than a block
    docs = spark.createDataFrame(rows, "doc_id long, text string, file int").repartition(3)
    files = tf.write_token_files(docs, tokenizer_spec(PATH), end_id=1)
    got = {r.doc_id: tuple(r) for r in files.digests().collect()}
    ids = {r.doc_id: r.ids for r in files.ids().collect()}
    whole, start = Tokenizer.from_file(PATH), 0
    assert len(got) == len(rows) and files.blocks().select("file").distinct().count() > 2
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[doc_id] == (doc_id, start, len(want), zlib.crc32(want.tobytes())) and ids[doc_id] == want.tolist()
        start += len(want)
    assert tf.write_token_files(docs.limit(0), tokenizer_spec(PATH), end_id=1).digests().collect() == []
