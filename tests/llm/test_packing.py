import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from beamloom.llm import packing, tokens
from beamloom.llm.tokens import Encoder, tokenizer_spec

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "Hello, World's  end\tit'll 12 x² ½", "ÉÀ İstanbul ΣΑΣ ς", "été ñ", "<|startoftext|> x<|endoftext|>y",
    "a\x1cb \x1f\x85c d", "日本語 テキスト", "Ǆ ǅ ß ẞ ﬁ", "😀😀 👍🏽", "x" * 300, "don't DON'T we'RE", "a b​c", "ªº _a_b__", "ﷺ ½",
]


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms), sorted(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.randint(1, max(1, capacity // 5)) for _ in range(rng.choice([1, 30, 400]))]
    counts = collections.Counter(lengths)
    plan, bins = packing.best_fit_plan(counts, capacity)
    room = np.full(bins, capacity)
    spots = collections.defaultdict(list)
    for length in counts:
        covered = 0
        for _, a, b, first, each, at in plan[plan[:, 0] == length]:
            covered += b - a
            for turn in range(b - a):
                spots[first + turn // each].append((at + turn % each * length, length))
                room[first + turn // each] -= length
        assert covered == counts[length]
    for places in spots.values():
        at = 0
        for start, length in sorted(places):
            assert start == at
            at += length
    assert (bins, sorted(room)) == plain_best_fit(lengths, capacity)


def test_random_texts_encode_as_by_the_library():
    rng = random.Random(11)
    whole, mine = Tokenizer.from_file(PATH), tokens.Encoder(tokenizer_spec(PATH), limit=50_000)
    alphabets = ["abcdefghij", "ABCxyz", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?'\"()-_/\\", "éüßñÅŒÿİıſ", "日本ΣσςДд", "\u0301\u200d\ufeff\xa0\x85\x1c\x1f", "🙂👍🏽", "’“”…", "ſƀɏɐ"]
    for k in range(12_000):
        some = "".join(rng.sample(alphabets, rng.randint(1, 4))) + " " * rng.randint(0, 6)
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 40)))
        if k % 50 == 0:
            text += rng.choice(["<|endoftext|>", "don't I'll we've 'S 'LL", "[CLS]", "</s>"]) + text
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert sum(len(k) + len(v) + tokens.ENTRY_BYTES for k, v in mine.items()) <= 50_000


def test_chunks_encode_as_the_whole_text():
    whole, mine = Tokenizer.from_file(PATH), Encoder(tokenizer_spec(PATH), limit=5)
    for text in [*ODD, " ".join(ODD)]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pack_documents(spark):
    rng = random.Random(1)
    texts = [*ODD, None] + [" ".join(rng.choice(["the", "onin", "Theas,", "é"]) for _ in range(n)) for n in (3000, 5, 5, 60, 4100, 2047, 700)]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = packing.pack_documents(docs, tokenizer_spec(PATH), capacity=256, end_id=0).collect()
    whole = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 256)):
            some = ids[at : at + 256]
            want[doc_id, piece, at, len(some), zlib.crc32(some.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(filled) == plain_best_fit([r.length for r in got], 256)[0]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer_spec(PATH)).collect() == []
