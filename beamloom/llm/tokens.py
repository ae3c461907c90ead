"""Whole texts to token ids with the tokenizers library, on the executors.

The library's own encoder spends most of its time on normalising whole texts. A text is therefore cut at white space,
where this family of vocabularies always cuts too, and each distinct word is encoded once by the library's model and
kept in the Python worker's cache, which is bounded in bytes. Chunks outside the plain Latin range, and chunks which
might hold a special token, go through the library's whole encoder. Vocabularies that do not drop white space always use
the latter.

Defined results: a null text is empty; very long texts are encoded whole; ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import returned, sliced, whole_text

ID = np.dtype("<u4")
#: Python's split() cuts at these characters, the vocabularies' patterns don't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Fixed value: the pattern of the vocabulary files whose chunks can be encoded alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this character, text is in normal form C and the libraries agree on letters and their lower case.
PLAIN_END = "ɐ"
BEYOND = re.compile(f"[{PLAIN_END}-\U0010ffff]").search
#: A generation of the cache takes about so many bytes; ENTRY_BYTES are those of an entry beside its key's and value's.
#: Two generations of LARGE_CACHE are about 300 MB a worker, for jobs that do little but tokenise.
CACHE_BYTES, LARGE_CACHE, ENTRY_BYTES = 24_000_000, 150_000_000, 180
#: Marks that a word's chunk often ends with; the pattern takes a run of them as one piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer words aren't kept.
LONGEST_KEPT = 48


def tokenizer_spec(path: str) -> str:
    """The text of a tokenizers file; it travels to executors by broadcast, so they need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def as_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and number the others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Kept(dict):
    """A bounded cache of two generations: when the young one is full it becomes the old one, whose entries return on use."""

    def __init__(self, limit: int):
        self.limit, self.room, self.old = limit, limit, {}

    def keep(self, key: str, value: bytes) -> bytes:
        self.room -= len(key) + len(value) + ENTRY_BYTES
        if self.room < 0:
            self.old = self.copy()
            self.clear()
            self.room = self.limit
        self[key] = value
        return value


class Encoder(_Kept):
    """White-space-free lower-case chunk -> ids; plain words and runs of marks are kept, in about twice `limit` bytes."""

    def __init__(self, spec: str, limit: int = CACHE_BYTES):
        import regex
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.whole = Tokenizer.from_str(spec)
        known = json.loads(spec)
        cut = [x.get("pattern", {}).get("Regex") for x in (known.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        steps = [x["type"] for x in (known.get("normalizer") or {}).get("normalizers", [])]
        self.by_chunk = WORD_PATTERN in cut and steps == ["NFC", "Replace", "Lowercase"]
        self.special = [t["content"] for t in known.get("added_tokens", [])]
        self.words = regex.compile(WORD_PATTERN)
        self.tokenize, self.letters = self.whole.model.tokenize, _byte_letters()

    def _encoded(self, text: str) -> bytes:
        return as_ids(self.whole.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        elif not word.isalnum():
            word = word.translate(self.letters)
        return as_ids([t.id for t in self.tokenize(word)])

    def __missing__(self, chunk: str) -> bytes:
        value = self.old.get(chunk)
        if value is not None:
            return self.keep(chunk, value)
        if not chunk.isalpha():
            word = chunk.rstrip(MARKS)
            if word.isalpha():  # and one run of marks
                return self[word] + self[chunk[len(word) :]]
            if len(cut := self.words.findall(chunk)) > 1:
                return b"".join(map(self.__getitem__, cut))
        value = self._word(chunk)
        return value if len(chunk) > LONGEST_KEPT else self.keep(chunk, value)

    def _plain(self, text: str) -> bool:
        """Whether a text or chunk, once lower-cased, can be encoded chunk by chunk."""
        return (text.isascii() or not BEYOND(text)) and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or any(c in text for c in NOT_SPACE) or any(s in text and (" " in s or s != s.strip()) for s in self.special):
            return self._encoded(text)
        if self._plain(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join([self[c.lower()] if self._plain(c) else self._encoded(c) for c in text.split()])


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(spec: str, limit: int) -> Encoder:
    """This Python worker's encoder; later tasks of the worker find its cache filled."""
    key = hash(spec), limit
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec, limit)
    return _encoders[key]


def encoded_batches(batches: Iterator[pa.RecordBatch], spec: str, end_id: int, limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """Batches of (doc_id, text) to (ids of documents, their token ids followed by end_id)."""
    encode, end = encoder(spec, limit).encode, np.array([end_id], ID).tobytes()
    for batch in batches:
        for some in sliced(batch, 1):
            yield some.column(0).to_pylist(), [encode(t) + end for t in some.column(1).to_pylist()]
    returned()


def token_rows(docs: DataFrame, spec: str, end_id: int, work, schema: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """docs(doc_id, text) through work(encoded batches) -> Arrow batches of `schema`."""
    shared = SparkContext._active_spark_context.broadcast(spec)

    def run(batches):
        return work(encoded_batches(batches, shared.value, end_id, cache_bytes))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)
