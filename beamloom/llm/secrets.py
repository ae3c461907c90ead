"""Secret scan: an Aho-Corasick keyword prefilter, anchored expressions only at its hits, embedded checksums last.

Texts are scanned as UTF-8 bytes. Every pattern is ASCII, so bytes give the same matches as code points, and lower-case
folding touches A-Z only; offsets of the few spans found are turned into code points at the end. The automaton reports
where keywords begin; each kind's expression is tried at those places only, from left to right and never inside the
kind's last match, which yields its leftmost non-overlapping matches. Runs of hexadecimal digits have no keyword: every
sixth byte is tested, and only four neighbours in a row that are all digits start the expression.

Kinds, in listed order: assign (a named value), access (access key ids), hex (long digests), and tokens whose last
characters are a checksum of the rest: github and npm (base-62 CRC-32 of the random part). A token with a wrong
checksum gives no span.

Defined results: a null or empty text has no spans; a very long text is scanned whole; of matches of one kind that overlap
the leftmost counts; repeated rows and ids give a row each; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, whole_text

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3

# Keywords, the expressions tried at them, and the digits of checksums.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]{24,}"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

HEX_DIGIT = np.zeros(256, bool)
HEX_DIGIT[list(b"0123456789abcdef")] = True
HEX_LEAST, STRIDE = 24, 6


def checksum62(payload: bytes) -> bytes:
    """CRC-32 of the payload as six base-62 digits."""
    value, digits = zlib.crc32(payload), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return "".join(reversed(digits)).encode()


def _valid(kind: str, found: re.Match) -> bool:
    if kind == "assign":
        return len(found[2]) >= 6
    if kind == "access":
        return len(found[0]) >= 20
    return checksum62(found[1]) == found[2]


@cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def _hex_runs(data: bytes) -> Iterator[tuple[int, int]]:
    if len(data) < HEX_LEAST:
        return
    dots = HEX_DIGIT[np.frombuffer(data, np.uint8)[::STRIDE]]
    rows = len(dots) - HEX_LEAST // STRIDE + 1
    near = dots[:rows].copy()
    for k in range(1, HEX_LEAST // STRIDE):
        near &= dots[k : k + rows]
    end = 0
    for at in np.flatnonzero(near) * STRIDE:
        if at >= end:
            start = int(at)
            while start > end and HEX_DIGIT[data[start - 1]]:
                start -= 1
            if found := PATTERNS["hex"].match(data, start):
                yield found.span()
            end = found.end() if found else int(at) + 1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by kind as listed."""
    data = text.encode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in _automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last - length + 1)
    spans = [("hex", *span) for span in _hex_runs(data)]
    for kind, starts in hits.items():
        end = 0
        for start in sorted(starts):
            if start >= end and (found := PATTERNS[kind].match(data, start)):
                end = found.end()
                if _valid(kind, found):
                    spans.append((kind, start, end))
    if not spans:
        return []
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    if len(data) == len(text):
        return spans
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points begun up to each byte
    return [(kind, int(begins[a]) - 1, int(begins[a]) - 1 + (b - a)) for kind, a, b in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, checked array<string>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans found in every row of docs(doc_id, text); checked: the matched texts of kinds with a valid checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find_spans(text)
                base = [s for s in spans if s[0] in KINDS[:BASE]]
                counts = [sum(s[0] == kind for s in base) for kind in KINDS[:BASE]]
                checked = [text[a:b] for kind, a, b in spans if kind not in KINDS[:BASE]]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), checked))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.string())]
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[p.split()[0] for p in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs["text"]).alias("text")).mapInArrow(lean(run), SCHEMA)
