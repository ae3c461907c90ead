"""Language identification: script ranges narrow the candidates of a word, Viterbi labels spans of mixed-language text.

A word (a run between white space) is scored for each language by its letter n-grams: the logarithms of their smoothed
shares among the language's n-grams, averaged over the orders 1 to 3, where a gram may begin or end with the edge of a run
of letters. The script of its first letter leaves those languages as candidates that write at least LEAST_SHARE of their
letters in it (all, if none does); the others fall NARROWED below the worst candidate. Words without letters say nothing.
Viterbi then finds the labels of a document's words with the greatest sum of scores, less SWITCH for each change of
language. Equal neighbours are one span.

A document's language is the one whose spans hold the most letters (ties to the smaller name). Its score is that share
of the letters times the probability of the language, against the others, from the scores of its own words.

Training is one pass: a task counts n-grams by language in arrays of BUCKETS places for each order and language, and
sends the places that aren't zero, so a language with a third of all rows is no task of its own. Only these
(3 * BUCKETS numbers a language at most) reach the driver. Texts are taken as arrays of code points, a slice at a time.
Viterbi runs on all SEGMENT-word pieces of a slice at once: a piece is first a table of best sums from each language to
each, the tables are chained along each document, and then every piece is labelled from where it begins.

Defined results: a null text, or one without letters, is `und` with score 0, as is every text where nothing was learned;
rows whose lang is null teach nothing; an empty lang is a name like others; very long texts are taken whole; repeated
rows are labelled, and counted in training, each; of languages that score alike the smaller name counts; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket, lean, sliced

BUCKETS, ORDERS = 1 << 15, 3
SMOOTHING, LEAST_SHARE, NARROWED, SWITCH = 0.5, 0.005, 8.0, 8.0
SEGMENT = 64
#: Texts are taken about this many bytes at a time; tables of this many numbers are held while segments are chained.
STEP, TABLE = 1 << 18, 1 << 20
UNKNOWN = "und"
SCORE_SCHEMA = "doc_id long, lang_pred string, score double"

#: First and last code points of scripts, in the order of code points.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x2FA1F),
)
NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))
_FIRST, _LAST = (np.array([s[k] for s in SCRIPTS]) for k in (1, 2))
_SCRIPT = np.array([NAMES.index(s[0]) for s in SCRIPTS])

_KEYS = np.random.default_rng(20240613).integers(1, 2**63, ORDERS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_letters: list[np.ndarray] = []


def letters_below(limit: int = 0x33000) -> np.ndarray:
    """Whether each code point is a letter; made once a process. Above, there are no assigned letters but for ideographs."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(limit)]))
    return _letters[0]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Number of each code point's script in NAMES."""
    at = np.searchsorted(_FIRST, points, side="right") - 1
    return np.where((at >= 0) & (points <= _LAST[at]), _SCRIPT[at], 0)


@dataclasses.dataclass
class Words:
    """The words of some texts, one after the other: each one's text, first code point, letters and script; and grams."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    #: Of each place that has grams: its word, and the bucket for each order.
    of: np.ndarray
    buckets: np.ndarray


def words_of(texts: list[str]) -> Words:
    """Places count from the beginning of each lower-cased text."""
    joined = "".join(f"{t}\n" for t in texts)  # white space keeps texts apart and ends the last word
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if sys.byteorder == "big":
        points = points.byteswap()
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    inside = ~blank
    first = inside.copy()
    first[1:] &= blank[:-1]
    last = inside.copy()
    last[:-1] &= blank[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    known = letters_below()
    letter = known[np.minimum(points, len(known) - 1)]
    here = np.where(letter, points, 0)
    back = np.concatenate([[0], here[:-1]])
    back2 = np.where(back == 0, 0, np.concatenate([[0, 0], here[:-2]])) if len(here) > 1 else np.zeros_like(here)
    at = np.flatnonzero(letter | (back > 0))
    grams = [here[at].astype(np.uint64), back[at].astype(np.uint64), back2[at].astype(np.uint64)]
    buckets, total = np.empty((ORDERS, len(at)), np.int64), np.zeros(len(at), np.uint64)
    for k in range(ORDERS):
        total = total + grams[k] * _KEYS[k]
        mixed = total + np.uint64(k + 1)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _KEYS[ORDERS]
        buckets[k] = (mixed >> np.uint64(64 - 15)).astype(np.int64)
    of = np.searchsorted(begin, at, side="right") - 1
    counts = np.concatenate([[0], np.cumsum(letter)])
    inside_word = letter[at]
    lead = np.full(len(begin), -1)
    lead[of[inside_word][::-1]] = at[inside_word][::-1]
    script = np.where(lead >= 0, scripts_of(points[lead]), 0) if len(points) else lead
    text = np.searchsorted(begins, begin, side="right") - 1
    return Words(text, begin - begins[text], end - begins[text], counts[end] - counts[begin], script, of, buckets)


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    """names, in order; logs[order, bucket, language]; allowed[script, language]."""

    names: tuple[str, ...]
    logs: np.ndarray
    allowed: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """A row for each word, a column for each language; 0 for the best."""
        out = np.zeros((len(words.begin), len(self.names)))
        if len(words.of):
            each = self.logs[0][words.buckets[0]]
            for k in range(1, ORDERS):
                each = each + self.logs[k][words.buckets[k]]
            starts = np.flatnonzero(np.diff(words.of, prepend=-1))
            out[words.of[starts]] = np.add.reduceat(each, starts, axis=0, dtype=np.float64) / ORDERS
        out[words.letters == 0] = 0
        allowed = self.allowed[words.script] | (words.letters == 0)[:, None]
        worst = np.where(allowed, out, np.inf).min(axis=1, keepdims=True, initial=np.inf)
        out = np.where(allowed, out, worst - NARROWED)
        return out - out.max(axis=1, keepdims=True, initial=-np.inf) if len(out) else out


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each row of scores; sizes: rows of each document, one after the other. A label stays where changing it
    is no better, and of equal labels the smaller one counts."""
    languages = scores.shape[1]
    firsts = np.cumsum(sizes) - sizes
    first = np.concatenate([np.arange(f, f + n, SEGMENT) for f, n in zip(firsts, sizes)] or [np.zeros(0, int)]).astype(np.int64)
    if not len(first):
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), -(-sizes // SEGMENT))
    length = np.minimum(SEGMENT, (firsts + sizes)[doc] - first)
    order = np.argsort(-length, kind="stable")  # segments that are still going come first
    first, length, count = first[order], length[order], len(first)
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    going = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]

    # best sums from each language to each over a segment, chained to what each segment begins with
    enter = np.zeros((count, languages))
    step = max(1, TABLE // languages**2)
    now, leaves = None, np.zeros(languages)
    in_order = place  # segments in the order of documents
    for lot in range(0, count, step):
        own = in_order[lot : lot + step]
        by = np.argsort(-length[own], kind="stable")
        table = np.where(np.eye(languages, dtype=bool), 0.0, -np.inf)[None].repeat(len(own), axis=0)
        for t in range(int(length[own].max())):
            live = int(np.searchsorted(-length[own[by]], -t, side="left"))
            part = table[:live]
            np.maximum(part, part.max(axis=2, keepdims=True) - switch, out=part)
            part += scores[first[own[by[:live]]] + t][:, None, :]
        back = np.empty(len(own), np.int64)
        back[by] = np.arange(len(own))
        for k, s in enumerate(own):
            if doc[lot + k] != now:
                now, leaves = doc[lot + k], np.zeros(languages)
            enter[s] = leaves
            leaves = (leaves[:, None] + table[back[k]]).max(axis=0)
            leaves = leaves - leaves.max()

    value, moved, target = enter.copy(), [], []
    for live_at, live in enumerate(going):
        part = value[:live]
        best = part.argmax(axis=1)
        high = part[np.arange(live), best][:, None] - switch
        moved.append(high > part)
        target.append(best)
        value[:live] = np.where(moved[-1], high, part) + scores[first[:live] + live_at]
    # each segment's language before it, for every language after it; then the ones that hold, from the end
    came = np.tile(np.arange(languages), (count, 1))
    for t in range(len(going) - 1, -1, -1):
        own = came[: going[t]]
        came[: going[t]] = np.where(np.take_along_axis(moved[t], own, axis=1), target[t][:, None], own)
    leave, state = np.empty(count, np.int64), 0
    for k in range(count - 1, -1, -1):
        s = in_order[k]
        if k == count - 1 or doc[k + 1] != doc[k]:
            state = int(value[s].argmax())
        leave[s] = state
        state = int(came[s, state])
    labels, at = np.zeros(len(scores), np.int64), leave.copy()
    for t in range(len(going) - 1, -1, -1):
        live = going[t]
        labels[first[:live] + t] = at[:live]
        at[:live] = np.where(moved[t][np.arange(live), at[:live]], target[t], at[:live])
    return labels


def train(docs: DataFrame, buckets: int = BUCKETS) -> LanguageModel:
    """A model of docs(text, lang), of all rows whose lang isn't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in sliced(whole, 0, STEP)):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                words = words_of([t.lower() for t, own in zip(texts, langs) if own == lang])
                counts = grams.setdefault(lang, np.zeros((ORDERS, buckets), np.int64))
                for k in range(ORDERS):
                    counts[k] += np.bincount(words.buckets[k], minlength=buckets)
                scripts.setdefault(lang, np.zeros(len(NAMES)))
                scripts[lang] += np.bincount(words.script, words.letters, minlength=len(NAMES))
        for lang, counts in grams.items():
            for kind, values in (*enumerate(counts), (ORDERS, scripts[lang].astype(np.int64))):
                at = np.flatnonzero(values)
                columns = [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(values[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "place", "number"])

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text"), F.col("lang").cast("string").alias("lang"))
    sent = rows.mapInArrow(lean(run, 0), "lang string, kind int, place int, number long").groupBy("lang", "kind", "place").agg(F.sum("number").alias("number")).toArrow()
    names = tuple(sorted(set(sent.column("lang").to_pylist())))
    which = np.searchsorted(np.array(names, object), np.array(sent.column("lang").to_pylist(), object)) if names else np.zeros(0, int)
    kind, place, number = (sent.column(c).to_numpy() for c in ("kind", "place", "number"))
    counts = np.zeros((ORDERS, buckets, len(names)))
    own = kind < ORDERS
    counts[kind[own], place[own], which[own]] = number[own]
    written = np.zeros((len(NAMES), len(names)))
    written[place[~own], which[~own]] = number[~own]
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets))
    allowed = written >= LEAST_SHARE * np.maximum(1, written.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(names, logs.astype(np.float32), allowed)


def _labelled(texts: list[str | None], model: LanguageModel) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, scores, labels) of texts."""
    words = words_of([(t or "").lower() for t in texts])
    scores = model.scores(words)
    sizes = np.bincount(words.text, minlength=len(texts)) if len(texts) else np.zeros(0, int)
    return words, scores, viterbi(scores, sizes)


def _verdicts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    if not model.names:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    words, scores, labels = _labelled(texts, model)
    size = len(model.names)
    held = np.bincount(words.text * size + labels, words.letters, minlength=len(texts) * size).reshape(-1, size)
    total, best = held.sum(axis=1), held.argmax(axis=1)
    own = labels == best[words.text]
    sums = np.zeros((len(texts), size))
    for k in range(size):
        sums[:, k] = np.bincount(words.text[own], scores[own, k], minlength=len(texts))
    share = np.exp(np.minimum(0, sums - sums[np.arange(len(texts)), best][:, None])).sum(axis=1)
    score = np.where(total > 0, held.max(axis=1) / np.maximum(total, 1) / share, 0.0)
    return [model.names[b] if t else UNKNOWN for b, t in zip(best, total)], score.tolist()


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 1, STEP)):
            names, scores = _verdicts(batch.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SCORE_SCHEMA)


def spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, start, end, lang) of docs(doc_id, text): runs of words of one language, places in code points of the text,
    end exclusive. Words without letters belong to the run they are in; texts without letters have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, 1, STEP)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            if model.names:
                words, _, labels = _labelled(texts, model)
                plain = words_of([t or "" for t in texts])  # lower-casing may move places, but neither makes nor joins words
                told = np.bincount(words.text, words.letters, minlength=len(texts)) > 0
                new = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
                for a, b in zip(new, [*new[1:], len(labels)]):
                    if told[d := words.text[a]]:
                        out.append((ids[d], int(plain.begin[a]), int(plain.end[b - 1]), model.names[labels[a]]))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "end", "lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, start long, end long, lang string")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, lang); the fold held_out teaches nothing."""
    bucket = fold_bucket(F.col("doc_id"), folds)
    model = train(docs.filter(bucket != held_out))
    return predict(docs, model).select("doc_id", (fold_bucket(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
