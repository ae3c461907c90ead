"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics come from the whole text's bytes, words and lines: nothing else is read. Class means and covariances are
sums over all labelled training rows, made where the rows are. Each covariance is shrunk towards the pooled one and
towards a multiple of the unit matrix; its Cholesky factor is computed once and kept in the model. A score is the
logistic function of the difference of the two log densities (Mahalanobis distances by triangular products, log
determinants, log priors), divided by a temperature since statistics aren't independent.

Defined results: a null text is empty; the empty text has statistics of zero and a score like any other; labels that
are null or not 0 or 1 are ignored; where a class has no labelled row, every score is that of the other class (1/2
without labels); very long texts are measured whole; a score of exactly the threshold is predicted 1; repeated rows are
scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, fold_bucket, lean, returned, scratch, settings, sliced, whole_text, written
from .filters import bounded, maybe_in
from .shingles import word_hashes

# Byte classes.
KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#$%&*@^~+", b"|<>{}[]\\/=_", b"'\"()-`",
)
KIND = np.full(256, len(KINDS), np.uint8)
for _k, _bytes in enumerate(KINDS):
    KIND[list(_bytes)] = _k
KIND[0x80:0xC0] = len(KINDS) + 1  # the further bytes of a character

NAMES = (
    "chars", "upper", "lower", "digit", "line_ends", "stops", "exclaims", "symbols", "marks", "quotes", "other",
    "word_length", "spread", "distinct_words", "top_word", "repeats", "distinct_lines", "line_length",
)


def statistics(text: bytes, words: np.ndarray) -> list[float]:
    """Transformed statistics of one text: logarithms of sizes, square roots of shares."""
    counts = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=len(KINDS) + 2).astype(float)
    chars = max(1.0, counts[:-1].sum())
    spaces, n = counts[3] + counts[4], len(words)
    letters = max(1.0, counts[0] + counts[1] + counts[len(KINDS)])
    share = np.sqrt(counts[[0, 1, 2, 4, 5, 6, 7, 8, 9, len(KINDS)]] / chars)
    share[0] = np.sqrt(counts[0] / letters)
    if n:
        _, times = np.unique(words, return_counts=True)
        p = times / n
        distinct, top, spread = len(times) / n, p.max(), -(p * np.log(p)).sum()
        repeats = np.sqrt((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
    else:
        distinct = top = spread = repeats = 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    kept = len(set(lines)) / len(lines) if lines else 0.0
    length = chars / max(1, len(lines))
    tail = [np.log1p((chars - spaces) / max(1, n)), spread, distinct, np.sqrt(top), repeats, kept, np.log1p(length)]
    return [np.log1p(counts[:-1].sum()), *share.tolist(), *map(float, tail)]


def statistics_of(column: pa.Array) -> np.ndarray:
    texts = column.cast(pa.large_binary()).to_pylist()
    return np.array([statistics(t, w) for t, w in zip(texts, word_hashes(column))], float).reshape(-1, len(NAMES))


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, features) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_of(batch.column(1))
            offsets = pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(lean(run), "doc_id long, features array<double>")


class Discriminant:
    """Two Gaussian classes: means, inverse Cholesky factors of the shrunk covariances, log determinants and priors."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled_share: float, ridge: float, temperature: float):
        self.counts, self.temperature = counts, temperature
        if counts.min() < 1:
            return
        d = sums.shape[1]
        self.means = sums / counts[:, None]
        scatter = squares - counts[:, None, None] * self.means[:, :, None] * self.means[:, None, :]
        pooled = scatter.sum(axis=0) / counts.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        self.inverse, self.offset = [], []
        for c in (0, 1):
            own = scatter[c] / counts[c]
            shrunk = ((1 - pooled_share) * own + pooled_share * pooled) / np.outer(self.scale, self.scale)
            shrunk += ridge * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            self.inverse.append(np.linalg.inv(factor))
            self.offset.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like score of class 1."""
        if self.counts.min() < 1:
            value = 0.5 if self.counts.sum() == 0 else float(self.counts[1] > 0)
            return np.full(len(x), value)
        log = [o - 0.5 * ((((x - m) / self.scale) @ i.T) ** 2).sum(axis=1) for m, i, o in zip(self.means, self.inverse, self.offset)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / self.temperature, -500, 500)))


def fit(features: DataFrame, labels: DataFrame, pooled_share: float = 0.1, ridge: float = 0.05, temperature: float = 2.0) -> Discriminant:
    """Discriminant of labels(doc_id, quality) over features(doc_id, features). All training rows count.

    Tasks sum their rows' moments; sums meet per (class, place), of which there are 2 (1 + d + d^2) however many rows.
    """
    d = len(NAMES)
    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        keys = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(keys[0].ravel()), pa.array(keys[1].ravel()), pa.array(total.ravel())], names=["c", "k", "v"])

    moments = features.join(known, "doc_id").select("quality", "features").mapInArrow(run, "c long, k long, v double")
    total = np.zeros((2, 1 + d + d * d))
    for row in moments.groupBy("c", "k").agg(F.sum("v").alias("v")).collect():
        total[row["c"], row["k"]] = row["v"]
    return Discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), pooled_share, ridge, temperature)


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.filter(fold_bucket(F.col("doc_id")) != 0)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    with settings(docs.sparkSession, **SMALL_BATCHES):
        features = written(document_statistics(docs), "features")
    model = fit(features, training_rows(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that the classifier rejects. Texts stay where they are: they are scored again, not joined.

    The columns of docs stay, whatever their names; null, empty and very long texts, repeated rows and empty tables are as
    in classify().
    """
    spark = docs.sparkSession
    with scratch(spark), settings(spark, **SMALL_BATCHES):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        table, words = bounded(training_rows(labels).select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id")
        labelled = maybe_in(rows, rows["doc_id"], table, words)  # and a few others, which fit() drops
        model = fit(written(document_statistics(labelled), "features"), training_rows(labels))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = sliced(pa.RecordBatch.from_arrays([text], names=["text"]), 0)
        scores = np.concatenate([model.score(statistics_of(p.column(0))) for p in parts])
        returned()
        return pa.array(scores)

    return docs.filter(score(whole_text()) >= threshold)
