"""Toxicity: cumulative-link ordinal regression over sparse text features, with the expected severity as output.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector shared by all ordered thresholds. Features are words
(runs of letters, A-Z as a-z, by 64-bit hash) with the logarithm of one plus their counts. The labels say
toxic or not; grades of severity are derived from them: documents labelled 0 have grade 0, those labelled 1 have grade
1 to GRADES by thirds of their number of indicative words, which are words whose smoothed log odds over training
documents exceed a limit. Near copies count as one training document, else the words of a text that was copied often
would pass for indicative: labelled documents are linked by their shingle sets as in near_dedup (COPIES; texts without
words are copies of each other), and one document of each component and label is read. The expected severity is the sum
over k of P(grade > k); a document is toxic where P(grade > 0) is at least 1/2.

Training reads at most MAX_ROWS labelled documents (a documented bound; smallest hash of the id first; of an id with
several texts, one); only their ids are broadcast, and only VOCABULARY words, chosen by an aggregate over all their words, reach the driver. Scoring covers
every document's whole text.

Defined results: a null text is empty and scores the bias; labels that are null or not 0 or 1 are ignored; without
labels of both classes all severities are 0; very long texts are scored whole; of words that indicate equally the smaller
hash enters the vocabulary; repeated rows are scored each, and count once in training; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, lean, scratch, settings, whole_text, written
from .near_dedup import near_duplicates
from .shingles import NOT_LETTER, word_hashes

MAX_ROWS = 20_000
VOCABULARY = 2048
GRADES = 3
LEAST_DOCS = 4
#: Near copies: words in a shingle, similarity of the sets.
COPIES = (3, (85, 100))
#: Words whose root_g() is at least so large may enter the vocabulary.
LEAST_Z = 3.0
INDICATIVE = 2.0


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(distinct word hashes, counts, words) of each text."""
    for words in word_hashes(column, NOT_LETTER):
        found, counts = np.unique(_signed(words), return_counts=True)
        yield found, counts, len(words)


class Vocabulary:
    """Chosen words, ascending by hash, with their log odds."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], odds[order]

    def row(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of a bag's words that are in the vocabulary."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0)
        place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = self.hashes[place] == found
        return place[known], counts[known]

    @staticmethod
    def values(counts: np.ndarray) -> np.ndarray:
        return np.log1p(counts)


class OrdinalModel:
    """Shared weights and ascending thresholds."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def above(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and threshold k."""
        linear = np.array([self.weights[p] @ Vocabulary.values(c) for f, t, _ in _bags(column) for p, c in [self.vocabulary.row(f, t)]])
        return 1 / (1 + np.exp(-np.clip(linear.reshape(-1, 1) - self.thresholds, -500, 500)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, decay: float = 5e-5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood weights and thresholds (Adam on all rows at once). Thresholds ascend by positive gaps."""
    top, n = int(grades.max()), len(grades)
    freq = np.array([(grades > k).mean() for k in range(top)])
    first = np.log((1 - freq[0]) / freq[0])
    gaps = np.log(np.maximum(np.diff(np.log((1 - freq) / freq)), 0.05))
    params = np.concatenate([np.zeros(features), [first], gaps])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    sigma = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    for step in range(1, steps + 1):
        w, theta = params[:features], params[features] + np.concatenate([[0.0], np.cumsum(np.exp(params[features + 1 :]))])
        linear = np.bincount(rows, values * w[columns], n)
        upper = np.concatenate([theta, [np.inf]])[grades]
        lower = np.concatenate([[-np.inf], theta])[grades]
        hi, lo = np.where(np.isinf(upper), 1.0, sigma(upper - linear)), np.where(np.isinf(lower), 0.0, sigma(lower - linear))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_linear = (d_hi - d_lo) / n
        g_w = np.bincount(columns, values * d_linear[rows], features) + decay * w
        g_theta = np.array([(d_lo[grades == k + 1].sum() - d_hi[grades == k].sum()) / n for k in range(top)])
        g_gaps = np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(params[features + 1 :])
        gradient = np.concatenate([g_w, [g_theta.sum()], g_gaps])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        params = params - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return params[:features], params[features] + np.concatenate([[0.0], np.cumsum(np.exp(params[features + 1 :]))])


def root_g(ones: Column, docs: Column, toxic: int, clean: int) -> Column:
    """Square root of the likelihood ratio statistic of a word in `ones` of the toxic and `docs` of all documents.

    About a standard normal's size where word and label are independent. It grows with the square root of the number of
    documents, whichever class is small: a word that one class never has is not held down by that class's size.
    """
    n = float(toxic + clean)
    cells = [(ones, docs, toxic), (docs - ones, docs, clean), (toxic - ones, n - docs, toxic), (clean - docs + ones, n - docs, clean)]
    parts = [F.when(x > 0, x * F.log(x * n / (row * float(column)))).otherwise(0.0) for x, row, column in cells]
    return F.sqrt(F.greatest(2 * sum(parts[1:], parts[0]), F.lit(0.0)))


def severity_grades(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """0 for clean documents; toxic ones by thirds of their indicative words. A third that is empty has no grade."""
    cuts = np.unique(np.quantile(hits[toxic == 1], [i / GRADES for i in range(1, GRADES)]))
    return np.unique(np.where(toxic == 1, 1 + np.searchsorted(cuts, hits, side="left"), 0), return_inverse=True)[1]


def without_copies(labelled: DataFrame) -> DataFrame:
    """One row of each component of near copies and label of labelled(row, toxic, text); equal rows may share a row number."""
    linked = near_duplicates(labelled.select(F.col("row").alias("doc_id"), "text"), *COPIES)
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))  # null: no words
    groups = linked.groupBy(F.col("doc_id").alias("row")).agg(F.min(group).alias("group"))
    kept = labelled.select("row", "toxic").join(groups, "row").groupBy("group", "toxic").agg(F.min("row").alias("row")).select("row", "toxic")
    return labelled.dropDuplicates(["row", "toxic"]).join(kept, ["row", "toxic"], "left_semi")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY) -> OrdinalModel | None:
    """An ordinal model of labels(doc_id, toxic); None where a class has no labelled document."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def bags(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, _ = zip(*_bags(batch.column(1))) if batch.num_rows else ((), (), ())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64))) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["toxic", "words", "counts"])

    # the sample has at most max_rows ids; each gives one row under each of its labels, however often it is repeated
    first = F.min(F.struct(F.xxhash64("doc_id", "text").alias("row"), "text")).alias("first")
    labelled = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(first).select("first.row", "toxic", "first.text")
    with settings(docs.sparkSession, **SMALL_BATCHES), scratch(docs.sparkSession) as keep:
        labelled = written(labelled, "labelled")
        single = without_copies(labelled)
        bag = written(single.select("toxic", "text").mapInArrow(lean(bags), "toxic int, words array<long>, counts array<long>"), "bags")
        keep.append(bag)
    docs_of = {r["toxic"]: r["n"] for r in bag.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(docs_of) < 2:
        return None
    odds = F.log((F.col("ones") + 0.5) / (docs_of[1] + 1.0)) - F.log((F.col("docs") - F.col("ones") + 0.5) / (docs_of[0] + 1.0))
    counted = bag.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("ones"), F.count(F.lit(1)).alias("docs"))
    counted = counted.filter(F.col("docs") >= LEAST_DOCS).withColumn("odds", odds).withColumn("z", root_g(F.col("ones"), F.col("docs"), docs_of[1], docs_of[0])).filter(F.col("z") >= LEAST_Z)
    chosen = counted.orderBy(F.desc("z"), "word").limit(vocabulary).select("word", "odds").toPandas()
    words = Vocabulary(chosen["word"].to_numpy(np.int64), chosen["odds"].to_numpy(float))

    def sparse(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for y, found, counts in zip(*(c.to_pylist() for c in batch.columns)):
                place, count = words.row(np.array(found, np.int64), np.array(counts, np.int64))
                rows.append((y, place.tolist(), Vocabulary.values(count).tolist(), int(count[words.odds[place] > INDICATIVE].sum())))
            types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["toxic", "places", "vals", "hits"])

    data = bag.mapInArrow(sparse, "toxic int, places array<long>, vals array<double>, hits long").toArrow().combine_chunks()
    toxic, hits = data.column("toxic").to_numpy(), data.column("hits").to_numpy()
    grades = severity_grades(toxic, hits)
    rows = np.repeat(np.arange(len(toxic)), pa.compute.list_value_length(data.column("places")).to_numpy())
    columns, values = (pa.concat_arrays([c.flatten() for c in data.column(x).chunks]).to_numpy() for x in ("places", "vals"))
    weights, thresholds = fit_ordinal(rows, columns, values, grades, len(words.hashes))
    return OrdinalModel(words, weights, thresholds)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, severity, grade, probability, toxic) for every row of docs(doc_id, text).

    severity: expected grade, 0 to GRADES; grade: the likeliest; probability: of a grade above 0; toxic: at least 1/2.
    """
    model = train(docs, labels, max_rows, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.above(batch.column(1)) if model else np.zeros((batch.num_rows, 1))
            each = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            columns = [batch.column(0), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0].copy()), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "probability", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, severity double, grade int, probability double, toxic boolean")
