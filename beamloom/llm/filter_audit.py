"""Filter interaction audit: what each filter removes under every order of application, by Walsh-Hadamard sums.

A document's mask has a bit for each filter that it fails. Spark aggregates, per part and label, a signed sum for each
of the 2^n parities: sum over documents of (-1)^(ones of mask AND parity). The sums are additive, so the aggregate is
partial before its shuffle, and a part with a third of all rows is as cheap as any. They are inverted exactly to the
number of documents with each mask; all orders and steps follow from those cells: a filter removes at its step the
documents that fail it and none before. A document failing k filters is removed by each of them in n!/k of the n!
orders, which gives Shapley values in closed form.

The last filter fails documents whose text any smaller id has, table-wide. Texts are grouped by SHA-256: rows of an id
first, then the ids of a text within a part and label, then the smallest id of the text over those few rows; the first
two are partial aggregates, so a text with a third of all rows is no task of its own.

Defined results: a null text is empty and a null source the empty string; a null id never fails the last filter nor makes
others fail it; repeated rows of one id don't make each other fail; of several labels of an id each 1 counts; labels that
are null count as 0; very long texts are taken whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, whole_text

#: Of a document's text, words and distinct words: conditions under which it fails.
FILTERS = {
    "A": lambda text, words, distinct: words < 50,
    "B": lambda text, words, distinct: 100 * distinct < 65 * words,
    "C": lambda text, words, distinct: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
    "D": lambda text, words, distinct: F.regexp_like(text, F.lit("[#$%&*|]")),
}
#: The filter of texts that a smaller id has.
REPEATED = "E"


def _sign(mask: Column, parity: Column) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(parity)) % 2)


def failing(docs: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """(doc_id, part, digest, mask) of each document; mask: a bit for each filter it fails, the first's the lowest."""
    words = F.filter(F.split("text", WS), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text().alias("text"))
    rows = rows.withColumn("words", words)
    counted = rows.select("doc_id", "part", "text", F.size("words").cast("long").alias("words"), F.size(F.array_distinct("words")).cast("long").alias("distinct"))
    mask = F.lit(0)
    for bit, condition in enumerate(filters.values()):
        mask = mask + F.when(condition(F.col("text"), F.col("words"), F.col("distinct")), 1 << bit).otherwise(0)
    return counted.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def parity_sums(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """(part, good, toxic, sums): the 2^n signed sums of each part and label."""
    bits = len(filters)
    one = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(f"{name}_one")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(one("quality"), one("toxic"))
    rows = failing(docs, filters)
    rows = rows.join(marks, rows["doc_id"] == marks["of"], "left")
    flags = [F.coalesce(f"{name}_one", F.lit(False)).alias(to) for name, to in (("quality", "good"), ("toxic", "toxic"))]
    label = ["part", "good", "toxic"]
    ids = rows.select("part", *flags, "digest", "mask", "doc_id").groupBy(*label, "digest", "mask", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))).alias("first")
    unnamed = F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("unnamed")
    texts = ids.groupBy(*label, "digest", "mask").agg(first, unnamed, F.sum("rows").alias("rows"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    own = F.when(F.col("first.doc_id") == least, F.col("first.rows")).otherwise(0)
    texts = texts.select(*label, "mask", (F.coalesce(own, F.lit(0)) + F.col("unnamed")).alias("once"), "rows")
    again = F.col("mask").bitwiseOR(F.lit(1 << bits))
    signed = [F.sum(F.col("once") * _sign(F.col("mask"), F.lit(w)) + (F.col("rows") - F.col("once")) * _sign(again, F.lit(w))) for w in range(2 << bits)]
    names = [f"s{w}" for w in range(2 << bits)]
    sums = texts.groupBy(*label).agg(*[s.alias(n) for s, n in zip(signed, names)])
    return sums.select(*label, F.array(*names).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, documents): the exact inverse of parity_sums()."""
    size = F.size("sums")
    rows = sums.select("part", "good", "toxic", "sums", F.explode(F.sequence(F.lit(0), size - 1)).alias("mask"))
    terms = F.zip_with("sums", F.sequence(F.lit(0), size - 1), lambda s, w: s * _sign(F.col("mask"), w))
    total = F.aggregate(terms, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("part", "good", "toxic", "mask", F.call_function("div", total, size).alias("documents"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part of
    docs(doc_id, source, text), order of all filters and step; labels(doc_id, quality, toxic)."""
    names = "".join(filters) + REPEATED
    counted = lambda condition: F.sum(F.when(condition, F.col("documents")).otherwise(0))
    found = cells(parity_sums(docs, labels, filters)).groupBy("part", "mask").agg(
        F.sum("documents").alias("n"), counted(F.col("good")).alias("good"), counted(F.col("toxic")).alias("toxic")
    )
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n cells a part
    orders = F.array(*[F.lit("".join(order)) for order in itertools.permutations(names)])
    rows = parts.select("part", "cells", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), F.substring("filter_order", at, F.lit(1))) - 1)
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda i: i < F.col("step")), F.lit(0), lambda a, i: a.bitwiseOR(bit(i)))
    rows = rows.select("*", bit(F.col("step")).alias("own"), before.alias("before"))

    def total(value, *conditions) -> Column:
        held = F.col("cells")
        for condition in conditions:
            held = F.filter(held, condition)
        return F.aggregate(held, F.lit(0).cast("long"), lambda a, c: a + value(c))

    count = lambda c: c["n"]
    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    passed = lambda c: c["mask"].bitwiseAND(F.col("before")) == 0
    share = math.factorial(len(names))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(count, passed, lambda c: ~fails(c)).alias("kept"),
        total(count, passed, fails).alias("removed"),
        total(count, fails, lambda c: ~passed(c)).alias("redundant"),
        total(count, lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: c["good"], passed, fails).alias("good_lost"),
        total(lambda c: c["toxic"], passed, fails).alias("toxic_lost"),
        total(lambda c: c["n"] * F.call_function("div", F.lit(share), F.bit_count(c["mask"])), fails).alias("shapley"),
    )
