"""Bloom filters as tables, built and probed by DataFrame operations only.

A filter of `words` 64-bit words is a table (word, bits). A key's 64-bit hash picks one word and four bits of it. A key
that was put in is always found; others rarely are, at KEY_BITS bits a key. A filter of at most MOST_WORDS words is
broadcast, which bounds what is sent whatever the number of keys (a fuller filter holds back less, never too much);
those of index runs grow with their run and are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KEY_BITS = 16
#: Words of a filter that is broadcast: at most about 40 MB.
MOST_WORDS = 1 << 20


def words_for(keys: int) -> int:
    return max(1, -(-keys * KEY_BITS // 64))


def _probe(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key and its bits."""
    drawn = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(4):
        place = F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.pmod(F.xxhash64(key), F.lit(words)), mask


def build(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits) of keys; words are combined before the shuffle."""
    word, mask = _probe(F.col(key), words)
    return keys.select(word.alias("word"), mask.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe_in(rows: DataFrame, key: Column, table: DataFrame, words: int, how: str = "left_semi") -> DataFrame:
    """rows whose key may have been put into the filter (left_semi), or the others (left_anti)."""
    word, mask = _probe(key, words)
    side = table.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    side = F.broadcast(side) if words <= MOST_WORDS else side
    return rows.join(side, (word == side["__word"]) & (side["__bits"].bitwiseAND(mask) == mask), how)


def bounded(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A written filter of a size that may be broadcast."""
    words = min(MOST_WORDS, words_for(keys.count()))
    return written(build(keys, key, words), "filter"), words


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def without(docs: DataFrame, key: Column, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose key is one of dropped(key). Only rows that may be among them are shuffled."""
    table, words = bounded(dropped, "key")
    name = free_name(docs, "__key")
    keyed = docs.withColumn(name, key)
    doubtful = maybe_in(keyed, keyed[name], table, words)
    sure = maybe_in(keyed, keyed[name], table, words, "left_anti")
    kept = doubtful.join(dropped.select(F.col("key").alias(name)), name, "left_anti")
    return sure.select(*columns_of(docs)).unionByName(kept.select(*columns_of(docs)))


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
