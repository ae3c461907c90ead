"""A corpus pipeline of five stages: quality, exact copies, near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read as the next one's docs. All but the
last return the columns of documents, in their order, whatever further columns there are.

Defined results, of every stage: null texts are empty ones; null ids, empty and very long texts, repeated rows and empty
tables are taken as the operator of the stage defines them (see its docstring); no stage fails on them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from beamloom.llm import common
from beamloom.llm.exact_dedup import drop_copies
from beamloom.llm.mixing import mix
from beamloom.llm.near_dedup import drop_near_copies
from beamloom.llm.packing import pack_documents
from beamloom.llm.quality import keep_good
from beamloom.llm.tokens import tokenizer_spec

#: Scratch tables of the stage before; its result has been written once the next stage begins.
_scratch: list[str] = []


def _stage(work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        if not any(path.rpartition("/")[2] in f for path in _scratch for f in read):
            common.release(spark, _scratch)
        _scratch.clear()
        before = common.table_paths(spark)
        try:
            return work(spark, docs, sf_dir)
        finally:
            _scratch.extend(p for p in common.table_paths(spark) if p not in before)

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: rows of equal texts go or stay together."""
    return keep_good(docs, common.table(spark, sf_dir, "labels"))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, the smallest id's; of repeated rows one."""
    return drop_copies(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), the smallest id's, with all the rows
    of that id; documents without words or id stay."""
    return drop_near_copies(docs, shingle_words=5, similarity=(80, 100))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again until the mix has its target entropy."""
    return mix(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their places in sequences of 2048."""
    return pack_documents(docs, tokenizer_spec(public_tokenizers.path("word_bpe_49k.json")), capacity=2048, end_id=0)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("packing", packing)]

#: SQL can't express the classifier, near copies and the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder, last = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", ""
    common.deleted_at_exit(spark, folder)  # the last stage's table is what the caller reads
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if last:
            common.release(spark, [last])
        last = path
    return docs
