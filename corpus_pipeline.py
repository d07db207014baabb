"""Corpus pipeline: toxic documents go, one document of each near-duplicate group
stays, repeated strings are cut, and what is left is packed into sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ligandspark.llm import packing, simhash, suffix_dedup, toxicity
from ligandspark.llm.common import table, written
from ligandspark.llm.queries import WORD_BPE
from ligandspark.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.RADIUS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return suffix_dedup.cut_repeats(docs, suffix_dedup.LENGTH, suffix_dedup.PASSAGE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack(docs, WORD_BPE, packing.CAPACITY, packing.END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None    # a trained classifier and a tokenizer decide; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
