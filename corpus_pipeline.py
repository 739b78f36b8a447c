"""The corpus pipeline: documents from raw to packed, each stage written and read again.

Every stage takes all rows that its predecessor left, with any columns: a null text counts as empty, rows with a null or repeated doc_id are
judged by their texts, and an empty table gives an empty result. The module needs ``airlake.llm`` and fails to import without it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from airlake.llm.common import Scratch
from airlake.llm.exact_dedup import drop_exact_duplicates
from airlake.llm.minhash import drop_near_duplicates
from airlake.llm.packing import pack_documents
from airlake.llm.substring_dedup import drop_repeats
from airlake.llm.toxicity import drop_toxic, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labels outside the held-out fold, scores below 0.5."""
    return drop_toxic(docs, learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document, then the one of smallest id, of those that are equal without white space."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class of near copies; a null doc_id is a class of its own."""
    return drop_near_duplicates(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages and lines of 25 words or more that an earlier one has; what is left without words goes."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents; a repeated doc_id is packed row by row."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("substring_dedup", substring),
    ("packing", packing),
]

#: Word shingle sketches, a learned lexicon and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a Parquet table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{Scratch(spark).root}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
