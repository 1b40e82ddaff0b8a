"""A training-text pipeline: quality rules, exact dedup, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage works on all rows that the one before kept. Quality rules drop what they reject; exact dedup keeps the
largest id of equal texts; of documents that the Jaccard join links, the smallest id stays; substring dedup takes
words out of texts (a text without words left goes); packing returns one row per piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import chosenpath, exact, packing, quality, substring
from sievework.llm.common import documents
from sievework.session import materialise, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail; repeated rows are judged one by one; an empty
    table gives an empty result."""
    prepare(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id; null and empty texts are equal; of rows that repeat id and
    text one stays; an empty table gives an empty result."""
    prepare(spark)
    return exact.keep_one(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; null and empty texts and rows without an
    id are linked to nothing; an empty table gives an empty result."""
    prepare(spark)
    return chosenpath.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; a document that loses every word goes, one without
    words or an id stays as it is; an empty table gives an empty result."""
    prepare(spark)
    return substring.cut_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 ids (a null or empty text: the end id only) and their places in sequences; repeated rows
    are pieces of their own; an empty table gives an empty result."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=0)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The quality stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
