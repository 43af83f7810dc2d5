"""A corpus from raw documents: what to keep, how to mix it, its tokens.

Every stage reads all rows that the one before it kept and does its part on the
whole of them; the tables beside ``documents`` (``labels``) come from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from modelwatch.llm import bpe, mix, neardup, quality, toxicity
from modelwatch.llm.common import table
from modelwatch.session import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of the text and of its host reject go."""
    return quality.keep_documents(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the labels of those still here."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, Jaccard of 0.8 or more) the document
    with the least id stays."""
    return neardup.without_near_duplicates(docs, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each pass over a document, cut where only a part is
    taken, so that the words of each source add up to its target."""
    return mix.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts of the mixture."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_group),
    ("source_mix", mixed_sources),
    ("bpe_encoding", encoded),
]

#: SQL can't train the classifier, so there is none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
