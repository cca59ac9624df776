"""Corpus pipeline: quality classifier, SimHash near-duplicates, surrogates for personal data, packing.

What all stages do with odd tables: every column may be null; null texts count as empty; texts of any length are read
whole; rows that repeat are rows of their own, with equal or null ids too; an empty table gives an empty result; other columns,
whatever their names, are kept by all stages but the last, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import packing, pii, quality, simhash
from seqloom.llm.common import read_table, stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on labels, accepts; all of them where labels do not show both kinds.

    Null sources and languages are sites of their own.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents, the one with the smallest doc_id stays; of equal ones the first row.

    A document without an id stays only where its whole group has none. Null texts and texts without words are one group.
    """
    return simhash.keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text and is null where that is."""
    return pii.pseudonymise(docs, found_col=None).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in the packed sequences; an empty document is one piece of one id."""
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("near_dedup", near_dedup), ("surrogates", surrogates), ("pack", pack)]

#: The classifier, fingerprints, surrogates and packing are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
