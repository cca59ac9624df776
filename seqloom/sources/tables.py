"""Fixture tables and the views of them that the engine's operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import ascii_only, collapse_ws


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered corpus: grp, seq, txt (white space collapsed)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("seq"), collapse_ws(F.col("text")).alias("txt"))


def ascii_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("txt", collapse_ws(ascii_only(F.col("txt"))))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query fragments: qid, txt."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), collapse_ws(F.col("text")).alias("txt"))


def ascii_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).withColumn("txt", collapse_ws(ascii_only(F.col("txt"))))
