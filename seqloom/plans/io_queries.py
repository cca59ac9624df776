"""Round trips through sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.registry import query
from seqloom.sources import io
from seqloom.sources.staging import staged_path
from seqloom.sources.tables import table


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return staged_path(spark, "io")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch(spark)
    io.write_csv(rows, path)
    return io.read_csv(spark, path, rows.schema)


@query("SELECT doc_id::VARCHAR AS audio_filepath, n_chars::DOUBLE AS duration, text FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("audio_filepath"), F.col("n_chars").cast("double").alias("duration"), "text")
    io.append_jsonl(rows.where("duration < 1000"), path)
    io.append_jsonl(rows.where("duration >= 1000"), path)
    return io.read_jsonl(spark, path)


@query("SELECT vec_id, embedding, label FROM embeddings")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    io.save_index(table(spark, sf_dir, "embeddings"), path)
    return io.load_index(spark, path)


@query("SELECT doc_id, length(text) AS n FROM documents")
def resumed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark)
    work = lambda rows: rows.select("doc_id", F.length("text").cast("long").alias("n"))
    step = F.floor(F.col("doc_id") / 500)
    io.resume(docs.where("doc_id % 3 = 0"), path, "doc_id", work, step)
    return io.resume(docs, path, "doc_id", work, step)


@query("SELECT o_custkey AS name, o_totalprice AS sequence_accuracy, o_orderkey::DOUBLE AS avg_latency FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_totalprice").alias("sequence_accuracy"), F.col("o_orderkey").cast("double").alias("avg_latency")), scratch(spark)
    io.append_results(rows.where("avg_latency % 2 = 0"), path, "2024-01-01_000000")
    io.append_results(rows.where("avg_latency % 2 = 1"), path, "2024-01-02_000000")
    stored = spark.read.parquet(path)
    old = io.update_latest(None, stored.where("run_at = '2024-01-01_000000'").drop("run_at"), ["name"])
    return io.update_latest(old, stored.where("run_at = '2024-01-02_000000'").drop("run_at"), ["name"])
