"""Sources and sinks: JSON, JSONL, CSV, text, result stores, checkpointed work, integrity gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators.evaluation import upsert_best

REF = T.StructType([T.StructField("surah", T.IntegerType()), T.StructField("ayah", T.IntegerType())])

#: One sample of a manifest.
SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("file", T.StringType()), T.StructField("surah", T.IntegerType()), T.StructField("ayah", T.IntegerType()), T.StructField("ayah_end", T.IntegerType()),
        T.StructField("category", T.StringType()), T.StructField("source", T.StringType()), T.StructField("expected_verses", T.ArrayType(REF)), T.StructField("also_accept", T.ArrayType(T.ArrayType(REF))),
        T.StructField("reciter", T.StringType()), T.StructField("ratio", T.DoubleType()), T.StructField("duration_s", T.DoubleType()),
    ]
)
CORPUS_ROW = T.StructType([T.StructField(n, t) for n, t in (("surah", T.IntegerType()), ("ayah", T.IntegerType()), ("text_uthmani", T.StringType()), ("text_clean", T.StringType()), ("surah_name", T.StringType()), ("surah_name_en", T.StringType()))])
TRAINING = T.StructType([T.StructField("audio_filepath", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("text", T.StringType())])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a JSON manifest; expected_verses defaults to the sample's own row."""
    whole = spark.read.schema(T.StructType([T.StructField("samples", T.ArrayType(SAMPLE))])).json(path, multiLine=True)
    rows = whole.select(F.explode("samples").alias("s")).select("s.*")
    return rows.withColumn("expected_verses", F.coalesce("expected_verses", F.array(F.struct("surah", "ayah"))))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS_ROW).json(path, multiLine=True)


def read_nested_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A staged REST answer of groups that hold rows, flattened."""
    rows = spark.read.json(path, multiLine=True).select(F.explode("data.surahs").alias("s"))
    return rows.select(F.col("s.number").alias("surah"), F.col("s.name").alias("surah_name"), F.explode("s.ayahs").alias("a")).select("surah", "surah_name", F.col("a.numberInSurah").alias("ayah"), F.col("a.text").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = TRAINING) -> DataFrame:
    """One object a line; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)


def read_sorted(spark: SparkSession, path: str, order: Column, n: int) -> DataFrame:
    """First n rows of a table in a fixed order: the deterministic form of a scan that stops early."""
    return spark.read.parquet(path).orderBy(order).limit(n)


def append_results(rows: DataFrame, path: str, at: str) -> None:
    """Add a run's results, partitioned by its time stamp (yyyy-MM-dd_HHmmss)."""
    rows.withColumn("run_at", F.lit(at)).write.mode("append").partitionBy("run_at").parquet(path)


def update_latest(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """Best row per key over the old summary and new results."""
    return upsert_best(new.limit(0) if old is None else old, new, key, "sequence_accuracy", "avg_latency")


def save_index(vectors: DataFrame, path: str) -> None:
    """Vectors and their metadata; the sort keeps ids of a file together for pruned reads."""
    vectors.sortWithinPartitions("vec_id").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def resume(rows: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], step: Column) -> DataFrame:
    """Work on rows that no finished step has, write them by step, and return all results. Running it again redoes nothing;
    a step that was lost midway is done anew, as a write commits whole."""
    spark = rows.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    todo = rows.join(spark.read.parquet(path).select(key), key, "left_anti") if exists else rows
    work(todo).withColumn("step", step).write.mode("append").partitionBy("step").parquet(path)
    return spark.read.parquet(path).drop("step")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports, newest first, broken entries left out; free-form fields stay JSON."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("events", T.ArrayType(T.StringType())), T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True)
    rows = rows.where(F.col("_broken").isNull() & F.col("id").isNotNull())
    return rows.select("id", "timestamp", F.coalesce(F.size("events"), F.lit(0)).alias("n_events")).orderBy(F.desc("timestamp"), "id")


def group_rows(corpus: DataFrame, group: int) -> DataFrame:
    """All rows of one group in order; raises if there is none."""
    rows = corpus.where(F.col("surah") == group).orderBy("ayah")
    if rows.isEmpty():
        raise LookupError(f"no group {group}")
    return rows


def check_hashes(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """Raise unless the files under path have the SHA-256 sums that expected gives by file name."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sum"))
    found = {r["name"]: r["sum"] for r in files.where(F.col("name").isin(list(expected))).collect()}
    wrong = {k for k, v in expected.items() if found.get(k) != v}
    if wrong:
        raise ValueError(f"files that are missing or differ: {sorted(wrong)}")


def read_audio(spark: SparkSession, path: str, decode: Callable[[bytes], list[float]]) -> DataFrame:
    """path, samples of every file under path; decode turns a file's bytes into mono samples at 16 kHz."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "samples": [decode(bytes(c)) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, samples array<float>")


def wav_samples(content: bytes) -> list[float]:
    """Mono samples of 16-bit PCM WAV bytes; channels are averaged."""
    import io
    import wave

    import numpy as np

    with wave.open(io.BytesIO(content)) as w:
        data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
    return (data.mean(axis=1) / 32768).astype(np.float32).tolist()
