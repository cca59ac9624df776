"""Corpus engineering: caps, samples, splits, funnels, chunked work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.structure import best_per
from seqloom.sources.staging import stage


def histogram(rows: DataFrame, key: str) -> DataFrame:
    """key, n, rank by count."""
    counted = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "key")))


def cap_per_key(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """First rows of each key. The window's limit is applied before the shuffle, so a hot key ships few rows per task."""
    return best_per(rows, keys, [F.asc(order)], most)


def stratified_sample(rows: DataFrame, stratum: str, row_id: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum by seeded hash: the same rows for any partitioning."""
    lot = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return best_per(rows.withColumn("_lot", lot), [stratum], [F.asc("_lot"), F.asc(row_id)], n).drop("_lot")


def numbered(rows: DataFrame, order: str, column: str) -> DataFrame:
    """Rows numbered from 0 in a global order without gathering them in one task: ranges are sorted apart, and each one's
    start is the number of rows before it.

    The ranges are written once: sampling them again for another set of columns would draw other borders.
    """
    part, place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    ranged = stage(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("*", part, place), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(column, F.col("_start") + F.col("_at")).drop("_at", "_part", "_start")  # one row a partition


def round_robin(rows: DataFrame, order: str, slots: int) -> DataFrame:
    return numbered(rows, order, "_n").withColumn("slot", F.col("_n") % slots).drop("_n")


def contiguous_chunks(rows: DataFrame, order: str, chunks: int) -> DataFrame:
    """Chunks of equal size in order; the last may be short."""
    size = max(1, -(-rows.count() // chunks))
    return numbered(rows, order, "_n").withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n")


def holdout(row_number: Column, every: int = 50) -> Column:
    return F.when(row_number % every == 0, "validation").otherwise("train")


def funnel(rows: DataFrame, reason: str, reasons: list[str]) -> DataFrame:
    """One row: how many were seen, and how many for each reason."""
    return rows.agg(F.count("*").alias("seen"), *[F.count_if(F.col(reason) == r).alias(r) for r in reasons])


def merge_chunks(original: DataFrame, done: DataFrame, chunk: str) -> DataFrame:
    """Finished chunks, and the original rows of chunks that are missing."""
    return done.unionByName(original.join(done.select(chunk).distinct(), chunk, "left_anti"))


def quota(rows: DataFrame, bucket: str, order: str, quotas: dict[str, int]) -> DataFrame:
    """First rows of each bucket up to its quota."""
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(order)))
    return ranked.where(F.col("_r") <= F.coalesce(F.try_element_at(most, F.col(bucket)), F.lit(0))).drop("_r")
