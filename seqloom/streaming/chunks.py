"""Chunks, silence sessions and their kin, as batch plans over (session, offset) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping_chunks(rows: DataFrame, key: str, offset: str, size: int, step: int) -> DataFrame:
    """Each row in every chunk (from 0, every step, size long) that holds its offset."""
    last = F.floor(F.col(offset) / step)
    first = F.greatest(F.floor((F.col(offset) - size) / step) + 1, F.lit(0))
    return rows.withColumn("chunk", F.explode(F.sequence(first, last)))


def chunk_table(lengths: DataFrame, key: str, length: str, size: int, step: int, least: int, pad: int) -> DataFrame:
    """key, chunk, start, n, padded: chunks of each stream; tails under least are skipped, short ones padded to pad."""
    rows = lengths.where(F.col(length) > 0).select(key, length, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(length) - 1) / step))).alias("chunk"))
    rows = rows.withColumn("start", F.col("chunk") * step).withColumn("n", F.least(F.lit(size), F.col(length) - F.col("start")))
    return rows.where(F.col("n") >= least).select(key, "chunk", "start", "n", F.greatest("n", F.lit(pad)).alias("padded"))


def silence_sessions(rows: DataFrame, key: str, order: str, silent: Column, limit: int) -> DataFrame:
    """Adds session: a session ends where `limit` silent rows have come in succession."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_silent", silent.cast("int"))
    rows = rows.withColumn("_island", F.count_if(F.col("_silent") == 0).over(w))
    quiet = F.sum("_silent").over(Window.partitionBy(key, "_island").orderBy(order))
    rows = rows.withColumn("_quiet", quiet).withColumn("_ends", ((F.col("_quiet") == limit) & (F.col("_silent") == 1)).cast("int"))
    session = F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("session", session).drop("_silent", "_island", "_quiet", "_ends")


def rapid_switching(rows: DataFrame, key: str, at: str, value: str, span: int, least: int) -> DataFrame:
    """Adds distinct_refs (distinct values within span before each row, itself included) and alarm (least or more)."""
    window = Window.partitionBy(key).orderBy(at).rangeBetween(-span, 0)
    rows = rows.withColumn("distinct_refs", F.size(F.collect_set(value).over(window)))
    return rows.withColumn("alarm", F.col("distinct_refs") >= least)


def changed_enough(rows: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """Adds steady: whether value stays within a share of the value before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    share = F.least(before, F.col(value)) / F.greatest(before, F.col(value))
    return rows.withColumn("steady", F.coalesce(share >= least, F.lit(False)))


def long_windows(lengths: DataFrame, key: str, length: str, size: int = 25, overlap: int = 1) -> DataFrame:
    return chunk_table(lengths, key, length, size, size - overlap, 1, 0)


def with_cooldown(alarms: DataFrame, key: str, at: str, least: int) -> DataFrame:
    """Of each key's alarms in order, those at least `least` after the last one kept."""

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (x - last >= least), F.concat(kept, F.array(x))).otherwise(kept)

    times = F.array_sort(F.collect_list(F.col(at).cast("long")))
    return alarms.groupBy(key).agg(F.aggregate(times, F.array().cast("array<bigint>"), step).alias("_t")).select(key, F.explode("_t").alias(at))
