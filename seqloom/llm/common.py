"""Helpers that the training-data operators share: table access, batch sizes, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.staging import shared_dir, stage, staged_path  # noqa: F401

#: Rows and bytes of one Arrow batch: the same for every operator, so that a frame's batches do not depend on which other is built.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch in bytes, as texts may be long; one longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Stands for a null id inside Python, where a column with nulls would become floating point and round large ids.
NO_ID = -(1 << 63)


def solid_id(column: Column) -> Column:
    """An id as a long without nulls."""
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def open_id(column: Column) -> Column:
    """A solid id with its nulls again."""
    return F.nullif(column, F.lit(NO_ID))


def checked_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark a staged table for broadcast if it has at most max_rows rows; else leave it for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def stored(docs: DataFrame) -> DataFrame:
    """docs itself if it is a selection of a table of files, whose rows have the same places in every scan; else a staged copy."""
    nodes = [docs._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in ("Project", "Filter") and not (node.nodeName() == "LogicalRelation" and docs.inputFiles()):
            return stage(docs, "stored")
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return docs


def without_rows(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """Stored documents without the rows whose place in the scan is in drop (rid)."""
    own = "_rid"
    while own in docs.columns:
        own += "_"
    rows = docs.withColumn(own, F.monotonically_increasing_id())
    return rows.join(drop.select(F.col("rid").alias(own)).hint("shuffle_hash"), own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: Rows from which a key is joined by broadcast instead of a shuffle that would bring them all to one task.
HOT_ROWS = 1_000_000


def join_to_classes(rows: DataFrame, classes: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Inner join of rows with a staged table of their distinct keys, which says how many rows each has.

    Keys of more than HOT_ROWS rows (fewer than one for every HOT_ROWS rows there are) are broadcast, the others shuffled.
    """
    hot = classes.where(F.col(count) > HOT_ROWS)
    if hot.isEmpty():
        return rows.join(classes, key)
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col(count) <= HOT_ROWS), key)
    return usual.unionByName(rows.join(F.broadcast(hot), key))


def lower_ascii(column):
    """Lower-case A-Z alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())
