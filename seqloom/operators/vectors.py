"""Vector operators of the retrieval engine: k nearest by inner product, accuracy at k, pooling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.structure import best_per

#: Rows of an index chunk and of a block of queries; their products are made at most SLICE queries at a time.
CHUNK_ROWS, BLOCK_ROWS, SLICE = 16_384, 4_096, 512
#: Scores are rounded to six places; a chunk keeps what rounding could still bring among its best.
PLACES, ROUNDING = 6, 2e-6


def _nearest(asks: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """qid, vec_id, score of each query's k largest products in a chunk, and of those that rounding may tie with them."""
    rows = rows.sort_values("vec_id")
    index, vec_id = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy()
    out = []
    for at in range(0, len(asks), SLICE):
        part = asks.iloc[at : at + SLICE]
        qid = part["qid"].to_numpy()
        scores = np.stack(part["q"].to_numpy()).astype(np.float64) @ index.T
        scores[qid[:, None] == vec_id[None, :]] = -np.inf
        least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else scores.min(axis=1)
        i, j = np.nonzero((scores >= least[:, None] - ROUNDING) & (scores > -np.inf))
        out.append(pd.DataFrame({"qid": qid[i], "vec_id": vec_id[j], "score": scores[i, j]}))
    return pd.concat(out)


def knn(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, score, rank: exact scan, scores rounded to 6, ties to smaller ids; a query's own row is left out.

    queries: qid, q; index: vec_id, v (ids long). Blocks of queries meet chunks of the index as matrices, and only a chunk's best
    rows leave it. Null ids, and null vectors or ones with null elements take no part; vectors of different lengths do not meet.
    """
    whole = lambda v: F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
    asks = queries.where(F.col("qid").isNotNull() & whole("q")).select(F.col("qid").cast("long").alias("qid"), "q", F.size("q").alias("size"))
    rows = index.where(F.col("vec_id").isNotNull() & whole("v")).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("size"))
    chunks = max(-(-rows.count() // CHUNK_ROWS), index.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-asks.count() // BLOCK_ROWS))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asks.withColumn("block", dealt("qid", blocks)).withColumn("chunk", every(chunks))
    rows = rows.withColumn("chunk", dealt("vec_id", chunks)).withColumn("block", every(blocks))
    keys = ["size", "block", "chunk"]

    def run(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _nearest(asks, rows, k) if len(asks) and len(rows) else pd.DataFrame({"qid": [], "vec_id": [], "score": []})

    pairs = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(run, "qid long, vec_id long, score double")
    return best_per(pairs.withColumn("score", F.round("score", PLACES)), ["qid"], [F.desc("score"), F.asc("vec_id")], k, "rank")


def hits_at(ranked: DataFrame, hit: str, ks: list[int]) -> DataFrame:
    """qid and a flag for each k: whether a hit ranks within k."""
    first = F.min(F.when(F.col(hit), F.col("rank")))
    return ranked.groupBy("qid").agg(*[F.coalesce(first <= k, F.lit(False)).alias(f"top{k}") for k in ks])


def mean_pool(frames: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """key and the mean of the vectors where mask holds, element by element."""
    rows = frames.where(mask).select(key, F.posexplode(vector).alias("d", "x"))
    means = rows.groupBy(key, "d").agg(F.avg("x").alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias(vector))


def consecutive_runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds run: how many rows in succession have had the same value, this one included."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    rows = rows.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w))
    return rows.withColumn("run", F.row_number().over(Window.partitionBy(key, "_island").orderBy(order))).drop("_fresh", "_island")
