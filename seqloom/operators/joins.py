"""Join operators: lookups, ambiguity-aware and exact-then-fuzzy joins, similarity joins, as-of correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.ngrams import char_ngrams
from seqloom.functions.similarity import lev_ratio, lev_ratio_at_least
from seqloom.operators.structure import best_per

#: Rows of a similarity join's corpus side that may be broadcast, and that a part of a larger one has about.
BROADCAST_ROWS, SALT_ROWS = 200_000, 50_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as there are cores (by keys, if given), if a few small files hold it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in order."""
    return best_per(rows, [key], [F.desc(order)])


def lookup_unless_ambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, outcome: value is null and outcome 'ambiguous' where a key has several values, else 'mapped'."""
    one = F.min(value) == F.max(value)
    found = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.when(one, F.min(value)).alias(value))
    return found.withColumn("outcome", F.when(F.col(value).isNull(), "ambiguous").otherwise("mapped"))


def similarity_join(queries: DataFrame, corpus: DataFrame, score: Column, most: int, tie: list[str]) -> DataFrame:
    """Each query's best `most` corpus rows by score (rounded to 6), ties in corpus order: a scan of the whole corpus.

    The corpus is broadcast if it is small enough; for larger ones use gram_candidates first.
    """
    pairs = queries.join(bounded(corpus), F.lit(True)).withColumn("score", F.round(score, 6))
    return best_per(pairs, ["qid"], [F.desc("score"), *[F.asc(t) for t in tie]], most, "rank")


def lev_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float) -> DataFrame:
    """Pairs with lev_ratio of at least `least`, by length bands: the ratio bounds the difference of lengths.

    Bands of equal width in log length make it an equi-join; each left row looks into the bands its partners can be in. A
    right side of checked size is broadcast; a larger one is dealt into parts of SALT_ROWS rows, so that no band of like lengths is one task.
    """
    import math

    width = math.log(max((2 - least) / least, 1 + 1e-9))  # of partners' lengths a <= b: b / a <= (2 - least) / least
    band = lambda c: F.floor(F.log(F.length(c) + F.lit(1e-9)) / width).cast("int")
    probe = spread(left).where(F.length(left_text) > 0).withColumn("_band", F.explode(F.sequence(band(left_text) - 1, band(left_text) + 1)))
    build = right.where(F.length(right_text) > 0).withColumn("_rband", band(right_text))
    n = build.count()
    if n <= BROADCAST_ROWS:
        pairs = probe.join(F.broadcast(build), F.col("_band") == F.col("_rband")).drop("_band", "_rband")
    else:
        parts = -(-n // SALT_ROWS)
        build = build.withColumn("_rpart", F.pmod(F.xxhash64(right_text), F.lit(parts)).cast("int"))
        probe = probe.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = probe.join(build, (F.col("_band") == F.col("_rband")) & (F.col("_part") == F.col("_rpart"))).drop("_band", "_rband", "_part", "_rpart")
    return pairs.withColumn("score", lev_ratio_at_least(F.col(left_text), F.col(right_text), least)).where("score is not null")


def exact_then_fuzzy(queries: DataFrame, corpus: DataFrame, least: float) -> DataFrame:
    """qid, grp, seq, how, score: equal texts first (smallest key), else the best lev_ratio of at least `least`, else no row.

    queries: qid, txt; corpus: grp, seq, txt. Only the unmatched remainder meets the fuzzy join.
    """
    ref = corpus.select("grp", "seq", F.col("txt").alias("ref"))
    exact = best_per(queries.join(ref, F.col("txt") == F.col("ref")), ["qid"], [F.asc("grp"), F.asc("seq")])
    rest = queries.join(exact.select("qid"), "qid", "left_anti")
    fuzzy = best_per(lev_join(rest, ref, "txt", "ref", least), ["qid"], [F.desc(F.round("score", 6)), F.asc("grp"), F.asc("seq")])
    return exact.select("qid", "grp", "seq", F.lit("exact").alias("how"), F.lit(1.0).alias("score")).unionByName(fuzzy.select("qid", "grp", "seq", F.lit("fuzzy").alias("how"), F.round("score", 6).alias("score")))


#: Queries, and cells of their gram table, that block scoring holds in memory; beyond them the joins score.
BLOCK_QUERIES, BLOCK_CELLS = 2_000, 8_000_000


def gram_candidates(queries: DataFrame, corpus: DataFrame, key: list[str], most: int = 50, n: int = 3) -> DataFrame:
    """qid, key, score, rank: corpus rows by summed idf of shared distinct n-grams (rounded to 6), ties in key order.

    A block of queries of checked size scores every row in one pass, and tasks emit their best rows alone; more
    queries go through joins on grams.
    """
    asked = queries.where("txt is not null").select("qid", "txt").limit(BLOCK_QUERIES + 1).collect()
    grams = [{r["txt"][i : i + n] for i in range(len(r["txt"]) - n + 1)} for r in asked]
    place = {g: i for i, g in enumerate(sorted(set().union(*grams)))}
    if len(asked) <= BLOCK_QUERIES and len(place) * len(asked) <= BLOCK_CELLS:
        scored = _score_block([r["qid"] for r in asked], grams, place, queries.schema["qid"].dataType.simpleString(), corpus, key, most, n)
    else:
        scored = _score_by_joins(queries, corpus, key, n)
    return best_per(scored, ["qid"], [F.desc("score"), *[F.asc(k) for k in key]], most, "rank")


def _score_block(qids: list, grams: list[set], place: dict[str, int], qid_type: str, corpus: DataFrame, key: list[str], most: int, n: int) -> DataFrame:
    def found(text: str | None) -> list[int]:
        return [place[g] for g in {text[i : i + n] for i in range(len(text) - n + 1)} if g in place] if text else []

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(len(place), np.int64)
        for b in batches:
            for t in b["txt"]:
                df[found(t)] += 1
        yield pd.DataFrame({"gram": np.flatnonzero(df), "df": df[df > 0]})

    total = corpus.count()
    corpus = spread(corpus.select(*key, "txt"))
    df = corpus.select("txt").mapInPandas(count, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()  # a row a gram
    has = np.zeros((len(place), len(qids)), bool)
    for q, own in enumerate(grams):
        has[[place[g] for g in own], q] = True
    idf = np.zeros(len(place))
    for r in df:
        idf[r["gram"]] = np.log(total / r["df"])
    weights = has * idf[:, None]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, qs, scores = [], [], []
            for i, t in enumerate(b["txt"]):
                own = found(t)
                hit = np.flatnonzero(has[own].any(0)) if own else []
                if len(hit):
                    rows.append(np.full(len(hit), i))
                    qs.append(hit)
                    scores.append(np.round(weights[own].sum(0)[hit], 6))
            if rows:
                out = b[key].iloc[np.concatenate(rows)].reset_index(drop=True).assign(_q=np.concatenate(qs), score=np.concatenate(scores))
                out = out.sort_values(["_q", "score", *key], ascending=[True, False, *[True] * len(key)]).groupby("_q").head(most)
                yield out.assign(qid=[qids[q] for q in out["_q"]])[["qid", *key, "score"]]

    types = {f.name: f.dataType.simpleString() for f in corpus.schema}
    return corpus.select(*key, "txt").mapInPandas(score, f"qid {qid_type}, " + ", ".join(f"{k} {types[k]}" for k in key) + ", score double")


def _score_by_joins(queries: DataFrame, corpus: DataFrame, key: list[str], n: int) -> DataFrame:
    """Grams are filtered to the queries' before anything is shuffled by gram; idf is over the whole corpus."""
    asked = queries.select("qid", F.explode(char_ngrams(F.col("txt"), n)).alias("gram"))
    wanted = bounded(asked.select("gram").distinct(), 1_000_000)
    postings = corpus.select(*key, F.explode(char_ngrams(F.col("txt"), n)).alias("gram")).join(wanted, "gram", "left_semi")
    total = corpus.count()
    weights = postings.groupBy("gram").agg(F.log(F.lit(total) / F.count("*")).alias("idf"))
    return asked.join(weights, "gram").join(postings, "gram").groupBy("qid", *key).agg(F.round(F.sum("idf"), 6).alias("score"))


def candidates_or_all(queries: DataFrame, corpus: DataFrame, key: list[str], most: int = 50, least: int = 20) -> DataFrame:
    """qid and key of each query's gram candidates; of the whole corpus for queries with fewer than least."""
    found = gram_candidates(queries, corpus, key, most).select("qid", *key)
    enough = found.groupBy("qid").count().where(F.col("count") >= least).select("qid")
    scan = queries.select("qid").join(enough, "qid", "left_anti").join(bounded(corpus.select(*key)), F.lit(True))
    return found.join(enough, "qid", "left_semi").unionByName(scan.select("qid", *key))


def rarity_votes(queries: DataFrame, corpus: DataFrame, key: list[str], tokens: str = "grams") -> DataFrame:
    """qid, key, weight: every query n-gram (repeats count) gives 1 / (its occurrences in the corpus) to each row that has it."""
    places = corpus.select(*key, F.explode(tokens).alias("gram"))
    rare = places.groupBy("gram").agg((1 / F.count("*")).alias("w"))
    asked = queries.select("qid", F.explode(tokens).alias("gram")).groupBy("qid", "gram").agg(F.count("*").alias("times"))
    rows = places.select(*key, "gram").distinct()
    return asked.join(rare, "gram").join(rows, "gram").groupBy("qid", *key).agg(F.round(F.sum(F.col("times") * F.col("w")), 6).alias("weight"))


def unused(rows: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key no used row has; used ranges (grp, first, last) are expanded first."""
    return rows.join(used, key, "left_anti")


def latest_before(events: DataFrame, key: str, order: list[str], is_commit: Column, is_found: Column, value: str) -> DataFrame:
    """Commits with the latest found value since the commit before them (null if there is none)."""
    w = Window.partitionBy(key).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_epoch", F.coalesce(F.count_if(is_commit).over(earlier), F.lit(0)))
    within = Window.partitionBy(key, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("found", F.last(F.when(is_found, F.col(value)), ignorenulls=True).over(within))
    return rows.where(is_commit).drop("_epoch")


def best_lev(queries: DataFrame, corpus: DataFrame, most: int = 5) -> DataFrame:
    """Full similarity scan by lev_ratio. Queries that fit one block meet each row in one pass; more go through a join of all pairs."""
    from seqloom.operators import scan

    asked = scan.block(queries)
    if asked is not None:
        found = scan.scan(asked, queries.schema["qid"].dataType.simpleString(), corpus, most).withColumn("score", F.round("raw", 6))
        return best_per(found, ["qid"], [F.desc("score"), F.asc("grp"), F.asc("seq")], most, "rank").select("qid", "rank", "grp", "seq", "score")
    ref = corpus.select("grp", "seq", F.col("txt").alias("ref"))
    return similarity_join(queries, ref, lev_ratio(F.col("txt"), F.col("ref")), most, ["grp", "seq"]).select("qid", "rank", "grp", "seq", "score")
