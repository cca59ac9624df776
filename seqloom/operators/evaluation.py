"""Evaluation of predicted against expected sequences, and aggregates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_score(expected: Column, predicted: Column) -> Column:
    """Struct of recall, precision, sequence_accuracy by greedy ordered match: each expected item takes its first
    occurrence after the item matched before, even when that skips others. Nothing expected: all 1. Nothing predicted: all 0."""

    def step(state: Column, item: Column) -> Column:
        at = F.array_position(F.slice(predicted, state["at"] + 1, F.greatest(F.size(predicted), F.lit(1))), item).cast("int")
        return F.struct(F.when(at > 0, state["at"] + at).otherwise(state["at"]).alias("at"), (state["n"] + F.when(at > 0, 1).otherwise(0)).alias("n"))

    n = F.aggregate(expected, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step)["n"]
    scored = F.struct((n / F.size(expected)).alias("recall"), (n / F.size(predicted)).alias("precision"), (predicted == expected).cast("double").alias("sequence_accuracy"))
    flat = lambda x: F.struct(*[F.lit(x).alias(k) for k in ("recall", "precision", "sequence_accuracy")])
    return F.when(F.size(expected) == 0, flat(1.0)).when(F.size(predicted) == 0, flat(0.0)).otherwise(scored)


def set_metrics(expected: Column, predicted: Column) -> Column:
    """Struct of recall, precision, exact and ordered over sets; nothing predicted: precision 1."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    hit = F.size(F.array_intersect(e, p))
    return F.struct(
        F.when(F.size(e) == 0, F.lit(1.0)).otherwise(hit / F.size(e)).alias("recall"),
        F.when(F.size(p) == 0, F.lit(1.0)).otherwise(hit / F.size(p)).alias("precision"),
        (F.sort_array(e) == F.sort_array(p)).alias("exact"),
        (p == e).alias("ordered"),
    )


def is_subsequence(part: Column, whole: Column) -> Column:
    def step(at: Column, item: Column) -> Column:
        found = F.array_position(F.slice(whole, F.greatest(at, F.lit(0)) + 1, F.greatest(F.size(whole), F.lit(1))), item).cast("int")
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

    return F.aggregate(part, F.lit(0), step) >= 0


def error_shape(expected: Column, predicted: Column) -> Column:
    missing, extra, hit = F.size(F.array_except(expected, predicted)), F.size(F.array_except(predicted, expected)), F.size(F.array_intersect(expected, predicted))
    return (
        F.when((missing == 0) & (extra == 0), "exact").when(F.size(predicted) == 0, "no_emit").when((hit == 0) & (extra > 0), "wrong_only")
        .when((missing > 0) & (extra == 0), "missing_only").when((missing > 0) & (extra > 0), "partial_with_extra").when((missing == 0) & (extra > 0), "expected_plus_extra").otherwise("other")
    )


def run_taxonomy(expected: Column, predicted: Column) -> Column:
    """exact, no_emit, extra_after, extra_before, partial_multi, missing_only, wrong_initial or wrong_group_jump; items are struct(grp, seq)."""
    n = F.size(expected)
    starts = F.slice(predicted, F.lit(1), n) == expected
    ends = F.slice(predicted, F.greatest(F.size(predicted) - n + 1, F.lit(1)), n) == expected
    jump = F.size(F.array_except(F.transform(predicted, lambda p: p["grp"]), F.transform(expected, lambda e: e["grp"]))) > 0
    return (
        F.when(predicted == expected, "exact").when(F.size(predicted) == 0, "no_emit").when(starts, "extra_after").when(ends, "extra_before")
        .when(is_subsequence(predicted, expected), F.when(n > 1, "partial_multi").otherwise("missing_only"))
        .when(jump, "wrong_group_jump").when(predicted[0] != expected[0], "wrong_initial").otherwise("other")
    )


def discovery_taxonomy(expected: Column, found: Column, group) -> Column:
    """exact, no_emit, missing_only, partial_multi, wrong_initial, extra_before, wrong_group_jump, extra_after or other, tested in this
    order; group gives an item's group."""
    strange = lambda items: F.filter(items, lambda x: ~F.array_contains(expected, x))
    at = F.filter(F.transform(expected, lambda x: F.array_position(found, x).cast("int")), lambda i: i > 0)
    first, last = F.coalesce(F.array_min(at), F.lit(0)), F.coalesce(F.array_max(at), F.lit(0))
    missing = F.size(F.filter(expected, lambda x: ~F.array_contains(found, x)))
    before = strange(F.slice(found, F.lit(1), F.greatest(first - 1, F.lit(0))))
    after = strange(F.slice(found, last + 1, F.greatest(F.size(found), F.lit(1))))
    groups = F.transform(expected, group)
    jump = F.exists(after, lambda x: ~F.array_contains(groups, group(x)))
    return (
        F.when(expected == found, "exact").when(F.size(found) == 0, "no_emit").when((F.size(strange(found)) == 0) & (missing > 0), "missing_only")
        .when((missing > 0) & (F.size(expected) > 1), "partial_multi").when(~F.array_contains(expected, F.get(found, F.lit(0))), "wrong_initial").when(F.size(before) > 0, "extra_before")
        .when(F.size(after) > 0, F.when(jump, "wrong_group_jump").otherwise("extra_after")).otherwise("other")
    )


def summarise_runs(runs: DataFrame) -> DataFrame:
    """category, median_pct, median_correct, min_correct of runs (run, category, correct, total): shares in per cent, halves rounded up."""
    totals = runs.groupBy("run").agg(F.sum("correct").alias("c")).agg(F.percentile("c", 0.5).alias("median_correct"), F.min("c").alias("min_correct"))
    share = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0))
    each = runs.groupBy("category").agg((F.floor(F.percentile(share, 0.5) * 1000 + 0.5) / 10).alias("median_pct"))
    return each.join(F.broadcast(totals), F.lit(True))  # one row


def false_jumps(history: DataFrame, key: str, order: str, near: int = 3) -> DataFrame:
    """Per key how often the shown item (grp, seq) changed to one that is neither expected nor near the one before."""
    w = Window.partitionBy(key).orderBy(order)
    rows = history.withColumn("_g", F.lag("grp").over(w)).withColumn("_s", F.lag("seq").over(w))
    changed = F.col("_g").isNotNull() & ((F.col("_g") != F.col("grp")) | (F.col("_s") != F.col("seq")))
    close = (F.col("_g") == F.col("grp")) & (F.abs(F.col("_s") - F.col("seq")) <= near)
    return rows.groupBy(key).agg(F.count_if(changed & ~close & ~F.col("expected")).alias("jumps"))


def stability(runs: DataFrame, key: str, passed: str) -> DataFrame:
    """Per key: stable_pass if all runs passed, stable_fail if none did, else flaky."""
    kind = F.when(F.min(passed), "stable_pass").when(~F.max(passed), "stable_fail").otherwise("flaky")
    return runs.groupBy(key).agg(kind.alias("stability"), F.count("*").alias("n_runs"))


def upsert_best(old: DataFrame, new: DataFrame, key: list[str], score: str, cost: str) -> DataFrame:
    """One row per key: higher score, then lower cost; an old row wins exact ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = F.struct(F.col(score), -F.col(cost), -F.col("_new"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(best)))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_new")
