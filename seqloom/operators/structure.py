"""Operators on an ordered corpus keyed (grp, seq): spans, neighbours, successors, runs, continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BONUSES = (0.22, 0.12, 0.06)


def by_group(*order: str) -> Window:
    return Window.partitionBy("grp").orderBy(*order or ("seq",))


def spans(corpus: DataFrame, longest: int, text: str = "txt", first_text: str | None = None) -> DataFrame:
    """grp, seq, seq_end, n_rows, span_text of every run of 2..longest consecutive rows of a group.

    The first row of a span gives first_text (its text without an opening phrase) where that is not null.
    """
    ahead = Window.partitionBy("grp").orderBy("seq").rowsBetween(0, longest - 1)
    rows = corpus.select("grp", "seq", F.collect_list(F.struct("seq", F.col(text).alias("txt"))).over(ahead).alias("run"), (F.coalesce(first_text, text) if first_text else F.col(text)).alias("head"))
    rows = rows.where(F.size("run") >= 2).select("grp", "seq", "run", "head", F.explode(F.sequence(F.lit(2), F.size("run"))).alias("n_rows"))
    rest = F.transform(F.slice("run", F.lit(2), F.col("n_rows") - 1), lambda r: r["txt"])
    return rows.select("grp", "seq", F.element_at("run", F.col("n_rows"))["seq"].alias("seq_end"), "n_rows", F.array_join(F.concat(F.array("head"), rest), " ").alias("span_text"))


def opening_spans(corpus: DataFrame, longest: int, text: str = "txt") -> DataFrame:
    """Spans that open their group."""
    first = corpus.groupBy("grp").agg(F.min("seq").alias("opening"))
    return spans(corpus, longest, text).join(first, "grp").where("seq = opening").drop("opening")


def opening_runs(corpus: DataFrame, longest: int, text: str = "txt") -> DataFrame:
    """grp, seq, run: the first rows (seq, txt) of a group, `longest` at most and two at least."""
    ahead = Window.partitionBy("grp").orderBy("seq").rowsBetween(0, longest - 1)
    run = F.collect_list(F.struct("seq", F.col(text).alias("txt"))).over(ahead)
    rows = corpus.select("grp", "seq", run.alias("run"), F.min("seq").over(Window.partitionBy("grp")).alias("opening"))
    return rows.where((F.col("seq") == F.col("opening")) & (F.size("run") >= 2) & F.col("grp").isNotNull()).drop("opening")


def spans_around(hits: DataFrame, corpus: DataFrame, longest: int, text: str = "txt") -> DataFrame:
    """Distinct spans of 2..longest rows that hold a hit (grp, at)."""
    table = spans(corpus.join(hits.select("grp").distinct(), "grp", "left_semi"), longest, text)
    return table.join(hits.select("grp", "at").distinct(), "grp").where("at between seq and seq_end").drop("at").dropDuplicates(["grp", "seq", "seq_end"])


def first_groups(ranked: DataFrame, most: int) -> DataFrame:
    """qid, grp, grp_rank of the `most` groups that appear first among ranked rows (qid, grp, rank)."""
    first = ranked.groupBy("qid", "grp").agg(F.min("rank").alias("first_rank"))
    top = first.withColumn("grp_rank", F.row_number().over(Window.partitionBy("qid").orderBy("first_rank", "grp"))).where(F.col("grp_rank") <= most)
    return top.select("qid", "grp", "grp_rank")


def spans_in_top_groups(spans_table: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """Spans in the `most` groups that appear first among ranked rows (qid, grp, rank)."""
    return spans_table.join(first_groups(ranked, most), "grp")


def strip_opening(corpus: DataFrame, phrase: str, first_seq: int, exempt: list[int], text: str = "txt") -> DataFrame:
    """Adds no_opening: the text of a group's first row without an opening phrase; null where there is none, or nothing else."""
    opens = (F.col("seq") == first_seq) & ~F.col("grp").isin(exempt) & F.startswith(F.col(text), F.lit(phrase))
    return corpus.withColumn("no_opening", F.when(opens, F.nullif(F.trim(F.substring(text, len(phrase) + 1, 1 << 30)), F.lit(""))))


def successors(corpus: DataFrame) -> DataFrame:
    """grp, seq, next_grp, next_seq: the next row of the group, else the first row of group + 1, else null."""
    first = corpus.groupBy(F.col("grp").alias("after")).agg(F.min("seq").alias("after_seq"))
    rows = corpus.select("grp", "seq", F.lead("seq").over(by_group()).alias("own"))
    rows = rows.join(first, rows["grp"] + 1 == first["after"], "left")
    inside = F.col("own").isNotNull()
    return rows.select("grp", "seq", F.when(inside, F.col("grp")).otherwise(F.col("after")).alias("next_grp"), F.coalesce("own", "after_seq").alias("next_seq"))


def neighbours(corpus: DataFrame, reach: int, text: str = "txt") -> DataFrame:
    """grp, seq, near: the texts of rows within reach in sequence numbers, in order."""
    window = Window.partitionBy("grp").orderBy("seq").rangeBetween(-reach, reach)
    return corpus.select("grp", "seq", F.collect_list(text).over(window).alias("near"))


def continuation_bonuses(corpus: DataFrame, hints: DataFrame, bonuses=BONUSES) -> DataFrame:
    """qid, grp, seq, bonus of the rows expected after each hint (qid, grp, seq).

    The next rows of the group that exist, by distance; if the very next does not, the first rows of
    group + 1, by place.
    """
    table = F.array(*[F.lit(b) for b in bonuses])
    rows = corpus.select("grp", "seq", (F.row_number().over(by_group()) - 1).alias("place"))
    h = hints.select("qid", F.col("grp").alias("hg"), F.col("seq").alias("hs"))
    last = h.join(rows, (F.col("hg") == F.col("grp")) & (F.col("hs") + 1 == F.col("seq")), "left_anti").select("qid", "hg")
    same = h.join(last.select("qid"), "qid", "left_anti").join(rows, (F.col("hg") == F.col("grp")) & F.col("seq").between(F.col("hs") + 1, F.col("hs") + len(bonuses)))
    over = last.join(rows, (F.col("hg") + 1 == F.col("grp")) & (F.col("place") < len(bonuses)))
    return same.select("qid", "grp", "seq", F.get(table, (F.col("seq") - F.col("hs") - 1).cast("int")).alias("bonus")).unionByName(over.select("qid", "grp", "seq", F.get(table, F.col("place").cast("int")).alias("bonus")))


def best_run(votes: DataFrame, weight: str = "weight") -> DataFrame:
    """Per grp the run of consecutive seq with the largest weight (ties: the earliest): first_seq, last_seq, weight."""
    rows = votes.groupBy("grp", "seq").agg(F.sum(weight).alias("w")).withColumn("island", F.col("seq") - F.row_number().over(by_group()))
    runs = rows.groupBy("grp", "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("w").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("weight", 9)), "first_seq"))
    return runs.withColumn("r", rank).where("r = 1").select("grp", "first_seq", "last_seq", "weight")


def word_ends(tokens: DataFrame, key: str, column: str, boundary: str) -> DataFrame:
    """key, word, end: how many tokens precede the end of each word of an array with boundary tokens."""
    rows = tokens.select(key, F.posexplode(column).alias("pos", "tok"))
    word = F.count_if(F.col("tok") == boundary).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("word", F.coalesce(word, F.lit(0))).where(F.col("tok") != boundary).groupBy(key, "word").agg((F.max("pos") + 1).alias("end"))


def group_sizes(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("grp").agg(F.count("*").alias("n_rows"))


def best_per(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1, rank: str | None = None) -> DataFrame:
    """The first rows of each key in an order, which must end with a unique key."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= most)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")
