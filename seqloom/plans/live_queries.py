"""Queries over parts of live sessions, tries, voted spans, and smaller evaluation and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators import decode, evaluation, retrieval, structure
from seqloom.plans.fact_queries import _SEQ, _sequences
from seqloom.plans.registry import CORPUS, PASSAGES, query, split
from seqloom.plans.stream_queries import _speech, corpus_rows
from seqloom.sources.tables import corpus, passages, table
from seqloom.streaming import live, tracker


@query("SELECT vec_id, embedding AS samples FROM embeddings")
def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as binary frames and read back."""
    from seqloom.sources.staging import stage

    rows = table(spark, sf_dir, "embeddings").select("vec_id", live.frame_of()("embedding").alias("frame"))
    return stage(rows, "frames").select("vec_id", live.samples_of()("frame").alias("samples"))


@query("SELECT vec_id, list_transform(generate_series(0, 42), lambda i: embedding[1 + floor(i * 1.5)::INT]) AS samples FROM embeddings")
def stride_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", live.strided(F.col("embedding"), 1.5).alias("samples"))


_CHUNKS = "e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, 1 + floor(value)::BIGINT AS n, CASE WHEN event_type = 'purchase' THEN 60 ELSE 120 END AS most FROM events)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.when(F.col("event_type") == "purchase", 60).otherwise(120)
    return table(spark, sf_dir, "events").select("user_id", "event_id", (1 + F.floor("value")).cast("long").alias("n"), most.cast("long").alias("most"))


@query(f"""WITH RECURSIVE {_CHUNKS}, b AS (SELECT user_id, k, event_id, least(n, most) AS held FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.event_id, least(b.held + e.n, e.most) FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1) SELECT user_id, event_id, held::BIGINT AS held FROM b""")
def rolling_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.rolling_buffer(_chunks(spark, sf_dir), "user_id", "event_id", "n", "most").select("user_id", "event_id", "held")


@query(f"""WITH RECURSIVE {_CHUNKS}, b AS (SELECT user_id, k, event_id, 0::BIGINT AS cycle, n >= 75 AS fires, CASE WHEN n >= 75 THEN 0 ELSE n END AS new FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.event_id, b.cycle + b.fires::INT, b.new + e.n >= 75, CASE WHEN b.new + e.n >= 75 THEN 0 ELSE b.new + e.n END FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT user_id, event_id, cycle::BIGINT AS cycle, fires FROM b""")
def count_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.triggers(_chunks(spark, sf_dir), "user_id", "event_id", "n", 75)


_LEDGER = """e AS (SELECT user_id AS session, event_id AS "offset", row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
CASE event_type WHEN 'view' THEN 'commit' WHEN 'click' THEN 'advance' WHEN 'purchase' THEN 'progress' WHEN 'error' THEN 'silence' ELSE 'exit' END AS what, (floor(value)::BIGINT % 9)::VARCHAR AS ref, value > 12 AS firm FROM events)"""


@query(f"""WITH RECURSIVE {_LEDGER}, start AS (SELECT DISTINCT session, 0::BIGINT AS k FROM e),
s AS (SELECT session, k, NULL::BIGINT AS spot, NULL::VARCHAR AS shown, NULL::VARCHAR AS before, false AS strong, false AS progress, false AS saved, NULL::VARCHAR AS saved_shown, NULL::VARCHAR AS saved_before, false AS saved_strong, false AS undone FROM start
UNION ALL SELECT e.session, e.k, e."offset",
  CASE WHEN what IN ('commit', 'advance') THEN ref WHEN what = 'silence' AND NOT strong AND NOT progress AND shown IS NOT NULL THEN before WHEN what = 'exit' AND saved THEN saved_shown ELSE shown END,
  CASE WHEN what IN ('commit', 'advance') THEN shown WHEN what = 'exit' AND saved THEN saved_before ELSE before END,
  CASE WHEN what = 'commit' THEN firm WHEN what = 'advance' THEN false WHEN what = 'exit' AND saved THEN saved_strong ELSE strong END,
  CASE WHEN what IN ('commit', 'advance', 'exit') THEN false WHEN what = 'progress' THEN true ELSE progress END,
  CASE WHEN what = 'advance' THEN true WHEN what IN ('commit', 'progress', 'exit') THEN false WHEN what = 'silence' AND NOT strong AND NOT progress AND shown IS NOT NULL THEN false ELSE saved END,
  CASE WHEN what = 'advance' THEN shown ELSE saved_shown END, CASE WHEN what = 'advance' THEN before ELSE saved_before END, CASE WHEN what = 'advance' THEN strong ELSE saved_strong END,
  (what = 'silence' AND NOT strong AND NOT progress AND shown IS NOT NULL) OR (what = 'exit' AND saved)
  FROM s JOIN e ON e.session = s.session AND e.k = s.k + 1)
SELECT session, spot AS "offset", shown, strong, undone FROM s WHERE k > 0""")
def commit_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as shown after commits, pending advances, progress, silences and exits."""
    kind = F.col("event_type")
    what = F.when(kind == "view", live.COMMIT).when(kind == "click", live.ADVANCE).when(kind == "purchase", live.PROGRESS).when(kind == "error", live.SILENCE).otherwise(live.EXIT)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("offset"), what.alias("what"), (F.floor("value").cast("long") % 9).cast("string").alias("ref"), (F.col("value") > 12).alias("strong"))
    return live.ledger(rows)


@query()
def tracker_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every chunk meant to the tracker: its best row, the rule that applied, and how many rows it emitted."""
    return tracker.diagnose(_speech(spark, sf_dir), corpus_rows(spark, sf_dir))


@query("SELECT user_id, event_id, count(*) OVER w AS n, min(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring buffer of a session's last 50 events at each event: how many, and the oldest."""
    last = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-49, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(last).alias("n"), F.min("event_id").over(last).alias("first"))


@query(f"WITH {CORPUS} SELECT grp, seq, len({split('txt')})::BIGINT AS n_ids FROM corpus WHERE len({split('txt')}) BETWEEN 1 AND 15")
def short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 1 to 15 tokens, which are decoded on their own."""
    n = F.size(text.words(F.col("txt")))
    return corpus(spark, sf_dir).where(n.between(1, 15)).select("grp", "seq", n.cast("long").alias("n_ids"))


@query(f"""WITH {CORPUS}, w AS (SELECT grp, seq, {split('txt')} AS t FROM corpus), g AS (SELECT grp, seq, t, list_filter(generate_series(3, len(t)), lambda i: t[i] = t[i - 1] AND t[i] = t[i - 2]) AS spots FROM w)
SELECT grp, seq, len(spots) > 0 OR len(t) > 30 AS hallucinated, array_to_string(CASE WHEN len(t) >= 4 AND len(spots) > 0 THEN t[1:spots[1] - 1] ELSE t END, ' ') AS kept FROM g""")
def repeated_words_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a word three times in succession, or over 30 words, and their words before the third."""
    w = text.words(F.col("txt"))
    return corpus(spark, sf_dir).select("grp", "seq", (decode.repeated_run(w, 3) | (F.size(w) > 30)).alias("hallucinated"), F.array_join(decode.cut_at_repeat(w), " ").alias("kept"))


@query(f"WITH {PASSAGES} SELECT qid, substr(txt, 1, 60) AS front, array_to_string({split('txt')}[1:20], ' ') AS words FROM passages")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("qid", F.substring("txt", 1, 60).alias("front"), F.array_join(F.slice(text.words(F.col("txt")), 1, 20), " ").alias("words"))


@query("SELECT user_id, round_even(avg(value), 3) AS mean3, round_even(max(value), 2) AS most2 FROM events GROUP BY 1")
def rounded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding half to even, as reports are written."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bround(F.avg("value"), 3).alias("mean3"), F.bround(F.max("value"), 2).alias("most2"))


@query("""WITH r AS (SELECT l_linenumber AS run, l_returnflag AS category, count(*) FILTER (l_discount > 0.04) AS correct, count(*) AS total FROM lineitem GROUP BY ALL),
t AS (SELECT run, sum(correct) AS correct FROM r GROUP BY 1), s AS (SELECT median(correct)::DOUBLE AS median_correct, min(correct)::BIGINT AS min_correct FROM t)
SELECT category, floor(median(correct / total) * 1000 + 0.5) / 10 AS median_pct, any_value(median_correct) AS median_correct, any_value(min_correct) AS min_correct FROM r CROSS JOIN s GROUP BY 1""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and least number right over runs, and each category's median share in per cent to one place."""
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("category")).agg(F.count_if(F.col("l_discount") > 0.04).alias("correct"), F.count("*").alias("total"))
    return evaluation.summarise_runs(runs)


@query("""WITH s AS (SELECT o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS mode, count(*) AS total FROM orders GROUP BY ALL)
SELECT name, mode, total, row_number() OVER (ORDER BY name, coalesce(mode, 'full'), total, mode IS NULL)::INT AS place FROM s""")
def sorted_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries in the order of reports, where a missing mode counts as full."""
    mode = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name"), mode.alias("mode")).agg(F.count("*").alias("total"))
    order = Window.orderBy("name", F.coalesce("mode", F.lit("full")), "total", F.col("mode").isNull())  # one row a name and mode
    return rows.withColumn("place", F.row_number().over(order))


@query(f"""WITH {_SEQ}, p AS (SELECT expected AS e, predicted AS d, list_filter(expected, lambda x: NOT list_contains(predicted, x)) AS missing, list_filter(predicted, lambda x: NOT list_contains(expected, x)) AS extra,
list_filter(list_transform(expected, lambda x: coalesce(list_position(predicted, x), 0)), lambda i: i > 0) AS spots FROM seqs),
q AS (SELECT *, coalesce(list_max(spots), 0) AS last, coalesce(list_min(spots), 0) AS first FROM p),
k AS (SELECT CASE WHEN e = d THEN 'exact' WHEN len(d) = 0 THEN 'no_emit' WHEN len(extra) = 0 AND len(missing) > 0 THEN 'missing_only' WHEN len(missing) > 0 AND len(e) > 1 THEN 'partial_multi'
WHEN NOT list_contains(e, d[1]) THEN 'wrong_initial' WHEN len(list_filter(d[1:first - 1], lambda x: NOT list_contains(e, x))) > 0 THEN 'extra_before'
WHEN len(list_filter(d[last + 1:len(d)], lambda x: NOT list_contains(e, x))) > 0 THEN CASE WHEN len(list_filter(d[last + 1:len(d)], lambda x: NOT list_contains(list_transform(e, lambda y: y % 2), x % 2))) > 0 THEN 'wrong_group_jump' ELSE 'extra_after' END
ELSE 'other' END AS kind FROM q) SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def discovery_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other order of the error kinds, for what was discovered on the way; items are odd or even groups."""
    rows = _sequences(spark, sf_dir).select(evaluation.discovery_taxonomy(F.col("expected"), F.col("predicted"), lambda x: x % 2).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


_CANDIDATES = "c AS (SELECT user_id AS utt, event_id AS cand, value AS loss, (1 + event_id % 9)::BIGINT AS length, 2 + user_id % 15 AS frames, (event_id % 4)::BIGINT AS first, (event_id % 4 + event_id % 3)::BIGINT AS last, value / 100 AS prior FROM events)"


@query(f"""WITH {_CANDIDATES}, s AS (SELECT utt, cand, round(-(loss / length) + 0.25 * prior - 0.5 * (last - first), 6) AS final FROM c WHERE 2 * length + 1 <= frames)
SELECT utt, cand, final, row_number() OVER (PARTITION BY utt ORDER BY final DESC, cand)::INT AS rank FROM s""")
def span_penalty_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by loss a token, text score, and a penalty for each further row of a span; those too long for the frames are out."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), e.alias("cand"), F.col("value").alias("loss"), (1 + e % 9).alias("length"), (2 + F.col("user_id") % 15).alias("frames"), (e % 4).alias("first"), (e % 4 + e % 3).alias("last"), (F.col("value") / 100).alias("prior"))
    return decode.rank_with_span_penalty(rows, text_weight=0.25)


_SPANS = f"""rows AS (SELECT qid // 10 AS grp, qid % 10 AS seq, {split('txt')} AS t FROM passages), filled AS (SELECT * FROM rows WHERE len(t) > 0),
seqs AS (SELECT grp, seq, 1 AS n_rows, t FROM filled
UNION ALL SELECT a.grp, a.seq, 2, list_concat(list_concat(a.t, ['|']), b.t) FROM filled a JOIN filled b ON a.grp = b.grp AND b.seq = a.seq + 1
UNION ALL SELECT a.grp, a.seq, 3, list_concat(list_concat(list_concat(list_concat(a.t, ['|']), b.t), ['|']), c.t) FROM filled a JOIN filled b ON a.grp = b.grp AND b.seq = a.seq + 1 JOIN filled c ON a.grp = c.grp AND c.seq = a.seq + 2)"""


def _token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select(F.floor(F.col("qid") / 10).alias("grp"), (F.col("qid") % 10).alias("seq"), text.words(F.col("txt")).alias("tokens"))


@query(f"""WITH {PASSAGES}, {_SPANS}, p AS (SELECT DISTINCT t[1:d] AS prefix, d FROM (SELECT t, unnest(generate_series(1, len(t))) AS d FROM seqs)), ends AS (SELECT len(t) AS d, count(*) AS n FROM seqs GROUP BY 1)
SELECT p.d::INT AS depth, count(*) AS nodes, count(DISTINCT p.prefix[1:p.d - 1]) AS parents, coalesce(any_value(ends.n), 0) AS ends FROM p LEFT JOIN ends ON ends.d = p.d GROUP BY p.d""")
def trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size by depth of the prefix tree of rows and of spans of up to three rows of a group."""
    found = decode.trie_sequences(_token_rows(spark, sf_dir), 3, "|")
    edges = decode.trie_edges(found)
    ends = found.groupBy(F.size("tokens").alias("depth")).agg(F.count("*").alias("ends"))
    sizes = edges.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_distinct("parent").alias("parents"))
    return sizes.join(ends, "depth", "left").select("depth", "nodes", "parents", F.coalesce("ends", F.lit(0)).alias("ends"))


@query()
def voted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match by indel ratio over all rows, and over spans of the groups of the best rows and of rare shared n-grams."""
    return retrieval.match_voted(passages(spark, sf_dir), corpus(spark, sf_dir))


@query()
def retrieve_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-pass retrieval without hint, by indel ratio."""
    return retrieval.retrieve(passages(spark, sf_dir), corpus(spark, sf_dir), single_limit=8, groups=3, span_limit=8, longest=4, fragments=False, indel=True)


@query()
def match_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row or span, where rows have a second spelling and opening rows a text without their opening words."""
    rows = structure.strip_opening(corpus(spark, sf_dir), "the ", 0, [1]).withColumn("other", F.translate("txt", "áéíóúñäöü", "aeiounaou"))
    return retrieval.match_rows(passages(spark, sf_dir), rows, hint=spark.createDataFrame([(3, 0)], "grp long, seq long"))
