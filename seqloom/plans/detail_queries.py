"""Queries over the smaller operators: timed words, votes and unions, quotas, cool-downs, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import alignment, similarity, text
from seqloom.operators import corpus as build
from seqloom.operators import decode, joins, retrieval
from seqloom.plans.match_queries import _PAIRS, _join, _lev, _pairs
from seqloom.plans.registry import ASCII_CORPUS, PASSAGES, query, split
from seqloom.sources.tables import ascii_corpus, corpus, passages, table
from seqloom.streaming import chunks


@query(f"""WITH {PASSAGES}, w AS (SELECT qid, {split('txt')} AS t FROM passages), e AS (SELECT qid, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS i, len(t) AS n FROM w)
SELECT qid, word, i, round(10.0 * i / n, 6) AS start, round(10.0 * (i + 1) / n, 6) AS "end" FROM e""")
def synthetic_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages(spark, sf_dir).withColumn("words", text.words(F.col("txt"))).withColumn("seconds", F.lit(10.0))
    rows = decode.spread_words(rows, "qid", "words", "seconds")
    return rows.select("qid", "word", F.col("i").cast("long").alias("i"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("SELECT user_id, round(coalesce(avg(-value) FILTER (event_type = 'view' AND value < 1), -1e308), 6) AS logp FROM events GROUP BY 1")
def mean_segment_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without a segment get the lowest finite score here, so that both engines can compare it."""
    mean = F.avg(F.when((F.col("event_type") == "view") & (F.col("value") < 1), -F.col("value")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.coalesce(mean, F.lit(-1e308)), 6).alias("logp"))


@query("""WITH s AS (SELECT user_id AS qid, floor(value)::INT % 9 AS item, event_id AS rank, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS source FROM events)
SELECT qid, item, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, item ORDER BY source, rank) AS k FROM s) WHERE k = 1""")
def union_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), (F.floor("value").cast("int") % 9).alias("item"), F.col("event_id").alias("rank"), "event_type")
    kind = F.col("event_type")
    parts = [rows.where(c).drop("event_type") for c in (kind == "view", kind == "click", ~kind.isin("view", "click"))]
    return retrieval.union_first_seen(parts, ["item"]).select("qid", "item", "source", "rank")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 10 WHEN 'fr' THEN 5 ELSE 0 END")
def bucket_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.quota(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 40, "de": 10, "fr": 5})


_PREFIX = _lev(_join("aw", "1", "least(len(aw), len(bw))"), _join("bw", "1", "least(len(aw), len(bw))"))


@query(f"""WITH {_PAIRS}, s AS (SELECT grp, seq, CASE WHEN least(len(aw), len(bw)) > 0 THEN {_PREFIX} ELSE 0.0 END AS p, {_lev('a', 'b')} AS f, len(aw)::DOUBLE / greatest(len(bw), 1) AS c FROM pairs)
SELECT grp, seq, round(CASE WHEN c > 0.8 THEN 0.3 * p + 0.7 * f ELSE 0.7 * p + 0.3 * f END, 6) AS score FROM s""")
def coverage_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    score = similarity.coverage_blend(a, b, similarity.prefix_words_ratio(a, b), similarity.lev_ratio(a, b))
    return _pairs(spark, sf_dir).select("grp", "seq", F.round(score, 6).alias("score"))


@query(f"""WITH {_PAIRS}, w AS (SELECT DISTINCT aw[1] AS x, bw[1] AS y FROM pairs WHERE len(aw) > 0 AND len(bw) > 0)
SELECT x, y, x = y OR (length(x) > 2 AND length(y) > 2 AND {_lev('x', 'y')} >= 0.7) AS same FROM w""")
def word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.get(text.words(F.col(c)), F.lit(0))
    rows = _pairs(spark, sf_dir).select(first("a").alias("x"), first("b").alias("y")).where("x is not null and y is not null").distinct()
    return rows.select("x", "y", similarity.words_match(F.col("x"), F.col("y")).alias("same"))


@query(f"""WITH {ASCII_CORPUS}, t AS (SELECT grp, seq, {split('txt')} AS w FROM corpus), r AS (SELECT grp, seq, w, {_join('w', '1', '3')} AS r FROM t),
k AS (SELECT grp, seq, w, r, unnest([k for k in [len({split('r')}) - 1, len({split('r')}), len({split('r')}) + 1] if k >= 1 and k <= len(w)]) AS k FROM r),
s AS (SELECT grp, seq, max(k) FILTER (r = {_join('w', '1', 'k')}) AS cut FROM k GROUP BY ALL)
SELECT grp, seq, {_join('w', 'coalesce(cut, 0) + 1', 'len(w)')} AS rest FROM r LEFT JOIN s USING (grp, seq)""")
def strip_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's own first three words as the residual: they go."""
    residual = F.array_join(F.slice(text.words(F.col("txt")), 1, 3), " ")
    return ascii_corpus(spark, sf_dir).select("grp", "seq", similarity.strip_leading_residual(F.col("txt"), residual).alias("rest"))


@query("""WITH n AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer), c AS (SELECT greatest(count(*) // 64, 1) AS step FROM customer)
SELECT c_custkey, c_name FROM n CROSS JOIN c WHERE place % step = 0""")
def round_trip_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced rows for a round-trip test."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    step = max(rows.count() // 64, 1)
    return build.numbered(rows, "c_custkey", "at").where(F.col("at") % step == 0).drop("at")


@query()
def alarm_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of rapid switching that are at least 300 events after the last one raised."""
    rows = chunks.rapid_switching(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", 400, 4)
    return chunks.with_cooldown(rows.where("alarm"), "user_id", "event_id", 300)


@query("SELECT user_id AS session, item, min(event_id) AS first FROM (SELECT user_id, event_id, floor(value)::INT % 12 AS item FROM events) GROUP BY ALL")
def chunkwise_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), (F.floor("value").cast("int") % 12).alias("item"), "event_id")
    return rows.groupBy("session", "item").agg(F.min("event_id").alias("first"))


@query("""WITH c AS (SELECT doc_id, n_chars AS n, unnest(generate_series(0, (n_chars - 1) // 2400)) AS chunk FROM documents WHERE n_chars > 0)
SELECT doc_id, chunk, chunk * 2400 AS start, least(2500, n - chunk * 2400) AS n, least(2500, n - chunk * 2400) AS padded FROM c""")
def long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.long_windows(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("len")), "doc_id", "len", 2500, 100)


@query()
def best_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage as it is and without its first word; the better match of the two."""
    w = text.words(F.col("txt"))
    asked = passages(spark, sf_dir).select("qid", F.array("txt", F.array_join(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), " ")).alias("hypotheses"))
    c = corpus(spark, sf_dir)
    return retrieval.best_hypothesis(asked, lambda q: retrieval.match_rows(q, c)).select("qid", "pos", "grp", "seq", "seq_end", "score")


@query()
def dtw_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring labels' frames, all of them in order of vec_id, compared by dynamic time warping."""
    frames = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("f"))
    other = frames.select((F.col("label") - 1).alias("label"), F.col("f").alias("g"))
    return frames.join(other, "label").select("label", F.round(alignment.udfs()["dtw_similarity"]("f", "g"), 6).alias("score"))


@query(f"""WITH {PASSAGES}, w AS (SELECT qid, {split('txt')} AS t FROM passages), p AS (SELECT qid, t, unnest(generate_series(1, least(len(t), 6))) AS n FROM w)
SELECT array_to_string(t[1:n], ' ') AS prefix, count(*) AS n_rows FROM p GROUP BY 1""")
def word_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.words(F.col("txt"))
    rows = passages(spark, sf_dir).where(F.size(w) > 0).select(w.alias("w"), F.explode(F.sequence(F.lit(1), F.least(F.size(w), F.lit(6)))).alias("n"))
    return rows.groupBy(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("prefix")).agg(F.count("*").alias("n_rows"))


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS peak, max(value) OVER (PARTITION BY user_id ORDER BY event_id) - value > 15 AS dropped FROM events")
def running_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = F.max("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", peak.alias("peak"), (peak - F.col("value") > 15).alias("dropped"))


@query()
def grapheme_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written in vowelled Arabic letters, as phonemes."""
    from seqloom.functions.phonemes import phonemes_udf

    arabic = F.translate(F.lower("txt"), "abdefhijklmnqrstuwxyzcgopv", "َبدِفهِجكلمنقرستُوخيزكغُبف")
    return passages(spark, sf_dir).select("qid", phonemes_udf()(arabic).alias("sounds"))
