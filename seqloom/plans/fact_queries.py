"""Queries over evaluation, aggregates, corpus engineering and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import scalar
from seqloom.operators import corpus as build
from seqloom.operators import evaluation, joins
from seqloom.plans.registry import query
from seqloom.sources.tables import table

#: Sequences to evaluate: a user's events in order as predicted, every second or third changed or dropped as expected.
_SEQ = """seqs AS (SELECT user_id, part, list(item ORDER BY event_id) AS expected, coalesce(list(CASE WHEN event_id % 7 = 3 THEN item + 1 ELSE item END ORDER BY event_id) FILTER (event_id % 5 <> 2), []) AS predicted
FROM (SELECT user_id, event_id, event_id // 3000 AS part, floor(value)::INT % 5 AS item FROM events) GROUP BY ALL)"""


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 3000).alias("part"), (F.floor("value").cast("int") % 5).alias("item"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["item"])
    told = F.when(F.col("event_id") % 5 != 2, F.struct("event_id", F.when(F.col("event_id") % 7 == 3, F.col("item") + 1).otherwise(F.col("item")).alias("item")))
    return rows.groupBy("user_id", "part").agg(ordered(F.struct("event_id", "item")).alias("expected"), ordered(told).alias("predicted"))


_GREEDY = """steps AS (SELECT user_id, part, expected, predicted, list_reduce(expected, lambda s, e: CASE WHEN list_position(predicted[(s % 1000) + 1:], e) > 0 THEN s + 1000 + list_position(predicted[(s % 1000) + 1:], e) ELSE s END, 0) AS state FROM seqs)"""


@query(f"""WITH {_SEQ}, {_GREEDY} SELECT user_id, part, round(CASE WHEN len(predicted) = 0 THEN 0 ELSE (state // 1000)::DOUBLE / len(expected) END, 6) AS recall,
round(CASE WHEN len(predicted) = 0 THEN 0 ELSE (state // 1000)::DOUBLE / len(predicted) END, 6) AS "precision", CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END::DOUBLE AS sequence_accuracy FROM steps""")
def sequence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir).select("user_id", "part", evaluation.sequence_score(F.col("expected"), F.col("predicted")).alias("s"))
    return rows.select("user_id", "part", *[F.round(f"s.{c}", 6).alias(c) for c in ("recall", "precision", "sequence_accuracy")])


_DISTINCT = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query(f"""WITH {_SEQ}, d AS (SELECT user_id, part, {_DISTINCT('expected')} AS e, {_DISTINCT('predicted')} AS p FROM seqs)
SELECT user_id, part, round(len(list_intersect(e, p))::DOUBLE / len(e), 6) AS recall, round(CASE WHEN len(p) = 0 THEN 1.0 ELSE len(list_intersect(e, p))::DOUBLE / len(p) END, 6) AS "precision", list_sort(e) = list_sort(p) AS exact, e = p AS ordered FROM d""")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir).select("user_id", "part", evaluation.set_metrics(F.col("expected"), F.col("predicted")).alias("s"))
    return rows.select("user_id", "part", F.round("s.recall", 6).alias("recall"), F.round("s.precision", 6).alias("precision"), "s.exact", "s.ordered")


@query(f"WITH {_SEQ} SELECT user_id, part, {_DISTINCT('predicted')} AS items FROM seqs")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("user_id", "part", F.array_distinct("predicted").alias("items"))


_SHAPE = """CASE WHEN miss = 0 AND extra = 0 THEN 'exact' WHEN np = 0 THEN 'no_emit' WHEN hit = 0 AND extra > 0 THEN 'wrong_only' WHEN miss > 0 AND extra = 0 THEN 'missing_only' WHEN miss > 0 THEN 'partial_with_extra' ELSE 'expected_plus_extra' END"""
_PARTS = """len(list_distinct(list_filter(expected, lambda x: NOT list_contains(predicted, x)))) AS miss, len(list_distinct(list_filter(predicted, lambda x: NOT list_contains(expected, x)))) AS extra, len(list_intersect(expected, predicted)) AS hit, len(predicted) AS np"""


@query(f"WITH {_SEQ}, c AS (SELECT user_id, part, {_PARTS} FROM seqs) SELECT {_SHAPE} AS shape, count(*) AS n FROM c GROUP BY 1")
def error_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).groupBy(evaluation.error_shape(F.col("expected"), F.col("predicted")).alias("shape")).agg(F.count("*").alias("n"))


@query(f"""WITH {_SEQ}, o AS (SELECT user_id, part, expected, list_filter(predicted, lambda x: x < 4) AS predicted FROM seqs), a AS (SELECT user_id, part, {_PARTS} FROM seqs), b AS (SELECT user_id, part, {_PARTS} FROM o),
x AS (SELECT user_id, part, {_SHAPE} AS stream FROM a), y AS (SELECT user_id, part, {_SHAPE} AS oracle FROM b)
SELECT CASE WHEN stream = 'exact' AND oracle = 'exact' THEN 'both_exact' WHEN stream = 'exact' THEN 'stream_only' WHEN oracle = 'exact' THEN 'oracle_only' WHEN stream = oracle THEN 'both_' || stream ELSE 'differ' END AS outcome, count(*) AS n FROM x JOIN y USING (user_id, part) GROUP BY 1""")
def oracle_compare_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir)
    stream = rows.select("user_id", "part", evaluation.error_shape(F.col("expected"), F.col("predicted")).alias("stream"))
    oracle = rows.select("user_id", "part", evaluation.error_shape(F.col("expected"), F.filter("predicted", lambda x: x < 4)).alias("oracle"))
    s, o = F.col("stream"), F.col("oracle")
    outcome = F.when((s == "exact") & (o == "exact"), "both_exact").when(s == "exact", "stream_only").when(o == "exact", "oracle_only").when(s == o, F.concat(F.lit("both_"), s)).otherwise("differ")
    return stream.join(oracle, ["user_id", "part"]).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query()
def run_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = lambda c: F.transform(c, lambda x: F.struct((x % 2).alias("grp"), x.alias("seq")))
    rows = _sequences(spark, sf_dir).select(evaluation.run_taxonomy(refs("expected"), refs("predicted")).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT user_id, event_id, floor(value)::INT // 10 AS grp, floor(value)::INT % 10 AS seq, event_type = 'click' AS expected FROM events),
l AS (SELECT *, lag(grp) OVER w AS g, lag(seq) OVER w AS s FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) FILTER (g IS NOT NULL AND (g <> grp OR s <> seq) AND NOT (g = grp AND abs(s - seq) <= 3) AND NOT expected) AS jumps FROM l GROUP BY 1""")
def false_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor("value").cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(v / 10).alias("grp"), (v % 10).alias("seq"), (F.col("event_type") == "click").alias("expected"))
    return evaluation.false_jumps(rows, "user_id", "event_id")


@query("SELECT user_id, min(epoch_us(ts)) FILTER (event_type = 'purchase') - min(epoch_us(ts)) AS micros FROM events GROUP BY 1")
def time_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.min(F.when(F.col("event_type") == "purchase", at)) - F.min(at)).alias("micros"))


@query("SELECT user_id, CASE WHEN bool_and(value > 0.3) THEN 'stable_pass' WHEN NOT bool_or(value > 0.3) THEN 'stable_fail' ELSE 'flaky' END AS stability, count(*) AS n_runs FROM events GROUP BY 1")
def stability_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stability(table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 0.3), "user_id", "ok")


@query("WITH r AS (SELECT l_returnflag, l_linenumber AS run, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(median(m), 4) AS median_of_means FROM r GROUP BY 1")
def median_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"))
    return means.groupBy("l_returnflag").agg(F.round(F.percentile("m", 0.5), 4).alias("median_of_means"))


@query("SELECT l_returnflag, round(sum(l_discount) / sum(l_quantity), 9) AS micro, round(avg(l_discount / l_quantity), 9) AS macro FROM lineitem GROUP BY 1")
def micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_discount") / F.sum("l_quantity"), 9).alias("micro"), F.round(F.avg(F.col("l_discount") / F.col("l_quantity")), 9).alias("macro"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS recall, round(avg(l_discount), 6) AS \"precision\", round(avg(l_tax), 6) AS latency, count(*) AS total FROM lineitem GROUP BY ALL")
def experiment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("recall"), F.round(F.avg("l_discount"), 6).alias("precision"), F.round(F.avg("l_tax"), 6).alias("latency"), F.count("*").alias("total"))


@query("""WITH b AS (SELECT o_custkey, o_totalprice AS score, o_orderkey AS cost, o_orderkey % 2 AS fresh FROM orders)
SELECT o_custkey, score, cost FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, cost, fresh) AS k FROM b) WHERE k = 1""")
def best_run_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("cost"))
    return evaluation.upsert_best(rows.where("cost % 2 = 0"), rows.where("cost % 2 = 1"), ["o_custkey"], "score", "cost")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_totalprice > 250000 THEN 100.0 ELSE 0 END), 1) AS accuracy FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("hit", F.when(F.col("o_totalprice") > 250000, 100.0).otherwise(0.0))
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return rows.groupingSets([[s, p], [s], []], s, p).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 1).alias("accuracy"))


@query("SELECT event_type, CASE WHEN value < 5 THEN 'low' ELSE 'high' END AS kind, count(*) AS n FROM events GROUP BY ROLLUP (event_type, kind)")
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("value") < 5, "low").otherwise("high"))
    return rows.rollup("event_type", "kind").agg(F.count("*").alias("n"))


@query("SELECT least(floor(l_discount * 100)::INT, 9) AS decile, count(*) AS n FROM lineitem GROUP BY 1")
def decile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.floor(F.col("l_discount") * 100).cast("int"), F.lit(9)).alias("decile")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_discount >= 0.05 THEN 'good' WHEN l_discount >= 0.02 THEN 'uncertain' ELSE 'bad' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy(F.when(d >= 0.05, "good").when(d >= 0.02, "uncertain").otherwise("bad").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type, min(value) AS lowest, round(avg(value), 6) AS mean, max(value) AS highest, round(sum(value) / count(DISTINCT user_id), 6) AS rtf FROM events GROUP BY 1")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("lowest"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("highest"), F.round(F.sum("value") / F.count_distinct("user_id"), 6).alias("rtf"))


@query("SELECT c_mktsegment AS key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment)::INT AS rank FROM customer GROUP BY 1")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.histogram(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("WITH g AS (SELECT source, lang, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY source, lang) SELECT source, lang, n, round(m, 4) AS mean, row_number() OVER (PARTITION BY lang ORDER BY m DESC, source)::INT AS rank FROM g")
def model_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("m"), "source"))
    return rows.select("source", "lang", "n", F.round("m", 4).alias("mean"), rank.alias("rank"))


@query("SELECT avg(value) AS mean FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def mean_over_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(kept, "user_id", "left_semi").agg(F.avg("value").alias("mean"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT unnest(generate_series(l_orderkey, l_orderkey + 1)) FROM lineitem WHERE l_linenumber > 5)")
def anti_join_used_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_linenumber > 5").select(F.explode(scalar.range_of(F.col("l_orderkey"), F.col("l_orderkey") + 1)).alias("o_orderkey"))
    return joins.unused(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), used, ["o_orderkey"])


@query("SELECT p_name, CASE WHEN min(p_brand) = max(p_brand) THEN min(p_brand) END AS p_brand, CASE WHEN min(p_brand) = max(p_brand) THEN 'mapped' ELSE 'ambiguous' END AS outcome FROM part GROUP BY 1")
def ambiguous_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.lookup_unless_ambiguous(table(spark, sf_dir, "part").select("p_name", "p_brand"), "p_name", "p_brand")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1")
def last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_wins(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey")


@query("SELECT n.n_name, r.r_name, count(*) AS n, round(sum(c.c_acctbal), 2) AS total FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"), F.sum("c_acctbal").alias("s"))
    return rows.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.sum("k").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("SELECT d.doc_id, coalesce([l.quality, l.toxic], [-1, -1]) AS marks FROM documents d LEFT JOIN labels l USING (doc_id)".replace("coalesce([l.quality, l.toxic], [-1, -1])", "CASE WHEN l.quality IS NOT NULL THEN [l.quality, l.toxic] ELSE [-1, -1] END"))
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.when(F.col("quality").isNotNull(), F.array("quality", "toxic")), F.array(F.lit(-1), F.lit(-1))).alias("marks"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 3")
def cap_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.cap_per_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", 3)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) AS k FROM documents) WHERE k <= 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 50, 7)


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS slot FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4)


@query("SELECT CASE WHEN doc_id % 50 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(build.holdout(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS seen, count(*) FILTER (quality IS NULL) AS unmapped, count(*) FILTER (quality = 0) AS denied, count(*) FILTER (quality = 1 AND n_chars > 5000) AS too_long, count(*) FILTER (quality = 1 AND n_chars <= 5000) AS kept FROM documents LEFT JOIN labels USING (doc_id)""")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    reason = F.when(q.isNull(), "unmapped").when(q == 0, "denied").when(F.col("n_chars") > 5000, "too_long").otherwise("kept")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return build.funnel(rows.withColumn("reason", reason), "reason", ["unmapped", "denied", "too_long", "kept"])


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT doc_id, CASE WHEN (doc_id // 100) % 3 = 1 THEN 'original' ELSE 'relabelled' END AS origin FROM documents")
def chunk_merge_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").withColumn("chunk", F.floor(F.col("doc_id") / 100))
    done = rows.where("chunk % 3 <> 1").withColumn("origin", F.lit("relabelled"))
    return build.merge_chunks(rows.withColumn("origin", F.lit("original")), done, "chunk").select("doc_id", "origin")


@query("SELECT doc_id AS id, source, length(text) AS n FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark")
def manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.length("text").cast("long").alias("n"))
    return docs.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source"), F.length("text").cast("long").alias("n")))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS unseen FROM orders)
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY unseen DESC, o_orderkey) AS k FROM r) WHERE k <= (SELECT count(*) // 5 FROM orders)""")
def prefer_unseen_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of all orders, each customer's first order before any second."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    marked = rows.join(first, "o_custkey").withColumn("unseen", F.col("o_orderkey") == F.col("first"))
    return marked.orderBy(F.desc("unseen"), "o_orderkey").limit(rows.count() // 5).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // (SELECT ceil(count(*) / 12)::BIGINT FROM documents) AS chunk FROM documents")
def contiguous_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.contiguous_chunks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 12)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END, 0) DESC, o_orderdate DESC, o_orderkey)::INT AS place FROM orders ORDER BY place LIMIT 100")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report: the hundred first by a key with a default, newest first."""
    price = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), F.lit(0.0))
    top = table(spark, sf_dir, "orders").withColumn("p", price).orderBy(F.desc("p"), F.desc("o_orderdate"), "o_orderkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p"), F.desc("o_orderdate"), "o_orderkey"))).select("o_orderkey", "place")
