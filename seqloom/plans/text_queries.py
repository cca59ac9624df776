"""Queries over text functions, predicates and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scalar, text
from seqloom.plans.registry import query, split, ws
from seqloom.sources.tables import corpus, table

_NORMAL = ws("""regexp_replace(regexp_replace(regexp_replace(text, '[\\x{064B}-\\x{065F}\\x{06D6}-\\x{06ED}\\x{0640}]', '', 'g'), '[\\x{FD3E}\\x{FD3F}\\x{0660}-\\x{0669}\\x{06F0}-\\x{06F9}]', '', 'g'), '[.,;:!?\\x{2026}\\x{060C}\\x{061B}\\x{061F}]', '', 'g')""")


@query(f"SELECT doc_id, {_NORMAL} AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_arabic(F.col("text")).alias("norm"))


@query(f"SELECT conv_id, turn, {ws('text')} AS norm FROM conversations")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fold_arabic(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {ws('text')} AS norm, length({ws('text')}) AS n FROM documents")
def collapse_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.collapse_ws(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", norm.alias("norm"), F.length(norm).cast("long").alias("n"))


@query(f"SELECT doc_id, len({split('text')}) AS n_words, {split('text')}[1] AS first_word, replace(text, ' ', '') AS joined FROM documents")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.get(w, F.lit(0)).alias("first_word"), text.despace(F.col("text")).alias("joined"))


@query(f"SELECT CASE WHEN len({split('text')}) <= 5 THEN 'short' WHEN len({split('text')}) <= 15 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM conversations GROUP BY 1")
def length_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(scalar.length_bucket(text.words(F.col("text"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, lpad(conv_id::VARCHAR, 6, '0') || lpad(turn::VARCHAR, 6, '0') AS key, translate(turn::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits FROM conversations")
def lookup_key_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.pad_key(F.col("conv_id"), F.col("turn"), 6).alias("key"), text.localised_digits(F.col("turn")).alias("digits"))


@query(f"SELECT item_id, array_to_string(list_transform({split('text')}, lambda w, i: CASE WHEN i IN (1, 3) THEN '[' || w || ']' ELSE w END), ' ') AS marked FROM benchmark")
def highlight_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.highlight(text.words(F.col("text")), F.array(F.lit(0), F.lit(2))).alias("marked"))


@query(f"SELECT item_id, list_transform(list_filter({split('text')}, lambda w: w IN ('the', 'and', 'of')), lambda w: CASE w WHEN 'the' THEN 'DH' WHEN 'and' THEN 'AE' ELSE 'AH' END) AS firsts, len(list_filter({split('text')}, lambda w: w IN ('the', 'and', 'of'))) * 2 AS n FROM benchmark")
def map_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for x in ("the", "DH AH", "and", "AE ND", "of", "AH V")])
    mapped = text.map_tokens(text.words(F.col("text")), pairs)
    return table(spark, sf_dir, "benchmark").select("item_id", F.filter(mapped, lambda x, i: i % 2 == 0).alias("firsts"), F.size(mapped).cast("long").alias("n"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND user_id BETWEEN 10 AND 60")
def filter_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") & F.col("user_id").between(10, 60)).select("event_id", "user_id", "value")


@query("SELECT d.doc_id, l.quality, coalesce(l.quality = 1, false) AS correct FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.quality IN (0), false)")
def deny_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(scalar.not_denied(F.col("quality"), [0])).select("doc_id", "quality", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("correct"))


@query("SELECT doc_id, coalesce(CASE WHEN n_chars > 500 THEN n_chars END, length(text)) AS duration FROM documents WHERE coalesce(CASE WHEN n_chars > 500 THEN n_chars END, length(text)) BETWEEN 100 AND 5000")
def duration_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("n_chars") > 500, F.col("n_chars"))
    measured = F.coalesce(known, F.length("text").cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", measured.alias("duration")).where(F.col("duration").between(100, 5000))


@query("SELECT l_orderkey, l_linenumber, unnest(generate_series(l_linenumber, greatest(l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber ELSE (l_linenumber + l_quantity % 4)::INT END))) AS seq FROM lineitem")
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") + F.col("l_quantity") % 4).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(scalar.range_of(F.col("l_linenumber").cast("long"), last.cast("long"))).alias("seq"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber <> l_quantity::INT THEN l_orderkey || ':' || l_linenumber || '-' || l_quantity::INT ELSE l_orderkey || ':' || l_linenumber END AS ref FROM lineitem""")
def ref_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.format_ref(F.col("l_orderkey"), F.col("l_linenumber"), last).alias("ref"))


@query("SELECT conv_id, turn, conv_id AS grp, turn AS first, turn + turn % 3 AS last FROM conversations")
def ref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = scalar.format_ref(F.col("conv_id"), F.col("turn"), F.col("turn") + F.col("turn") % 3)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.parse_ref(ref).alias("r"))
    return rows.select("conv_id", "turn", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("grp", "first", "last")])


@query("SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang, try_cast(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS BIGINT) AS number FROM pages")
def regex_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", i)
    return table(spark, sf_dir, "pages").select("page_id", part(1).alias("lang"), part(2).try_cast("bigint").alias("number"))


@query("""WITH k AS (SELECT c_custkey, string_split(c_name, '#') AS p FROM customer)
SELECT count(*) AS n, count(*) FILTER (try_cast(p[2] AS BIGINT) IS NULL) AS failed, sum(try_cast(p[2] AS BIGINT))::BIGINT AS total FROM k""")
def split_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.try_element_at(F.split("c_name", "#"), F.lit(2)).try_cast("bigint")
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("n"), F.count_if(number.isNull()).alias("failed"), F.sum(number).alias("total"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN n_chars < 500 THEN lang END), ''), nullif(trim(CASE WHEN n_chars < 1000 THEN source ELSE ' ' END), ''), '') AS label FROM documents")
def coalesce_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", scalar.first_filled(F.when(n < 500, F.col("lang")), F.when(n < 1000, F.col("source")).otherwise(F.lit(" "))).alias("label"))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 5.0 ELSE least(greatest(value, 5.0), 20.0) END AS value FROM events")
def clamp_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "signup", F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", scalar.clamp(value, 5.0, 20.0).alias("value"))


@query(f"SELECT conv_id, turn, len({split('text')}) AS n_tokens, 2 * len({split('text')}) + 1 <= 60 AS feasible FROM conversations WHERE len({split('text')}) BETWEEN 1 AND 45")
def feasible_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(text.words(F.col("text")))
    rows = table(spark, sf_dir, "conversations").where(n.between(1, 45))
    return rows.select("conv_id", "turn", n.cast("long").alias("n_tokens"), scalar.feasible(n, F.lit(60)).alias("feasible"))


@query("SELECT user_id, nullif(floor(value)::INT % 3, 0) AS predicted, count(*) AS n FROM events GROUP BY ALL")
def null_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.nullif(F.floor("value").cast("int") % 3, F.lit(0)).alias("predicted")).agg(F.count("*").alias("n"))


@query("SELECT json_extract_string(props, '$.k')::INT % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"SELECT grp, count(*) AS n_rows, min(seq) AS first, max(seq) AS last FROM (SELECT conv_id AS grp, turn AS seq FROM conversations) GROUP BY 1")
def group_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n_rows"), F.min("seq").alias("first"), F.max("seq").alias("last"))
