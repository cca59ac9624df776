"""Queries over n-grams and the structure of an ordered corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import ngrams, text
from seqloom.operators import structure
from seqloom.plans.registry import CORPUS, PASSAGES, query, split
from seqloom.sources.tables import corpus, passages, table

_GRAMS = lambda x, n: f"CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(generate_series(1, length({x}) - {n - 1}), lambda i: substr({x}, i, {n}))) ELSE [] END"
_TOKENS = lambda x, n: f"CASE WHEN len({x}) >= {n} THEN list_transform(generate_series(1, len({x}) - {n - 1}), lambda i: array_to_string({x}[i:i + {n - 1}], ' ')) ELSE [] END"


@query(f"WITH {PASSAGES} SELECT qid, unnest({_GRAMS('txt', 3)}) AS gram FROM passages")
def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("qid", F.explode(ngrams.char_ngrams(F.col("txt"), 3)).alias("gram"))


@query(f"""WITH {CORPUS}, g AS (SELECT unnest({_GRAMS('txt', 3)}) AS gram FROM corpus)
SELECT gram, count(*) AS df, round(ln((SELECT count(*) FROM corpus) / count(*)), 6) AS idf FROM g GROUP BY gram""")
def ngram_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    total = rows.count()
    found = rows.select(F.struct("grp", "seq").alias("id"), F.explode(ngrams.char_ngrams(F.col("txt"), 3)).alias("gram"))
    return ngrams.idf(found, "id", "gram", total).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {CORPUS}, {PASSAGES},
p AS (SELECT qid, {_GRAMS('txt', 2)} AS b, {_GRAMS('txt', 3)} AS t FROM passages)
SELECT x.qid, y.qid AS other, len(list_intersect(x.b, y.b)) + 0.48 * len(list_intersect(x.t, y.t)) AS overlap FROM p x JOIN p y ON x.qid < y.qid""")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).select("qid", ngrams.char_ngrams(F.col("txt"), 2).alias("b"), ngrams.char_ngrams(F.col("txt"), 3).alias("t"))
    o = p.select(F.col("qid").alias("other"), F.col("b").alias("b2"), F.col("t").alias("t2"))
    overlap = ngrams.shared(F.col("b"), F.col("b2")) + 0.48 * ngrams.shared(F.col("t"), F.col("t2"))
    return p.join(o, F.col("qid") < F.col("other")).select("qid", "other", overlap.alias("overlap"))


def _ngram_sql(n: int) -> str:
    context = f"array_to_string(g[1:{n - 1}], ' ')" if n > 1 else "''"
    return f"""WITH {CORPUS}, w AS (SELECT {split('txt')} AS t FROM corpus),
e AS (SELECT unnest(CASE WHEN len(t) >= {n} THEN list_transform(generate_series(1, len(t) - {n - 1}), lambda i: t[i:i + {n - 1}]) ELSE [] END) AS g FROM w)
SELECT {context} AS context, g[{n}] AS word, count(*) AS cnt FROM e GROUP BY ALL"""


@query(_ngram_sql(2))
def word_bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.counts(corpus(spark, sf_dir).withColumn("w", text.words(F.col("txt"))), "w", 2)


@query(_ngram_sql(3))
def word_trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.counts(corpus(spark, sf_dir).withColumn("w", text.words(F.col("txt"))), "w", 3)


_COUNTS = ", ".join(f"k{n} AS (SELECT {c} AS context, g[{n}] AS word, count(*) AS cnt FROM (SELECT unnest(CASE WHEN len(t) >= {n} THEN list_transform(generate_series(1, len(t) - {n - 1}), lambda i: t[i:i + {n - 1}]) ELSE [] END) AS g FROM w) GROUP BY ALL)" for n, c in ((1, "''"), (2, "g[1]"), (3, "g[1] || ' ' || g[2]")))


@query(f"""WITH {CORPUS}, {PASSAGES}, w AS (SELECT {split('txt')} AS t FROM corpus), {_COUNTS},
q AS (SELECT DISTINCT qid, unnest({_TOKENS(split('txt'), 3)}) AS g FROM passages),
p AS (SELECT qid, string_split(g, ' ') AS g FROM q),
s AS (SELECT count(*) AS v, sum(cnt) AS n FROM k1),
n3 AS (SELECT context, sum(cnt) AS n FROM k3 GROUP BY 1), n2 AS (SELECT context, sum(cnt) AS n FROM k2 GROUP BY 1)
SELECT qid, g[1] AS c2, g[2] AS c1, g[3] AS word, round(CASE WHEN n3.n IS NOT NULL THEN ln((coalesce(k3.cnt, 0) + 0.1) / (n3.n + 0.1 * s.v))
  WHEN n2.n IS NOT NULL THEN ln((coalesce(k2.cnt, 0) + 0.1) / (n2.n + 0.1 * s.v)) ELSE ln((coalesce(k1.cnt, 0) + 0.1) / (s.n + 0.1 * s.v)) END, 6) AS logp
FROM p CROSS JOIN s LEFT JOIN n3 ON n3.context = g[1] || ' ' || g[2] LEFT JOIN k3 ON k3.context = g[1] || ' ' || g[2] AND k3.word = g[3]
LEFT JOIN n2 ON n2.context = g[2] LEFT JOIN k2 ON k2.context = g[2] AND k2.word = g[3] LEFT JOIN k1 ON k1.word = g[3]""")
def lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).withColumn("w", text.words(F.col("txt")))
    uni, bi, tri = (ngrams.counts(c, "w", n) for n in (1, 2, 3))
    grams = passages(spark, sf_dir).select("qid", F.explode(ngrams.token_ngrams(text.words(F.col("txt")), 3)).alias("g")).distinct().withColumn("g", F.split("g", " "))
    asked = grams.select("qid", F.col("g")[0].alias("c2"), F.col("g")[1].alias("c1"), F.col("g")[2].alias("word"))
    return ngrams.backoff(asked, uni, bi, tri).withColumn("logp", F.round("logp", 6))


@query(f"""WITH {CORPUS}, p AS (SELECT list_concat(['<bos>', '<bos>'], {split('txt')}, ['<eos>']) AS t FROM corpus),
e AS (SELECT unnest(list_transform(generate_series(1, len(t) - 2), lambda i: t[i:i + 2])) AS g FROM p),
k AS (SELECT g[1] || ' ' || g[2] AS context, g[3] AS word, count(*) AS cnt FROM e GROUP BY ALL)
SELECT context, word, cnt, round(cnt / sum(cnt) OVER (PARTITION BY context), 6) AS share FROM k""")
def lm_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.array(F.lit("<bos>"), F.lit("<bos>")), text.words(F.col("txt")), F.array(F.lit("<eos>")))
    k = ngrams.counts(corpus(spark, sf_dir).withColumn("w", padded), "w", 3)
    return k.withColumn("share", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("context")), 6))


@query(f"WITH {CORPUS}, w AS (SELECT DISTINCT unnest({split('txt')}) AS word FROM corpus) SELECT word FROM w")
def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(F.explode(text.words(F.col("txt"))).alias("word")).distinct().orderBy("word")


@query(f"WITH {CORPUS}, w AS (SELECT DISTINCT unnest({split('txt')}) AS word FROM corpus), p AS (SELECT word, unnest(list_transform(generate_series(1, length(word)), lambda i: substr(word, 1, i))) AS prefix FROM w) SELECT prefix, count(*) AS n_words FROM p GROUP BY 1")
def vocab_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = corpus(spark, sf_dir).select(F.explode(text.words(F.col("txt"))).alias("word")).distinct()
    return v.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n_words"))


_SPANS = "spans AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT grp, seq, lead(seq, {k - 1}) OVER w AS seq_end, {k} AS n_rows, txt || {' || '.join(f''' ' ' || lead(txt, {i}) OVER w''' for i in range(1, k))} AS span_text FROM corpus WINDOW w AS (PARTITION BY grp ORDER BY seq)) WHERE seq_end IS NOT NULL" for k in (2, 3, 4)) + ")"


@query(f"WITH {CORPUS}, {_SPANS} SELECT * FROM spans")
def spans_2_to_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.spans(corpus(spark, sf_dir), 4)


@query(f"WITH {CORPUS}, {_SPANS} SELECT * FROM spans WHERE seq = 0")
def opening_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.opening_spans(corpus(spark, sf_dir), 4)


@query(f"WITH {CORPUS}, {_SPANS}, hits AS (SELECT DISTINCT grp, seq AS at FROM corpus WHERE length(txt) > 900) SELECT DISTINCT s.* FROM spans s JOIN hits h ON s.grp = h.grp AND h.at BETWEEN s.seq AND s.seq_end")
def spans_around_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    hits = c.where(F.length("txt") > 900).select("grp", F.col("seq").alias("at"))
    return structure.spans_around(hits, c, 4)


@query("""WITH r AS (SELECT conv_id AS grp, turn AS seq, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS own FROM conversations),
f AS (SELECT conv_id AS g, min(turn) AS first FROM conversations GROUP BY 1)
SELECT grp, seq, CASE WHEN own IS NOT NULL THEN grp ELSE f.g END AS next_grp, coalesce(own, f.first) AS next_seq FROM r LEFT JOIN f ON f.g = r.grp + 1""")
def next_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.successors(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT grp, seq, list(txt) OVER (PARTITION BY grp ORDER BY seq RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM corpus")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.neighbours(corpus(spark, sf_dir), 2)


@query("""WITH h AS (SELECT conv_id * 1000 + turn AS qid, conv_id AS hg, turn AS hs FROM conversations),
r AS (SELECT conv_id AS grp, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
l AS (SELECT qid, hg FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.grp = hg AND r.seq = hs + 1))
SELECT qid, grp, seq, [0.22, 0.12, 0.06][seq - hs]::DOUBLE AS bonus FROM h JOIN r ON grp = hg AND seq BETWEEN hs + 1 AND hs + 3 WHERE qid NOT IN (SELECT qid FROM l)
UNION ALL SELECT qid, grp, seq, [0.22, 0.12, 0.06][place + 1]::DOUBLE FROM l JOIN r ON grp = hg + 1 AND place < 3""")
def continuation_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).select("grp", "seq")
    return structure.continuation_bonuses(c, c.select((F.col("grp") * 1000 + F.col("seq")).alias("qid"), "grp", "seq"))


@query("""WITH v AS (SELECT user_id AS grp, floor(value)::INT % 17 AS seq, sum(value) AS w FROM events GROUP BY ALL),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY grp ORDER BY seq) AS island FROM v),
r AS (SELECT grp, island, min(seq) AS first_seq, max(seq) AS last_seq, sum(w) AS weight FROM i GROUP BY ALL)
SELECT grp, first_seq, last_seq, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(weight, 9) DESC, first_seq) AS k FROM r) WHERE k = 1""")
def best_contiguous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), (F.floor("value").cast("int") % 17).alias("seq"), F.col("value").alias("weight"))
    return structure.best_run(votes).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {CORPUS} SELECT grp, seq, CASE WHEN seq = 0 AND grp NOT IN (1, 9) AND starts_with(txt, 'The ') THEN nullif(trim(substr(txt, 5)), '') END AS no_opening FROM corpus""")
def strip_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.strip_opening(corpus(spark, sf_dir), "The ", 0, [1, 9]).select("grp", "seq", "no_opening")


@query(f"""WITH {PASSAGES}, t AS (SELECT qid, list_transform({split('txt')}, lambda w: CASE WHEN w LIKE '%.' OR w LIKE '%,' THEN '|' ELSE w END) AS toks FROM passages),
e AS (SELECT qid, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM t),
n AS (SELECT *, coalesce(count(*) FILTER (tok = '|') OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS word FROM e)
SELECT qid, word, max(pos) + 1 AS "end" FROM n WHERE tok <> '|' GROUP BY ALL""")
def token_word_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = F.transform(text.words(F.col("txt")), lambda w: F.when(F.endswith(w, F.lit(".")) | F.endswith(w, F.lit(",")), "|").otherwise(w))
    return structure.word_ends(passages(spark, sf_dir).select("qid", toks.alias("toks")), "qid", "toks", "|").withColumn("end", F.col("end").cast("long"))
