"""Queries over similarities, joins and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import alignment, ngrams, similarity, text
from seqloom.operators import joins, retrieval, structure
from seqloom.plans.registry import ASCII_CORPUS, ASCII_PASSAGES, CORPUS, PASSAGES, query, split, ws
from seqloom.plans.structure_queries import _GRAMS, _TOKENS
from seqloom.sources.tables import ascii_corpus, ascii_passages, corpus, passages, table


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE (length({a}) + length({b}) - levenshtein({a}, {b}))::DOUBLE / (length({a}) + length({b})) END"


def _join(words: str, first: str, last: str) -> str:
    return f"coalesce(array_to_string({words}[{first}:{last}], ' '), '')"


#: Neighbouring turns of a conversation, as pairs to compare.
_PAIRS = f"{ASCII_CORPUS}, pairs AS (SELECT x.grp, x.seq, x.txt AS a, y.txt AS b, {split('x.txt')} AS aw, {split('y.txt')} AS bw FROM corpus x JOIN corpus y ON x.grp = y.grp AND x.seq + 1 = y.seq)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ascii_corpus(spark, sf_dir)
    following = c.select("grp", (F.col("seq") - 1).alias("seq"), F.col("txt").alias("b"))
    return joins.spread(c.withColumnRenamed("txt", "a"), "grp", "seq").join(joins.spread(following, "grp", "seq"), ["grp", "seq"])


@query(f"WITH {_PAIRS} SELECT grp, seq, levenshtein(a, b) AS edits, round({_lev('a', 'b')}, 6) AS ratio FROM pairs")
def lev_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("grp", "seq", F.levenshtein("a", "b").cast("long").alias("edits"), F.round(similarity.lev_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"WITH {_PAIRS} SELECT grp, seq, round(CASE WHEN least(len(aw), len(bw)) > 0 THEN {_lev(_join('aw', '1', 'least(len(aw), len(bw))'), _join('bw', '1', 'least(len(aw), len(bw))'))} ELSE 0.0 END, 6) AS ratio FROM pairs")
def prefix_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("grp", "seq", F.round(similarity.prefix_words_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"""WITH {_PAIRS}, t AS (SELECT *, unnest(generate_series(1, least(len(aw) // 2, 4))) AS k FROM pairs WHERE len(aw) >= 2 AND len(bw) >= 2),
s AS (SELECT grp, seq, max({_lev(_join('aw', 'k + 1', 'len(aw)'), _join('bw', '1', 'least(len(aw) - k, len(bw))'))}) AS r FROM t GROUP BY ALL)
SELECT grp, seq, round(coalesce(r, 0.0), 6) AS ratio FROM pairs LEFT JOIN s USING (grp, seq)""")
def suffix_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("grp", "seq", F.round(similarity.suffix_prefix_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"""WITH {_PAIRS} SELECT grp, seq, round(greatest({_lev('a', 'b')}, {_lev("replace(a, ' ', '')", "replace(b, ' ', '')")}), 6) AS ratio FROM pairs""")
def spaceless_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("grp", "seq", F.round(similarity.spaceless_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


#: First words of passages as short queries and as windows.
_WORDS = f"{ASCII_PASSAGES}, {ASCII_CORPUS}, firsts AS (SELECT qid, {split('txt')}[1] AS w FROM passages)"


@query(f"""WITH {_WORDS} SELECT qid, grp, seq, round(CASE WHEN length(w) <= 10 AND replace(txt, ' ', '') <> '' THEN greatest({_lev('w', "substr(replace(txt, ' ', ''), 1, length(w) + 6)")}, {_lev('w', split('txt') + '[1]')}) ELSE 0.0 END, 6) AS boost FROM firsts CROSS JOIN corpus""")
def short_query_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = ascii_passages(spark, sf_dir).select("qid", F.get(text.words(F.col("txt")), F.lit(0)).alias("w"))
    start, first = similarity.opening(F.col("txt"))
    openings = joins.spread(ascii_corpus(spark, sf_dir)).select("grp", "seq", start.alias("start"), first.alias("first"))
    boost = similarity.opening_boost(F.col("w"), F.col("start"), F.col("first"))
    return joins.bounded(firsts).join(openings, F.lit(True)).select("qid", "grp", "seq", F.round(boost, 6).alias("boost"))


@query(f"""WITH {_WORDS}, p AS (SELECT f.qid, f.w, unnest(generate_series(1, greatest(length(txt) - length(w) + 1, 1))) AS i, txt FROM firsts f JOIN passages USING (qid)),
s AS (SELECT qid, max({_lev('w', 'substr(txt, i, length(w))')}) AS r FROM p GROUP BY 1) SELECT qid, round(r, 6) AS ratio FROM s""")
def partial_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ascii_passages(spark, sf_dir).withColumn("w", F.get(text.words(F.col("txt")), F.lit(0)))
    return rows.select("qid", F.round(similarity.partial_ratio(F.col("w"), F.col("txt")), 6).alias("ratio"))


@query(f"""WITH {_PAIRS}, w AS (SELECT *, {_join('aw', '1', '5')} AS q FROM pairs), p AS (SELECT grp, seq, q, unnest(generate_series(1, greatest(len(bw) - least(len(aw), 5) - 2, 1))) AS i, bw, least(len(aw), 5) + 3 AS n FROM w),
s AS (SELECT grp, seq, max(CASE WHEN length(q) < 3 THEN 0.0 ELSE {_lev('q', _join('bw', 'i', 'i + n - 1'))} END) AS r FROM p GROUP BY ALL) SELECT grp, seq, round(r, 6) AS ratio FROM s""")
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("q", F.array_join(F.slice(text.words(F.col("a")), 1, 5), " "))
    return rows.select("grp", "seq", F.round(similarity.best_window_ratio(F.col("q"), F.col("b")), 6).alias("ratio"))


@query(f"""WITH {_PAIRS}, i AS (SELECT grp, seq, aw, bw, list_filter(generate_series(1, least(len(aw), len(bw))), lambda k: aw[k] <> bw[k]) AS gaps FROM pairs)
SELECT grp, seq, coalesce(gaps[1] - 1, least(len(aw), len(bw)))::BIGINT AS shared FROM i""")
def stable_prefix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("grp", "seq", similarity.common_prefix(text.words(F.col("a")), text.words(F.col("b"))).cast("long").alias("shared"))


@query(f"""WITH {ASCII_CORPUS}, {ASCII_PASSAGES}, s AS (SELECT qid, grp, seq, round({_lev('passages.txt', 'corpus.txt')}, 6) AS score FROM passages CROSS JOIN corpus),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grp, seq)::INT AS rank, grp, seq, score FROM s) SELECT * FROM r WHERE rank <= 5""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.best_lev(ascii_passages(spark, sf_dir), ascii_corpus(spark, sf_dir), 5)


_VARIANTS = "corpus AS (SELECT qid AS grp, 0 AS seq, txt FROM passages), queries AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN txt ELSE 'x' || substr(txt, 9) END AS txt FROM passages)"


@query(f"""WITH {ASCII_PASSAGES}, {_VARIANTS},
e AS (SELECT qid, grp, seq, 'exact' AS how, 1.0::DOUBLE AS score FROM (SELECT qid, c.grp, c.seq, row_number() OVER (PARTITION BY qid ORDER BY c.grp, c.seq) AS k FROM queries q JOIN corpus c ON q.txt = c.txt) WHERE k = 1),
f AS (SELECT qid, c.grp, c.seq, {_lev('q.txt', 'c.txt')} AS r FROM queries q JOIN corpus c ON length(q.txt) > 0 AND length(c.txt) > 0 WHERE qid NOT IN (SELECT qid FROM e)),
b AS (SELECT qid, grp, seq, 'fuzzy' AS how, round(r, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(r, 6) DESC, grp, seq) AS k FROM f WHERE r >= 0.7) WHERE k = 1)
SELECT * FROM e UNION ALL SELECT * FROM b""")
def exact_then_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ascii_passages(spark, sf_dir)
    changed = F.when(F.col("qid") % 2 == 0, F.col("txt")).otherwise(F.concat(F.lit("x"), F.substring("txt", 9, 1 << 30)))
    return joins.exact_then_fuzzy(p.select("qid", changed.alias("txt")), p.select(F.col("qid").alias("grp"), F.lit(0).alias("seq"), "txt"), 0.7)


@query(f"""WITH {CORPUS}, {PASSAGES}, pg AS (SELECT qid, unnest({_GRAMS('txt', 3)}) AS gram FROM passages), cg AS (SELECT grp, seq, unnest({_GRAMS('txt', 3)}) AS gram FROM corpus),
w AS (SELECT gram, ln((SELECT count(*) FROM corpus) / count(*)) AS idf FROM cg GROUP BY 1),
s AS (SELECT qid, grp, seq, round(sum(idf), 6) AS score FROM pg JOIN w USING (gram) JOIN cg USING (gram) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grp, seq)::INT AS rank FROM s) SELECT qid, grp, seq, score, rank FROM r WHERE rank <= 50""")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.gram_candidates(passages(spark, sf_dir), corpus(spark, sf_dir), ["grp", "seq"]).select("qid", "grp", "seq", "score", "rank")


@query(f"""WITH {CORPUS}, {PASSAGES}, cg AS (SELECT grp, seq, unnest({_TOKENS(split('txt'), 2)}) AS gram FROM corpus), pg AS (SELECT qid, unnest({_TOKENS(split('txt'), 2)}) AS gram FROM passages),
n AS (SELECT gram, 1 / count(*) AS w FROM cg GROUP BY 1) SELECT qid, grp, seq, round(sum(w), 6) AS weight FROM pg JOIN n USING (gram) JOIN (SELECT DISTINCT * FROM cg) USING (gram) GROUP BY ALL""")
def rarity_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ngrams.token_ngrams(text.words(F.col("txt")), 2).alias("grams")
    return joins.rarity_votes(passages(spark, sf_dir).select("qid", grams), corpus(spark, sf_dir).select("grp", "seq", grams), ["grp", "seq"])


@query(f"""WITH {PASSAGES}, d AS (SELECT doc_id, {ws('text')} AS txt FROM documents), pg AS (SELECT qid, unnest({_GRAMS('txt', 3)}) AS gram FROM passages),
dg AS (SELECT doc_id, unnest({_GRAMS('txt', 3)}) AS gram FROM d), w AS (SELECT gram, ln((SELECT count(*) FROM d) / count(*)) AS idf FROM dg GROUP BY 1),
s AS (SELECT qid, doc_id, round(sum(idf), 6) AS score FROM pg JOIN w USING (gram) JOIN dg USING (gram) GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 20),
c AS (SELECT t.qid, t.doc_id, t.score, contains(d.txt, p.txt) AS contained FROM t JOIN d USING (doc_id) JOIN passages p USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY contained DESC, score DESC, doc_id) AS k FROM c) SELECT qid, doc_id, score, contained FROM r WHERE k = 1""")
def fragment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each passage the document it most likely comes from: idf candidates, then containment."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.collapse_ws(F.col("text")).alias("txt"))
    p = passages(spark, sf_dir)
    found = joins.gram_candidates(p, docs, ["doc_id"], 20).drop("rank")
    rows = found.join(docs.withColumnRenamed("txt", "ref"), "doc_id").join(F.broadcast(p) if p.limit(100_001).count() <= 100_000 else p, "qid").withColumn("contained", F.contains("ref", "txt"))
    return structure.best_per(rows, ["qid"], [F.desc("contained"), F.desc("score"), F.asc("doc_id")]).select("qid", "doc_id", "score", "contained")


def _retrieval_sql(single_limit: int, groups: int, span_limit: int) -> str:
    words = lambda x: split(x)
    raw = lambda v: f"greatest({_lev('q.txt', v)}, CASE WHEN least(len({words('q.txt')}), len({words(v)})) > 0 THEN {_lev(_join(words('q.txt'), '1', f'least(len({words('q.txt')}), len({words(v)}))'), _join(words(v), '1', f'least(len({words('q.txt')}), len({words(v)}))'))} ELSE 0.0 END)"
    return f"""WITH {ASCII_CORPUS}, {ASCII_PASSAGES},
hint AS (SELECT 0.22 AS bonus, 3 AS g, 1 AS s UNION ALL SELECT 0.12, 3, 2 UNION ALL SELECT 0.06, 3, 3),
s AS (SELECT q.qid, c.grp, c.seq, round({raw('c.txt')}, 6) AS raw, coalesce(h.bonus, 0.0)::DOUBLE AS bonus FROM passages q CROSS JOIN corpus c LEFT JOIN (SELECT hint.* FROM hint JOIN corpus ON grp = g AND seq = s) h ON h.g = c.grp AND h.s = c.seq),
t AS (SELECT *, round(least(raw + bonus, 1.0), 6) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grp, seq)::INT AS rank FROM t),
g AS (SELECT qid, grp FROM (SELECT qid, grp, row_number() OVER (PARTITION BY qid ORDER BY min(rank), grp) AS k FROM r GROUP BY qid, grp) WHERE k <= {groups}),
{{spans}},
p AS (SELECT q.qid, c.grp, c.seq, c.seq_end, round({raw('c.span_text')}, 6) AS raw FROM g JOIN passages q USING (qid) JOIN spans c USING (grp)),
ps AS (SELECT p.*, round(least(raw + coalesce(h.bonus, 0.0), 1.0), 6) AS score FROM p LEFT JOIN (SELECT hint.* FROM hint JOIN corpus ON grp = g AND seq = s) h ON h.g = p.grp AND h.s = p.seq),
pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grp, seq, seq_end)::INT AS rank FROM ps)
SELECT qid, 'single' AS kind, grp, seq, seq AS seq_end, score, rank FROM r WHERE rank <= {single_limit} UNION ALL SELECT qid, 'span', grp, seq, seq_end, score, rank FROM pr WHERE rank <= {span_limit}"""


from seqloom.plans.structure_queries import _SPANS  # noqa: E402

_RETRIEVED = _retrieval_sql(8, 3, 8).replace("{spans}", _SPANS)


def _hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(3, 0)], "grp long, seq long")


@query(_RETRIEVED)
def retrieve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows and spans of each passage, with a continuation bonus after row (3, 0)."""
    return retrieval.retrieve(ascii_passages(spark, sf_dir), ascii_corpus(spark, sf_dir), hint=_hints(spark), single_limit=8, groups=3, span_limit=8, longest=4, fragments=False)


@query(f"SELECT qid, kind, grp, seq, seq_end, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, rank) AS k FROM ({_RETRIEVED})) WHERE k = 1 AND score >= 0.3")
def match_single_or_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best row or span of at least .3; a row wins ties."""
    found = retrieve_candidates(spark, sf_dir)
    return structure.best_per(found, ["qid"], [F.desc("score"), F.asc("kind"), F.asc("rank")]).where("score >= 0.3").select("qid", "kind", "grp", "seq", "seq_end", "score")


@query()
def retrieve_with_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As retrieve_candidates, with the semi-global fragment boost; the groups that give spans are fixed before it."""
    return retrieval.retrieve(passages(spark, sf_dir), corpus(spark, sf_dir), hint=_hints(spark), single_limit=32, groups=3, span_limit=32, longest=4, fragments=True)


@query()
def match_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-pass match by indel ratio over trigram candidates, with runners-up."""
    return retrieval.match_rows(passages(spark, sf_dir), corpus(spark, sf_dir), hint=_hints(spark))


@query()
def joint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlist by n-gram overlap, fragment blend, spans of the best groups, prefix and global-span rescue."""
    return retrieval.joint_match(passages(spark, sf_dir), corpus(spark, sf_dir))


@query()
def rerank_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical rerank among near-equal rows of each passage."""
    found = joins.gram_candidates(passages(spark, sf_dir), corpus(spark, sf_dir), ["grp", "seq"], 5)
    top = F.max("score").over(Window.partitionBy("qid"))
    rows = found.withColumn("score", F.round(F.col("score") / top, 6)).join(passages(spark, sf_dir), "qid")
    return retrieval.rerank(rows.join(corpus(spark, sf_dir).withColumnRenamed("txt", "ref"), ["grp", "seq"]))


@query(f"""WITH p AS (SELECT user_id, event_id, (CASE WHEN event_type = 'error' THEN NULL ELSE floor(value)::INT % 3 END) AS answer, value / 100 AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
b AS (SELECT user_id, (pos - 1) // 3 AS part, pos, answer, score FROM p),
v AS (SELECT user_id, part, answer, count(*) AS n, min(pos) AS first FROM b WHERE answer IS NOT NULL GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY n DESC, first) AS k FROM v) WHERE k = 1 AND n >= 2),
a AS (SELECT user_id, part, max(CASE WHEN pos % 3 = 1 THEN answer END) AS anchor, max(CASE WHEN pos % 3 = 1 THEN score END) AS anchor_score FROM b GROUP BY ALL),
x AS (SELECT * FROM (SELECT user_id, part, answer, row_number() OVER (PARTITION BY user_id, part ORDER BY score DESC, pos) AS k FROM b WHERE answer IS NOT NULL) WHERE k = 1)
SELECT a.user_id, a.part, CASE WHEN a.anchor IS NOT NULL AND a.anchor_score >= 0.5 THEN a.anchor WHEN m.answer IS NOT NULL THEN m.answer ELSE x.answer END AS answer
FROM a LEFT JOIN m USING (user_id, part) LEFT JOIN x USING (user_id, part)""")
def tta_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes over three passes: a confident first pass stands, else two equal answers, else the best score."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", place.alias("pos"), F.when(F.col("event_type") != "error", F.floor("value").cast("int") % 3).alias("answer"), (F.col("value") / 100).alias("score"))
    return retrieval.vote(rows.withColumn("part", F.floor((F.col("pos") - 1) / 3)).withColumn("pos", (F.col("pos") - 1) % 3), ["user_id", "part"])


@query(f"""WITH {ASCII_CORPUS}, {ASCII_PASSAGES}, s AS (SELECT qid, grp, seq, round({_lev('passages.txt', 'corpus.txt')}, 6) AS score FROM passages CROSS JOIN corpus),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grp, seq) AS k FROM s) WHERE k = 1)
SELECT qid, grp, seq, score, CASE WHEN score >= 0.33 THEN 'text' ELSE 'rescored' END AS stage FROM r""")
def two_stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident matches stop; only the others meet the second stage (here one that keeps its input)."""
    best = joins.best_lev(ascii_passages(spark, sf_dir), ascii_corpus(spark, sf_dir), 1).drop("rank")
    return retrieval.two_stage(best, 0.33, lambda rest: rest)


@query("""WITH h AS (SELECT user_id AS qid, event_id AS pos, floor(value)::INT % 7 AS grp FROM events), f AS (SELECT qid, grp, min(pos) AS first FROM h GROUP BY ALL)
SELECT qid, grp, k FROM (SELECT qid, grp, row_number() OVER (PARTITION BY qid ORDER BY first)::INT AS k FROM f) WHERE k <= 4""")
def groups_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pos"), (F.floor("value").cast("int") % 7).alias("grp"))
    return structure.best_per(rows.groupBy("qid", "grp").agg(F.min("pos").alias("first")), ["qid"], [F.asc("first")], 4, "k").drop("first")


def _udf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    following = c.select("grp", (F.col("seq") - 1).alias("seq"), F.col("txt").alias("b"))
    return joins.spread(c.withColumnRenamed("txt", "a"), "grp", "seq").join(joins.spread(following, "grp", "seq"), ["grp", "seq"])


@query()
def indel_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = alignment.udfs()
    return _udf_pairs(spark, sf_dir).select("grp", "seq", F.round(u["indel_ratio"]("a", "b"), 6).alias("indel"), F.round(u["lexical_score"]("a", "b"), 6).alias("lexical"))


@query()
def semi_global_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = alignment.udfs()
    found = joins.gram_candidates(passages(spark, sf_dir), corpus(spark, sf_dir), ["grp", "seq"], 5)
    rows = found.join(passages(spark, sf_dir), "qid").join(corpus(spark, sf_dir).withColumnRenamed("txt", "ref"), ["grp", "seq"])
    return rows.select("qid", "grp", "seq", u["semi_global"]("txt", "ref").alias("edits"), F.round(u["fragment_score"]("txt", "ref"), 6).alias("fragment"))


@query()
def align_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _udf_pairs(spark, sf_dir).select("grp", "seq", alignment.udfs()["align_errors"](text.words(F.col("a")), text.words(F.col("b"))).alias("x"))
    return rows.select("grp", "seq", F.size("x.errors").alias("n_errors"), F.round("x.per", 6).alias("per"), F.round("x.correct_rate", 6).alias("correct_rate"))


@query()
def word_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = lambda c: F.trim(F.regexp_replace(F.replace(F.col(c), F.lit(" "), F.lit("|")), "(.)", "$1 "))
    rows = passages(spark, sf_dir).withColumn("other", F.regexp_replace("txt", "th", "d")).select("qid", alignment.udfs()["word_corrections"](spell("other"), spell("txt")).alias("x"))
    return rows.select("qid", F.explode("x").alias("c")).select("qid", "c.*")


@query()
def lookahead_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, a, b = alignment.udfs(), text.words(F.col("a")), text.words(F.col("b"))
    rows = _udf_pairs(spark, sf_dir).select("grp", "seq", u["lookahead_align"](a, b).alias("x"), u["fuzzy_lcs"](a, b).alias("y"))
    return rows.select("grp", "seq", F.col("x.position").alias("position"), F.size("x.matched").alias("matched"), F.size("y.matched").alias("lcs"))


@query()
def token_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of words, and the micro-average per group: summed edits over summed lengths."""
    rows = _udf_pairs(spark, sf_dir).select("grp", alignment.udfs()["token_edits"](text.words(F.col("a")), text.words(F.col("b"))).alias("edits"), F.size(text.words(F.col("b"))).alias("n"))
    return rows.groupBy("grp").agg(F.sum("edits").alias("edits"), F.sum("n").alias("n"), F.round(F.try_divide(F.sum("edits"), F.sum("n")), 6).alias("wer"))


@query()
def char_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.substring(F.col("txt"), F.lit(1), F.floor(F.length("txt") / 2).cast("int"))
    return passages(spark, sf_dir).select("qid", alignment.udfs()["char_progress"](half, F.col("txt")).alias("word"))


