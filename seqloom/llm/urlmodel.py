"""URL filters: host and path rules, then a ratio of character language models. DataFrame functions alone.

Two variable-order Markov models are counted over the characters of the URLs that the rules accept and reject. Contexts
are no, one and two characters, and of three and four those that are frequent: at least one in SHARE of all
characters of all URLs follows them. Each order is smoothed into the next shorter one by the number of distinct
characters that follow the context (Witten and Bell), the shortest into the uniform distribution; a context
that a model never saw gives the shorter one's probability. So every character of every URL is scored, whether
any ruled URL shows it or not. A URL's score is its log-likelihood under the accepted model less that under the rejected
one, divided by its length.

The models are counted on most of the ruled URLs; the threshold is the one with the fewest errors on the others, which
a hash of the URL picks, so that copies of a URL are on one side.

The alphabet is folded to 42 symbols, so there are at most 42**3 weights of two characters and SHARE * 42 of each
longer order at any size of input: the tables that scoring broadcasts have a proven bound. Weights are whole numbers
(millionths), so their sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import lower_ascii, stage

#: host, path, verdict: a rule fits its host and all subdomains, and URLs whose path starts with its path.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Letters, one symbol for all digits (0), marks, and one for everything else (*); ^ stands before the start.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0.-/_?=&%#:~+@*^"
SCALE = 1_000_000
#: Longest context; and the share of all characters that contexts longer than two must be followed by.
ORDER, SHARE = 4, 1000
#: Characters that are cut into grams at once: substrings of a long text would each be sought from its start.
BLOCK = 256
#: First hexadecimal digits of the hashes of ruled URLs that are held out for the threshold: three in sixteen.
HELD_OUT = "012"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (most characters of host and path), as struct of rule and verdict; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def folded(url: Column) -> Column:
    """The URL's characters in the model's alphabet."""
    text = F.regexp_replace(lower_ascii(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.regexp_replace(text, r"[^a-z0./_?=&%#:~+@\-]", "*")


def _context(k: int) -> str:
    """Name of the column of the k characters before one."""
    return f"x{k}"


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each character c of column text, with the 0 to ORDER characters before it (x0, x1, ...)."""
    padded = F.concat(F.lit("^" * ORDER), "text")
    blocks = F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{1,{BLOCK + ORDER}}})).{{1,{BLOCK}}}"), F.lit(1))  # each with the first characters of the next
    parts = rows.where("length(text) > 0").select(*keep, F.explode(blocks).alias("t")).where(F.length("t") > ORDER)
    at = parts.select(*keep, "t", F.explode(F.sequence(F.lit(ORDER + 1), F.length("t"))).alias("i"))
    return at.select(*keep, F.expr("substring(t, i, 1)").alias("c"), *[F.expr(f"substring(t, i - {k}, {k})").alias(_context(k)) for k in range(ORDER + 1)])


def weights(counts: DataFrame) -> list[DataFrame]:
    """For each context length from 2 to ORDER a table of context, c, weight: millionths of the log ratio of accepted to rejected.

    counts: x{ORDER}, c, n, good, bad: how often all URLs, and those that each model learns from, show c after the longest context.
    Every (context, c) of any URL has a row, up to length 2 for all contexts, beyond it for frequent ones.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    found, shorter = [], None
    for k in range(ORDER + 1):
        own = counts.select(F.substring(_context(ORDER), ORDER - k + 1, k).alias(_context(k)) if k else F.lit("").alias(_context(0)), "c", "n", "good", "bad")
        own = own.groupBy(_context(k), "c").agg(*[F.sum(m).alias(m) for m in ("n", "good", "bad")])
        context = own.groupBy(_context(k)).agg(F.sum("n").alias("all"), *[f.alias(f"{name}_{m}") for m in ("good", "bad") for name, f in (("n", F.sum(m)), ("t", F.count_if(F.col(m) > 0)))])
        if k > 2:
            context = context.where(F.col("all") * SHARE >= total)
        rows = own.join(F.broadcast(context), _context(k))
        if shorter is None:
            rows = rows.withColumns({f"p_{m}": F.lit(1.0 / (len(SYMBOLS) - 1)) for m in ("good", "bad")})
        else:
            below = shorter.select(_context(k - 1), "c", "p_good", "p_bad")
            rows = rows.withColumn(_context(k - 1), F.substring(_context(k), 2, k - 1)).join(F.broadcast(below), [_context(k - 1), "c"])
        for m in ("good", "bad"):
            n, t, p = F.col(f"n_{m}"), F.col(f"t_{m}"), F.col(f"p_{m}")
            rows = rows.withColumn(f"p_{m}", F.when(n > 0, (F.col(m) + t * p) / F.greatest(n + t, F.lit(1))).otherwise(p))
        shorter = stage(rows.select(_context(k), "c", "p_good", "p_bad"), f"order{k}")
        if k >= 2:
            found.append(shorter.select(_context(k), "c", F.round(F.log(F.col("p_good") / F.col("p_bad")) * SCALE).cast("long").alias("weight")))
    return found


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the score of the character models (millionths a character).

    Every row stays: null ids and repeated rows too. A null or empty URL has empty host and path, fits no
    rule and scores 0. Without rule-judged URLs to learn from on both sides every score is 0 and the method allows. An
    empty table gives no rows; other columns are ignored. URLs of any length are read whole.
    """
    host, path = host_path(F.col("url"))
    text = folded(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("held", F.substring(F.md5(F.col("text").cast("binary")), 1, 1).isin(*HELD_OUT))
    rows = stage(rows.select("rid", "page_id", "host", "path", "text", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), "held"), "urls")

    learns = lambda verdict: F.count_if((F.col("ruled") == verdict) & ~F.col("held"))
    counts = stage(grams(rows, "ruled", "held").groupBy(_context(ORDER), "c").agg(F.count("*").alias("n"), learns("allow").alias("good"), learns("block").alias("bad")), "grams")
    both = counts.agg((F.sum("good") > 0) & (F.sum("bad") > 0)).first()[0]
    if both:
        chars = grams(rows, "rid")
        tables = weights(counts)
        for k, table in enumerate(tables, 2):
            chars = chars.join(F.broadcast(table.withColumnRenamed("weight", f"w{k}")), [_context(k), "c"], "left")
        deepest = F.coalesce(*[F.col(f"w{k}") for k in range(ORDER, 1, -1)])
        sums = chars.groupBy("rid").agg(F.sum(deepest).alias("w"))
        scored = rows.join(sums, "rid", "left").withColumn("score", F.floor(F.coalesce("w", F.lit(0)) / F.greatest(F.length("text"), F.lit(1))).cast("long"))
    else:
        scored = rows.withColumn("score", F.lit(0).cast("long"))
    scored = stage(scored.select("page_id", "host", "path", "rule", "ruled", "held", "score"), "scored")
    cut = threshold(scored.where("held")) if both else 0
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")


def threshold(scored: DataFrame) -> int:
    """The score from which URLs are allowed: fewest errors on rule-judged ones, the lowest such step; 0 without them.

    Scores are counted in steps of a thousandth. A smoothed probability is no smaller than a product of ORDER + 1 fractions of counts,
    so a score lies within a few hundred and its steps in a table of a few hundred thousand rows at any size of input.
    """
    step = SCALE // 1000
    steps = scored.where("ruled is not null").groupBy(F.floor(F.col("score") / step).cast("int").alias("s")).agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")).collect()
    steps.sort(key=lambda r: r["s"])
    errors = sum(r["bad"] for r in steps)
    best, cut = errors, steps[0]["s"] if steps else 0
    for r in steps:
        errors += r["good"] - r["bad"]
        if errors < best:
            best, cut = errors, r["s"] + 1
    return cut * step


def oracle_sql(rules=RULES) -> str:
    """The same judgement in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = lambda x: f"translate({x}, '{upper}', '{upper.lower()}')"
    longest = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True)
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if what == 'rule' else v}'" for h, p, v in longest) + " END"

    def order(k: int) -> str:
        """Contexts of k characters, their symbols' probabilities under both models, and the weight."""
        before = f"x{k - 1}" if k else ""
        frequent = f" HAVING sum(n) * {SHARE} >= (SELECT sum(n) FROM counts)" if k > 2 else ""
        smooth = lambda m: f"CASE WHEN n_{m} > 0 THEN ({m} + t_{m} * p_{m}) / greatest(n_{m} + t_{m}, 1) ELSE p_{m} END AS p_{m}"
        below = f"JOIN (SELECT {before}, c, p_good, p_bad FROM order{k - 1}) AS below ON below.{before} = substr(own{k}.x{k}, 2) AND below.c = own{k}.c" if k else f"CROSS JOIN (SELECT 1.0::DOUBLE / {len(SYMBOLS) - 1} AS p_good, 1.0::DOUBLE / {len(SYMBOLS) - 1} AS p_bad) AS below"
        return f"""own{k} AS (SELECT right(x{ORDER}, {k}) AS x{k}, c, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM counts GROUP BY ALL),
context{k} AS (SELECT x{k}, sum(good) AS n_good, sum(bad) AS n_bad, count(*) FILTER (good > 0) AS t_good, count(*) FILTER (bad > 0) AS t_bad FROM own{k} GROUP BY x{k}{frequent}),
order{k} AS (SELECT own{k}.x{k}, own{k}.c, {smooth('good')}, {smooth('bad')} FROM own{k} JOIN context{k} ON own{k}.x{k} = context{k}.x{k} {below}),"""

    orders = "\n".join(order(k) for k in range(ORDER + 1))
    deep = range(ORDER, 1, -1)
    return f"""
WITH rest AS (SELECT page_id, url, row_number() OVER () AS rid, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT rid, page_id, {low('h')} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path,
          regexp_replace(regexp_replace({low("coalesce(url, '')")}, '[0-9]', '0', 'gs'), '[^a-z0./_?=&%#:~+@-]', '*', 'gs') AS text FROM hosts),
ruled AS (SELECT *, {cases('rule')} AS rule, {cases('verdict')} AS ruled, left(md5(text), 1) IN ({", ".join(f"'{x}'" for x in HELD_OUT)}) AS held FROM parts),
places AS (SELECT rid, ruled, held, '{"^" * ORDER}' || text AS t, unnest(generate_series({ORDER + 1}, length(text) + {ORDER})) AS i FROM ruled),
chars AS (SELECT rid, ruled, held, substr(t, i - {ORDER}, {ORDER}) AS x{ORDER}, substr(t, i, 1) AS c FROM places),
counts AS (SELECT x{ORDER}, c, count(*) AS n, count(*) FILTER (ruled = 'allow' AND NOT held) AS good, count(*) FILTER (ruled = 'block' AND NOT held) AS bad FROM chars GROUP BY ALL),
{orders}
weighted AS (SELECT counts.x{ORDER}, counts.c, round(ln(coalesce({", ".join(f"order{k}.p_good" for k in deep)}) / coalesce({", ".join(f"order{k}.p_bad" for k in deep)})) * {SCALE})::BIGINT AS weight
             FROM counts {" ".join(f"LEFT JOIN order{k} ON order{k}.x{k} = right(counts.x{ORDER}, {k}) AND order{k}.c = counts.c" for k in deep)}),
summed AS (SELECT rid, sum(weight) AS w FROM chars JOIN weighted USING (x{ORDER}, c) GROUP BY rid),
known AS (SELECT coalesce(sum(good) > 0 AND sum(bad) > 0, false) AS k FROM counts),
scored AS (SELECT page_id, host, path, rule, ruled, held, CASE WHEN k THEN floor(coalesce(w, 0)::DOUBLE / greatest(length(text), 1)) ELSE 0 END::BIGINT AS score FROM ruled LEFT JOIN summed USING (rid) CROSS JOIN known),
steps AS (SELECT floor(score::DOUBLE / {SCALE // 1000})::BIGINT AS s, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM scored WHERE ruled IS NOT NULL AND held GROUP BY ALL),
errors AS (SELECT s + 1 AS cut, (SELECT sum(bad) FROM steps) + sum(good - bad) OVER (ORDER BY s) AS e FROM steps
           UNION ALL SELECT min(s), sum(bad) FROM steps),
cut AS (SELECT coalesce((SELECT cut FROM errors, known WHERE e IS NOT NULL AND k ORDER BY e, cut LIMIT 1), 0) * {SCALE // 1000} AS lowest)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= lowest THEN 'allow' ELSE 'block' END) AS verdict, score FROM scored CROSS JOIN cut
"""
