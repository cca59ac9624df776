"""N-grams: of characters and of tokens, counts, indexes and back-off models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(items: Column, n: int, glue: str) -> Column:
    """All runs of n items, joined. Arrays are zipped with themselves, shifted: each is made once a row, where an
    expression in a lambda would be made again for every element, and cutting a string walks it from its start."""
    out = items
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(items, F.lit(k), F.greatest(F.size(items), F.lit(1))), lambda a, b: F.concat(a, F.lit(glue), b))
    return F.filter(out, lambda x: x.isNotNull())


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of characters; none in a text shorter than n."""
    return F.when(F.length(text) >= n, F.array_distinct(_runs(F.split(text, ""), n, ""))).otherwise(F.array().cast("array<string>"))


def token_ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of tokens, repeats included, joined by blanks."""
    return F.when(F.size(tokens) >= n, _runs(tokens, n, " ")).otherwise(F.array().cast("array<string>"))


def shared(a: Column, b: Column) -> Column:
    """Size of the intersection."""
    return F.size(F.array_intersect(a, b))


def idf(rows: DataFrame, row_id: str, gram: str, total: int | Column) -> DataFrame:
    """gram, df, idf = ln(total / df) of a table with one row for each distinct gram of a row."""
    total = F.lit(total) if isinstance(total, int) else total
    return rows.groupBy(gram).agg(F.count("*").alias("df")).withColumn("idf", F.log(total / F.col("df")))


def counts(rows: DataFrame, tokens: str, n: int) -> DataFrame:
    """context (n - 1 tokens), word, cnt over all rows; context is empty for n = 1."""
    gram = rows.select(F.explode(token_ngrams(F.col(tokens), n)).alias("gram"))
    word = F.substring_index("gram", " ", -1)
    context = F.substring(F.col("gram"), F.lit(1), F.length("gram") - F.length(word) - 1) if n > 1 else F.lit("")
    return gram.groupBy(context.alias("context"), word.alias("word")).agg(F.count("*").alias("cnt"))


def prefixes(words: DataFrame, word: str) -> DataFrame:
    """Distinct character prefixes of all words."""
    return words.where(F.length(word) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.col(word), F.lit(1), i))).alias("prefix")).distinct()


def backoff(queries: DataFrame, uni: DataFrame, bi: DataFrame, tri: DataFrame, add: float = 0.1) -> DataFrame:
    """Add `logp` to queries (c2, c1, word): trigram if its context was seen, else bigram, else unigram; add-k smoothed.

    uni, bi, tri are counts() of orders 1 to 3. Contexts are summed once, so that each query joins two small tables per order.
    """
    vocab, total = uni.agg(F.count("*"), F.sum("cnt")).first()
    out = queries
    for tag, table, context in (("3", tri, F.concat_ws(" ", "c2", "c1")), ("2", bi, F.col("c1"))):
        sums = table.groupBy(F.col("context").alias(f"x{tag}")).agg(F.sum("cnt").alias(f"n{tag}"))
        own = table.select(F.col("context").alias(f"y{tag}"), F.col("word").alias(f"w{tag}"), F.col("cnt").alias(f"k{tag}"))
        out = out.withColumn(f"ctx{tag}", context).join(sums, F.col(f"ctx{tag}") == F.col(f"x{tag}"), "left")
        out = out.join(own, (F.col(f"ctx{tag}") == F.col(f"y{tag}")) & (F.col("word") == F.col(f"w{tag}")), "left")
    out = out.join(uni.select(F.col("word").alias("w1"), F.col("cnt").alias("k1")), F.col("word") == F.col("w1"), "left")
    smooth = lambda k, n: F.log((F.coalesce(k, F.lit(0)) + add) / (n + add * vocab))
    logp = F.when(F.col("n3").isNotNull(), smooth(F.col("k3"), F.col("n3"))).when(F.col("n2").isNotNull(), smooth(F.col("k2"), F.col("n2"))).otherwise(smooth(F.col("k1"), F.lit(total or 0)))
    return out.select(*queries.columns, logp.alias("logp"))
