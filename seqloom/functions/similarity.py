"""String similarities that built-in functions express. Three ratios, never one name:

lev_ratio    unit-cost edits: (|a| + |b| - lev) / (|a| + |b|)
indel_ratio  a substitution costs two: 2 LCS / (|a| + |b|) (module alignment)
max_ratio    tokens: 1 - lev / max(|a|, |b|) (module alignment)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.text import despace, words


def lev_ratio(a: Column, b: Column) -> Column:
    """Both empty: 1."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - F.levenshtein(a, b)) / total)


def lev_ratio_at_least(a: Column, b: Column, least: float) -> Column:
    """lev_ratio, or null below least. Lengths alone rule out most pairs, and the distance stops at its bound."""
    total = F.length(a) + F.length(b)
    bound = F.floor((1 - least) * total + F.lit(1e-9)).cast("int")
    near = F.abs(F.length(a) - F.length(b)) <= bound
    return F.when(near & (F.levenshtein(a, b) <= bound), lev_ratio(a, b))


def _best(count: Column, score) -> Column:
    """Largest score(i) for i = 1..count; 0 if count is below 1."""
    return F.when(count >= 1, F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), score))).otherwise(F.lit(0.0))


def partial_ratio(a: Column, b: Column) -> Column:
    """lev_ratio of the shorter with its best equally long window in the longer; 0 if either is empty."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    best = _best(F.length(long) - F.length(short) + 1, lambda i: lev_ratio(short, F.substring(long, i, F.length(short))))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(best)


def prefix_words_ratio(query: Column, text: Column) -> Column:
    """lev_ratio of as many first words as both have; 0 without words."""
    q, t = words(query), words(text)
    n = F.least(F.size(q), F.size(t))
    return F.when(n > 0, lev_ratio(F.array_join(F.slice(q, 1, n), " "), F.array_join(F.slice(t, 1, n), " "))).otherwise(F.lit(0.0))


def suffix_prefix_ratio(query: Column, text: Column) -> Column:
    """Best lev_ratio of the query without its first 1..min(n/2, 4) words and as many first words of the text."""
    q, t = words(query), words(text)

    def trimmed(k: Column) -> Column:
        left = F.size(q) - k
        return lev_ratio(F.array_join(F.slice(q, k + 1, left), " "), F.array_join(F.slice(t, 1, F.least(left, F.size(t))), " "))

    tries = F.least(F.floor(F.size(q) / 2).cast("int"), F.lit(4))
    return F.when((F.size(q) < 2) | (F.size(t) < 2), F.lit(0.0)).otherwise(_best(tries, trimmed))


def spaceless_ratio(a: Column, b: Column) -> Column:
    return F.greatest(lev_ratio(a, b), lev_ratio(despace(a), despace(b)))


def opening(text: Column) -> tuple[Column, Column]:
    """What short_query_boost reads of a text: its first 16 characters without blanks, and its first word."""
    return F.substring(despace(text), 1, 16), F.coalesce(F.try_element_at(words(text), F.lit(1)), F.lit(""))


def short_query_boost(query: Column, text: Column) -> Column:
    """For queries of ten characters or fewer: against the text's start (query length + 6) or its first word; both without blanks."""
    return opening_boost(query, *opening(text))


def opening_boost(query: Column, start: Column, first: Column) -> Column:
    """short_query_boost of a text whose opening is known: where texts meet many queries, each is cut once."""
    q = despace(query)
    boost = F.greatest(lev_ratio(q, F.substring(start, F.lit(1), F.length(q) + 6)), F.when(first != "", lev_ratio(q, first)).otherwise(F.lit(0.0)))
    return F.when((F.length(q) <= 10) & (start != ""), boost).otherwise(F.lit(0.0))


def coverage_blend(query: Column, text: Column, prefix_score: Column, full_score: Column) -> Column:
    """Prefix and full score, .3 / .7 where the query covers over .8 of the text's words, else .7 / .3."""
    coverage = F.size(words(query)) / F.greatest(F.size(words(text)), F.lit(1))
    return F.when(coverage > 0.8, 0.3 * prefix_score + 0.7 * full_score).otherwise(0.7 * prefix_score + 0.3 * full_score)


def words_match(a: Column, b: Column, least: float = 0.7) -> Column:
    """Equal, or both over two characters and similar."""
    return (a == b) | ((F.length(a) > 2) & (F.length(b) > 2) & (lev_ratio(a, b) >= least))


def strip_leading_residual(text: Column, residual: Column, least: float = 0.82) -> Column:
    """The text without its first n words, where n is the residual's number of words, or one less or more, whichever start is
    most similar to the residual (ties: fewest words); the whole text if none reaches least."""
    w, n = words(text), F.size(words(residual))
    fits = F.filter(F.array(n - 1, n, n + 1), lambda k: (k >= 1) & (k <= F.size(w)))
    scored = F.transform(fits, lambda k: F.struct(lev_ratio(F.array_join(F.slice(w, 1, k), " "), residual).alias("score"), (-k).alias("k")))
    best = F.array_max(scored)
    cut = F.when(best["score"] >= least, -best["k"]).otherwise(F.lit(0))
    return F.array_join(F.slice(w, F.coalesce(cut, F.lit(0)) + 1, F.greatest(F.size(w), F.lit(1))), " ")


def best_window_ratio(query: Column, text: Column) -> Column:
    """Best lev_ratio with a window of the query's number of words plus three; 0 under three characters."""
    q, t = words(query), words(text)
    size = F.size(q) + 3
    best = _best(F.greatest(F.size(t) - size + 1, F.lit(1)), lambda i: lev_ratio(query, F.array_join(F.slice(t, i, size), " ")))
    return F.when(F.length(query) < 3, F.lit(0.0)).otherwise(best)


def common_prefix(a: Column, b: Column) -> Column:
    """How many first tokens two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    gap = F.array_position(same, False)
    return F.when(n == 0, F.lit(0)).when(gap == 0, n).otherwise(gap - 1).cast("int")
