"""Decoding of frame-level scores: argmax, collapse, forward scores, fusion ranking, constrained beams."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMPOSSIBLE = 1e9


def argmax(frame: Column) -> Column:
    """Place of the largest value, from 0; the first of equal ones."""
    return (F.array_position(frame, F.array_max(frame)) - 1).cast("int")


def collapse(frames: DataFrame, utt: str, t: str, token: str, blank: int, separators: Sequence[int] = ()) -> DataFrame:
    """utt, ids: tokens in order without repeats in succession, then without blanks and separators (both part repeats)."""
    w = Window.partitionBy(utt).orderBy(t)
    fresh = ~F.col(token).eqNullSafe(F.lag(token).over(w))
    rows = frames.withColumn("_keep", fresh & ~F.col(token).isin(blank, *separators))
    items = F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct(F.col(t), F.col(token)))))
    return rows.groupBy(utt).agg(F.transform(items, lambda x: x[token]).alias("ids"))


def ids_to_text(ids: Column, pieces: Column, drop: list[int]) -> Column:
    """Pieces of ids joined, word marks to blanks, unknown and blank ids dropped."""
    kept = F.filter(ids, lambda i: ~i.isin(drop))
    return F.trim(F.replace(F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), ""), F.lit("▁"), F.lit(" ")))


def tokens_to_ids(tokens: Column, vocab: Column) -> Column:
    """Ids of tokens in a map; unknown ones go."""
    return F.filter(F.transform(tokens, lambda t: F.try_element_at(vocab, t)), lambda i: i.isNotNull())


def join_words(raw: Column) -> Column:
    """'b i s m i | a l l a h' to 'bismi allah'."""
    return F.trim(F.regexp_replace(F.replace(F.replace(raw, F.lit(" "), F.lit("")), F.lit("|"), F.lit(" ")), " +", " "))


def ctc_loss(logprobs: np.ndarray, target: Sequence[int], blank: int) -> float:
    """Negative forward log-likelihood divided by the target's length; IMPOSSIBLE if empty, too long or not finite."""
    n, steps = len(target), len(logprobs)
    if not n or 2 * n + 1 > steps:
        return IMPOSSIBLE
    labels = np.full(2 * n + 1, blank)
    labels[1::2] = target
    skip = np.zeros(2 * n + 1, bool)
    skip[3::2] = labels[3::2] != labels[1:-2:2]
    alpha = np.full(2 * n + 1, -np.inf)
    alpha[:2] = logprobs[0, labels[:2]]
    with np.errstate(all="ignore"):
        for t in range(1, steps):
            one = np.concatenate([[-np.inf], alpha[:-1]])
            two = np.where(skip, np.concatenate([[-np.inf, -np.inf], alpha[:-2]]), -np.inf)
            alpha = np.logaddexp(np.logaddexp(alpha, one), two) + logprobs[t, labels]
        total = np.logaddexp(alpha[-1], alpha[-2])
    return float(-total / n) if math.isfinite(total) else IMPOSSIBLE


def rescore(utterances: DataFrame, candidates: DataFrame, blank: int) -> DataFrame:
    """utt, cand, loss: forward loss of every feasible candidate of an utterance.

    utterances: utt, frames (array of arrays); candidates: utt, cand, ids. Infeasible candidates are filtered on plain
    columns before Python and get IMPOSSIBLE; each pair is a row of its own, so no group is gathered.
    """

    @F.pandas_udf("double")
    def loss(frames: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([ctc_loss(np.stack(f), list(i), blank) for f, i in zip(frames, ids)])

    pairs = candidates.join(utterances, "utt")
    fits = (F.size("ids") > 0) & (2 * F.size("ids") + 1 <= F.size("frames"))
    good = pairs.where(fits).select("utt", "cand", loss("frames", "ids").alias("loss"))
    return good.unionByName(pairs.where(~fits).select("utt", "cand", F.lit(IMPOSSIBLE).alias("loss")))


def fuse(candidates: DataFrame, weak: Column) -> DataFrame:
    """Adds length_fit, acoustic_fit, margin, fusion and rank to utt, cand, prior, loss, length, observed.

    Weights of text, acoustics and length are .6 .25 .15, for weak texts .45 .4 .15. The acoustic fit is min-max over the
    feasible candidates of an utterance; a margin is the loss to the next feasible one (0 for the last).
    """
    own = Window.partitionBy("utt")
    ok = F.col("loss") < IMPOSSIBLE
    low, high = F.min(F.when(ok, F.col("loss"))).over(own), F.max(F.when(ok, F.col("loss"))).over(own)
    rows = candidates.withColumn("length_fit", F.least("length", "observed") / F.greatest("length", "observed"))
    rows = rows.withColumn("acoustic_fit", F.when(ok, 1 - (F.col("loss") - low) / F.greatest(high - low, F.lit(1e-6))).otherwise(F.lit(0.0)))
    following = F.lead(F.when(ok, F.col("loss"))).over(own.orderBy("loss", F.desc("prior"), "cand"))
    rows = rows.withColumn("margin", F.when(ok, F.coalesce(following, F.col("loss")) - F.col("loss")).otherwise(F.lit(0.0)))
    weight = lambda a, b: F.when(weak, a).otherwise(b)
    fusion = F.col("prior") * weight(0.45, 0.6) + F.col("acoustic_fit") * weight(0.4, 0.25) + F.col("length_fit") * 0.15
    rows = rows.withColumn("fusion", F.round(F.least(F.lit(1.0), fusion), 6))
    return rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("fusion"), F.desc("prior"), "loss", "cand")))


def longest_within(candidates: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """Per utt the longest prefix candidate whose loss is within tolerance of the best (equal lengths: the later one)."""
    best = F.min("loss").over(Window.partitionBy("utt"))
    rows = candidates.withColumn("_best", best).where(F.col("loss") <= F.col("_best") + tolerance)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("utt").orderBy(F.desc("length"), F.desc("cand")))).where("_r = 1").drop("_r", "_best")


class Trie:
    """Prefix tree of token sequences; nodes are numbered in breadth order."""

    def __init__(self, sequences: dict):
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[list] = [[]]
        level = [(0, 0, list(sequences.items()))]
        while level:
            after = []
            for node, depth, items in level:
                by: dict[int, list] = {}
                for name, ids in items:
                    if len(ids) == depth:
                        self.ends[node].append(name)
                    else:
                        by.setdefault(ids[depth], []).append((name, ids))
                for token, own in by.items():
                    self.children[node][token] = len(self.children)
                    after.append((len(self.children), depth + 1, own))
                    self.children.append({})
                    self.ends.append([])
            level = after

    def tokens_after(self, ids: Sequence[int]) -> list[int]:
        """The tokens that may follow a prefix, in order; none for an unknown prefix."""
        node = self.walk(ids)
        return [] if node is None else sorted(self.children[node])

    def ends_below(self, ids: Sequence[int], most: int | None = None) -> list:
        """The sequences that start with a prefix, shortest first."""
        found, level = [], [self.walk(ids)]
        while level and level[0] is not None and (most is None or len(found) < most):
            found += [name for node in level for name in self.ends[node]]
            level = [child for node in level for _, child in sorted(self.children[node].items())]
        return found[:most]

    def walk(self, ids: Sequence[int]) -> int | None:
        node = 0
        for i in ids:
            node = self.children[node].get(i)
            if node is None:
                return None
        return node


def beam_search(logprobs: np.ndarray, blank: int, trie: Trie, width: int = 8) -> list[dict]:
    """Prefix beams within a trie, best first: ids, score, matched ends on the way, whether the last node ends a sequence.

    As in the decoder it stands for, a frame that repeats the last token does not extend the same prefix.
    """
    beams = {(): (0.0, -math.inf, 0, ())}
    for frame in logprobs:
        grown: dict[tuple, list] = {}
        for ids, (quiet, voiced, node, met) in beams.items():
            total = np.logaddexp(quiet, voiced)
            if total == -math.inf:
                continue
            kept = grown.setdefault(ids, [-math.inf, -math.inf, node, met])
            kept[0] = np.logaddexp(kept[0], total + frame[blank])
            for token, child in trie.children[node].items():
                came = (quiet if ids and ids[-1] == token else total) + frame[token]
                own = grown.setdefault((*ids, token), [-math.inf, -math.inf, child, (*met, *trie.ends[child])])
                own[1] = np.logaddexp(own[1], came)
        beams = dict(sorted(((k, tuple(v)) for k, v in grown.items()), key=lambda b: -np.logaddexp(b[1][0], b[1][1]))[:width])
    out = [{"ids": list(k), "score": float(np.logaddexp(q, v)), "matched": list(met), "complete": bool(trie.ends[node])} for k, (q, v, node, met) in beams.items()]
    return sorted(out, key=lambda x: -x["score"])


def repeated_run(tokens: Column, times: int = 3) -> Column:
    """Whether some token stands `times` times in succession."""
    places = F.sequence(F.lit(1), F.greatest(F.size(tokens) - times + 1, F.lit(1)))
    return (F.size(tokens) >= times) & F.exists(places, lambda i: F.size(F.array_distinct(F.slice(tokens, i, times))) == 1)


def cut_at_repeat(tokens: Column, times: int = 3) -> Column:
    """The tokens before one that stands for the `times`-th time in succession; all of them where none does, or where they are few."""
    n = F.size(tokens)
    places = F.when(n >= times, F.sequence(F.lit(times), F.greatest(n, F.lit(times)))).otherwise(F.array().cast("array<int>"))
    third = F.filter(places, lambda i: F.size(F.array_distinct(F.slice(tokens, i - times + 1, times))) == 1)
    return F.when((n > times) & (F.size(third) > 0), F.slice(tokens, F.lit(1), F.get(third, F.lit(0)) - 1)).otherwise(tokens)


def rank_with_span_penalty(candidates: DataFrame, text_weight: float = 0.0, penalty: float = 0.5) -> DataFrame:
    """utt, cand, final, rank of candidates (utt, cand, loss, length, frames, first, last, prior): the negative loss a token, plus the
    weighted text score, less the penalty for each row of a span after the first. Candidates whose tokens cannot be aligned with
    the frames (2 length + 1 > frames), and empty ones, are left out."""
    able = candidates.where((F.col("length") > 0) & (2 * F.col("length") + 1 <= F.col("frames")) & (F.col("loss") < float("inf")))
    final = -(F.col("loss") / F.col("length")) + text_weight * F.col("prior") - penalty * (F.col("last") - F.col("first"))
    rows = able.select("utt", "cand", F.round(final, 6).alias("final"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("utt").orderBy(F.desc("final"), "cand")))


def trie_sequences(rows: DataFrame, longest: int, boundary: str) -> DataFrame:
    """grp, seq, n_rows, tokens of the rows (grp, seq, tokens), and of every run of up to `longest` consecutive rows of a group.

    A boundary token stands between rows. A run with a row that has no tokens is left out.
    """
    ahead = Window.partitionBy("grp").orderBy("seq").rowsBetween(0, longest - 1)
    runs = rows.select("grp", "seq", F.collect_list("tokens").over(ahead).alias("run"))
    each = runs.select("grp", "seq", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("n_rows")).withColumn("run", F.slice("run", F.lit(1), F.col("n_rows")))
    joined = F.aggregate(F.slice("run", 2, longest), F.get("run", F.lit(0)), lambda have, more: F.concat(have, F.array(F.lit(boundary)), more))
    return each.where(F.forall("run", lambda r: F.size(r) > 0)).select("grp", "seq", "n_rows", joined.alias("tokens"))


def trie_edges(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """depth, parent, token, node: the edges of the prefix tree of token sequences.

    A node is named by a 128-bit hash chained over its tokens, so a sequence gives one row a token and no prefix is copied.
    """
    link = lambda h, token: F.md5(F.concat(h, F.lit(" "), token.cast("string")).cast("binary"))
    step = lambda have, token: F.concat(have, F.array(link(F.element_at(have, -1), token)))
    chain = F.aggregate(F.col(column), F.array(F.md5(F.lit("").cast("binary"))), step)
    rows = sequences.select(F.explode(F.arrays_zip(F.slice(chain, F.lit(1), F.size(column)).alias("parent"), F.col(column).alias("token"), F.slice(chain, 2, 1 << 30).alias("node"), F.sequence(F.lit(1), F.greatest(F.size(column), F.lit(1))).alias("depth"))).alias("e"))
    return rows.select("e.depth", "e.parent", "e.token", "e.node").where("token is not null").distinct()


def drop_overlaps(words: DataFrame, key: str, slack: float = 0.15) -> DataFrame:
    """Timed words (key, start, end) that begin no earlier than slack before the latest end so far."""
    before = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("_end", before).where(F.col("_end").isNull() | (F.col("start") >= F.col("_end") - slack)).drop("_end")


def spread_words(rows: DataFrame, key: str, words: str, seconds: str) -> DataFrame:
    """key, i, word, start, end: a text's words spread evenly over its seconds."""
    n = F.size(words)
    each = rows.select(key, F.col(seconds).alias("_s"), n.alias("_n"), F.posexplode(words).alias("i", "word"))
    return each.select(key, "i", "word", (F.col("_s") * F.col("i") / F.col("_n")).alias("start"), (F.col("_s") * (F.col("i") + 1) / F.col("_n")).alias("end"))
