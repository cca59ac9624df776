"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is a log-odds from a classifier on style features and on telling words,
fitted on labelled documents. Host and path posteriors (source, and source with language) then move
it: the classifier's posteriors are summed per host and path by grouped aggregation; a path's mean is
shrunk toward its host's and a host's toward the global mean, with prior strengths estimated from the
spread between groups, so that sparse sites fall back to their parent. The decision combines both:

    log-odds = evidence + logit(path posterior) - logit(global mean)

A document is good if it is labelled neither low quality nor toxic.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checked_broadcast, small_batches, stage, stored, without_rows

#: Bound on the labelled documents that the classifier is fitted on (smallest hashes of their ids).
FIT_ROWS = 20_000
#: Words are known by hashes of 24 bits: with fewer, harmless words share the hash of a telling one.
WORD_BUCKETS = 1 << 24
#: A word tells if it is this many standard deviations above its expected share of bad documents, in so many documents at any size of the sample, mostly bad ones.
TELLING_Z, TELLING_SUPPORT, TELLING_SHARE = 6.0, 8, 0.85

#: A document goes if it is good with less than this probability; below one half, to keep clean documents.
REJECT_BELOW = 0.3

FEATURES = ["upper", "digit", "punct", "high", "space", "distinct_words", "repeated_next", "repeated_lines", "word_length", "long_words", "lone_marks", "marked_words", "log_words", "telling"]

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_CLASS[128:] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str) -> list[str]:
    return text.lower().split()


def style(text: str) -> list[float]:
    """Features of a text's form; all zero for an empty text."""
    if not text:
        return [0.0] * (len(FEATURES) - 1)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    by = np.bincount(_CLASS[raw], minlength=6) / n
    words = words_of(text)
    k = max(1, len(words))
    lines = text.split("\n")
    again = sum(a == b for a, b in zip(words, words[1:]))
    distinct = set(words)
    marks = sum(1 for w in words if not w[0].isalnum() and not w.strip(_STRIP))
    marked = sum(1 for w in words if w[-1] in _STRIP and len(w) > 1 and w[-2] in _STRIP)
    return [by[1], by[2], by[3], by[4], by[5], len(distinct) / k ** 0.8, again / k, 1 - len(set(lines)) / len(lines), min(n / k, 30) / 10, sum(len(w) > 20 for w in distinct) / k, marks / k, marked / k, math.log1p(k) / 10]


def word_buckets(text: str) -> set[int]:
    import xxhash

    return {xxhash.xxh32_intdigest(w.strip(_STRIP).encode("utf-8", "replace")) % WORD_BUCKETS for w in set(words_of(text))}


class Model:
    """Telling words with their log-odds, and a logistic regression on the features."""

    def __init__(self, words: dict[int, float], mean, spread, weights):
        self.words, self.mean, self.spread, self.weights = words, mean, spread, weights

    def telling(self, buckets: set[int]) -> float:
        return max((self.words[b] for b in buckets if b in self.words), default=0.0)

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of good against the labelled share, for rows of features."""
        x = np.clip((rows - self.mean) / self.spread, -8, 8)
        return np.clip(np.column_stack([np.ones(len(x)), x, x[:, :-1] ** 2]) @ self.weights, -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Text and good (0/1) of at most fit_rows labelled documents. Of several labels of an id the worst counts; null labels are left out."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    return docs.select(F.col("doc_id").alias("id"), F.col("text")).join(F.broadcast(some), F.col("id") == F.col("doc_id")).select("text", "good")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """Fit the document classifier; None without labels of both kinds (all documents then have evidence 0)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            buckets = [sorted(word_buckets(t)) for t in texts]
            yield pd.DataFrame({"good": b["good"], "style": [style(t) for t in texts], "buckets": buckets, "words": [hashlib.blake2b(np.array(x, "<i4").tobytes(), digest_size=16).hexdigest() for x in buckets]})

    sample = stage(labelled(docs, labels, fit_rows).mapInPandas(run, "good int, style array<double>, buckets array<int>, words string"), "labelled")
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not n or good in (0, n):
        return None

    def fitted(words: dict[int, float]) -> Model:
        model = Model(words, None, None, None)

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"good": b["good"], "x": [[*s, model.telling(set(k))] for s, k in zip(b["style"], b["buckets"], strict=True)]})

        rows = sample.mapInPandas(features, "good int, x array<double>").toPandas()  # fit_rows at most
        x, y = np.array(rows["x"].tolist()), rows["good"].to_numpy(float)
        model.mean, model.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.clip((x - model.mean) / model.spread, -8, 8)
        model.weights = logistic(np.column_stack([np.ones(len(z)), z, z[:, :-1] ** 2]), y)
        return model

    by_style = fitted({})

    def styled_well(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([[*s, 0.0] for s in b["style"]]).reshape(len(b), len(FEATURES))
            yield b[["good", "buckets", "words"]][by_style.evidence(x) > 0]

    # Words tell among documents that their style does not give away; documents of the same words count once.
    once = stage(sample.mapInPandas(styled_well, "good int, buckets array<int>, words string").groupBy("words", "good").agg(F.min("buckets").alias("buckets")), "once")
    n, good = once.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not n or good in (0, n):
        return by_style
    share = 1 - good / n
    table = once.select("good", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum(1 - F.col("good")).alias("bad"))
    z = (F.col("bad") - F.col("n") * share) / math.sqrt(share * (1 - share)) / F.sqrt("n")
    told = table.where((F.col("n") >= TELLING_SUPPORT) & (z > TELLING_Z) & (F.col("bad") >= TELLING_SHARE * F.col("n"))).collect()  # of fit_rows documents at most
    return fitted({r["b"]: math.log((r["bad"] + 0.5) / (r["n"] - r["bad"] + 0.5) * (1 - share) / share) for r in told})


def evidence(docs: DataFrame, model: Model | None, extra: list) -> DataFrame:
    """extra columns and the classifier's log-odds of good (logit) for every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(*extra, F.col("text"))
    schema = rows.drop("text").withColumn("logit", F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            if model is None:
                logit = np.zeros(len(texts))
            else:
                x = np.array([[*style(t), model.telling(word_buckets_of(t, model))] for t in texts]).reshape(len(texts), len(FEATURES))
                logit = model.evidence(x)
            yield b.drop_columns(["text"]).append_column("logit", pa.array(logit, pa.float64()))

    return rows.mapInArrow(run, schema)


def word_buckets_of(text: str, model: Model) -> set[int]:
    return word_buckets(text) if model.words else set()


def _logit(p):
    return F.log(p / (1 - p))


def site_posteriors(rows: DataFrame) -> DataFrame:
    """host, path, shift: the log-odds that a path's posterior adds. Null hosts and paths are groups of their own.

    rows has host, path and p. Strength of a prior = mean * (1 - mean) / variance between groups - 1,
    estimated by moments over hosts, and over paths around their hosts.
    """
    paths = stage(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    top = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k")).first()
    if not top["n"]:
        return paths.select("host", "path", F.lit(0.0).alias("shift"))
    mean = min(max(top["s"] / top["n"], 1e-4), 1 - 1e-4)
    unit = mean * (1 - mean)

    def strength(groups: DataFrame, n: str, centre) -> float:
        spread = groups.agg(F.sum(F.col(n) * F.pow(F.col("g") - centre, 2) - unit).alias("v"), F.sum(n).alias("n")).first()
        between = max((spread["v"] or 0.0) / max(spread["n"] or 1, 1), unit / 1000)
        return max(unit / between - 1, 1.0)

    a = strength(hosts.withColumn("g", F.col("hs") / F.col("hn")), "hn", F.lit(mean))
    host = hosts.select(F.col("host").alias("h"), ((F.col("hs") + a * mean) / (F.col("hn") + a)).alias("host_mean"))
    both = paths.join(host, F.col("host").eqNullSafe(F.col("h")))
    b = strength(both.withColumn("g", F.col("s") / F.col("n")), "n", F.col("host_mean"))
    post = (F.col("s") + b * F.col("host_mean")) / (F.col("n") + b)
    post = F.least(F.greatest(post, F.lit(1e-4)), F.lit(1 - 1e-4))
    return both.select("host", "path", (_logit(post) - _logit(F.lit(mean))).alias("shift"))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = REJECT_BELOW, id_col: str = "doc_id", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """rid (row of this scan), doc_id, evidence, site_shift, p_good and keep for every document.

    Null texts count as empty; null hosts and paths form a site; null and repeated ids keep their rows. Without
    usable labels nothing is rejected. An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, fit_rows)
    extra = [F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path")]
    rows = stage(evidence(docs, model, extra), "evidence").withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    sites = checked_broadcast(stage(site_posteriors(rows), "sites").withColumnsRenamed({"host": "h2", "path": "p2"}))
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")), "left")
    total = F.col("logit") + F.coalesce("shift", F.lit(0.0))
    p = 1 / (1 + F.exp(-total))
    keep = F.lit(True) if model is None else p >= threshold
    return joined.select("rid", "doc_id", F.col("logit").alias("evidence"), F.coalesce("shift", F.lit(0.0)).alias("site_shift"), p.alias("p_good"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; what is not a stored table is stored first."""
    docs = stored(docs)
    return without_rows(docs, stage(score(docs, labels, **settings).where("not keep").select("rid"), "rejected"))
