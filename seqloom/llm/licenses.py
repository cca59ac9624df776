"""Licence scans by diagonal voting.

Every rolling word k-gram of every text is joined by hash to the k-grams of licence templates. A hit at word
i of the text and word j of the template lies on diagonal i - j; hits are counted per text, template and
diagonal, so a passage that follows the template votes for one diagonal, and insertions or gaps move it to a
neighbour. Neighbouring diagonals are merged, and the span they cover is verified against the template's words;
where a text repeats itself and more than RUN of them chain, every run of RUN neighbours is verified.

The templates are a fixed, small table, so broadcasting it has a proven bound and the k-grams are never
shuffled: only hits are, a few for each text that quotes a licence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import lower_ascii, open_id, small_batches, solid_id

K = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases: each place where the words stand consecutively counts.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Passages that name or grant a licence, and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("mozilla public license version 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
]

#: Pairs of two of these words are in every text; in templates they vote for nothing. No passage is lost by it: where SIMILAR of a
#: template's words stand on one diagonal, whichever others are missing, enough other pairs are left to reach the votes asked for (tested).
COMMON = frozenset("a and any as by for free in is it of or the this to under use with you may not are that".split())

#: Diagonals this close are one passage; a span is verified if this share of the template's words is found in order.
SLACK, SIMILAR = 3, 0.8

#: Diagonals that one passage can stretch over.
RUN = 50


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def template_grams(phrases=PHRASES, templates=TEMPLATES, k: int = K) -> list[tuple[int, int, str, str]]:
    """template, place and words of every k-gram that votes. Templates are numbered, base phrases first."""
    out = []
    for t, (text, _) in enumerate([*phrases, *templates]):
        words = text.split(" ")
        for at in range(len(words) - k + 1):
            own = words[at : at + k]
            if t < len(phrases) or not COMMON.issuperset(own):
                out.append((t, at, *own))
    return out


def votes_needed(size: int) -> int:
    """Votes that a group of diagonals must have before its spans are verified against a template of that size."""
    return max(1, int(SIMILAR * (size - K + 1)) // 3)


def in_order(span: list[int], size: int) -> int:
    """Words of a template of that size found in the span in order (longest common subsequence); span: each word's places in the template, as bits."""
    full = row = (1 << size) - 1
    for places in span:
        hit = row & places
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def passages(group: list[tuple[int, int, int, list[str]]], words: list[str]) -> Iterator[tuple[int, int, int]]:
    """Matched words, first and last diagonal of the runs of a group that hold enough of the template's words in order.

    group: diagonal, votes, start, window, by diagonal. Windows of neighbours overlap, so a run covers one stretch of
    the text. A run that meets an earlier one and matches no more words than it is left out.
    """
    places: dict[str, int] = {}
    for i, w in enumerate(words):
        places[w] = places.get(w, 0) | 1 << i
    base, stretch = group[0][2], []
    for _, _, start, window in group:
        stretch += [places.get(w, 0) for w in window[base + len(stretch) - start :]]
    if in_order(stretch, len(words)) < SIMILAR * len(words):  # then no run has more
        return
    before, most = -RUN, 0
    for at in range(max(1, len(group) - RUN + 1)):
        run = group[at : at + RUN]
        matched = in_order(stretch[run[0][2] - base : run[-1][2] + len(run[-1][3]) - base], len(words))
        if matched >= SIMILAR * len(words) and (matched > most or at >= before + RUN):
            before, most = at, matched
            yield matched, run[0][0], run[-1][0]


def verified(hits: list[tuple[int, int, int, int, list[str]]], phrases=PHRASES, templates=TEMPLATES) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Base places, first and last start, base labels, the method's labels, and score, of one text.

    hits: template, diagonal, votes, first word of window, window (the words around the diagonal's span).
    """
    n, first, last, base, score = 0, None, None, set(), 0.0
    spans: list[tuple[float, int, int, int, str]] = []  # share, matched words, start, end, label
    by: dict[int, list] = {}
    for t, diagonal, votes, start, window in hits:
        if t < len(phrases):
            words = phrases[t][0].split(" ")
            at = diagonal - start
            if votes == len(words) - K + 1 and window[at : at + len(words)] == words:
                n += 1
                first, last = min(diagonal, diagonal if first is None else first), max(diagonal, -1 if last is None else last)
                base.add(phrases[t][1])
                score = 1.0
                spans.append((1.0, len(words), diagonal, diagonal + len(words), phrases[t][1]))
        else:
            by.setdefault(t, []).append((diagonal, votes, start, window))
    for t, found in by.items():
        words, label = templates[t - len(phrases)][0].split(" "), templates[t - len(phrases)][1]
        need = votes_needed(len(words))
        groups: list[list] = []
        for hit in sorted(found, key=lambda h: h[:3]):
            if groups and hit[0] - groups[-1][-1][0] <= SLACK:
                groups[-1].append(hit)
            else:
                groups.append([hit])
        for group in groups:
            if sum(h[1] for h in group) < need:
                continue
            for matched, low, high in passages(group, words):
                spans.append((matched / len(words), matched, low, high + len(words), label))
                score = max(score, matched / len(words))
    labels, kept = set(), []
    for span in sorted(spans, reverse=True):  # where passages overlap, the one that fits better names the licence
        if all(span[4] == k[4] or span[3] <= k[2] or span[2] >= k[3] for k in kept):
            kept.append(span)
            labels.add(span[4])
    return n, first, last, base, labels, score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Null and empty texts have no words; null and repeated ids keep their rows; whole texts are read. Label
    strings are empty where nothing is found, first_word and last_word null, score 0. An empty table gives
    no rows; other columns are ignored. A text's hits meet in one row: a window of a template's length for each diagonal
    of its words that has votes, which for a text of nothing but licence words is some dozen times the text.
    """
    spark = docs.sparkSession
    sizes = [len(t.split(" ")) for t, _ in [*phrases, *templates]]
    grams = spark.createDataFrame([(t, at, a, b, sizes[t]) for t, at, a, b in template_grams(phrases, templates)], "template int, at int, w1 string, w2 string, size int")
    grams = F.broadcast(grams.select("template", "at", "size", F.xxhash64("w1", "w2").alias("hash"), F.col("w1").alias("t1"), F.col("w2").alias("t2")))

    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), 0)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), solid_id(F.col(id_col)).alias("doc_id"), words.alias("words"))
    places = rows.select("rid", "doc_id", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("i", "w1"))
    places = places.withColumn("w2", F.get("words", F.col("i") + 1)).withColumn("h", F.when(F.col("w2").isNotNull(), F.xxhash64("w1", "w2")))
    hits = places.join(grams, (places["h"] == grams["hash"]) & (places["w1"] == grams["t1"]) & (places["w2"] == grams["t2"]), "left").where("template is not null or i is null or i = 0")
    diagonal = F.col("i") - F.col("at")
    start = F.greatest(diagonal - SLACK, F.lit(0))
    window = F.when(F.col("template").isNotNull(), F.slice("words", start + 1, F.col("size") + 2 * SLACK))
    votes = (
        hits.select("rid", "doc_id", "n_words", "template", diagonal.alias("diagonal"), start.alias("start"), window.alias("window"))
        .groupBy("rid", "doc_id", "n_words", "template", "diagonal", "start").agg(F.count("*").alias("votes"), F.first("window").alias("window"))
    )
    gathered = votes.groupBy("rid", "doc_id", "n_words").agg(F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "votes", "start", "window"))).alias("hits"))
    small_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for hits in b["hits"]:
                n, first, last, base, more, score = verified([(h["template"], h["diagonal"], h["votes"], h["start"], list(h["window"])) for h in hits], phrases, templates) if len(hits) else (0, None, None, set(), set(), 0.0)
                out.append((n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score))
            got = pd.DataFrame(out, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            got["first_word"], got["last_word"] = got["first_word"].astype("Int64"), got["last_word"].astype("Int64")
            yield pd.concat([b[["doc_id", "n_words"]], got], axis=1)

    found = gathered.mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return found.withColumn("doc_id", open_id(F.col("doc_id")))
