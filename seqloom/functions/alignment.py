"""Alignments that built-in functions cannot express: plain functions, and Arrow UDFs over them.

Distances keep a column of their table as the bits of one integer, so a step costs a few operations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F



def _masks(tokens: Sequence) -> dict:
    masks: dict = {}
    for i, t in enumerate(tokens):
        masks[t] = masks.get(t, 0) | 1 << i
    return masks


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, a row of the table in one integer."""
    masks, row = _masks(a), (1 << len(a)) - 1
    for t in b:
        hit = row & masks.get(t, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def _column_scores(pattern: Sequence, tokens: Sequence, free_start: bool):
    """Edits of the whole pattern against the tokens up to each place (from their start, or from anywhere): differences of
    neighbouring cells are kept as bits, so a column is a few operations on integers."""
    n = len(pattern)
    full, last, masks = (1 << n) - 1, 1 << (n - 1), _masks(pattern)
    up, down, score = full, 0, n
    yield score
    for t in tokens:
        same = masks.get(t, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up) & full, diagonal & up
        score += bool(right & last) - bool(left & last)
        yield score
        right, left = (right << 1 | (not free_start)) & full, (left << 1) & full
        up, down = left | ~(diagonal | right) & full, right & diagonal


def edit_distance(a: Sequence, b: Sequence, substitution: int = 1) -> int:
    """Edits between two sequences of any tokens; a substitution costs 1 or 2."""
    if substitution == 2:
        return len(a) + len(b) - 2 * lcs_length(a, b)
    if not len(a) or not len(b):
        return len(a) + len(b)
    for score in _column_scores(a, b, False):
        pass
    return score


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); 1 if both are empty."""
    total = len(a) + len(b)
    return 1.0 if not total else (total - edit_distance(a, b, 2)) / total


def max_ratio(a: Sequence, b: Sequence) -> float:
    """1 - edits / longer length, over tokens; 1 if both are empty."""
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - edit_distance(a, b) / longest


def semi_global_distance(query: str, text: str) -> int:
    """Fewest edits of the query against any part of the text."""
    if not query:
        return 0
    return min(_column_scores(query, text, True))


def fragment_score(query: str, text: str) -> float:
    return 1.0 if not query else max(0.0, 1 - semi_global_distance(query, text) / len(query))


def partial_indel_ratio(a: str, b: str) -> float:
    """Best indel_ratio of the shorter with an equally long window of the longer; 0 if either is empty."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 1.0
    n, best, at = len(short), 0, 0
    while at <= len(long) - n:
        found = lcs_length(short, long[at : at + n])
        best = max(best, found)
        at += best - found + 1  # a window one further shares one more at most
    return best / n


def fragment_blend(query: str, text: str, full: float) -> float:
    """A partial query against a longer text: containment of three words or more, else a blend with the best window."""
    q, t = query.split(), text.split()
    if len(q) >= 3 and f" {query} " in f" {text} ":
        return max(full, 0.98)
    if len(q) < 4 or len(t) < 2:
        return full
    window = partial_indel_ratio(query, text)
    return full if window <= full else max(full, 0.25 * full + 0.75 * window * min(1.0, len(t) / len(q)))


def suffix_prefix_indel(query: str, text: str) -> float:
    q, t = query.split(), text.split()
    if min(len(q), len(t)) < 2:
        return 0.0
    return max(indel_ratio(" ".join(q[k:]), " ".join(t[: len(q) - k])) for k in range(1, min(len(q) // 2, 4) + 1))


def align(predicted: Sequence[str], reference: Sequence[str], insert_first: bool = False) -> list[tuple[str | None, str | None]]:
    """Pairs (reference, predicted) of a cheapest global alignment. From the end, ties go to the pair, then to
    deletion, then to insertion (the other way round with insert_first)."""
    n, m = len(reference), len(predicted)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    steps = np.arange(m + 1)
    same = np.array([[r == p for p in predicted] for r in reference], bool).reshape(n, m)
    for i in range(1, n + 1):
        row = cost[i].copy()
        row[1:] = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + ~same[i - 1])
        cost[i] = np.minimum.accumulate(row - steps) + steps
    pairs = []
    while n or m:
        here = cost[n, m]
        moves = {
            "pair": n and m and here == cost[n - 1, m - 1] + (not same[n - 1, m - 1]),
            "delete": n and here == cost[n - 1, m] + 1,
            "insert": m and here == cost[n, m - 1] + 1,
        }
        order = ("pair", "insert", "delete") if insert_first else ("pair", "delete", "insert")
        move = next(k for k in order if moves[k])
        n, m = n - (move != "insert"), m - (move != "delete")
        pairs.append((reference[n] if move != "insert" else None, predicted[m] if move != "delete" else None))
    return pairs[::-1]


def alignment_errors(predicted: Sequence[str], reference: Sequence[str], insert_first: bool = False) -> dict:
    """errors (type, position in the reference, expected, got), per, correct_rate and the pairs.

    Without a reference the error rate is the number of predicted tokens, and the rate of correct ones 0 (1 if
    nothing was predicted either).
    """
    pairs = align(predicted, reference, insert_first)
    errors, place, right = [], 0, 0
    for expected, got in pairs:
        if expected == got:
            right += 1
        else:
            kind = "insertion" if expected is None else "deletion" if got is None else "substitution"
            errors.append({"type": kind, "position": place, "expected": expected, "got": got})
        place += expected is not None
    n = len(reference)
    return {"errors": errors, "per": len(errors) / n if n else float(len(errors)), "correct_rate": right / n if n else float(not predicted), "alignment": [{"ref": r, "pred": p} for r, p in pairs]}


def word_corrections(predicted: str, reference: str, before_word: int | None = None) -> list[dict]:
    """Errors of aligned phonemes gathered by word of the reference (words end at |), in order of first error.

    The first error's type stands unless a substitution follows in the word. Errors past the end count to
    the last word; words from before_word on are left out.
    """
    p, r = [t for t in predicted.split() if t != "|"], reference.split()
    if not p and not predicted.split() or not r:
        return []
    word_of, at = [], 0
    for t in r:
        if t == "|":
            at += 1
        else:
            word_of.append(at)
    if not word_of:
        return []
    found: dict[int, dict] = {}
    for e in alignment_errors(p, [t for t in r if t != "|"])["errors"]:
        word = word_of[min(e["position"], len(word_of) - 1)]
        if before_word is not None and word >= before_word:
            continue
        own = found.setdefault(word, {"word_index": word, "expected": "", "got": "", "error_type": e["type"]})
        own["expected"] += e["expected"] or ""
        own["got"] += e["got"] or ""
        if e["type"] == "substitution":
            own["error_type"] = "substitution"
    return list(found.values())


def lev_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 1.0 if not total else (total - edit_distance(a, b)) / total


@lru_cache(1 << 18)
def words_match(a: str, b: str, least: float = 0.7) -> bool:
    if a == b:
        return True
    total = len(a) + len(b)
    return len(a) > 2 and len(b) > 2 and (total - abs(len(a) - len(b))) / total >= least and lev_ratio(a, b) >= least


def lookahead_align(heard: Sequence[str], words: Sequence[str], start: int = 0, ahead: int = 5) -> tuple[int, list[int]]:
    """Greedy: each heard word takes the first matching word among the next `ahead`. Position after the last match, and the matches."""
    matched, at = [], start
    for w in heard:
        hit = next((j for j in range(at, min(at + ahead, len(words))) if words_match(w, words[j])), None)
        if hit is not None:
            matched.append(hit)
            at = hit + 1
    if not len(heard) or not len(words):
        return 0, []
    return (matched[-1] + 1 if matched else start), matched


def fuzzy_lcs(heard: Sequence[str], words: Sequence[str]) -> tuple[int, list[int]]:
    """Longest common subsequence under words_match; position after the furthest matched word, and the matched places.

    Row i of the table is an integer, whose bit j is 0 where the cell after word j is one more than the cell before it.
    """
    m = len(words)
    full, masks, same = (1 << m) - 1, _masks(words), {}
    for h in heard:
        if h not in same:
            same[h] = sum(places for w, places in masks.items() if words_match(h, w))
    rows = [full]
    for h in heard:
        hit = rows[-1] & same[h]
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
    out, i, j = [], len(heard), m
    while i and j:
        if same[heard[i - 1]] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            out.append(j)
            continue
        before, here = rows[i - 1] & ((1 << j) - 1), rows[i] & ((1 << j) - 1)
        if before.bit_count() == here.bit_count():  # the cell above is as large
            i -= 1
        else:
            j -= 1
    return (out[0] + 1 if out else 0), out[::-1]


def char_progress(text: str, words: Sequence[str], least: float = 0.55) -> int:
    """Index of the word that a partial text reaches: best window without blanks, searched in steps of a fifth and then around the best; -1 if none is similar."""
    q, joined = text.replace(" ", ""), "".join(words)
    if len(q) < 3 or len(q) >= len(joined):
        return -1
    step, last = max(1, len(q) // 5), len(joined) - len(q)
    best, end = 0.0, 0
    for places in (range(0, last + 1, step), None):
        if places is None:
            if step == 1:
                break
            places = range(max(0, end - len(q) - step), min(last, end - len(q) + step) + 1)
        for i in places:
            score = lev_ratio(q, joined[i : i + len(q)])
            if score > best:
                best, end = score, i + len(q)
    if best < least:
        return -1
    ends = np.cumsum([len(w) for w in words])
    return min(int(np.searchsorted(ends, end)), len(words) - 1)


def lexical_score(query: str, text: str, least: float = 0.72) -> float:
    """Ordered word coverage, matching start and length fit, less unmatched words; within 0..1."""
    q, t = query.split(), text.split()
    if not q or not t:
        return 0.0
    similar = lambda a, b: indel_ratio(a, b) >= least
    matched, at = 0, 0
    for w in q:
        hit = next((j for j in range(at, len(t)) if similar(w, t[j])), None)
        if hit is not None:
            matched, at = matched + 1, hit + 1
    start = next((i for i, (a, b) in enumerate(zip(q, t)) if not similar(a, b)), min(len(q), len(t)))
    shorter, longer = sorted((len(q), len(t)))
    score = 0.60 * matched / shorter + 0.25 * start / min(3, shorter) + 0.15 * shorter / longer - 0.15 * (len(q) - matched) / len(q)
    return max(0.0, min(1.0, score))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all frames; by products, and by differences where those would cancel."""
    norms = (a * a).sum(-1)[:, None] + (b * b).sum(-1)[None]
    square = norms - 2 * (a @ b.T)
    i, j = np.nonzero(square < 1e-6 * norms)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        square[x, y] = ((a[x] - b[y]) ** 2).sum(-1)
    return np.sqrt(square)


def dtw_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 / (1 + cost per step of the longer), cost of the cheapest monotone path over Euclidean frame distances.

    Two rows of the table are kept, and distances of a block of rows. Along a row, a cell is the running sum of
    distances plus the least (cost above less the running sum before it) so far.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    above, block = np.full(m + 1, np.inf), max(1, (1 << 20) // m)
    above[0] = 0
    for at in range(0, n, block):
        for far in _distances(a[at : at + block], b):
            run, row = np.cumsum(far), np.full(m + 1, np.inf)
            row[1:] = run + np.minimum.accumulate(np.minimum(above[1:], above[:-1]) - (run - far))
            above = row
    return float(1 / (1 + above[-1] / max(n, m)))


def _pairwise(function, kind: str):
    @F.pandas_udf(kind)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)])

    return udf


ERRORS = "struct<errors:array<struct<type:string,position:int,expected:string,got:string>>,per:double,correct_rate:double,alignment:array<struct<ref:string,pred:string>>>"
CORRECTIONS = "array<struct<word_index:int,expected:string,got:string,error_type:string>>"
PLACES = "struct<position:int,matched:array<int>>"


def _struct(function):
    def run(a, b):
        position, matched = function(list(a), list(b))
        return {"position": position, "matched": matched}

    return run


def _frame(function, kind: str):
    """UDF whose result is a struct."""

    @F.pandas_udf(kind)
    def udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([function(x, y) for x, y in zip(a, b)])

    return udf


def udfs() -> dict:
    """Arrow UDFs by name; made on call, as they need an active Spark."""
    return {
        "lev_ratio": _pairwise(lambda a, b: lev_ratio(*sorted((a, b), key=len, reverse=True)), "double"),  # a step for each character of the shorter
        "indel_ratio": _pairwise(indel_ratio, "double"),
        "partial_indel_ratio": _pairwise(partial_indel_ratio, "double"),
        "max_ratio": _pairwise(lambda a, b: max_ratio(list(a), list(b)), "double"),
        "token_edits": _pairwise(lambda a, b: edit_distance(list(a), list(b)), "int"),
        "semi_global": _pairwise(semi_global_distance, "int"),
        "fragment_score": _pairwise(fragment_score, "double"),
        "fragment_blend": _pairwise(lambda a, b: fragment_blend(a, b, indel_ratio(a, b)), "double"),
        "suffix_prefix_indel": _pairwise(suffix_prefix_indel, "double"),
        "lexical_score": _pairwise(lexical_score, "double"),
        "char_progress": _pairwise(lambda a, b: char_progress(a, b.split()), "int"),
        "align_errors": _frame(lambda a, b: alignment_errors(list(a), list(b)), ERRORS),
        "align_errors_insert_first": _frame(lambda a, b: alignment_errors(list(a), list(b), True), ERRORS),
        "word_corrections": _pairwise(word_corrections, CORRECTIONS),
        "lookahead_align": _frame(_struct(lookahead_align), PLACES),
        "fuzzy_lcs": _frame(_struct(fuzzy_lcs), PLACES),
        "dtw_similarity": _pairwise(lambda a, b: dtw_similarity(np.stack(a), np.stack(b)), "double"),
    }
