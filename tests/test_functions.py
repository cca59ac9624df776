"""Golden values and properties of functions."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import alignment as al
from seqloom.functions import scalar, similarity, text
from seqloom.operators import decode, evaluation, structure
from seqloom.plans.catalog import QUERIES

short = st.text("abc ", max_size=12)


def table_distance(a, b, substitution=1, free=False):
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (0 if x == y else substitution)))
        row = new
    return min(row) if free else row[-1]


@settings(max_examples=300, deadline=None)
@given(short, short)
def test_distances(a, b):
    lev, indel = al.edit_distance(a, b), al.edit_distance(a, b, 2)
    assert lev == table_distance(a, b) and indel == table_distance(a, b, 2)
    assert al.semi_global_distance(a, b) == table_distance(a, b, 1, True)
    assert lev <= indel <= 2 * lev and lev == al.edit_distance(b, a)
    assert 0 <= al.indel_ratio(a, b) == al.indel_ratio(b, a) <= 1
    if a and b:
        s, l = sorted((a, b), key=len)
        assert al.partial_indel_ratio(a, b) == pytest.approx(max(al.indel_ratio(s, l[i : i + len(s)]) for i in range(len(l) - len(s) + 1)))
    errors = al.alignment_errors(list(a), list(b))["errors"]
    assert len(errors) == lev


@pytest.mark.parametrize(("q", "t", "edits"), [("bcd", "abcde", 0), ("bxd", "abcde", 1), ("abc", "", 3), ("", "abcde", 0), ("abcdef", "bcd", 3), ("bismiallahi", "bismiallahiarraHmaaniarraHiimi", 0)])
def test_semi_global(q, t, edits):
    assert al.semi_global_distance(q, t) == edits


@pytest.mark.parametrize(("q", "t", "score"), [("bcd", "abcde", 1.0), ("bxd", "abcde", 2 / 3), ("abcdef", "bcd", 0.5), ("", "abc", 1.0)])
def test_fragment_score(q, t, score):
    assert al.fragment_score(q, t) == pytest.approx(score)
    assert al.fragment_score("zzzzz", "abcde") < 0.2


def test_three_ratios_differ():
    assert (al.indel_ratio("ab", "cd"), al.lev_ratio("ab", "cd"), al.max_ratio("ab", "cd")) == (0.0, 0.5, 0.0)


def test_alignment_cases():
    assert al.alignment_errors([], []) == {"errors": [], "per": 0.0, "correct_rate": 1.0, "alignment": []}
    assert al.alignment_errors(["a", "b"], [])["per"] == 2.0 and al.alignment_errors([], ["a"])["per"] == 1.0
    got = al.alignment_errors(list("bizm"), list("bism"))
    assert got["errors"] == [{"type": "substitution", "position": 2, "expected": "s", "got": "z"}] and got["correct_rate"] == 0.75
    fixes = al.word_corrections("b i z m i | a l a h i", "b i s m i | a l l a h i")
    assert [(f["word_index"], f["expected"], f["got"], f["error_type"]) for f in fixes] == [(0, "s", "z", "substitution"), (1, "l", "", "deletion")]
    assert al.word_corrections("b i z m i | a l a h i", "b i s m i | a l l a h i", 1)[0]["word_index"] == 0


def test_word_alignments():
    heard, words = "the quik fox".split(), "a the quick brown fox".split()
    assert al.lookahead_align(heard, words) == al.fuzzy_lcs(heard, words) == (5, [1, 2, 4])
    assert al.lookahead_align(["zzz"], words, 2) == (2, []) and al.lookahead_align([], words) == (0, [])
    assert al.char_progress("quick bro", "the quick brown fox jumps".split()) == 2 and al.char_progress("ab", words) == -1
    assert al.lexical_score("a b c", "a b c") == 1.0 and al.lexical_score("", "a") == 0.0
    assert al.dtw_similarity(np.eye(3), np.eye(3)) == 1.0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalisers(spark):
    one = lambda c: value(spark, c)
    assert one(text.normalize_arabic(F.lit("بِسْمِ ٱللَّهِ، ۝١ "))) == "بسم الله"
    assert one(text.normalize_arabic(F.lit("مَـٰلِكِ"))) == "مالك"
    assert one(text.normalize_arabic(F.lit("صلوة"), strip_hamza=True)) == "صلاة"
    assert one(text.fold_arabic(F.lit("أُمَّةٌ إلى"))) == "امه الي"
    assert one(text.collapse_ws(F.lit(" a  \n b "))) == "a b"
    assert one(text.merge_marks(F.lit("a ۖ b"))) == "aۖ b"


def test_similarities(spark):
    one = lambda c: value(spark, c)
    lit = F.lit
    assert one(similarity.lev_ratio(lit(""), lit(""))) == 1.0 and one(similarity.lev_ratio(lit("ab"), lit("cd"))) == 0.5
    assert one(similarity.partial_ratio(lit("bcd"), lit("abcde"))) == 1.0 and one(similarity.partial_ratio(lit(""), lit("a"))) == 0.0
    assert one(similarity.lev_ratio_at_least(lit("abcd"), lit("abce"), 0.9)) is None
    assert one(similarity.strip_leading_residual(lit("one two three four"), lit("one two"))) == "three four"
    assert one(similarity.suffix_prefix_ratio(lit("x y one two"), lit("one two three"))) == 1.0
    assert one(similarity.words_match(lit("quick"), lit("quik"))) and not one(similarity.words_match(lit("ab"), lit("ac")))


def test_scalars(spark):
    one = lambda c: value(spark, c)
    inf = float("inf")
    assert one(scalar.log_add_exp(F.lit(-inf), F.lit(-inf))) == -inf
    assert one(scalar.log_add_exp(F.lit(0.0), F.lit(0.0))) == pytest.approx(math.log(2))
    assert one(scalar.format_ref(F.lit(2), F.lit(5), F.lit(5))) == "2:5" and one(scalar.format_ref(F.lit(2), F.lit(5), F.lit(7))) == "2:5-7"
    assert one(scalar.range_of(F.lit(3), F.lit(1))) == [3] and one(scalar.clamp(F.lit(inf), 1.0, 2.0)) == 1.0
    assert one(scalar.confidence(F.lit(inf))) == 0.0


@pytest.mark.parametrize(("expected", "predicted", "scores"), [("abc", "ac", (2 / 3, 1, 0)), ("a", "ab", (1, 0.5, 0)), ("abc", "", (0, 0, 0)), ("abc", "bca", (1 / 3, 1 / 3, 0)), ("ab", "ab", (1, 1, 1)), ("", "a", (1, 1, 1))])
def test_sequence_score(spark, expected, predicted, scores):
    arr = lambda s: F.array(*[F.lit(c) for c in s]) if s else F.array().cast("array<string>")
    assert tuple(value(spark, evaluation.sequence_score(arr(expected), arr(predicted)))) == pytest.approx(scores)


def test_successors(spark):
    rows = [(1, 1), (1, 7), (2, 1), (4, 1)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in structure.successors(spark.createDataFrame(rows, "grp long, seq long")).collect()}
    assert got == {(1, 1): (1, 7), (1, 7): (2, 1), (2, 1): (None, None), (4, 1): (None, None)}


def test_span_counts(spark):
    rows = [(g, s, f"t{s}") for g in range(3) for s in range(g + 2)]
    n = structure.spans(spark.createDataFrame(rows, "grp long, seq long, txt string"), 3).groupBy("grp").count().collect()
    assert {r["grp"]: r["count"] for r in n} == {g: sum(max(0, g + 2 - k + 1) for k in (2, 3)) for g in range(3)}


def paths(target, steps, blank, vocab):
    import itertools

    for p in itertools.product(range(vocab), repeat=steps):
        out = [k for k, _ in itertools.groupby(p)]
        if [k for k in out if k != blank] == target:
            yield p


@pytest.mark.parametrize("target", [[0], [0, 1], [1, 1]])
def test_ctc_loss_sums_all_paths(target):
    rng = np.random.default_rng(0)
    f = rng.standard_normal((5, 3))
    f -= np.log(np.exp(f).sum(1, keepdims=True))
    total = sum(math.exp(sum(f[t, k] for t, k in enumerate(p))) for p in paths(target, 5, 2, 3))
    assert decode.ctc_loss(f, target, 2) == pytest.approx(-math.log(total) / len(target))
    assert decode.ctc_loss(f, [0, 1, 0], 2) == decode.ctc_loss(f, [], 2) == decode.IMPOSSIBLE


def test_trie_and_beams():
    trie = decode.Trie({"ab": [0, 1], "a": [0], "bc": [1, 2]})
    assert trie.ends[trie.walk([0])] == ["a"] and trie.walk([2]) is None
    frames = np.log(np.full((4, 4), 0.01))
    for t, k in enumerate((0, 3, 1, 3)):
        frames[t, k] = math.log(0.97)
    best = decode.beam_search(frames, 3, trie)[0]
    assert best["ids"] == [0, 1] and best["matched"] == ["a", "ab"] and best["complete"]


@pytest.mark.parametrize(
    ("text", "sounds"),
    [
        ("بِسْمِ ٱللَّهِ", "b i s m i | a l l a h i"), ("ٱلرَّحْمَـٰنِ ٱلرَّحِيمِ", "a r r a H m aa n i | a r r a H ii m i"), ("قُلْ هُوَ", "q u l | h u w a"), ("نُورٌ", "n uu r u n"), ("كِتَابًا", "k i t aa b a n"),
        ("رَحْمَةً", "r a H m a t a n"), ("رَحْمَة", "r a H m a h"), ("هُدًى", "h u d a n aa"), ("أَنَا", "< a n aa"), ("إِلَىٰ", "< i l aa"), ("ءَامَنَ", "< aa m a n a"), ("ٱلْحَمْدُ", "a l H a m d u"), ("", ""), ("abc", ""),
    ],
)
def test_phonemes(text, sounds):
    from seqloom.functions.phonemes import phonemes

    assert phonemes(text) == sounds


def test_block_and_join_scores_agree(spark):
    from seqloom.operators import joins

    corpus = spark.createDataFrame([(1, 1, "the quick fox"), (1, 2, "the slow fox"), (2, 1, ""), (2, 2, None), (3, 1, "ünïcödé fox"), (3, 2, "the quick fox")], "grp long, seq long, txt string")
    queries = spark.createDataFrame([(7, "quick foxes"), (8, "zz"), (9, None), (10, "ïcö")], "qid long, txt string")
    block = {(r["qid"], r["grp"], r["seq"]): r["score"] for r in joins.gram_candidates(queries, corpus, ["grp", "seq"], 50).collect()}
    joined = {(r["qid"], r["grp"], r["seq"]): r["score"] for r in joins._score_by_joins(queries, corpus, ["grp", "seq"], 3).collect()}
    assert block == joined and {q for q, _, _ in block} == {7, 10}


def test_fuzzy_lcs_by_full_table():
    rng = random.Random(5)
    pool = ["quick", "quik", "brown", "browm", "the", "a", "of", "fox", "foxes", "jumps"]
    for _ in range(200):
        heard, words = ([rng.choice(pool) for _ in range(rng.randint(0, 70))] for _ in range(2))
        best = [[0] * (len(words) + 1) for _ in range(len(heard) + 1)]
        for i, h in enumerate(heard):
            for j, w in enumerate(words):
                best[i + 1][j + 1] = best[i][j] + 1 if al.words_match(h, w) else max(best[i][j + 1], best[i + 1][j])
        out, i, j = [], len(heard), len(words)
        while i and j:
            if al.words_match(heard[i - 1], words[j - 1]):
                i, j = i - 1, j - 1
                out.append(j)
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        assert al.fuzzy_lcs(heard, words) == ((out[0] + 1 if out else 0), out[::-1])


def test_lookahead_align_reads_whole_turns(spark, tmp_path):
    words = [f"{c}{d}word" * 2 for c in "abcdefghij" for d in "klmnopqrst"]
    rows = [(1, 0, "user", " ".join(words)), (1, 1, "user", " ".join(words))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["lookahead_align"](spark, str(tmp_path)).collect()
    assert [(r["grp"], r["seq"], r["lcs"]) for r in got] == [(1, 0, 100)]


def full_dtw(a, b):
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            cost[i + 1, j + 1] = np.sqrt(((a[i] - b[j]) ** 2).sum()) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    return 1 / (1 + cost[-1, -1] / max(len(a), len(b)))


def test_dtw_reads_all_frames(spark, tmp_path):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 9), (30, 70), (70, 30)):
        a, b = rng.normal(size=(n, 4)) + 1e3, rng.normal(size=(m, 4)) + 1e3
        b[m // 2] = a[n // 2]
        assert abs(al.dtw_similarity(a, b) - full_dtw(a, b)) < 1e-9
    frames = {k: rng.normal(size=(60, 4)).astype(np.float32).astype(float) for k in (0, 1)}
    frames[1][:20] = frames[0][:20]
    rows = [(2 * i + k, k, [float(x) for x in f[i]]) for k, f in frames.items() for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["dtw_similarity"](spark, str(tmp_path)).collect()
    assert [(r["label"], round(full_dtw(frames[0], frames[1]), 6)) for r in got] == [(0, got[0]["score"])]


def test_numbers_of_a_million_wide_rows(spark):
    from seqloom.operators.corpus import contiguous_chunks, numbered

    rows = spark.range(1_000_000).selectExpr("pmod(id * 7919, 1000003) AS k", "repeat(cast(id AS string), 12) AS wide")
    got = numbered(rows, "k", "n").agg({"n": "max", "*": "count"}).first()
    assert got["max(n)"] == 999_999 and got["count(1)"] == 1_000_000
    assert numbered(rows, "k", "n").select("n").distinct().count() == 1_000_000
    assert sorted(r["count"] for r in contiguous_chunks(rows, "k", 7).groupBy("chunk").count().collect()) == [142_852] + [142_858] * 6


def test_knn_equals_brute_force(frame):
    from seqloom.operators.vectors import knn

    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, [1.0] * 5), (70, None), (71, [1.0, None, 1.0, 1.0, 1.0]), (72, [1.0])]
    index = frame(rows, "vec_id long, v array<double>")
    got = knn(index.selectExpr("vec_id AS qid", "v AS q"), index, 4).collect()
    want = {(q, r): (i, s) for q in range(60) for r, (s, i) in enumerate(sorted(((float(v[q] @ v[i]), i) for i in range(60) if i != q), key=lambda x: (-x[0], x[1]))[:4], 1)}
    assert {(r["qid"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
