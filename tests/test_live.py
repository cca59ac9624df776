"""Live-session parts, tries, and matchers against plain versions in Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import alignment as al
from seqloom.operators import decode, retrieval
from seqloom.plans import stream_queries
from seqloom.plans.catalog import QUERIES
from seqloom.streaming import live
from seqloom.streaming.tracker import Corpus, Row, Tracker, match_front, peel

WORDS = "the quick brown fox jumps over a lazy dog and runs far away home".split()


def small_corpus(seed=3, openings=True):
    rng = random.Random(seed)
    rows = []
    for g in range(1, 6):
        for s in range(1, rng.randint(2, 5)):
            text = " ".join(rng.choices(WORDS, k=rng.randint(2, 7)))
            opened = openings and s == 1 and g % 2 == 0
            rows.append((g, s, f"in the name {text}" if opened else text, text.replace("o", "oo"), text if opened else None))
    return rows[:18]


def questions(rows, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(25):
        a = rng.randrange(len(rows))
        words = " ".join(r[2] for r in rows[a : a + rng.randint(1, 3)]).split()
        cut = words[rng.randint(0, len(words) // 3) :] or words
        out.append((i, " ".join(w[:-1] + "x" if len(w) > 3 and rng.random() < 0.2 else w for w in cut)))
    return out


@pytest.mark.parametrize("hint", [None, (2, 1), (3, 9)])
def test_rows_and_spans_with_variants_equal_the_plain_matcher(frame, hint):
    rows, asked = small_corpus(), questions(small_corpus())
    corpus = frame(rows, "grp long, seq long, txt string, other string, no_opening string")
    hints = None if hint is None else frame([hint], "grp long, seq long")
    got = {r["qid"]: r for r in retrieval.match_rows(frame(asked, "qid long, txt string"), corpus, hint=hints).collect()}
    plain = Corpus([Row(g, s, t, n, o) for g, s, t, o, n in rows])
    for qid, text in asked:
        want = match_front(plain, text, hint, longest=3)
        assert (want is None) == (qid not in got)
        if want:
            assert got[qid]["score"] == pytest.approx(want["score"], abs=1.1e-6)
            assert (got[qid]["grp"], got[qid]["seq"], got[qid]["seq_end"]) == (want["grp"], want["seq"], want["seq_end"])


def test_voted_spans_equal_the_plain_version(frame):
    rows = [(g, s, t) for g, s, t, _, _ in small_corpus(8, openings=False)]
    asked = [*questions([(g, s, t) for g, s, t in rows], 9), (90, ""), (91, "zzz qqq")]
    got = {r["qid"]: tuple(r)[1:] for r in retrieval.match_voted(frame(asked, "qid long, txt string"), frame(rows, "grp long, seq long, txt string"), gram=2, best_groups=1, voted_groups=1).collect()}
    grams = lambda t: list(zip(t.split(), t.split()[1:]))
    count = {}
    for _, _, t in rows:
        for g in grams(t):
            count[g] = count.get(g, 0) + 1
    for qid, text in asked:
        if not text:
            assert qid not in got
            continue
        ranked = sorted(rows, key=lambda r: (-round(al.indel_ratio(text, r[2]), 6), r[0], r[1]))
        groups = {ranked[0][0]}
        votes = {(g, s): sum(1 / count[x] for x in grams(text) if x in set(grams(t))) for g, s, t in rows}
        total = {}
        for (g, _), w in votes.items():
            total[g] = total.get(g, 0) + w
        runs = {}
        for g in sorted(total, key=lambda g: (-round(total[g], 6), g))[:2]:
            if total[g]:
                best = run = 0.0
                for s in range(1, 9):
                    run = run + votes[g, s] if votes.get((g, s)) else 0.0
                    best = max(best, run)
                runs[g] = (round(best, 6), round(total[g], 6), -g)
        if runs:
            groups.add(max(runs, key=runs.get))
        best = (round(al.indel_ratio(text, ranked[0][2]), 6), ranked[0][0], ranked[0][1], ranked[0][1])
        spans = []
        for g in groups:
            own = [r for r in rows if r[0] == g]
            for i in range(len(own)):
                for n in range(2, min(7, len(own) - i) + 1):
                    spans.append((-round(al.indel_ratio(text, " ".join(r[2] for r in own[i : i + n])), 6), g, own[i][1], own[i + n - 1][1]))
        if spans and -min(spans)[0] > best[0]:
            best = (-min(spans)[0], *min(spans)[1:])
        want = (*best[1:], round(best[0], 4)) if best[0] >= 0.3 else (0, 0, 0, 0.0)
        assert got[qid] == want


def test_retrieval_by_indel_ratio(frame):
    rows = [(g, s, t) for g, s, t, _, _ in small_corpus(4, openings=False)]
    asked = questions(rows, 6)
    got = retrieval.retrieve(frame(asked, "qid long, txt string"), frame(rows, "grp long, seq long, txt string"), single_limit=100, fragments=False, indel=True).where("kind = 'single'").collect()
    texts = {(g, s): t for g, s, t in rows}
    assert len(got) == len(asked) * len(rows)
    for r in got:
        q, t = dict(asked)[r["qid"]], texts[r["grp"], r["seq"]]
        if len(q.replace(" ", "")) > 10:  # shorter ones also score by their start
            n = min(len(q.split()), len(t.split()))
            assert r["score"] == pytest.approx(max(al.indel_ratio(q, t), al.indel_ratio(" ".join(q.split()[:n]), " ".join(t.split()[:n]))), abs=1.1e-6)


@pytest.mark.parametrize(("name", "how"), [("verse_tracker_deltas", "delta"), ("verse_tracker_snapshots", "snapshot"), ("tentative_hold", "gated")])
def test_tracker_queries_walk_every_session(spark, sf_dir, name, how):
    corpus, chunks = stream_queries.corpus_rows(spark, sf_dir).value, stream_queries._speech(spark, sf_dir).collect()
    got, want = {}, {}
    for r in sorted(QUERIES[name](spark, sf_dir).collect(), key=lambda r: (r["session"], r["pos"])):
        got.setdefault(r["session"], []).append((r["grp"], r["seq"], r["score"]))
    for session in {c["session"] for c in chunks}:
        tracker, found, so_far = Tracker(corpus, streaming=how == "gated"), [], ""
        for c in sorted((c for c in chunks if c["session"] == session), key=lambda c: c["offset"]):
            so_far = f"{so_far} {c['txt']}".strip()
            found += tracker.gated(c["txt"], c["log_prob"]) if how == "gated" else tracker.snapshot(so_far) if how == "snapshot" else tracker.delta(c["txt"])
        found += tracker.finish_gated() if how == "gated" else tracker.finish()
        want[session] = [(e["grp"], e["seq"], round(e["score"], 6)) for e in found]
    assert got == {k: v for k, v in want.items() if v} and got


def test_peeled_transcripts(spark, sf_dir):
    corpus, chunks = stream_queries.corpus_rows(spark, sf_dir).value, stream_queries._speech(spark, sf_dir).collect()
    got = {}
    for r in sorted(QUERIES["peel_transcript"](spark, sf_dir).collect(), key=lambda r: (r["session"], r["pos"])):
        got.setdefault(r["session"], []).append((r["grp"], r["seq"], r["score"]))
    for session in {c["session"] for c in chunks}:
        whole = " ".join(c["txt"] for c in sorted((c for c in chunks if c["session"] == session), key=lambda c: c["offset"]))
        assert got[session] == [(e["grp"], e["seq"], round(e["score"], 6)) for e in peel(whole, lambda t, hint: match_front(corpus, t, hint))]
    assert sum(map(len, got.values())) >= 35


def test_diagnostics_count_what_is_emitted(spark, sf_dir):
    notes = QUERIES["tracker_diagnostics"](spark, sf_dir).collect()
    assert {n["event"] for n in notes} <= {"nothing", "rises", "falls", "stays", "shifts", "starts"}
    emitted = {s: sum(n["emitted"] for n in notes if n["session"] == s) for s in {n["session"] for n in notes}}
    rows = QUERIES["verse_tracker_deltas"](spark, sf_dir).groupBy("session").count().collect()
    assert all(0 <= r["count"] - emitted[r["session"]] <= 1 for r in rows)  # one more may come at the end


def test_best_hypothesis_is_the_better_of_two(frame):
    rows, asked = [(g, s, t) for g, s, t, _, _ in small_corpus(4, openings=False)], questions(small_corpus(4, openings=False), 7)
    corpus = frame(rows, "grp long, seq long, txt string")
    both = [(q, [t, " ".join(t.split()[1:])]) for q, t in asked]
    got = {r["qid"]: r for r in retrieval.best_hypothesis(frame(both, "qid long, hypotheses array<string>"), lambda q: retrieval.match_rows(q, corpus)).collect()}
    plain = Corpus([Row(*r) for r in rows])
    for q, texts in both:
        scores = [(match_front(plain, t, None, longest=3) or {"score": -1.0})["score"] for t in texts]
        if max(scores) > 0:
            assert got[q]["score"] == pytest.approx(max(scores), abs=1.1e-6)


def test_trie_of_rows_and_spans(frame):
    rows = [(1, 1, [1, 2]), (1, 2, [1, 3, 3]), (1, 3, []), (1, 4, [1, 2]), (2, 1, [2])]
    found = decode.trie_sequences(frame(rows, "grp long, seq long, tokens array<int>"), 3, 9)
    sequences = {(r["grp"], r["seq"], r["n_rows"]): r["tokens"] for r in found.collect()}
    assert sequences == {(1, 1, 1): [1, 2], (1, 1, 2): [1, 2, 9, 1, 3, 3], (1, 2, 1): [1, 3, 3], (1, 4, 1): [1, 2], (2, 1, 1): [2]}
    trie = decode.Trie(sequences)
    edges = decode.trie_edges(found).collect()
    assert len(edges) == len(trie.children) - 1 == len({e["node"] for e in edges})
    assert sorted(e["token"] for e in edges if e["depth"] == 2) == [2, 3]
    assert trie.tokens_after([1]) == [2, 3] and trie.tokens_after([5]) == [] and trie.walk([1, 2, 9, 1]) is not None
    assert trie.ends_below([1, 2]) == [(1, 1, 1), (1, 4, 1), (1, 1, 2)] and trie.ends_below([1], 2) == [(1, 1, 1), (1, 4, 1)] and trie.ends_below([7]) == []


def test_frames_in_batch_and_on_a_stream(spark, frame, tmp_path):
    samples = [[0.5, -1.0, 3.25], [], None]
    rows = frame([(1, i, s) for i, s in enumerate(samples)], "session long, offset long, samples array<float>").withColumn("frame", live.frame_of()("samples"))
    rows.select("session", "offset", "frame").write.parquet(str(tmp_path / "f"))
    assert [r["samples"] for r in live.frames(spark, str(tmp_path / "f")).orderBy("offset").collect()] == samples
    query = live.frames(spark, str(tmp_path / "f"), stream=True).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert sorted((r["offset"], r["samples"]) for r in spark.table("frames").collect())[:2] == [(0, samples[0]), (1, [])]


def test_strides_and_buffers(frame):
    rows = frame([(1, [float(x) for x in range(7)]), (2, []), (3, None)], "id long, s array<double>")
    got = {r["id"]: r["t"] for r in rows.select("id", live.strided(F.col("s"), 2.5).alias("t")).collect()}
    assert got == {1: [0.0, 2.0, 5.0], 2: [], 3: None}
    rng = np.random.default_rng(1)
    chunks = [(int(k), i, int(rng.integers(1, 30)), int(rng.choice([20, 50, 90]))) for i, k in enumerate(rng.integers(0, 3, 60))]
    held = {}
    want = {}
    for k, i, n, most in chunks:
        held[k] = want[k, i] = min(held.get(k, 0) + n, most)
    got = live.rolling_buffer(frame(chunks, "k long, i long, n long, most long"), "k", "i", "n", "most").collect()
    assert {(r["k"], r["i"]): r["held"] for r in got} == want


def test_commits_and_rollbacks(frame):
    def shown(*events):
        rows = [(1, i, *e, *[None] * (3 - len(e))) for i, e in enumerate(events)]
        return [(r["shown"], r["undone"]) for r in live.ledger(frame(rows, "session long, offset long, what string, ref string, strong boolean")).orderBy("offset").collect()]

    assert shown(("commit", "a", True), ("commit", "b", False), ("silence",))[-1] == ("a", True)
    assert shown(("commit", "a", False), ("commit", "b", True), ("silence",))[-1] == ("b", False)
    assert shown(("commit", "a", True), ("commit", "b", False), ("progress",), ("silence",))[-1] == ("b", False)
    assert shown(("commit", "a", True), ("advance", "b"), ("exit",)) == [("a", False), ("b", False), ("a", True)]
    assert shown(("commit", "a", True), ("advance", "b"), ("progress",), ("exit",))[-1] == ("b", False)
    assert shown(("exit",), ("silence",)) == [(None, False)] * 2
