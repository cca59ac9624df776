"""Trackers in batch and on streams, and sources and sinks."""

import json
import wave

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.sources import io
from seqloom.functions.alignment import indel_ratio
from seqloom.streaming.tracker import Corpus, Row, State, Tracker, best_path, match_front, peel, peel_sessions, track, track_stream

TEXTS = {(1, 1): "in the name of the kind one", (1, 2): "all praise is for the lord of worlds", (1, 3): "master of the last day", (2, 1): "this is the book without any doubt", (2, 2): "a guide for those who fear"}
ROWS = [Row(g, s, t) for (g, s), t in TEXTS.items()]


@pytest.fixture
def corpus():
    return Corpus(ROWS)


def refs(found):
    return [(f["grp"], f["seq"]) for f in found]


def run(tracker, chunks, how="delta"):
    out = []
    for c in chunks:
        out += getattr(tracker, how)(c)
    return refs(out + tracker.finish())


def test_single_and_consecutive_rows(corpus):
    assert run(Tracker(corpus), [TEXTS[1, 3]]) == [(1, 3)]
    assert run(Tracker(corpus), [TEXTS[1, 1], TEXTS[1, 2], TEXTS[1, 3]]) == [(1, 1), (1, 2), (1, 3)]


def test_snapshots_and_silence(corpus):
    whole = TEXTS[2, 1].split()
    assert run(Tracker(corpus), [" ".join(whole[:n]) for n in range(1, len(whole) + 1)], "snapshot") == [(2, 1)]
    assert run(Tracker(corpus), ["", "  "]) == []


def test_unsure_chunks_are_held_back(corpus):
    t = Tracker(corpus)
    assert t.gated("zzz zzz zzz", -5.0) == [] and t.state.text == ""
    assert t.gated("one", -0.1) == []
    t.state.pending = {"grp": 1, "seq": 1, "score": 0.5}
    for _ in range(3):
        t.gated("", None)
    assert t.state.pending is None


def test_streaming_mode_needs_two_words_and_a_better_score(corpus):
    t = Tracker(corpus, streaming=True)
    assert t.delta("praise") == [] and t.finish() == []
    t = Tracker(corpus, streaming=True)
    assert t.delta("all") == [] and refs(t.delta("praise is for the lord of worlds") + t.finish()) == [(1, 2)]
    text = "a guide xxxxxxx yyyyyyy zzzz"  # between .3 and .4
    assert Tracker(corpus).find(text)["score"] < 0.4 and Tracker(corpus, streaming=True).find(text) is None


def test_tentative_rows_of_forty_percent_are_kept_at_the_end(corpus):
    t = Tracker(corpus, State(pending={"grp": 1, "seq": 1, "score": 0.42}), streaming=True)
    assert refs(t.finish_gated()) == [(1, 1)]
    t = Tracker(corpus, State(pending={"grp": 1, "seq": 1, "score": 0.39}), streaming=True)
    assert t.finish_gated() == []


def test_low_confidence_chunk_is_skipped_and_sure_rows_leave_at_once(corpus):
    t = Tracker(corpus, streaming=True)
    assert t.gated("utter noise here", -2.0) == []
    assert refs(t.gated(TEXTS[1, 1], -0.3) + t.gated(TEXTS[1, 2], -0.3)) == [(1, 1)]
    assert refs(t.finish_gated()) == [(1, 2)]


def test_expected_row_wins_among_equal_texts():
    refrain = Corpus([Row(55, s, "which of the favours will you deny") for s in (13, 16, 18)] + [Row(55, 12, "grain with husks and scented plants"), Row(55, 17, "lord of the two easts")])
    t = Tracker(refrain, State(last=[55, 17]))
    assert refs(t.snapshot("which of the favours will you deny") + t.finish()) == [(55, 18)]
    assert refs(Tracker(refrain).snapshot("which of the favours will you deny")) == []


def test_text_that_outgrows_rows_is_split(corpus):
    t = Tracker(corpus)
    assert refs(t.snapshot(" ".join([TEXTS[1, 2], TEXTS[1, 3]])) + t.finish()) == [(1, 2), (1, 3)]


def test_a_repeated_row_is_emitted_once(corpus):
    t = Tracker(corpus, State(last=[1, 3]))
    assert t.snapshot(TEXTS[1, 3]) == [] and t.finish() == []


def brute_find(corpus, text, last=None, least=0.3):
    best, words = None, text.split()
    for r in corpus.rows:
        for form in (r.text, r.no_opening):
            if not form:
                continue
            own = form.split()
            a = 0.3 if len(words) / len(own) > 0.8 else 0.7
            score = a * indel_ratio(text, " ".join(own[: len(words)])) + (1 - a) * indel_ratio(text, form) + 0.15 * (last is not None and corpus.next.get(last) == (r.grp, r.seq))
            if best is None or score > best[0]:
                best = (score, r.grp, r.seq)
    return best if best and best[0] >= least else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4), st.text("abc d", min_size=1, max_size=12)), min_size=1, max_size=8), st.text("abc d", min_size=1, max_size=12))
def test_find_leaves_no_row_out(rows, text):
    c = Corpus([Row(g, s, " ".join(t.split()), " ".join(t.split()[1:]) or None) for (g, s), t in {(g, s): t for g, s, t in rows}.items() if t.split()])
    text, last = " ".join(text.split()), (1, 1)
    want = brute_find(c, text, last) if text else None
    got = Tracker(c, State(last=list(last))).find(text)
    assert (got and (got["score"], got["grp"], got["seq"])) == want


def test_every_word_misspelt_still_matches(corpus):
    assert refs([Tracker(corpus).find("mastar off tha lazt dayy")]) == [(1, 3)]


def test_front_matches_spans_and_hinted_rows(corpus):
    got = match_front(corpus, f"{TEXTS[1, 1]} {TEXTS[1, 2]} {TEXTS[1, 3]}")
    assert (got["grp"], got["seq"], got["seq_end"], got["score"]) == (1, 1, 3, 1.0)
    assert match_front(corpus, TEXTS[2, 1], (1, 3))["score"] == 1.0 and match_front(corpus, "") is None
    assert corpus.bonuses((1, 1)) == {(1, 2): 0.22, (1, 3): 0.12} and corpus.bonuses((1, 3)) == {(2, 1): 0.22, (2, 2): 0.12}


def test_successor_crosses_groups(corpus):
    assert corpus.next[1, 2] == (1, 3) and corpus.next[1, 3] == (2, 1) and corpus.next[2, 2] is None


def test_best_path_prefers_neighbours():
    cycles = [[{"grp": 1, "seq": 1, "score": 0.6}, {"grp": 5, "seq": 9, "score": 0.65}], [{"grp": 1, "seq": 2, "score": 0.6}, {"grp": 7, "seq": 1, "score": 0.7}]]
    assert refs(best_path(cycles)) == [(1, 1), (1, 2)] and best_path([]) == []


def test_peel_transcript():
    def match(text, hint):
        return next(({"grp": g, "seq": s, "text": t, "score": 1.0} for (g, s), t in TEXTS.items() if text.startswith(t)), None)

    assert refs(peel(f"{TEXTS[1, 1]} {TEXTS[1, 2]} {TEXTS[2, 1]} noise", match)) == [(1, 1), (1, 2), (2, 1)]


def test_stream_equals_batch(spark, corpus, tmp_path):
    chunks = []
    for session, order in ((1, [(1, 1), (1, 2), (1, 3)]), (2, [(2, 1), (2, 2)])):
        parts = [p for key in order for p in (" ".join(TEXTS[key].split()[:3]), " ".join(TEXTS[key].split()[3:]))]
        chunks += [(session, i, p, -0.1, i == len(parts) - 1) for i, p in enumerate(parts)]
    schema = "session long, offset long, txt string, log_prob double, last boolean"
    key = lambda rows: sorted((r["session"], r["pos"], r["grp"], r["seq"], r["score"]) for r in rows)
    want = key(track(spark.createDataFrame(chunks, schema), spark.sparkContext.broadcast(corpus)).collect())
    assert [(r[0], r[2], r[3]) for r in want] == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (2, 2, 1), (2, 2, 2)]
    source = str(tmp_path / "in")
    for lo, hi in ((0, 2), (2, 5), (5, 99)):
        spark.createDataFrame([c for c in chunks if lo <= c[1] < hi], schema).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = track_stream(stream, corpus).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert key(spark.table("tracked").collect()) == want


def test_manifest_and_reports(spark, tmp_path):
    samples = [{"id": "a", "surah": 1, "ayah": 2, "category": "short"}, {"id": "b", "surah": 1, "ayah": 3, "expected_verses": [{"surah": 1, "ayah": 3}, {"surah": 1, "ayah": 4}]}]
    (tmp_path / "m.json").write_text(json.dumps({"samples": samples}, indent=1))
    got = {r["id"]: [tuple(x) for x in r["expected_verses"]] for r in io.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a": [(1, 2)], "b": [(1, 3), (1, 4)]}
    (tmp_path / "r").mkdir()
    (tmp_path / "r/1.json").write_text(json.dumps({"id": "x", "timestamp": "2024-01-01", "events": [{"a": 1}]}))
    (tmp_path / "r/2.json").write_text(json.dumps({"id": "y", "timestamp": "2024-02-01"}))
    (tmp_path / "r/3.json").write_text("{ broken")
    assert [(r["id"], r["n_events"]) for r in io.read_reports(spark, str(tmp_path / "r")).collect()] == [("y", 0), ("x", 1)]


def test_hash_gate_lookup_and_lines(spark, tmp_path):
    import hashlib

    (tmp_path / "f").mkdir()
    (tmp_path / "f/model.bin").write_bytes(b"abc")
    io.check_hashes(spark, str(tmp_path / "f"), {"model.bin": hashlib.sha256(b"abc").hexdigest()})
    with pytest.raises(ValueError, match="model.bin"):
        io.check_hashes(spark, str(tmp_path / "f"), {"model.bin": "0"})
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "surah int, ayah int, text string")
    assert [r["ayah"] for r in io.group_rows(rows, 1).collect()] == [1, 2]
    with pytest.raises(LookupError):
        io.group_rows(rows, 9)
    io.write_lines(rows, "text", str(tmp_path / "lines"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a", "b"]


def test_resume_redoes_nothing(spark, tmp_path):
    rows, seen = spark.range(20).withColumnRenamed("id", "k"), []

    def work(todo):
        seen.append(todo.count())
        return todo.withColumn("v", F.col("k") * 2)

    path = str(tmp_path / "done")
    io.resume(rows.where("k < 12"), path, "k", work, F.floor(F.col("k") / 5))
    assert io.resume(rows, path, "k", work, F.floor(F.col("k") / 5)).count() == 20 and seen == [12, 8]


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\x00\x40\x00\xc0")
    assert io.read_audio(spark, str(tmp_path), io.wav_samples).first()["samples"] == [0.5, -0.5]


def test_peel_sessions_reads_as_far_as_the_longest_row(spark, frame):
    words = [f"word{i}" for i in range(70)]
    heard = [f"{w}x" for w in words[:60]] + words[60:]
    rows = Corpus([Row(1, 1, " ".join(words)), Row(2, 1, "word5x qqqq")])
    got = peel_sessions(frame([(1, " ".join(heard))], "session long, txt string"), spark.sparkContext.broadcast(rows)).collect()
    assert [(r["grp"], r["seq"]) for r in got] == [(1, 1)]
