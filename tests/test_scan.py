"""Scans of a whole corpus: packed distances against the plain ones, and best rows against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom.functions import alignment as al
from seqloom.functions import packed
from seqloom.functions.packed import Packed
from seqloom.operators import joins, retrieval, scan
from seqloom.plans.catalog import QUERIES


def some_text(r, longest, letters="ab cé"):
    return "".join(r.choice(letters) for _ in range(r.choice([0, 1, 7, 8, 9, longest])))


@pytest.mark.parametrize("seed", range(20))
def test_packed_distances(seed):
    r = random.Random(seed)
    patterns, text = [some_text(r, 70) for _ in range(r.randint(1, 9))], some_text(r, 90)
    p, stops = Packed(patterns), sorted({0, len(text) // 2, len(text)})
    for at, column in zip(stops, p.edits(text, stops)):
        assert p.kept(column, False).tolist() == [len(q) + at - al.edit_distance(q, text[:at]) for q in patterns]
    for at, column in zip(stops, p.common(text, stops)):
        assert p.kept(column, True).tolist() == [2 * al.lcs_length(q, text[:at]) for q in patterns]
    assert p.anywhere(text).tolist() == [al.semi_global_distance(q, text) for q in patterns]


def no_pairs(df):
    """The plan does not join each query with each row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_rows_equal_all_pairs(spark, frame, sf_dir):
    r = random.Random(3)
    rows = [(g, s, some_text(r, 40)) for g in range(9) for s in range(7)] + [(20 + i, 0, "ab ca") for i in range(8)] + [(40, 0, None)]
    asked = [(i, some_text(r, 30)) for i in range(20)] + [(50, "ab ca"), (51, None)]
    got = [tuple(x) for x in joins.best_lev(frame(asked, "qid long, txt string"), frame(rows, "grp long, seq int, txt string"), 3).collect()]
    want = []
    for qid, q in asked:
        score = lambda t: -1.0 if q is None or t is None else round(al.lev_ratio(q, t), 6)
        best = sorted((-score(t), g, s) for g, s, t in rows)[:3]
        want += [(qid, k + 1, g, s, None if x > 0 else -x) for k, (x, g, s) in enumerate(best)]
    assert sorted(got) == want
    assert no_pairs(QUERIES["search_topk"](spark, sf_dir))


def test_two_stage_scan_joins_no_pairs(spark, sf_dir):
    assert no_pairs(QUERIES["two_stage_gate"](spark, sf_dir))


def retrieved_both_ways(frame, monkeypatch, **options):
    """Rows of the scan, and of the join of all pairs that more queries than a block's go through."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["the", "a", "run", "stone", "é", "wind", "of", "rivers"]) for _ in range(n))
    rows = [(g, s, say(r.choice([1, 3, 8, 14]))) for g in range(7) for s in range(1, 6)] + [(20 + i, 1, "the wind of rivers run") for i in range(6)]
    rows += [(30, 1, None), (30, 2, ""), (31, 1, "  the \t wind  of"), (31, 2, " stone a")]
    asked = [(i, say(r.choice([1, 2, 5, 9]))) for i in range(14)] + [(50, "the wind of rivers run"), (51, None), (52, ""), (53, " wind  of rivers and stones "), (54, "ru")]
    out = []
    for most in (2_000, 0):
        monkeypatch.setattr(scan, "BLOCK_QUERIES", most)
        hint = frame([(2, 1)], "grp long, seq long")
        found = retrieval.retrieve(frame(asked, "qid long, txt string"), frame(rows, "grp long, seq int, txt string"), hint=hint, longest=3, **options)
        out.append(sorted(tuple(x) for x in found.collect()))
    return out


@pytest.mark.parametrize("limit, groups", [(4, 2), (1, 5)])
def test_rows_and_spans_equal_all_pairs(frame, monkeypatch, limit, groups):
    got, want = retrieved_both_ways(frame, monkeypatch, single_limit=limit, groups=groups, span_limit=6, fragments=False)
    assert got == want and len({x[0] for x in got}) == 19


def test_match_single_or_span_comes_from_the_scan(spark, sf_dir, monkeypatch):
    calls, scanned = [], scan.scan
    monkeypatch.setattr(scan, "scan", lambda *a, **b: calls.append(b) or scanned(*a, **b))
    rows = QUERIES["match_single_or_span"](spark, sf_dir).collect()
    assert len(calls) == 1 and calls[0]["start"] and len({r["qid"] for r in rows}) == len(rows)


def test_rows_and_spans_by_indel_ratio_equal_all_pairs(frame, monkeypatch):
    for limit, groups in ((4, 2), (1, 5)):
        got, want = retrieved_both_ways(frame, monkeypatch, single_limit=limit, groups=groups, span_limit=6, fragments=False, indel=True)
        assert got == want


def test_rows_and_spans_with_fragments_equal_all_pairs(frame, monkeypatch):
    for limit, groups in ((4, 2), (1, 5)):
        got, want = retrieved_both_ways(frame, monkeypatch, single_limit=limit, groups=groups, span_limit=6, fragments=True)
        assert got == want


def test_opening_boost_reads_a_text_once(frame):
    from pyspark.sql import functions as F
    from seqloom.functions import similarity

    texts = ["the wind of rivers", "", None, "a", "  ab  cd efghijklmnopqrstuvwxyz"]
    pairs = frame([(q, t) for q in ("the", "", "ab cd efghij", "abcdefghij", "x", None) for t in texts], "q string, t string")
    start, first = similarity.opening(F.col("t"))
    cut = pairs.select("q", "t", start.alias("start"), first.alias("first"))
    for q, t, got in cut.select("q", "t", similarity.opening_boost(F.col("q"), F.col("start"), F.col("first"))).collect():
        bare, own = (t or "").replace(" ", ""), (q or "").replace(" ", "")
        ends = [al.lev_ratio(own, bare[: len(own) + 6]), *[al.lev_ratio(own, w) for w in (t or "").split()[:1]]]
        assert got == pytest.approx(max(ends) if q is not None and bare and len(own) <= 10 else 0.0, abs=1e-12)


def test_voted_matches_equal_all_pairs(frame, monkeypatch):
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["the", "run", "stone", "é", "wind"]) for _ in range(n))
    rows = [(g, s, say(r.choice([2, 5, 9]))) for g in range(9) for s in range(1, 5)] + [(20, 1, None), (20, 2, "")]
    asked, out = [(i, say(r.choice([2, 6, 12]))) for i in range(12)] + [(50, ""), (51, None)], []
    calls, scanned = [], scan.scan
    monkeypatch.setattr(scan, "scan", lambda *a, **b: calls.append(b) or scanned(*a, **b))
    for most in (2_000, 0):
        monkeypatch.setattr(scan, "BLOCK_QUERIES", most)
        out.append(sorted(map(tuple, retrieval.match_voted(frame(asked, "qid long, txt string"), frame(rows, "grp long, seq long, txt string"), gram=2).collect())))
    assert out[0] == out[1] and len(out[0]) == 12 and len(calls) == 1


def test_unit_vectors_equal_sql_to_the_sign(frame, spark, tmp_path):
    import duckdb
    from seqloom.plans.catalog import ORACLES

    inf, nan = float("inf"), float("nan")
    rows = [[-1e-9, 1.0], [1e-9, -1.0], [0.0, 0.0], [3.0, None, 4.0], None, [], [nan, 1.0], [inf, 1.0], [None, None], [-0.3, 0.4, 0.2]]
    frame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: repr(u) for i, u in con.sql(ORACLES["l2_normalize"]).fetchall()}
    assert {r["vec_id"]: repr(r["unit"] if r["unit"] is None else list(r["unit"])) for r in QUERIES["l2_normalize"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("seed", range(8))
def test_packed_side_by_side(seed):
    r = random.Random(seed)
    patterns, text = [some_text(r, 70) for _ in range(r.randint(1, 9))], some_text(r, 90)
    p, stops = Packed.joined([Packed([q]) for q in patterns]), [0, len(text) // 2, len(text)]
    for at, column in zip(stops, p.edits(text, stops)):
        assert p.kept(column, False).tolist() == [len(q) + at - al.edit_distance(q, text[:at]) for q in patterns]
    for at, row in zip(stops, p.anywhere_by(text, stops)):
        assert row.tolist() == [al.semi_global_distance(q, text[:at]) for q in patterns]


@pytest.mark.parametrize("most, least", [(6, 2), (3, 30)])
def test_overlaps_equal_joins(frame, monkeypatch, most, least):
    r = random.Random(9)
    rows = [(g, s, some_text(r, 40)) for g in range(9) for s in range(7)] + [(20 + i, 0, "ab ca") for i in range(8)] + [(40, 0, None), (41, 0, "")]
    asked, out = [(i, some_text(r, 30)) for i in range(12)] + [(50, "ab ca"), (51, None), (52, "")], []
    monkeypatch.setattr(scan, "SLAB", 5)
    for cells in (8_000_000, 0):
        monkeypatch.setattr(scan, "GRAM_CELLS", cells)
        found = retrieval.overlap_shortlist(frame(asked, "qid long, txt string"), frame(rows, "grp long, seq int, txt string"), most, least)
        out.append(sorted(map(tuple, found.collect())))
    assert out[0] == out[1] and {x[0] for x in out[0]} == {q for q, _ in asked}


def test_joint_match_equals_all_pairs(frame, monkeypatch):
    r = random.Random(11)
    words = ["the", "run", "stone", "é", "wind", "rivers", "of", "mountain", "bright", "under"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(g, s, say(r.choice([4, 9, 16]))) for g in range(12) for s in range(1, 6)] + [(20, 1, None), (20, 2, ""), (20, 3, say(6)), (21, 1, say(3))]
    texts = {(g, s): t for g, s, t in rows}
    bent = lambda t: " ".join(w if r.random() < 0.7 else r.choice(words) for w in t.split())
    asked = [(i, say(r.choice([1, 5, 12, 30]))) for i in range(10)] + [(20 + g, bent(f"{texts[g, 1]} {texts[g, 2]}")) for g in range(8)]
    asked += [(30 + g, bent(f"{texts[g, 2]} {texts[g, 3]}")) for g in range(8)] + [(40 + g, bent(f"{texts[g, 1]} {texts[g, 2]}"[5:])) for g in range(8)] + [(50, ""), (51, None), (52, "the wind")]
    out, calls, nested = [], [], scan.nested
    monkeypatch.setattr(scan, "nested", lambda *a, **b: calls.append(1) or nested(*a, **b))
    for most in (2_000, 0):
        monkeypatch.setattr(scan, "BLOCK_QUERIES", most)
        found = retrieval.joint_match(frame(asked, "qid long, txt string"), frame(rows, "grp long, seq long, txt string"), groups=4, longest=4, shortlist=20)
        out.append(sorted(map(tuple, found.collect())))
    assert out[0] == out[1] and len(calls) == 1 and len({x[1] for x in out[0]}) >= 2


def test_first_words_are_counted_once_a_text(frame, monkeypatch):
    """However many words the queries have: fields are taken at their stops, and counted together."""
    r, calls, counts = random.Random(4), [], Packed.counts
    monkeypatch.setattr(Packed, "counts", lambda self, bits: calls.append(1) or counts(self, bits))
    asked = [(i, " ".join(r.choice(["the", "run", "stone", "é"]) for _ in range(i + 1))) for i in range(30)]
    run = []
    monkeypatch.setattr(scan, "spread", lambda df: type("Rows", (), {"mapInArrow": lambda self, f, schema: run.append(f)})())
    scan.scan(asked, "long", frame([(1, 1, "")], "grp long, seq long, txt string"), 3, start=True)
    import pyarrow as pa

    text = " ".join(["the", "stone", "wind"] * 6)
    out = [b.to_pylist() for b in run[0](iter([pa.RecordBatch.from_pylist([{"grp": 1, "seq": 1, "txt": text}])]))][0]
    assert len(calls) <= 4
    for row in out:
        q = asked[row["qid"]][1].split()
        n = min(len(q), 18)
        want = max(al.lev_ratio(" ".join(q), text), al.lev_ratio(" ".join(q[:n]), " ".join(text.split()[:n])))
        if len("".join(q)) > 10:
            assert row["raw"] == pytest.approx(want, abs=1e-12)
    assert len(out) == 30


@pytest.mark.parametrize("seed", range(12))
def test_lanes_equal_plain_distances(seed, monkeypatch):
    r = random.Random(seed)
    some = lambda longest: "".join(r.choice("ab cé😀") for _ in range(r.choice([0, 1, 63, 64, 65, longest])))
    monkeypatch.setattr(packed, "LANES", r.choice([1, 4, 8_192]))
    monkeypatch.setattr(packed, "STEPS", r.choice([1, 300, 2_000_000]))
    patterns, texts = [some(150) for _ in range(9)], [some(90) + r.choice(["", "ж"]) for _ in range(7)]
    asks = np.array([[r.random() < 0.7 for _ in patterns] for _ in texts])
    want = np.array([[al.semi_global_distance(q, t) for q in patterns] for t in texts])
    assert (packed.Lanes(patterns).anywhere(texts, asks) == want)[asks].all()
    assert (packed.Lanes(patterns).anywhere(texts, asks | True) == want).all()


def scanned(frame, monkeypatch, asked, rows, *options, **more):
    """What one task returns for rows that come in this order."""
    run = []
    monkeypatch.setattr(scan, "spread", lambda df: type("Rows", (), {"mapInArrow": lambda self, f, schema: run.append(f)})())
    scan.scan(asked, "long", frame([(1, 1, "")], "grp long, seq long, txt string"), *options, **more)
    return [x for b in run[0](iter([pa.RecordBatch.from_pylist([dict(zip(("grp", "seq", "txt"), x)) for x in rows])])) for x in b.to_pylist()]


@pytest.mark.parametrize("cells, held", [(16_000_000, 1_024), (16_000_000, 2), (0, 2)])
def test_ratio_under_the_floor_counts_beside_the_fragment_score(frame, monkeypatch, cells, held):
    """The third row's ratio cannot reach the score of the first two; raised toward its fragment score it is the best."""
    monkeypatch.setattr(scan, "LANE_CELLS", cells)
    monkeypatch.setattr(scan, "HELD", held)
    query = "the wind of rivers runs under stone"
    rows = [(1, 1, query[:18] + "zzzzzzzzzzzzzzz"), (1, 2, query[:18] + "yyyyyyyyyyyyyyy"), (2, 1, "q q q q q q q " + query + " kkk jjj xxx qqq kkk jjj xxx qqq"), (3, 1, None), (4, 1, "zz")]
    found = {(x["grp"], x["seq"]): x for x in scanned(frame, monkeypatch, [(7, query)], rows, 2, 1, start=True, fragment=0.7)}
    text = rows[2][2]
    first = " ".join(text.split()[: len(query.split())])
    assert al.lev_ratio(query, text) > al.lev_ratio(query, first)
    assert found[2, 1]["raw"] == pytest.approx(al.lev_ratio(query, text), abs=1e-12) and found[2, 1]["frag"] == 1


def test_scans_leave_no_core_idle(frame, spark):
    """One partition more than cores would take two rounds."""
    cores = spark.sparkContext.defaultParallelism
    rows = frame([(i, 1, "the wind") for i in range(40)], "grp long, seq int, txt string")
    for parts, want in ((cores + 1, cores), (2 * cores, 2 * cores), (1, cores)):
        found = scan.scan([(1, "the wind")], "long", rows.repartition(parts), 2, indel=True)
        assert found.rdd.getNumPartitions() == want
