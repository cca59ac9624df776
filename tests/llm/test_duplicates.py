"""SimHash near-duplicates, embedding near-duplicates, nearest neighbours and components, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import collide, common, simhash, vptree
from seqloom.llm.components import components

DOCS = "doc_id long, text string, fp string, rid string"
VECTORS = "vec_id long, embedding array<float>, links int, rid int"


def least_labels(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(a, rng.randrange(max(0, a - 4), a + 1)) for a in range(200)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(500, 500 + i) for i in range(1, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = least_labels(900, edges)
    assert got == {i: label[i] for i in range(900) if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(2)
    for n in range(50):
        text = rng.choice(["", " "]) + "".join(rng.choice(["A", "Éa", "bc", "x\x1cy", "Z\xa0z"]) + rng.choice([" ", "\t", "\n\x0b"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def components_of(fps, ids, max_bits=3):
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= max_bits]
    label = least_labels(len(fps), links)
    least = {}
    for i, l in enumerate(label):
        least[l] = min([x for x in (least.get(l), ids[i]) if x is not None], default=None)
    return [least[l] for l in label]


def near_copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(300)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(300)] = word()
        rows.append((1000 - i, " ".join(own), None, None))
    rows += [(i, " ".join(word() for _ in range(30)), None, None) for i in range(40)] + [(None, rows[0][1], None, None), ((1 << 62) + 1, "alone", None, None), (2007, None, None, None), (2008, "", None, None), (2009, " ", None, None), (2009, " ", None, None)]
    return rows


@pytest.mark.parametrize(("cell_rows", "blocks"), [(3, None), (8192, None), (8192, 4), (5, 5), (8192, 6), (8192, 7)])
def test_links_survive_split_cells(spark, cell_rows, blocks):
    fps = [simhash.fingerprint(t) for _, t, _, _ in near_copies()]
    distinct = sorted({simhash._signed(f) for f in fps})
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in distinct], "fp long"), cell_rows=cell_rows, blocks=blocks).collect()
    at = {f: i for i, f in enumerate(distinct)}
    unsigned = [f % (1 << 64) for f in distinct]
    assert least_labels(len(distinct), [(at[e["a"]], at[e["b"]]) for e in edges]) == components_of(unsigned, list(range(len(distinct))))


def test_blocks_grow_with_the_table():
    assert [simhash.blocks_for(n, 3) for n in (0, 4_000_000, 5_000_000, 10**9, 10**10, 10**11)] == [4, 4, 5, 5, 6, 6]


def test_hot_fingerprints_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaabbc")], "k string, i int")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(tuple(r) for r in common.join_to_classes(rows, classes, "k").collect()) == sorted((k, i, {"a": 4, "b": 2, "c": 1}[k]) for i, k in enumerate("aaaabbc"))


def test_near_duplicates_and_survivors(frame, tmp_path, spark):
    rows = near_copies()
    frame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    stored = [tuple(r) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t, _, _ in stored]
    want = components_of(fps, [r[0] for r in stored])
    got = simhash.near_duplicates(docs).collect()
    key = lambda x: tuple(str(y) for y in x)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=key) == sorted([(r[0], f"{f:016x}", w) for r, f, w in zip(stored, fps, want)], key=key)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want)) and kept[0].asDict().keys() == {"doc_id", "text", "fp", "rid"}


def test_no_documents(frame, spark, tmp_path):
    assert simhash.near_duplicates(frame([], DOCS)).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [b + s * rng.standard_normal(16) for b in base for s in (0.0, 0.02, 0.05, 0.09, 0.12)] + list(rng.standard_normal((40, 16))) + [base[0]] * 3 + [2 * base[1]]
    out = [(int(i * 7 % 113), [float(x) for x in v], 0, 0) for i, v in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    return out + [(200, None, 0, 0), (201, [], 0, 0), (202, [0.0] * 16, 0, 0), (203, [nan] + [1.0] * 15, 0, 0), (204, [inf] + [1.0] * 15, 0, 0), (205, [None] + [1.0] * 15, 0, 0), (206, [1.0, 2.0], 0, 0), (206, [2.0, 4.0], 0, 0), (None, out[0][1], 0, 0), ((1 << 62) + 1, [0.5] * 16, 0, 0)]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosines(rows):
    with np.errstate(all="ignore"):
        out = np.full((len(rows), len(rows)), -9.0)
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if i != j and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]):
                    x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                    out[i, j] = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))
    return out


@pytest.mark.parametrize("cell_rows", [4, 2048])
def test_embedding_links(frame, cell_rows):
    rows = vectors()
    near = cosines(rows) >= 0.95
    label = least_labels(len(rows), list(zip(*np.nonzero(near))))
    least = {}
    for i, l in enumerate(label):
        least[l] = min([x for x in (least.get(l), rows[i][0]) if x is not None], default=None)
    want = sorted([(r[0], int(n), least[l], r[0] is not None and r[0] == least[l]) for r, n, l in zip(rows, near.sum(1), label)], key=str)
    got = collide.near_duplicates(frame(rows, VECTORS), cell_rows=cell_rows).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got], key=str) == want


def test_calibration_and_recall_at_the_limit():
    plan = collide.Plan(64, 100_000)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    (ca, pa), (cb, pb) = plan.project(a), plan.project(b)
    assert (ca == cb).all(2).any(1).mean() > 0.999
    assert (np.abs(pa.astype(int) - pb) <= plan.wide).all(1).mean() > 0.99 and (np.abs(pa.astype(int) - pb)[:, 0] <= plan.wide).mean() > 0.999
    assert ((np.abs(pa.astype(int) - pb) <= plan.window).sum(1) >= plan.count).mean() > 0.999


def test_no_vectors(frame):
    assert collide.near_duplicates(frame([], VECTORS)).count() == 0
    assert vptree.search(frame([], VECTORS), F.lit(True)).count() == 0
    only = collide.near_duplicates(frame([(1, None, 0, 0), (1, [0.0], 0, 0)], VECTORS)).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in only] == [(0, 1, True)] * 2


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(4096, 1024), (70, 9)])
def test_exact_at_factor_one(frame, shard_rows, block_rows):
    rows = vectors()
    got = vptree.search(frame(rows, VECTORS), F.col("vec_id") % 3 == 0, k=5, shard_rows=shard_rows, block_rows=block_rows).collect()
    near, want = cosines(rows), []
    for i, r in enumerate(rows):
        if r[0] is not None and r[0] % 3 == 0 and usable(r[1]):
            found = [j for j in range(len(rows)) if near[i, j] > -9 and rows[j][0] is not None]
            found.sort(key=lambda j: (-round(near[i, j], 12), rows[j][0]))
            want += [(r[0], k, rows[j][0], round(near[i, j], 9)) for k, j in enumerate(found[:5], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)


def test_larger_factors_keep_most(frame):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v], 0, 0) for i, v in enumerate(rng.standard_normal((1500, 8)))]
    df = frame(rows, VECTORS)
    exact = {(r["query_id"], r["vec_id"]) for r in vptree.search(df, F.col("vec_id") % 50 == 0).collect()}
    loose = {(r["query_id"], r["vec_id"]) for r in vptree.search(df, F.col("vec_id") % 50 == 0, factor=1.5).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)
