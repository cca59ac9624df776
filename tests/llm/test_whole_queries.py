"""Whole queries and the pipeline against plain versions in Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_fingerprint, components_of
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import packing, pii, quality, queries
from seqloom.llm.common import stored, without_rows

MARKS = {c for c in map(chr, range(33, 127)) if not c.isalnum()}


def plain_features(text):
    if not text:
        return [0.0] * 13
    raw = text.encode("utf-8", "replace")
    share = lambda test: sum(1 for b in raw if test(b)) / len(raw)
    words, lines = text.lower().split(), text.split("\n")
    k, distinct = max(1, len(words)), set(words)
    return [
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: chr(b) in MARKS), share(lambda b: b > 127), share(lambda b: b in b"\t\n\v\f\r "),
        len(distinct) / k**0.8, sum(words[i] == words[i - 1] for i in range(1, len(words))) / k, 1 - len(set(lines)) / len(lines), min(len(raw) / k, 30) / 10,
        sum(len(w) > 20 for w in distinct) / k, sum(not w[0].isalnum() and set(w) <= MARKS for w in words) / k, sum(len(w) > 1 and set(w[-2:]) <= MARKS for w in words) / k, math.log(1 + k) / 10,
    ]


def plain_logit(text, model):
    told = [model.words[b] for b in quality.word_buckets(text or "") if b in model.words] if model.words else []
    x = [*plain_features(text or ""), max([0.0, *told]) if not told else max(told)]
    z = [min(max((v - m) / s, -8), 8) for v, m, s in zip(x, model.mean, model.spread)]
    total = sum(w * v for w, v in zip(model.weights, [1.0, *z, *[v * v for v in z[:-1]]], strict=True))
    return min(max(total, -30), 30)


def plain_quality(rows, model):
    """p_good of (text, host, path) rows: evidence, and posteriors of paths shrunk to hosts and of hosts to all."""
    logit = [plain_logit(t, model) for t, _, _ in rows]
    p = [1 / (1 + math.exp(-x)) for x in logit]
    hosts, paths = {}, {}
    for q, (_, host, path) in zip(p, rows):
        hosts.setdefault(host, []).append(q)
        paths.setdefault((host, path), []).append(q)
    mean = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
    unit = mean * (1 - mean)

    def strength(groups, centre):
        spread = sum(len(g) * (sum(g) / len(g) - centre(k)) ** 2 - unit for k, g in groups.items()) / sum(map(len, groups.values()))
        return max(unit / max(spread, unit / 1000) - 1, 1.0)

    a = strength(hosts, lambda k: mean)
    host_mean = {h: (sum(g) + a * mean) / (len(g) + a) for h, g in hosts.items()}
    b = strength(paths, lambda k: host_mean[k[0]])
    odds = lambda x: math.log(x / (1 - x))
    shift = {k: odds(min(max((sum(g) + b * host_mean[k[0]]) / (len(g) + b), 1e-4), 1 - 1e-4)) - odds(mean) for k, g in paths.items()}
    return [1 / (1 + math.exp(-(x + shift[host, path]))) for x, (_, host, path) in zip(logit, rows)]


def plain_attempts(texts, key=pii.KEY):
    """Draws of names until no surrogate, whole or family name alone, stands for two."""
    names = {c for t in texts for _, _, kind, c in pii.find(t or "") if kind == "name"}
    attempts = dict.fromkeys(names, 0)
    while True:
        users = {}
        for c in names:
            new = pii.name_surrogate(c, attempts[c], key)
            for form in {new, new.rpartition(" ")[2]}:
                users.setdefault(form, set()).add(c)
        losers = {c for own in users.values() for c in own if c != min(own)}
        if not losers:
            return attempts
        for c in losers:
            attempts[c] += 1


def plain_replace(text, attempts):
    for a, b, kind, canon in reversed(pii.find(text or "")):
        text = text[:a] + pii.surrogate(kind, canon, text[a:b], pii.KEY, attempts.get(canon, 0) if kind == "name" else 0) + text[b:]
    return text


def test_quality_equals_the_plain_version(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    want = plain_quality([tuple(r)[1:] for r in rows], model)
    got = {r["doc_id"]: (r["p_good"], r["keep"]) for r in queries.op8_quality_bayes(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, p in zip(rows, want):
        assert got[r["doc_id"]][0] == pytest.approx(p, abs=1e-9) and got[r["doc_id"]][1] == (p >= quality.REJECT_BELOW)


def test_surrogates_equal_the_plain_version(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    attempts = plain_attempts([t for _, t in docs])
    kinds = lambda t: [k for _, _, k, _ in pii.find(t or "")]
    want = {(i, plain_replace(t, attempts), len(kinds(t)), ",".join(sorted(set(kinds(t))))) for i, t in docs}
    assert {(r["doc_id"], r["text"], r["n_entities"], r["kinds"]) for r in queries.op6_pii_surrogates(spark, sf_dir).collect()} == want


def test_many_names_stay_apart(spark):
    names = spark.range(200_000).selectExpr("'name' AS kind", "concat(if(id % 2 = 0, 'm|', 'f|'), if(id % 5 = 0, 'Ann ', ''), 'N', lower(conv(id, 10, 36)), 'x') AS canon")
    names = names.selectExpr("kind", "canon", "split(canon, '[|]')[1] AS text")
    attempts = pii.collision_check(names, b"k", most=1_000_000)
    forms = {}
    for r in names.collect():
        new = pii.name_surrogate(r["canon"], attempts.get(r["canon"], 0), b"k")
        for form in {new, new.rpartition(" ")[2]}:
            assert forms.setdefault(form, r["canon"]) == r["canon"]


def test_mentions_of_a_person_share_a_surrogate():
    text = "Mr John Smith met Mrs. Ann Lee. Mr Smith left. John Smith, said Mr. John Smith, knew Ann Lee, Mrs Lee and Ann Leeds."
    new = pii.replace(text)[0]
    full, family = pii.name_surrogate("m|John Smith", 0, pii.KEY), pii.name_surrogate("m|John Smith", 0, pii.KEY).split(" ")[1]
    assert new.count(full) == 3 and new.count(f"Mr {family} ") == 1 and "Smith" not in new and "Ann Leeds" in new and new.count("Ann Lee") == 1
    two = "Mr John Smith and Mr Paul Smith met. Mr Smith spoke."  # which one is not known: a person of his own
    assert [c for _, _, _, c in pii.find(two)] == ["m|John Smith", "m|Paul Smith", "m|Smith"]
    assert pii.find("John Smith left, Smith too.") == []


@pytest.fixture(scope="module")
def plain_pipeline(spark):
    from conftest import SF

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    good = plain_quality([r[1:] for r in rows], quality.fit(docs, labels))
    kept = [r for r, p in zip(rows, good) if p >= quality.REJECT_BELOW]
    least = components_of([brute_fingerprint(t) for _, t, _, _ in kept], [i for i, *_ in kept])
    kept = [r for r, c in zip(kept, least) if r[0] == c]
    attempts = plain_attempts([t for _, t, _, _ in kept])
    return [(i, plain_replace(t, attempts)) for i, t, _, _ in kept]


def test_pipeline_equals_the_plain_version(spark, sf_dir, plain_pipeline):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc, text in plain_pipeline:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            own = np.array(ids[at : at + packing.CAPACITY], "<u4")
            want[doc, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        ends = [0, *[a + n for a, n in sorted(places)]]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    assert len(by) == packing.lower_bound(Counter(r["length"] for r in rows), packing.CAPACITY)


ODD = "doc_id long, text string, lang string, source string, n_chars long, rid long, _rid long, fp long, keep string, entities string, logit double, length int, part int, h string"
LONG = "some quite ordinary words of a long text " * 5_000


def odd_rows():
    rows = [(1, "the same text of five words", "en", "web", 27), (1, "the same text of five words", "en", "web", 27), (2, "the same text of five words", None, None, None), (3, None, "en", "web", None), (4, "", "en", None, 0), (5, LONG, "en", "web", len(LONG)), (None, "no id but a@b.org", None, "web", 3)]
    return [(*r, 7, 8, 9, "x", "y", 0.5, 3, 1, "z") for r in rows]


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_on_odd_tables(spark, frame, sf_dir, rows):
    docs = frame(rows, ODD)
    good = corpus_pipeline.good_documents(spark, docs, sf_dir)
    one = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    new = corpus_pipeline.surrogates(spark, docs, sf_dir)
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    for found in (good, one, new):
        assert found.columns == docs.columns
    key = lambda found: sorted((tuple(r) for r in found.collect()), key=str)
    assert set(key(good)) <= set(rows)
    assert key(one) == sorted([r for i, r in enumerate(rows) if i in (0, 3, 5, 6)], key=str)  # null and empty texts are alike
    assert key(new) == sorted([(r[0], pii.replace(r[1])[0], *r[2:4], len(pii.replace(r[1])[0]) if r[1] is not None else None, *r[5:]) for r in rows], key=str)
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(r[0] for r in rows)


def test_rows_keep_their_places(spark, tmp_path):
    docs = spark.range(1000).withColumn("_rid", F.col("id") * 2)
    docs.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert stored(table) is table and stored(table.where("id > 3").select("id")).count() == 996
    shuffled = table.repartition(7).orderBy("id")
    assert stored(shuffled) is not shuffled and stored(docs) is not docs
    drop = table.withColumn("rid", F.monotonically_increasing_id()).where("id % 10 = 0")
    left = without_rows(table, drop)
    assert left.columns == ["id", "_rid"] and left.count() == 900 and left.where("id % 10 = 0").isEmpty()
