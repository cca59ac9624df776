"""Best-fit packing."""

import itertools
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import packing

DOCS = "doc_id long, text string, length int, piece string"


def total(runs):
    return sum(n for _, n in runs)


def packed(runs):
    out = Counter()
    for filling, n in runs:
        for s in filling:
            out[s] += n
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_every_piece_is_packed_once(sizes):
    counts = Counter(sizes)
    for runs in (packing.best_fit(counts, 40), packing.bin_completion(counts, 40, nodes=500)):
        assert packed(runs) == counts and all(sum(f) <= 40 for f, _ in runs)
    assert packing.lower_bound(counts, 40) <= total(packing.bin_completion(counts, 40, nodes=500)) <= total(packing.best_fit(counts, 40))


def fewest(sizes, capacity):
    for n in itertools.count(len(sizes) and 1):
        rooms = [capacity] * n

        def place(i):
            if i == len(sizes):
                return True
            for j in {r: j for j, r in enumerate(rooms)}.values():
                if rooms[j] >= sizes[i]:
                    rooms[j] -= sizes[i]
                    if place(i + 1):
                        return True
                    rooms[j] += sizes[i]
            return False

        if place(0):
            return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fewest_sequences_on_small_inputs(sizes):
    sizes = sorted(sizes, reverse=True)
    assert total(packing.bin_completion(Counter(sizes), 20)) == fewest(sizes, 20)


def test_beats_best_fit_where_it_can():
    sizes = [5, 4, 3, 3, 3, 2]
    assert total(packing.best_fit(Counter(sizes), 10)) == 3
    assert total(packing.bin_completion(Counter(sizes), 10)) == 2


def test_ids_are_the_tokenizers():
    encoder = packing.CachedEncoder(packing.default_tokenizer(), cache_bytes=20_000)
    texts = ["", "Hello, World's   end\n", "ÀÉß don't!! 12²½", "日本語 Ως İ a\x85b\xa0c\x1cd", "<|endoftext|> x", "a" * 5000, "é é ﬁ", "x " * 300]
    for t, e in zip(texts * 2, encoder.tokenizer.encode_batch(texts * 2, add_special_tokens=False), strict=True):
        assert encoder.encode([t])[0].tolist() == e.ids


def check(rows, docs, capacity):
    encoder = packing.CachedEncoder(packing.default_tokenizer())
    want = Counter()
    for doc, text, *_ in docs:
        ids = np.append(encoder.encode([text or ""])[0], np.uint32(1)).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[doc, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_cut_and_laid_out(frame):
    docs = [(1, "the quick brown fox " * 40, 0, ""), (2, None, 0, ""), (2, "", 0, ""), (None, "fox", 0, ""), ((1 << 62) + 1, "fox", 0, ""), (3, "jumps " * 25, 0, ""), (3, "jumps " * 25, 0, ""), (4, "über " * 7, 0, None)]
    rows = packing.pack(frame(docs, DOCS).repartition(3), capacity=16).collect()
    n = check(rows, docs, 16)
    assert n <= -(-sum(r["length"] for r in rows) // 16) + 1


def test_no_documents(frame):
    assert packing.pack(frame([], DOCS)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs).collect()
    n = check(rows, [tuple(r) for r in docs.collect()], packing.CAPACITY)
    assert n == packing.lower_bound(Counter(r["length"] for r in rows), packing.CAPACITY)
