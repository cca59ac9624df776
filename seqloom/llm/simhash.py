"""SimHash near-duplicates: pivot distance tables.

Fingerprints of three-word shingles are linked when they differ in at most three bits. For every
distinct fingerprint the Hamming distances to reference fingerprints (pivots) are computed once.
The triangle inequality |d(x, p) - d(y, p)| <= d(x, y) then discards every pair whose table rows differ
by more than the limit in any coordinate; survivors are verified on the fingerprints.

Pairs meet in cells: cut into b blocks, two fingerprints at distance 3 or less agree in at least b - 3 blocks whole, so no
link is lost among the cells of all choices of b - 3 blocks. More blocks give longer keys and more copies: four blocks 16 bits
and 4 copies, five 25 and 10, six 32 and 20. The fewest blocks are taken that leave a cell CELL_ROWS random fingerprints
or fewer, so cells do not grow with the table, and pairs grow as rows do. Within a cell rows are sorted by their first
pivot distance, so that the inequality bounds the window each row looks at. A cell emits a spanning forest of
its links, not the links: a group of n near copies costs n rows. Cells with more rows than `cell_rows` are
dealt out by pairs of chunks, so no task holds more than two chunks of one cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checked_broadcast, join_to_classes, open_id, small_batches, solid_id, stage, stored, without_rows
from seqloom.llm.components import components

PIVOTS, CELL_ROWS = 16, 64


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles of a text; unsigned. No words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and \x20 \x09-\x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        return xxhash.xxh64_intdigest(joined, 42)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[:-1] + 1).tolist()]
    ends = [*gaps[2 - 1 + 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends)]), np.uint8)
    n = len(ends)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[at * 8 : (at + 4096) * 8].reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints, made by rule: hashes of their numbers."""
    return [_signed(xxhash.xxh64_intdigest(str(i).encode(), 7)) for i in range(count)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (row number of this scan), doc_id, fp (long with the fingerprint's bits) for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rid": b["rid"], "doc_id": b["doc_id"], "fp": pd.Series([_signed(fingerprint(t)) for t in b["text"]], dtype="int64")})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), solid_id(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "rid long, doc_id long, fp long").withColumn("doc_id", open_id(F.col("doc_id")))


def with_pivot_table(fps: DataFrame, count: int = PIVOTS) -> DataFrame:
    """Add the row of the distance table: count distances, eight to a long (t0, t1, ...)."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivots(count)]
    packed = []
    for at in range(0, count, 8):
        word = far[at]
        for j, d in enumerate(far[at + 1 : at + 8], 1):
            word = word.bitwiseOR(F.shiftleft(d, 8 * j))
        packed.append(word.alias(f"t{at // 8}"))
    return fps.select("fp", far[0].cast("int").alias("d0"), *packed)


def deal_cells(rows: DataFrame, key: str, row_id: str, cell_rows: int) -> DataFrame:
    """Give each row its cells (lo, hi, chunk). A key with more than cell_rows rows is cut into chunks;
    each pair of chunks is a cell of its own, so every pair of the key's rows meets in one cell."""
    hot = stage(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select(key, F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks")), "hot")
    dealt = rows.join(checked_broadcast(hot), key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(row_id), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "chunks")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group of keys is cut."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = np.ones(len(b), bool)
        for k in keys:
            last &= (b[k] == b[k].iloc[-1]).to_numpy()
        cut = int(np.argmax(last))
        if cut or (held and any(held[-1][k].iloc[-1] != b[k].iloc[0] for k in keys)):
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True) if held else b.iloc[:cut].reset_index(drop=True)
            held = [b.iloc[cut:]]
        else:
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def join_pairs(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union the pairs into a forest of parents whose roots are flat."""
    apart = parent[left] != parent[right]
    left, right = left[apart], right[apart]
    while len(left):
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        parent = roots(parent)
        apart = parent[left] != parent[right]
        left, right = left[apart], right[apart]
    return parent


def cell_links(rows: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Spanning forest of the links inside each cell of rows, which are sorted by cell and first pivot distance."""
    fp = rows["fp"].to_numpy().view(np.uint64)
    table = np.column_stack([rows[c].to_numpy().astype(np.int64) for c in rows.columns if c[0] == "t"]).view(np.uint8).astype(np.int16)
    d0, chunk = rows["d0"].to_numpy(), rows["chunk"].to_numpy()
    split = (rows["lo"] != rows["hi"]).to_numpy()
    cell = np.cumsum(np.concatenate([[True], (rows[["band", "lo", "hi"]].to_numpy()[1:] != rows[["band", "lo", "hi"]].to_numpy()[:-1]).any(1)]))
    parent = np.arange(len(fp))
    left, step = np.arange(len(fp)), 1
    while True:
        left = left[left + step < len(fp)]
        right = left + step
        left = left[(cell[left] == cell[right]) & (d0[right] - d0[left] <= max_bits)]  # sorted: once out, out for larger steps
        if not len(left):
            break
        right = left + step
        seen = ~split[left] | (chunk[left] != chunk[right])
        a, b = left[seen], right[seen]
        near = np.abs(table[a] - table[b]).max(axis=1) <= max_bits  # the pivots' inequality
        a, b = a[near], b[near]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits  # verification
        parent = join_pairs(parent, a[close], b[close])
        step += 1
    linked = parent != np.arange(len(fp))
    return pd.DataFrame({"a": fp[linked].view(np.int64), "b": fp[parent[linked]].view(np.int64)})


def block_bounds(blocks: int) -> list[int]:
    return [round(64 * i / blocks) for i in range(blocks + 1)]


def blocks_for(rows: int, max_bits: int) -> int:
    """The fewest blocks whose keys leave CELL_ROWS random fingerprints in a cell, or fewer."""
    for blocks in range(max_bits + 1, 2 * max_bits + 4):
        at = block_bounds(blocks)
        shortest = sum(sorted(b - a for a, b in zip(at, at[1:]))[: blocks - max_bits])
        if rows <= CELL_ROWS << shortest:
            break
    return blocks


def block_keys(fp, blocks: int, max_bits: int) -> list:
    """For each choice of blocks - max_bits blocks the fingerprint's bits in them, hashed with the number of the choice."""
    at = block_bounds(blocks)
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << (at[i + 1] - at[i])) - 1) << at[i] for i in kept)
        keys.append(F.xxhash64(fp.bitwiseAND(F.lit(_signed(mask))), F.lit(n)))
    return keys


def fingerprint_links(fps: DataFrame, max_bits: int = 3, cell_rows: int = 8192, blocks: int | None = None) -> DataFrame:
    """Edges a, b that connect all distinct fingerprints (column fp) at max_bits or fewer differing bits.

    Keys that hash alike share a cell, which costs a comparison and changes no link. blocks: by default as the number of rows asks for.
    """
    if not 0 <= max_bits < 16:
        raise ValueError("blocks hold links of fifteen bits at most")
    blocks = blocks or blocks_for(fps.count(), max_bits)
    rows = with_pivot_table(fps).withColumn("band", F.explode(F.array(*block_keys(F.col("fp"), blocks, max_bits))))
    rows = deal_cells(rows, "band", "fp", cell_rows)
    order = ["band", "lo", "hi", "d0", "fp"]
    small_batches(fps.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, ["band", "lo", "hi"]):
            if len(whole) > 1:
                yield cell_links(whole, max_bits)

    return rows.repartition("band", "lo", "hi").sortWithinPartitions(*order).mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3) -> DataFrame:
    """One row per document: rid, doc_id, fingerprint (16 hex digits), component_id, component (a fingerprint).

    component_id is the smallest id reachable over links (itself included). Null texts count as empty;
    texts without words have fingerprint zero and are linked like any other. Null ids keep their rows
    and never name a component that has another id. Repeated rows fall in one component. An empty
    table gives no rows; columns other than the two named are ignored.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "classes")
    edges = stage(fingerprint_links(classes.select("fp"), max_bits), "links")
    comp = stage(components(edges), "components")
    named = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "n", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = stage(named.join(least, "component").select("fp", "n", "component", "component_id"), "named")
    return join_to_classes(fps, named, "fp").select("rid", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that repeat another: of each component the row with the smallest id stays.

    All columns stay. Of equal smallest ids the first row of the scan stays; rows without an id stay only where their whole component
    has none. Rows are matched by their place in the scan of docs; what is not a stored table is stored first.
    """
    docs = stored(docs)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("rid")).alias("place")
    found = stage(near_duplicates(docs, id_col, text_col).select("rid", "component", place), "found")
    first = stage(found.groupBy("component").agg(F.min("place").alias("first")), "first")  # apart, so that skew handling can split the join
    drop = stage(found.join(first, "component").where("place <> first").select("rid"), "dropped")
    return without_rows(docs, drop)
