"""Best-fit packing of tokenised documents by bin completion.

A piece matters to the packing by its length alone, and there are at most `capacity` lengths. So the
corpus is reduced to a histogram of lengths (at most 4096 rows at any size of input); the driver
solves the packing on it; the answer is a list of runs "this filling, that many times". Executors then
give every piece its place from its rank among the pieces of its length.

The solver is bin completion branch-and-bound: around the largest remaining length it enumerates the
undominated fillings of the rest of the sequence, orders them by waste, prunes branches whose waste
bound cannot beat the incumbent, and keeps the best-fit solution as first incumbent.

Ranks need no global sort: the tokenising task numbers its pieces per length, and a prefix sum over the
(task, length) counts turns these into global ranks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import open_id, small_batches, solid_id, stage
from seqloom.llm.wordtable import WordTable

CAPACITY = 4096
END_ID = 1
#: Bytes of words that one Python worker remembers; characters cut into words at once.
CACHE_BYTES, BLOCK_CHARS = 16_000_000, 1_500_000

Run = tuple[tuple[int, ...], int]


def slices(text, blank, newline, most: int) -> Iterator:
    """A text or bytes in parts of at most `most`, each cut before a blank or newline; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(blank, at + 1, at + most), text.rfind(newline, at + 1, at + most))
        if cut < 0:
            cut = min((x for x in (text.find(blank, at + most), text.find(newline, at + most)) if x >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


class CachedEncoder:
    """Token ids of whole texts, with a cache of words that is bounded in bytes.

    The tokenizer lower-cases, drops white space and cuts a text into words, which it encodes one by one. Texts of
    Latin-1 letters and marks are cut into words here, a block of texts at a time, and each distinct word of a
    block is looked up once; the tokenizer encodes unknown ones, many in one call, and its word ends say which ids
    belong to which. Other texts are cut at blanks and newlines, which no normalisation or word spans, and those
    chunks are encoded whole. Memory follows the block and the longest single word or chunk, not the text.
    """

    OTHER = re.compile("[^\t-\r -~\u00a1-\u00ff]")
    LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")
    #: What a lower-cased Latin-1 character belongs to: 0 white space, 1 a word of letters, 2 a digit alone, 3 a run of marks.
    KIND = np.array([0 if c in "\t\n\v\f\r " else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in map(chr, range(256))], np.uint8)

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.words, self.chunks = WordTable(cache_bytes), WordTable(cache_bytes // 4)

    def _one_by_one(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in items], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(x) for x in found])

    def _all_at_once(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(items).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(items) or ends[-1] != len(ids):
            return self._one_by_one([x.decode("latin-1").encode() for x in items])
        return ids, np.diff(ends, prepend=0)

    def word_starts(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start in lower-cased Latin-1 bytes, and which bytes belong to words."""
        kind = self.KIND[raw]
        start = kind != 0
        inside = start.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        mark = np.flatnonzero(start & (raw == 39))  # 's 't 'm 'd 're 've 'll are words of their own
        if len(mark):
            raw, kind = np.append(raw, [0] * 3), np.append(kind, [0] * 3)
            one, two = raw[mark + 1], raw[mark + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for own, size in ((mark[short], 2), (mark[long & ~short], 3)):
                start[own + 1] = False
                rest = own + size
                start[rest[kind[rest] == 1]] = True
        return np.flatnonzero(start), inside

    def _block(self, parts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"\n".join(parts).translate(self.LOWER), np.uint8)
        at, inside = self.word_starts(raw)
        if not len(at):
            return [np.zeros(0, "<u4")] * len(parts)
        before = np.cumsum(inside, dtype=np.int32)
        offsets = np.append(before[at] - 1, before[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        found, sizes = self.words.look_up(words, self._all_at_once)
        end = np.cumsum(sizes)
        firsts = np.cumsum([0, *[len(p) + 1 for p in parts]])[1:-1]
        return np.split(found, np.append(0, end)[np.searchsorted(at, firsts)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(held, self._block([p for _, p in held]), strict=True):
                out[i].append(ids)

        for i, t in enumerate(texts):
            if self.OTHER.search(t):
                for part in slices(t, " ", "\n", BLOCK_CHARS):
                    chunks = [x for x in part.encode("utf-8", "replace").replace(b"\n", b" ").split(b" ") if x]
                    out[i].append(self.chunks.look_up(pa.array(chunks, pa.binary()), self._one_by_one)[0])
                continue
            for part in slices(t.encode("latin-1"), b" ", b"\n", BLOCK_CHARS):
                held.append((i, part))
                size += len(part)
                if size > BLOCK_CHARS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]


@cache
def encoder_for(path: str) -> CachedEncoder:
    """One encoder per Python worker: its words stay known from task to task."""
    return CachedEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[], str] = default_tokenizer, capacity: int = CAPACITY) -> DataFrame:
    """doc_id (solid), piece, start, length, ids_crc32 of every piece, with part (its task) and nth (its number among the task's pieces of its length)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, seen = encoder_for(tokenizer()), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4")
        for b in batches:
            out = []
            for doc, ids in zip(b["doc_id"], encoder.encode([t or "" for t in b["text"]]), strict=True):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    out.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(solid_id(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing on a histogram. Bins with the same filling are handled together."""
    groups: dict[int, Counter] = {}  # room left -> fillings -> bins
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in groups:
            groups[room] = Counter()
            insort(rooms, room)
        groups[room][filling] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                filling, bins = next(iter(groups[room].items()))
            else:
                room, filling, bins = capacity, (), -(-left // (capacity // size))
            fit = room // size  # a best-fit bin takes pieces of one size until none fits
            full = min(bins, left // fit)
            if room != capacity or filling:
                groups[room][filling] -= full + (full < bins and left > full * fit)
                if groups[room][filling] <= 0:
                    del groups[room][filling]
                if not groups[room]:
                    del groups[room]
                    rooms.remove(room)
            if full:
                put(room - fit * size, filling + (size,) * fit, full)
            left -= full * fit
            if full < bins and left:
                put(room - left * size, filling + (size,) * left, 1)
                left = 0
    return [(f, n) for by in groups.values() for f, n in by.items() if n]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest sequences by total length and by wasted room: a piece over capacity - k leaves room that pieces under k alone can fill."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    at = np.array(sizes, np.int64)
    n = np.array([counts[s] for s in sizes], np.int64)
    cum_n, cum_s = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(at * n)])
    for k in [0, *[s for s in sizes if 2 * s <= capacity]]:
        big, half, low = np.searchsorted(at, capacity - k, "right"), np.searchsorted(at, capacity // 2, "right"), np.searchsorted(at, k, "left")
        n1, n2 = cum_n[-1] - cum_n[big], cum_n[big] - cum_n[half]
        room = n2 * capacity - (cum_s[big] - cum_s[half])
        best = max(best, int(n1 + n2 + max(0, -(-(cum_s[half] - cum_s[low] - room) // capacity))))
    return best


def fillings(sizes: list[int], counts: dict[int, int], room: int, most: int, steps: int) -> list[tuple[int, ...]]:
    """Undominated fillings of room from the remaining sizes (ascending), least waste first.

    Dropped as dominated: a filling that some remaining piece still fits in, and one where a larger piece
    could replace a piece or two and still fit. A filling without waste, found early, ends the search.
    """
    found: dict[tuple[int, ...], int] = {}
    budget = [steps]

    def fit(limit: int, below: int) -> int:
        return bisect_right(sizes, min(limit, below)) - 1

    def walk(left: int, top: int, taken: tuple[int, ...]) -> bool:
        budget[0] -= 1
        at = fit(left, top)
        while at >= 0:
            size = sizes[at]
            if taken.count(size) < counts[size]:
                rest = left - size
                if rest == 0:
                    found[(*taken, size)] = 0
                    return True
                if walk(rest, size, (*taken, size)):
                    return True
                if budget[0] <= 0:
                    return bool(found)
            at -= 1
        low = next((s for s in sizes[:64] if taken.count(s) < counts[s]), None)
        if low is None or low > left:
            found.setdefault(taken, left)
        return False

    walk(room, room, ())
    kept = []
    for taken, waste in sorted(found.items(), key=lambda x: (x[1], len(x[0]), [-s for s in x[0]])):
        if waste:
            swaps = [*set(taken), *{a + b for i, a in enumerate(taken) for b in taken[i + 1 :]}]
            if any((i := fit(s + waste, room)) >= 0 and sizes[i] > s and sizes[i] not in taken for s in swaps):
                continue
        kept.append(taken)
        if len(kept) == most:
            break
    return kept or [()]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 20_000, width: int = 4, steps: int = 400) -> list[Run]:
    """Pack a histogram of lengths into as few sequences as found: runs (lengths of one sequence, how many times).

    nodes bounds the branches looked at, steps the enumeration around one piece, width the completions kept
    at one piece; they bound the search for better answers, not what is packed. Empty histogram: no runs.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("lengths must lie in 1..capacity")
    best = best_fit(counts, capacity)
    used, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())

    left, sizes, runs = dict(counts), sorted(counts), []
    stack: list[Iterator] = []
    waste, allowed = 0, (used - 1) * capacity - total  # a better answer wastes this much at most

    def take(run: Run, sign: int) -> None:
        for s, k in Counter(run[0]).items():
            was = left[s]
            left[s] -= sign * k * run[1]
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))
            elif not was:
                insort(sizes, s)

    def branch() -> Iterator[Run]:
        top = sizes[-1]
        left[top] -= 1
        usable = sizes if left[top] else sizes[:-1]
        options = fillings(usable, left, capacity - top, width, steps)
        left[top] += 1
        for rest in options:
            own = Counter((top, *rest))
            yield (top, *rest), min(left[s] // k for s, k in own.items())

    while used > bound and nodes > 0:
        if not sizes:  # a full packing better than the incumbent
            best, used = list(runs), sum(n for _, n in runs)
            allowed = (used - 1) * capacity - total
            if used <= bound:
                break
        else:
            stack.append(branch())
        while stack:  # next branch of the deepest open piece
            if len(runs) >= len(stack):
                last = runs.pop()
                take(last, -1)
                waste -= (capacity - sum(last[0])) * last[1]
            nodes -= 1
            run = next(stack[-1], None) if nodes > 0 else None
            if run is None:
                stack.pop()
                if nodes <= 0:
                    break
                continue
            more = (capacity - sum(run[0])) * run[1]
            if waste + more > allowed:  # the waste bound
                continue
            runs.append(run)
            take(run, 1)
            waste += more
            break
        if not stack:
            break
    return best


def plan(runs: list[Run]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset, pieces of this length in a sequence) of its places, by first rank.

    Bounded whatever the input: best fit adds three fillings at most for each of `capacity` lengths, the search opens `nodes`,
    and a filling has about sqrt(2 * capacity) different lengths at most.
    """
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for filling, times in runs:
        offset = 0
        for s, k in Counter(filling).items():
            places.setdefault(s, []).append((ranks[s], sequence, offset, k))
            ranks[s] += times * k
            offset += s * k
        sequence += times
    return {s: np.array(p, np.int64) for s, p in places.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[], str] = default_tokenizer, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A document is its text's ids and one end id; longer ones than capacity are cut. Null texts count as
    empty (one piece of one id); null and repeated ids keep their rows; an empty table gives no rows;
    other columns are ignored.
    """
    found = stage(pieces(docs, id_col, text_col, tokenizer, capacity), "pieces")
    counted = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = docs.sparkSession.sparkContext.broadcast(plan(bin_completion(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counted.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = found.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths, ranks = b["length"].to_numpy(), b["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(b) else []:
                first, seq, off, k = places.value[int(lengths[own[0]])].T
                at = np.searchsorted(first, ranks[own], "right") - 1
                nth = ranks[own] - first[at]
                sequence[own] = seq[at] + nth // k[at]
                offset[own] = off[at] + nth % k[at] * lengths[own]
            yield b.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    placed = ranked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", open_id(F.col("doc_id")))
