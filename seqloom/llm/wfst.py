"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Compiled from a model are three machines: the normaliser (dummy prefix, blanks to the blank mark, everything else to
itself), the pieces as arcs from strings of characters to ids, and byte fallback as arcs from any character to the ids of
its bytes. Composed with an input they are a lattice of arcs (start, end, ids, weight), whose shortest path in the
tropical semiring (minimum, plus) is the encoding.

Weights. In a unigram model a piece weighs its negative score, and fallback PENALTY more than the worst piece; it is an arc
where no piece holds the character alone. In a BPE model the encoding is decided by merges, not by a sum of scores; there
the transducer's states are pieces, and going from one piece to the next weighs 0 if merging both their
characters gives those two pieces again, and infinity if not. A sequence of pieces is the BPE encoding exactly if each
neighbouring pair is such, so one path of finite weight remains. Runs of blanks are the exception: their pieces
all have one score, so the order of merges is not decided by pieces; segments with two blanks in a row are merged directly.

No piece crosses from a character to a blank mark, and none holds a pair of characters that no piece has, so
texts are cut there first, and the paths of the segments are kept in a memory bounded in bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import open_id, small_batches, solid_id
from seqloom.llm.wordtable import WordTable

BLANK = "▁"
INFINITE = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed value: what an unknown character weighs more than the worst piece of a unigram model.
PENALTY = 10.0
#: Bytes of segments that a worker remembers, pairs of pieces, and segments looked up at once.
CACHE_BYTES, CACHE_PAIRS, BLOCK_SEGMENTS, BLOCK_CHARS = 40_000_000, 150_000, 500_000, 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, cache_pairs: int = CACHE_PAIRS):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type == USER for p in model.pieces):
            raise ValueError("only identity normalisation without user-defined pieces is compiled")
        self.bpe = model.trainer_spec.model_type == BPE
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.output = [b"" if p.type in (CONTROL, UNKNOWN) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        self.longest = max(map(len, self.ids))
        self.fallback = PENALTY - min(self.score.values(), default=0.0)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(x[1] == BLANK != x[0] for x in self.pairs):
            raise ValueError("pieces that end in a blank mark are not compiled")
        self.follows: dict[tuple[str, str], bool] = {}
        self.stable: dict[str, bool] = {}
        self.cache_pairs = cache_pairs
        self.known = WordTable(cache_bytes)
        self.cut = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")

    def normalised(self, text: str) -> str:
        """The normaliser's output."""
        return self.prefix + text.replace(" ", BLANK)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: join the neighbours whose union is the best piece, leftmost first, until none is one."""
        if len(text) > 64:
            return self._merged_by_heap(text)
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_by_heap(self, text: str) -> list[str]:
        """The same in n log n steps: joins wait in a heap by score and place; those whose parts have changed are passed over."""
        parts: list[str] = list(text)
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < len(parts):
                whole = parts[i] + parts[right[i]]
                if (s := self.score.get(whole)) is not None:
                    heapq.heappush(heap, (-s, i, whole))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j == len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(i)
            offer(left[i])
        return [p for p in parts if p]

    def _follows(self, a: str, b: str) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > self.cache_pairs:
                self.follows.clear()
            known = self.follows[a, b] = self.merged(a + b) == [a, b]
        return known

    def arcs(self, text: str, i: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """The lattice's arcs that leave place i of a normalised text: end, ids, weight in a unigram model."""
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            piece = text[i:j]
            if piece in self.ids:
                yield j, (self.ids[piece],), -self.score[piece]
            elif j == i + 1:
                yield j, self.fallen(piece), self.fallback

    def fallen(self, char: str) -> tuple[int, ...]:
        """Byte fallback: the ids of a character that no piece holds alone."""
        return tuple(self.bytes[b] for b in char.encode("utf-8", "replace")) if self.bytes else (self.unknown,)

    def shortest_path(self, text: str) -> list[int]:
        """The ids of a normalised text, which is the output of the lattice's shortest path in the tropical semiring."""
        if not self.bpe:
            return self._least_path(text)
        parts = [] if BLANK * 2 in text else self._finite_path(text)
        return [x for p in parts or self.merged(text) for x in ((self.ids[p],) if p in self.ids else self.fallen(p))]

    def _finite_path(self, text: str) -> list[str]:
        """Depth first, longest pieces first. All arcs weigh 0 or infinity, so any path that arrives is shortest;
        states that were left in vain are not entered again, so each is entered once."""
        n, score, stable, follows = len(text), self.score, self.stable, self.follows
        out: list[str] = []
        dead: set[tuple[int, str]] = set()
        i, j = 0, min(n, self.longest)  # place, and end of the piece to try there
        while i < n:
            last = out[-1] if out else None
            while j > i:
                piece = text[i:j]
                if piece in score and (j, piece) not in dead:
                    ok = stable.get(piece)
                    if ok is None:
                        ok = stable[piece] = self.merged(piece) == [piece]
                    if ok and last is not None:
                        ok = follows.get((last, piece))
                        if ok is None:
                            ok = self._follows(last, piece)
                    if ok:
                        break
                j -= 1
            if j > i:
                out.append(piece)
                i, j = j, min(n, j + self.longest)
            elif out:
                back = out.pop()
                dead.add((i, back))
                i, j = i - len(back), i - 1
            else:
                return []
        return out

    def _least_path(self, text: str) -> list[int]:
        """Relaxation from left to right: arcs only go forward."""
        best: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())] + [(INFINITE, 0, ())] * len(text)
        for i in range(len(text)):
            so_far = best[i][0]
            for j, ids, weight in self.arcs(text, i):
                if so_far + weight < best[j][0]:
                    best[j] = (so_far + weight, i, ids)
        out, j = [], len(text)
        while j:
            out.append(best[j][2])
            j = best[j][1]
        return [x for ids in reversed(out) for x in ids]

    def _segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after another, and how many each has. A pair of characters that no piece has is a cut."""
        found = []
        for text in (s.decode() for s in segments):
            out, start, pairs = [], 0, self.pairs
            for i in range(1, len(text)):
                if text[i - 1 : i + 1] not in pairs:
                    out += self.shortest_path(text[start:i])
                    start = i
            found.append(out + self.shortest_path(text[start:]))
        return np.array([x for out in found for x in out], "<u4"), np.array([len(out) for out in found])

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The segments of a text, a bounded number at a time."""
        if len(text) <= BLOCK_CHARS:
            yield self.cut.findall(text)
        else:
            found = (m.group() for m in self.cut.finditer(text))
            while part := list(islice(found, BLOCK_SEGMENTS)):
                yield part

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; none for an empty one. Segments of many texts are looked up together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[str] = []
        owners: list[tuple[int, int]] = []  # text, and where its segments end among those held

        def flush() -> None:
            ids, sizes = self.known.look_up(pa.array(held, pa.binary()), self._segments)
            ends = np.append(0, np.cumsum(sizes))[[end for _, end in owners]]
            for (i, _), own in zip(owners, np.split(ids, ends[:-1]), strict=True):
                out[i].append(own)
            held.clear()
            owners.clear()

        for i, t in enumerate(texts):
            for part in self._parts(self.normalised(t)) if t else ():
                held += part
                owners.append((i, len(held)))
                if len(held) >= BLOCK_SEGMENTS:
                    flush()
        if held:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, "<u4") for x in out]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for an empty one."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of a sequence of ids: the transducer read the other way."""
        raw = b"".join(map(self.output.__getitem__, np.asarray(ids).tolist()))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@cache
def machine_for(path: str) -> Transducer:
    """One transducer per Python worker: what it has compiled and the paths it has found stay from task to task."""
    return Transducer(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Callable[[], str] = default_model) -> DataFrame:
    """doc_id and ids (array) of every text. Null and empty texts have no ids; null and repeated ids of documents keep their rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = machine_for(model())
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [x.astype(np.int32) for x in machine.encode_all([t or "" for t in b["text"]])]})

    return docs.select(solid_id(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>").withColumn("doc_id", open_id(F.col("doc_id")))


def decode(tokens: DataFrame, ids_col: str = "ids", model: Callable[[], str] = default_model) -> DataFrame:
    """doc_id and text of every sequence of ids; null and empty sequences give empty texts."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = machine_for(model())
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [machine.decode([] if x is None else x) for x in b["ids"]]})

    return tokens.select(solid_id(F.col("doc_id")).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(run, "doc_id long, text string").withColumn("doc_id", open_id(F.col("doc_id")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Callable[[], str] = default_model) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), and whether decoding gives the text back.

    Whole texts; null texts count as empty (no ids, which give the empty text back). An empty table gives no
    rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = machine_for(model())
        for b in batches:
            texts = [t or "" for t in b["text"]]
            out = [(len(ids), zlib.crc32(ids.astype("<u4").tobytes()), machine.decode(ids) == t) for t, ids in zip(texts, machine.encode_all(texts), strict=True)]
            got = pd.DataFrame(out, columns=["n_tokens", "ids_crc32", "round_trip"])
            yield pd.concat([b["doc_id"], got], axis=1)

    return docs.select(solid_id(F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean").withColumn("doc_id", open_id(F.col("doc_id")))
