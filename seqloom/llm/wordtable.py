"""A bounded memory of words and their token ids, which Python workers keep from task to task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of unknown words that one call encodes.
CALL_BYTES = 100_000


class WordTable:
    """Words and their ids in flat Arrow and numpy arrays, of a bounded size in bytes: beyond it the half used longest ago goes."""

    def __init__(self, most: int):
        self.most, self.clock = most, 0
        self.words = pa.array([], pa.binary())
        self.ids, self.starts, self.used = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def nbytes(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.starts.nbytes + self.used.nbytes

    def trim(self) -> None:
        self.clock += 1
        if self.nbytes() <= self.most:
            return
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :])
        ids, sizes = self.take(keep)
        self.words, self.ids, self.used = self.words.take(pa.array(keep)), ids, self.used[keep]
        self.starts = np.append(0, np.cumsum(sizes))

    def find(self, words: pa.BinaryArray) -> np.ndarray:
        """Places of words in the table; -1 for unknown ones."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False) if len(self.words) else np.full(len(words), -1, np.int32)
        self.used[at[at >= 0]] = self.clock
        return at

    def add(self, words: pa.BinaryArray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.ids = np.append(self.ids, ids)
        self.used = np.append(self.used, np.full(len(words), self.clock, np.int32))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after another, and how many each has."""
        sizes = (self.starts[1:] - self.starts[:-1])[at]
        where = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        where += np.arange(len(where))
        return self.ids[where], sizes

    def look_up(self, words: pa.BinaryArray, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has; unknown ones are encoded in calls of a bounded size."""
        self.trim()
        at = self.find(words)
        unknown = at < 0
        if unknown.any():
            missing = words.filter(pa.array(unknown))
            new, known = pc.unique(missing), len(self.words)
            at = at.copy()
            at[unknown] = pc.index_in(missing, value_set=new).to_numpy() + known
            call = np.cumsum(pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64) + 25) // CALL_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(call)) + 1), len(new)]
            found = [encode(new.slice(a, b - a).to_pylist()) for a, b in zip(cuts, cuts[1:])]
            self.add(new, *map(np.concatenate, zip(*found)))
        return self.take(at)
