"""Character n-grams of many words at once, as hashes in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Stand for the beginning and the end of a word; no letter has these code points.
BEGIN, END = "\x02", "\x03"
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Letters:
    """The words, each between BEGIN and END, as one run of code points."""

    codes: np.ndarray
    word: np.ndarray  # the word of each letter
    start: np.ndarray  # where the word of each letter starts
    end: np.ndarray  # where it ends
    n_words: int

    @classmethod
    def of(cls, words: list[str]) -> Letters:
        joined = "".join([f"{BEGIN}{w}{END}" for w in words])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        return cls(codes, word, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), len(words))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams inside words, and the word of each."""
        size = len(self.codes) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.codes[:size].copy()
        for k in range(1, n):
            h = h * _STEP + self.codes[k : size + k]
        inside = np.arange(size) + n <= self.end[:size]
        return mixed(h[inside], n), self.word[:size][inside]

    def histories(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each letter after BEGIN: the hash of its history (up to order - 1 letters of the word), that of
        history and letter, and its word. A history that BEGIN cuts short is one of its own."""
        at = np.flatnonzero(np.arange(len(self.codes)) > self.start)
        have = np.minimum(order - 1, at - self.start[at])
        h = np.zeros(len(at), np.uint64)
        for back in range(order - 1, 0, -1):
            use = have >= back
            h[use] = h[use] * _STEP + self.codes[at[use] - back]
        history = mixed(h, 1)
        return history, mixed(history * _STEP + self.codes[at], 2), self.word[at]


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x51ED2701)) * _MIX
    return h ^ (h >> np.uint64(29))
