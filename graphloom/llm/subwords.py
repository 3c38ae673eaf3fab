"""Distinct words of a slice of texts, alone or with the bytes before them, and the byte n-grams that end inside them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from graphloom.llm.tokens import Words, join_hash

BEGIN, END = 0x01, 0x02


class DistinctWords:
    """The distinct words of a slice, each once, with a mark before and behind.

    ``data``: bytes of all distinct words, marks included; ``start``: where each begins, with the end;
    ``index``: the distinct word of every word of the slice; ``words``: the slice's words.
    """

    lead: np.ndarray | int = 1  # bytes of each item before its word

    def __init__(self, column: pa.Array, kind: str):
        self.words = Words(column, kind)
        _, first, self.index = np.unique(self.words.hashes, return_index=True, return_inverse=True)
        begin, length = self.words.starts[first], self.words.ends[first] - self.words.starts[first]
        self.start = np.concatenate([[0], np.cumsum(length + 2)])
        self.data = np.empty(int(self.start[-1]), np.uint8)
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        self.data[np.repeat(self.start[:-1] + 1, length) + inner] = self.words.folded[np.repeat(begin, length) + inner]
        self.data[self.start[:-1]] = BEGIN
        self.data[self.start[1:] - 1] = END
        #: index of each byte inside its marked word
        self.place = np.arange(len(self.data)) - np.repeat(self.start[:-1], length + 2)

    def predicted(self) -> np.ndarray:
        """Mask of the bytes of words and their end marks, without what stands before."""
        return self.place >= np.repeat(np.broadcast_to(self.lead, len(self.start) - 1), np.diff(self.start))

    def packed(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Every run of ``n`` bytes (at most 7) inside a word as an integer, and the position of its last byte."""
        if len(self.data) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = len(self.data) - n + 1
        value = np.zeros(total, np.int64)
        for k in range(n):
            value = value << 8 | self.data[k : k + total]
        last = np.flatnonzero(self.place[n - 1 :] >= n - 1)
        return value[last], last + n - 1

    def per_text(self, value: np.ndarray) -> np.ndarray:
        """Sum over each text's words of a value per distinct word."""
        total = np.concatenate([[0.0], np.cumsum(value[self.index], dtype=np.float64)])
        return total[self.words.first[1:]] - total[self.words.first[:-1]]

    def per_word(self, value: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sum over each distinct word of values given at byte positions."""
        total = np.zeros(len(self.data))
        np.add.at(total, last, value)
        return np.add.reduceat(total, self.start[:-1]) if len(self.data) else np.zeros(0)


class WordsInContext(DistinctWords):
    """The same for words with the ``reach`` bytes before them: each distinct pair of the two once.

    A text reads as a begin mark, then its words, each with an end mark behind it. The bytes before a word run over as
    many words as they need, and stop at the begin mark. Every digit reads as 0: numbers are not learned one by one.
    """

    def __init__(self, column: pa.Array, kind: str, reach: int):
        words = self.words = Words(column, kind)
        length = words.ends - words.starts
        text = words.owner()
        opens = np.cumsum(np.diff(text, prepend=-1) > 0)  # begin marks so far
        at = np.cumsum(length + 1) - length - 1 + opens  # of each word in the stream
        stream = np.full(int(at[-1] + length[-1] + 1) if len(at) else 0, END, np.uint8)
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        stream[np.repeat(at, length) + inner] = words.folded[np.repeat(words.starts, length) + inner]
        stream[(stream >= 0x30) & (stream <= 0x39)] = 0x30
        head = words.first[:-1][words.counts > 0]
        stream[at[head] - 1] = BEGIN
        lead = np.minimum(at - np.repeat(at[head] - 1, words.counts[words.counts > 0]), reach)
        before = lead.astype(np.uint64)
        for k in range(reach, 0, -1):
            before = np.where(lead >= k, before << np.uint64(8) | stream[np.maximum(at - k, 0)], before)
        _, first, self.index = np.unique(join_hash(words.hashes, before), return_index=True, return_inverse=True)
        size = lead[first] + length[first] + 1
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.place = np.arange(int(self.start[-1])) - np.repeat(self.start[:-1], size)
        self.data = stream[np.repeat(at[first] - lead[first], size) + self.place]
        self.lead = lead[first]
