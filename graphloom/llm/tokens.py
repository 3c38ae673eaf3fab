"""Words of Arrow text columns as numpy arrays: the helper behind the Arrow operators of this package.

A word is a maximal run of bytes that are not separators. Words are found, folded and hashed
for a whole slice of texts at once; a slice is bounded by bytes, never by cutting a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_SPACES = [0x20, *range(0x09, 0x0E)]


def _fold_upper(table: np.ndarray) -> np.ndarray:
    table[65:91] = np.arange(97, 123, dtype=np.uint8)
    return table


@cache
def byte_table(kind: str) -> np.ndarray:
    """Byte → folded byte, 0 for a separator.

    ``plain``: words end at ASCII white space. ``lower``: the same with A-Z lower-cased.
    ``letters``: only ASCII letters, digits and bytes above 127 belong to words, lower-cased.
    A NUL byte inside a plain word is kept apart from separators by :func:`words`.
    """
    table = np.arange(256, dtype=np.uint8)
    if kind != "plain":
        _fold_upper(table)
    if kind == "letters":
        keep = np.zeros(256, bool)
        keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x41:0x5B] = keep[0x80:] = True
        table[~keep] = 0
    else:
        table[_SPACES] = 0
    return table


@cache
def _separators(kind: str) -> np.ndarray:
    if kind == "letters":
        return byte_table(kind) == 0
    out = np.zeros(256, bool)
    out[_SPACES] = True
    return out


@cache
def _codes() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.ones(1, np.uint64)


def _factors(n: int) -> np.ndarray:
    """An odd factor per byte of a word. Powers of one base would not do: long words of two letters, one with
    the letters of the other swapped (Thue-Morse words of 2,048 letters), then have equal hashes."""
    global _FACTORS
    if len(_FACTORS) < n:
        with np.errstate(over="ignore"):
            at = np.arange(1, (1 << int(n - 1).bit_length()) + 1, dtype=np.uint64) * np.uint64(_BASE)
        _FACTORS = mix(at) | np.uint64(1)
    return _FACTORS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of ordered pairs of 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b ^ np.uint64(0xD6E8FEB86659FD93 + salt)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null has no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a slice of texts.

    ``starts``/``ends``: byte spans in ``data``. ``first``: index of each text's first word,
    with the total at the end. ``hashes``: 64-bit hash of each folded word.
    """

    def __init__(self, column: pa.Array, kind: str):
        self.data, self.offsets = utf8(column)
        self.folded = byte_table(kind)[self.data]
        n = len(self.data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(self.offsets), np.int64)
            self.hashes = np.zeros(0, np.uint64)
            return
        inside = ~_separators(kind)[self.data]
        text_start = np.zeros(n + 1, bool)
        text_start[self.offsets] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | text_start[1:n]
        stops[:-1] &= ~inside[1:] | text_start[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        if len(self.starts) == 0:
            self.hashes = np.zeros(0, np.uint64)
            return
        lengths = self.ends - self.starts
        compact = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(compact, lengths)
        with np.errstate(over="ignore"):
            terms = _codes()[self.folded[inside]] * _factors(int(lengths.max()))[at]
            self.hashes = mix(np.add.reduceat(terms, compact) + lengths.astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int, folded: bool = True) -> bytes:
        return (self.folded if folded else self.data)[self.starts[i] : self.ends[i]].tobytes()


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that stay inside one text, and where they start."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(total, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ hashes[k : k + total]) * np.uint64(0xFF51AFD7ED558CCD) + (out >> np.uint64(29))
    out = mix(out)
    ends = np.repeat(first[1:], np.diff(first))[:total]
    keep = np.flatnonzero(np.arange(total) + n <= ends)
    return out[keep], keep


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``size`` bytes of text; a longer text makes a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = utf8(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def int64s(column: pa.Array) -> np.ndarray:
    """Values of an integer column without nulls."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64)
