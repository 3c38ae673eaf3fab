"""What both removers of repeated passages share: row identity, window hashes, and the removal itself.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window covers it whose word
sequence also starts in a document with a smaller ``doc_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tables import unused
from graphloom.llm.tokens import Words, column_of, join_hash, slices

WINDOW = 50
LAST = 2**63 - 1


def identified(docs: DataFrame) -> DataFrame:
    """``(d, h, text)``: the order of a document (null ids last) and a hash that tells rows of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))


def window_hashes(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Hash of the ``window`` words from each position on, by doubling; the last ``window - 1`` positions are undefined."""
    out, have, power, size = None, 0, hashes, 1
    rest = window
    while rest:
        if rest & 1:
            shifted = np.zeros_like(hashes)
            shifted[: len(hashes) - have] = power[have:] if have < len(hashes) else power[:0]
            out = join_hash(shifted, np.full_like(hashes, size)) if out is None else join_hash(out, shifted, size)
            have += size
        rest >>= 1
        if rest:
            moved = np.zeros_like(hashes)
            if size < len(hashes):
                moved[: len(hashes) - size] = power[size:]
            power, size = join_hash(power, moved, size), size * 2
    return out


def window_starts(first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mask of the positions where a whole window starts."""
    total = int(first[-1])
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(total) + window <= ends


def remove_windows(docs: DataFrame, removed: DataFrame, window: int = WINDOW, kept: bool = False) -> DataFrame:
    """Apply ``removed(d, h, s, n)``: windows starting at the words ``s … s + n - 1`` of a document go.

    Gives ``(doc_id, n_words, n_removed, kept_sha256)`` per row of ``docs``, or with ``kept`` all columns of
    ``docs`` with the kept words, joined by spaces, as ``text`` (unchanged where nothing is removed).
    """
    # a set: repeated rows of a document bring their ranges once
    ranges = removed.groupBy("d", "h").agg(F.collect_set(F.struct("s", "n")).alias("_ranges"))
    d, h, at, long = unused(docs, "_d", "_h", "_s", "_n")
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), h: F.xxhash64(F.col("text").cast("string"))})
    ranges = ranges.select(F.col("d").alias(d), F.col("h").alias(h), F.col("_ranges.s").alias(at), F.col("_ranges.n").alias(long))
    joined = keyed.join(ranges, [d, h], "left").drop(d, h)
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(column_of(batch, "text"), "plain")
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            for name, sign in ((at, 1), (long, -1)):
                starts, lengths = column_of(batch, at), column_of(batch, long)
                rows = np.repeat(np.arange(len(starts)), [0 if x is None else x for x in _lengths(starts)])
                s = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                place = words.first[rows] + s
                np.add.at(edge, place if name == at else place + n - 1 + window, sign)
            gone = np.cumsum(edge[:-1]) > 0
            below = np.concatenate([[0], np.cumsum(gone)])
            n_removed = below[words.first[1:]] - below[words.first[:-1]]
            texts = [_kept_text(words, gone, r) if n_removed[r] or not kept else None for r in range(batch.num_rows)]
            if kept:
                old = column_of(batch, "text").to_pylist() if n_removed.any() else None
                text = pa.array([o if t is None else t.decode() for o, t in zip(old, texts, strict=True)], pa.string()) if old else column_of(batch, "text")
                yield pa.RecordBatch.from_arrays([text if n == "text" else column_of(batch, n) for n in names], names)
            else:
                digests = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "doc_id"), pa.array(words.counts), pa.array(n_removed), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"]
                )

    if kept:
        return joined.mapInArrow(apply, docs.schema)
    joined = joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at, long)
    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _lengths(lists: pa.ListArray) -> list:
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_pylist()


def _kept_text(words: Words, gone: np.ndarray, row: int) -> bytes:
    a, b = int(words.first[row]), int(words.first[row + 1])
    if a == b:
        return b""
    own = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()
    if len(own) != b - a:  # cannot happen for valid text; never join the wrong words
        raise ValueError("words and split differ")
    drop = gone[a:b]
    return b" ".join(own if not drop.any() else [w for w, g in zip(own, drop.tolist(), strict=True) if not g])
