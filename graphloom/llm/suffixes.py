"""Removal of repeated passages by sparse suffix arrays.

Suffixes are kept at content-selected positions only: the minimiser of a window is the first of its
``GRAM``-word runs with the smallest hash, so equal windows keep the suffix at the same place. Windows that follow
each other and have one minimiser make one span. Spans that are equal throughout settle at once, by the
smallest document. Of minimisers with different spans the suffixes are sorted; neighbours are compared for
the words they share to the right, and the matches are extended over the words to the left: a window
that begins ``o`` words before the minimiser is the same in a run of suffixes that share ``50 - o`` words and in which
the ``o`` words before are equal too, and the smallest document of such a class keeps it.

A minimiser with more than ``GROUP`` suffixes is not sorted in one task: the windows around it are
counted by their hashes instead, with map-side combination, which gives the same rows.

Defined results are those of :mod:`graphloom.llm.recompression`: a null or empty text has no words; texts
under 50 words lose nothing; repeats within one document or one ``doc_id`` stay; a null ``doc_id`` counts as
largest; an empty table gives no rows; other columns are ignored (``strip`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.recompression import _signed, _single_windows, _span_keys
from graphloom.llm.repeats import WINDOW, identified, remove_windows, window_hashes, window_starts
from graphloom.llm.tokens import Words, column_of, grams, int64s, join_hash, slices
from graphloom.session import cut, free

GRAM = 10
GROUP = 2_000
ROWS = 5_000


def minimisers(words: Words, window: int = WINDOW, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(name, position, start, count)`` of the spans of windows with one minimiser."""
    none = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    if len(words.hashes) < window:
        return none
    whole = window_starts(words.first, window)
    starts = np.flatnonzero(whole)
    if len(starts) == 0:
        return none
    value = np.full(len(words.hashes), np.uint64(2**64 - 1))
    gram, at = grams(words.hashes, words.first, size)
    value[at] = gram
    best, width = np.arange(len(value)), 1
    span = window - size + 1
    while width * 2 <= span:
        other = best[np.minimum(np.arange(len(value)) + width, len(value) - 1)]
        best = np.where(value[other] < value[best], other, best)
        width *= 2
    first, second = best[starts], best[starts + span - width]
    chosen = np.where(value[second] < value[first], second, first)
    cutting = np.ones(len(starts), bool)
    cutting[1:] = (chosen[1:] != chosen[:-1]) | (np.diff(starts) != 1)
    head = np.flatnonzero(cutting)
    return value[chosen[head]], chosen[head], starts[head], np.diff(np.append(head, len(starts)))


def find_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(name, key, d, h, p, s, n)``: minimiser, hash of the span's windows, its place, first window, number of windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(column_of(batch, "text"), "plain")
            name, place, start, count = minimisers(words, window)
            if len(start) == 0:
                continue
            row = np.searchsorted(words.first, start, side="right") - 1
            key = _span_keys(window_hashes(words.hashes, window), start, count)
            d, h = int64s(column_of(batch, "d")), int64s(column_of(batch, "h"))
            numbers = [pa.array((x - y).astype(np.int32)) for x, y in ((place, words.first[row]), (start, words.first[row]), (count, 0))]
            yield pa.RecordBatch.from_arrays([_signed(name), _signed(key), pa.array(d[row]), pa.array(h[row]), *numbers], ["name", "key", "d", "h", "p", "s", "n"])

    return identified(docs).mapInArrow(find, "name long, key long, d long, h long, p int, s int, n int")


SUFFIX = "name long, suffix binary, before binary, d long, h long, p int, s int, n int"


def _suffix_rows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Rows of ``SUFFIX``: the words from each minimiser on, and those before it backwards, as far as its windows reach."""
    asked = wanted.groupBy("d", "h").agg(F.collect_set(F.struct("name", "p", "s", "n")).alias("a"))
    asked = asked.select("d", "h", *[F.col(f"a.{c}").alias(f"{c}s") for c in ("name", "p", "s", "n")])
    texts = identified(docs).join(asked, ["d", "h"]).dropDuplicates(["d", "h"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(column_of(batch, "text"), "plain")
            lists = [column_of(batch, c) for c in ("names", "ps", "ss", "ns")]
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
            name, p, s, n = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            d, h = int64s(column_of(batch, "d"))[row], int64s(column_of(batch, "h"))[row]
            first = words.first[row]
            after = [words.hashes[a:b].tobytes() for a, b in zip((first + p).tolist(), (first + np.minimum(s + n - 1, p) + window).tolist(), strict=True)]
            before = [words.hashes[a:b][::-1].tobytes() for a, b in zip((first + s).tolist(), (first + p).tolist(), strict=True)]
            columns = [pa.array(name), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(d), pa.array(h), *(pa.array(x.astype(np.int32)) for x in (p, s, n))]
            names = [f.split()[0] for f in SUFFIX.split(", ")]
            for at in range(0, len(name), 5_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 5_000) for c in columns], names)

    return texts.select("d", "h", "text", "names", "ps", "ss", "ns").mapInArrow(find, SUFFIX)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of binary values as rows of a matrix, zero beyond their lengths."""
    blobs = column.to_pylist()
    length = np.array([len(b) // 8 for b in blobs])
    out = np.zeros((len(blobs), width), np.uint64)
    flat = np.frombuffer(b"".join(blobs), np.uint64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    keep = place < width
    out[np.repeat(np.arange(len(blobs)), length)[keep], place[keep]] = flat[keep]
    return out, length


def repeated_in(rows: pa.Table, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``(row, window start)`` of the windows that a smaller document has, among suffixes sorted under their minimisers."""
    rows = rows.combine_chunks()
    name, d, p, s, n = (rows[c].to_numpy() for c in ("name", "d", "p", "s", "n"))
    right, right_length = _matrix(rows["suffix"].combine_chunks(), window)
    left, _ = _matrix(rows["before"].combine_chunks(), window)
    shared = np.zeros(len(name), np.int64)  # words in common with the neighbour above
    same = right[1:] == right[:-1]
    same &= np.arange(window)[None] < np.minimum(right_length[1:], right_length[:-1])[:, None]
    shared[1:] = np.where(same.all(1), window, same.argmin(1))
    shared[1:][name[1:] != name[:-1]] = -1
    low, high = p - s - n + 1, p - s
    extended = np.zeros(len(name), np.uint64)
    found = []
    for o in range(int(high.max(initial=-1)) + 1):
        if o:
            extended = join_hash(extended, left[:, o - 1])
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) == 0:
            continue
        run = np.cumsum(shared < window - o)
        _, group = np.unique(join_hash(run[own].astype(np.uint64), extended[own]), return_inverse=True)
        lowest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, d[own])
        gone = own[d[own] > lowest[group]]
        found.append((gone, p[gone] - o))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compared(suffixes: DataFrame, window: int) -> DataFrame:
    """``(d, h, s, n)``: repeated windows of the sorted suffixes."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        row, start = repeated_in(rows, window)
        d, h = (rows[c].to_numpy()[row] for c in ("d", "h"))
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(h), pa.array(start.astype(np.int32)), pa.array(np.ones(len(row), np.int32))], ["d", "h", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < ROWS:
                continue
            # all but the last minimiser, whose suffixes may go on
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            names = rows.column(0).to_numpy()
            to = int(np.searchsorted(names, names[-1], side="left"))
            if to:
                yield settle([rows.slice(0, to)])
            held, count = [rows.slice(to)], len(names) - to
        if count:
            yield settle(held)

    return suffixes.repartition("name").sortWithinPartitions("name", "suffix").mapInArrow(run, "d long, h long, s int, n int")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(d, h, s, n)``: ranges of windows that also start in a document with a smaller id."""
    found = cut(find_spans(docs, window))
    keys = cut(found.groupBy("name", "key").agg(F.min("d").alias("d0"), F.max("d").alias("d1")))
    whole = found.join(keys.where("d1 > d0"), ["name", "key"]).where("d > d0").select("d", "h", "s", "n")
    varied = keys.groupBy("name").agg(F.count(F.lit(1)).alias("keys"), F.min("d0").alias("m0"), F.max("d0").alias("m1")).where("keys > 1 AND m1 > m0").select("name")
    first = cut(found.join(varied, "name").join(keys, ["name", "key"]).where("d = d0").select("name", "d", "h", "p", "s", "n").distinct())
    # rows, not keys: one document may have a key at any number of places
    many = cut(first.groupBy("name").count().where(F.col("count") > GROUP).select("name"))
    sorted_ = _compared(_suffix_rows(docs, first.join(many, "name", "left_anti"), window), window)
    counted = cut(_single_windows(docs, first.join(many, "name", "left_semi").select("name", "d", "h", "s", "n"), window))
    lowest = counted.groupBy("name", "print").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d1 > d0")
    hot = counted.join(lowest, ["name", "print"]).where("d > d0").select("d", "h", "s", F.lit(1).alias("n"))
    # written, so that the tables behind it need not wait for the texts to move
    out = cut(whole.unionByName(sorted_).unionByName(hot))
    free(found, keys, first, many, counted)
    return out


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    return remove_windows(docs, repeated_windows(docs, window), window)


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the repeated words; a text that loses none stays as it is."""
    return remove_windows(docs, repeated_windows(docs, window), window, kept=True)
