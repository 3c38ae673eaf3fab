"""Removal of repeated passages by recompression.

Rounds name symbols over every text: a run of one symbol becomes a symbol, and so does a pair of
neighbours whose first is of the left and second of the right class of the round. A name is a hash
of what it stands for, so a round names globally without an exchange, and equal substrings get equal interior symbols.
For each symbol the words are tracked on which its being there depends (its context): a merged pair
depends on its two parts only; a symbol that stayed single also depends on the neighbour it could
have joined, and a run on both its neighbours.

The anchor of a window is the longest symbol whose context lies in the window, the leftmost of
these. That is a function of the window's words alone: equal windows have equal anchors, at the same
place. Windows that follow each other and share an anchor make one span. Joins then go from coarse to fine:
equal spans under one anchor name settle at once, by the smallest document; only where one
name has different spans, the single windows under that name are compared. All of it is counting by keys
with map-side combination, so a passage in a third of all documents makes no large group.

Defined results: a null text and an empty one have no words; texts under 50 words lose nothing; a window
repeated within one document, or in rows of one ``doc_id``, is no repeat; a null ``doc_id`` counts as largest;
an empty table gives no rows; other columns are ignored (``strip`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.repeats import WINDOW, identified, remove_windows, window_hashes, window_starts
from graphloom.llm.tokens import Words, column_of, int64s, join_hash, mix, slices
from graphloom.session import cut, free

# the same for every text, whatever else is in its slice: where equal windows stopped at different rounds, their anchors would differ.
# More rounds give longer symbols, which lie whole in few windows, and so more spans (sf0.1: 1.57 times as many with 14)
ROUNDS = 8
RUN_EVERY = 4


def symbols(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """``(name, left, right, context from, context to)`` of all symbols whose context fits in a window."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, left = hashes, np.arange(len(hashes), dtype=np.int64)
    right, low, high = left + 1, left, left + 1
    made = [(name, left, right, low, high)]
    for step in range(ROUNDS):
        if len(name) < 2:
            break
        if step % RUN_EVERY == 0:
            name, left, right, low, high, doc, new = _runs(name, left, right, low, high, doc, first)
        else:
            name, left, right, low, high, doc, new = _pairs(name, left, right, low, high, doc, first, step)
        new &= high - low <= window
        if new.any():
            made.append((name[new], left[new], right[new], low[new], high[new]))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _neighbours(low, high, doc, first):
    """Context of the left and of the right neighbour; beyond a text it never fits in a window."""
    before, after = np.empty_like(low), np.empty_like(high)
    same = doc[1:] == doc[:-1]
    before[0], after[-1] = first[doc[0]] - 1, first[doc[-1] + 1] + 1
    before[1:] = np.where(same, low[:-1], first[doc[1:]] - 1)
    after[:-1] = np.where(same, high[1:], first[doc[:-1] + 1] + 1)
    return before, after


def _runs(name, left, right, low, high, doc, first):
    before, after = _neighbours(low, high, doc, first)
    begins = np.ones(len(name), bool)
    begins[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(begins)
    last = np.append(at[1:], len(name)) - 1
    count = last - at + 1
    several = count > 1
    new_name = np.where(several, join_hash(name[at], count.astype(np.uint64), 1), name[at])
    new_low = np.minimum(np.minimum.reduceat(low, at), before[at])
    new_high = np.maximum(np.maximum.reduceat(high, at), after[last])
    return new_name, left[at], right[last], new_low, new_high, doc[at], several


def _pairs(name, left, right, low, high, doc, first, step):
    before, after = _neighbours(low, high, doc, first)
    is_left = (mix(name + np.uint64(step * 2 + 1)) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(name), bool)
    joined[:-1] = is_left[:-1] & ~is_left[1:] & (doc[1:] == doc[:-1])
    second = np.zeros(len(name), bool)
    second[1:] = joined[:-1]
    stays = ~second
    at = np.flatnonzero(stays)
    pair = joined[at]
    partner = np.minimum(at + 1, len(name) - 1)
    new_name = np.where(pair, join_hash(name[at], name[partner], 2), name[at])
    alone_low = np.where(is_left[at], low[at], np.minimum(low[at], before[at]))
    alone_high = np.where(is_left[at], np.maximum(high[at], after[at]), high[at])
    new_low = np.where(pair, np.minimum(low[at], low[partner]), alone_low)
    new_high = np.where(pair, np.maximum(high[at], high[partner]), alone_high)
    return new_name, left[at], np.where(pair, right[partner], right[at]), new_low, new_high, doc[at], pair


def spans(words: Words, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """``(name, start, count)``: windows that follow each other and have one anchor, with its name."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(words.hashes) == 0:
        return none
    whole = window_starts(words.first, window)
    if not whole.any():
        return none
    name, left, right, low, high = symbols(words.hashes, words.first, window)
    # windows from high - window to low hold the context
    begin = np.maximum(high - window, words.first[np.searchsorted(words.first, left, side="right") - 1])
    end = low.copy()
    owner = np.full(len(words.hashes), -1, np.int64)
    open_ = whole.copy()
    length = right - left
    order = np.lexsort((-left, -length))
    edges = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, edges):
        todo = np.concatenate([[0], np.cumsum(open_)])
        if todo[-1] == 0:
            break
        use = group[(end[group] >= begin[group])]
        use = use[todo[end[use] + 1] > todo[begin[use]]]
        if len(use) == 0:
            continue
        n = end[use] - begin[use] + 1
        at = np.repeat(begin[use] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        who = np.repeat(use, n)
        free = open_[at]
        at, who = at[free], who[free]
        owner[at] = who  # symbols come from right to left: the leftmost is written last
        open_[at] = False
    starts = np.flatnonzero(whole)
    own = owner[starts]
    cutting = np.ones(len(starts), bool)
    cutting[1:] = (own[1:] != own[:-1]) | (np.diff(starts) != 1)
    head = np.flatnonzero(cutting)
    return name[own[head]], starts[head], np.diff(np.append(head, len(starts)))


def _span_keys(prints: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of the windows of each span in order."""
    at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(join_hash(prints[at], rank.astype(np.uint64), 3), np.cumsum(count) - count))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(name, key, d, h, s, n)`` of every span: anchor name, hash of its windows, first window and their number."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(column_of(batch, "text"), "plain")
            name, start, count = spans(words, window)
            if len(start) == 0:
                continue
            row = np.searchsorted(words.first, start, side="right") - 1
            key = _span_keys(window_hashes(words.hashes, window), start, count)
            d, h = int64s(column_of(batch, "d")), int64s(column_of(batch, "h"))
            columns = [_signed(name), _signed(key), pa.array(d[row]), pa.array(h[row]), pa.array((start - words.first[row]).astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["name", "key", "d", "h", "s", "n"])

    return identified(docs).mapInArrow(find, "name long, key long, d long, h long, s int, n int")


def _single_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(name, print, d, h, s)``: the windows of the spans ``wanted(name, d, h, s, n)``, from the texts."""
    asked = wanted.groupBy("d", "h").agg(F.collect_set(F.struct("name", "s", "n")).alias("asked"))
    asked = asked.select("d", "h", F.col("asked.name").alias("names"), F.col("asked.s").alias("starts"), F.col("asked.n").alias("counts"))
    texts = identified(docs).join(asked, ["d", "h"]).dropDuplicates(["d", "h"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(column_of(batch, "text"), "plain")
            prints = window_hashes(words.hashes, window)
            lists = [column_of(batch, c) for c in ("names", "starts", "counts")]
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
            name, s, n = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start, row, name = np.repeat(s, n) + rank, np.repeat(row, n), np.repeat(name, n)
            d, h = int64s(column_of(batch, "d")), int64s(column_of(batch, "h"))
            columns = [pa.array(name), _signed(prints[words.first[row] + start]), pa.array(d[row]), pa.array(h[row]), pa.array(start.astype(np.int32))]
            for at in range(0, len(name), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in columns], ["name", "print", "d", "h", "s"])

    return texts.select("d", "h", "text", "names", "starts", "counts").mapInArrow(find, "name long, print long, d long, h long, s int")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(d, h, s, n)``: ranges of windows that also start in a document with a smaller id."""
    found = cut(find_spans(docs, window))
    keys = found.groupBy("name", "key").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    keys = cut(keys)
    whole = found.join(keys.where("d1 > d0"), ["name", "key"]).where("d > d0").select("d", "h", "s", "n")
    varied = keys.groupBy("name").agg(F.count(F.lit(1)).alias("keys"), F.min("d0").alias("m0"), F.max("d0").alias("m1")).where("keys > 1 AND m1 > m0").select("name")
    first = found.join(varied, "name", "left_semi").join(keys, ["name", "key"]).where("d = d0")
    single = cut(_single_windows(docs, first.select("name", "d", "h", "s", "n"), window))
    lowest = single.groupBy("name", "print").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d1 > d0")
    parts = single.join(lowest, ["name", "print"]).where("d > d0").select("d", "h", "s", F.lit(1).alias("n"))
    # written, so that the tables behind it need not wait for the texts to move
    out = cut(whole.unionByName(parts))
    free(found, keys, single)
    return out


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    return remove_windows(docs, repeated_windows(docs, window), window)


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the repeated words; a text that loses none stays as it is."""
    return remove_windows(docs, repeated_windows(docs, window), window, kept=True)
