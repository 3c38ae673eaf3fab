"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``size`` words (an item of fewer words is one
window). A window is a set of word shingles, and a document contains it only if it has all of
them: for whole containment the necessary prefix is one shingle. Shingles are ordered by how
often they occur over all documents, each window is filed under its rarest one, and a document
position with that shingle is a candidate if the window fits in the document there (length and
position bound). Candidates are verified word by word over the window.

The window index is held by the tasks in parts of at most ``PART_WINDOWS`` windows. A benchmark of
more windows takes more parts, and the documents stream through one after the other, so memory
is bounded at every benchmark size.

Defined results: a null or empty text, or one without words, is not contaminated (0 words); null
or wordless items have no windows; repeated documents each get their own row; repeated items count
by ``item_id`` once; an empty benchmark or an empty table gives zero hits or no rows; other columns are
carried along under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import Words, column_of, grams, slices
from graphloom.session import cut

WINDOW = 10
SHINGLE = 5
PART_WINDOWS = 200_000
_BITS = 20

REPORT = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,item_ids:array<string>,spans:array<bigint>>"


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(item, n, words)``: distinct windows of the items, words joined by one space."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, items = Words(column_of(batch, "text"), "letters"), column_of(batch, "item").to_pylist()
            rows = []
            for r, item in enumerate(items):
                a, b = int(words.first[r]), int(words.first[r + 1])
                n = min(size, b - a)
                if n and item is not None:
                    own = [words.word(i) for i in range(a, b)]
                    rows += [(item, n, b" ".join(own[s : s + n]).decode()) for s in range(b - a - n + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.string())],
                ["item", "n", "words"],
            )

    named = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(cut_items, "item string, n int, words string").distinct()


class WindowIndex:
    """Windows of one part, filed under the shingles of a chosen order."""

    def __init__(self, windows: pd.DataFrame):
        windows = windows.sort_values(["words", "item"], kind="stable")
        texts, of_text = np.unique(windows["words"].to_numpy(dtype=object), return_inverse=True)
        self.texts = [t.encode() for t in texts]
        self.items = windows["item"].tolist()
        self.item_from = np.searchsorted(of_text, np.arange(len(texts) + 1))
        words = Words(pa.array(texts, pa.large_string()), "letters")
        self.length = words.counts
        self.hashes = np.zeros((len(texts), int(self.length.max(initial=0))), np.uint64)
        self.hashes[words.owner(), np.arange(len(words.hashes)) - np.repeat(words.first[:-1], self.length)] = words.hashes
        tokens, window, offset, wide = [], [], [], []
        for k in sorted(set(np.minimum(self.length, SHINGLE).tolist())):
            value, at = grams(words.hashes, words.first, k)
            owner = words.owner()[at]
            own = np.minimum(self.length[owner], SHINGLE) == k
            tokens.append(value[own])
            window.append(owner[own])
            offset.append((at - words.first[owner])[own])
            wide.append(np.full(int(own.sum()), k))
        none = [np.zeros(0, np.int64)]
        self.token = np.concatenate(tokens or [np.zeros(0, np.uint64)])
        self.window, self.offset, self.wide = (np.concatenate(x or none) for x in (window, offset, wide))
        self._file()

    def _file(self) -> None:
        order = np.argsort(self.token, kind="stable")
        self.token, self.window, self.offset, self.wide = self.token[order], self.window[order], self.offset[order], self.wide[order]
        self.key, self.start = np.unique(self.token, return_index=True)
        self.start = np.append(self.start, len(self.token))
        self.widths = sorted(set(self.wide.tolist()))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.key & np.uint64((1 << _BITS) - 1)] = True

    def keep_prefixes(self, count: np.ndarray) -> None:
        """File each window under its rarest shingle only; ties go to the smaller hash."""
        rarity = count[np.searchsorted(self.key, self.token)]
        order = np.lexsort((self.token, rarity, self.window))
        first = order[np.r_[True, np.diff(self.window[order]) != 0]] if len(order) else order
        self.token, self.window, self.offset, self.wide = self.token[first], self.window[first], self.offset[first], self.wide[first]
        self._file()

    def matches(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(key number, word position)`` of the documents' shingles that are filed here."""
        for k in self.widths:
            value, at = grams(words.hashes, words.first, k)
            maybe = np.flatnonzero(self.seen[value & np.uint64((1 << _BITS) - 1)])
            key = np.minimum(np.searchsorted(self.key, value[maybe]), len(self.key) - 1)
            same = self.key[key] == value[maybe]
            yield key[same], at[maybe[same]]

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(window, first word position)`` of every verified occurrence."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        owner = words.owner()
        for key, at in self.matches(words):
            n = self.start[key + 1] - self.start[key]
            entry = np.repeat(self.start[key] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            window = self.window[entry]
            doc = np.repeat(owner[at], n)
            begin = np.repeat(at, n) - self.offset[entry]
            fits = (begin >= words.first[doc]) & (begin + self.length[window] <= words.first[doc + 1])
            window, begin = window[fits], begin[fits]
            for k in range(self.hashes.shape[1]):
                beyond = self.length[window] <= k
                same = beyond | (words.hashes[np.where(beyond, 0, begin + k)] == self.hashes[window, k])
                window, begin = window[same], begin[same]
            exact = [
                b" ".join(words.word(i) for i in range(b, b + int(self.length[w]))) == self.texts[w]
                for w, b in zip(window.tolist(), begin.tolist(), strict=True)
            ]
            found.append((window[exact], begin[exact]) if exact else found[0])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _counted(docs: DataFrame, index: WindowIndex) -> np.ndarray:
    """How often each shingle of the index occurs over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value.key), np.int64)
        for batch in slices(batches):
            for key, _ in held.value.matches(Words(column_of(batch, "text"), "letters")):
                total += np.bincount(key, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    rows = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(index.key), np.int64)
    out[rows["key"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _report(words: Words, index: WindowIndex, before: list | None) -> pa.Array:
    window, begin = index.occurrences(words)
    doc = words.owner()[begin] if len(begin) else begin
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + index.length[window], -1)
    held: dict[int, set] = {}
    for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
        held.setdefault(d, set()).update(index.items[index.item_from[w] : index.item_from[w + 1]])
    for d, earlier in enumerate(before or []):
        if earlier and earlier["spans"]:
            held.setdefault(d, set()).update(earlier["item_ids"])
            spans = np.asarray(earlier["spans"], np.int64) + words.first[d]
            np.add.at(edge, spans[::2], 1)
            np.add.at(edge, spans[1::2], -1)
    hit = np.cumsum(edge[:-1]) > 0
    below = np.concatenate([[0], np.cumsum(hit)])
    n_hit = below[words.first[1:]] - below[words.first[:-1]]
    rows = []
    for d, n in enumerate(words.counts.tolist()):
        spans, items = [], sorted(held.get(d, ()))
        if items:
            own = np.diff(np.concatenate([[0], hit[words.first[d] : words.first[d + 1]].astype(np.int8), [0]]))
            spans = np.stack([np.flatnonzero(own == 1), np.flatnonzero(own == -1)], 1).ravel().tolist()
        rows.append({"n_words": n, "n_hit": int(n_hit[d]), "n_items": len(items), "item_ids": items, "spans": spans})
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])
    return pa.array(rows, kind)


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, report: str = "contamination", part: int = PART_WINDOWS) -> DataFrame:
    """``docs`` with one more column ``report``: words, hit words, items found and hit word spans.

    ``spans`` holds start and end word positions by turns. ``docs`` needs a string column ``text``.
    """
    if report in docs.columns:
        raise ValueError(f"docs already have a column {report}")
    windows = cut(item_windows(benchmark, size))
    parts = max(1, -(-windows.count() // part))
    # maxRecordsPerBatch bounds the rows of a batch, slices() its bytes
    out = docs.withColumn(report, F.lit(None).cast(REPORT))
    for k in range(parts):
        own = windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(parts)) == k)
        index = WindowIndex(own.toPandas())
        if len(index.key):
            index.keep_prefixes(_counted(docs, index))
        held = docs.sparkSession.sparkContext.broadcast(index)
        schema = out.schema

        def find(batches: Iterator[pa.RecordBatch], held=held, k=k, names=tuple(out.columns)) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words = Words(column_of(batch, "text"), "letters")
                before = column_of(batch, report).to_pylist() if k else None
                made = _report(words, held.value, before)
                yield pa.RecordBatch.from_arrays([made if n == report else column_of(batch, n) for n in names], list(names))

        out = out.mapInArrow(find, schema)
    return out


def digest(found: DataFrame, report: str = "contamination") -> DataFrame:
    """One row per document: counts, the digest of its item ids, and whether it is contaminated."""
    r = F.col(report)
    return found.select(
        "doc_id",
        r.n_words.alias("n_words"),
        r.n_hit.alias("n_hit"),
        r.n_items.alias("n_items"),
        F.sha2(F.array_join(r.item_ids, ","), 256).alias("items_sha256"),
        (r.n_hit > 0).alias("contaminated"),
    )
