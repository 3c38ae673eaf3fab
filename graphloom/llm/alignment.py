"""Which tokens of two tokenizers cover the same bytes, and how often two ids meet in all documents.

Both tokenizers cut ``space + text`` into tokens. All tokens are sorted by their start, the ends are turned into
their running maximum, and a token that starts where this maximum stands opens a new group: there both
tokenizers end a token. Inside a group every pair of an A and a B token that share a byte is a link; the tokens of A that
a token of B meets are found by binary search and expanded.

No token of either tokenizer runs across a single space between two other characters, so a text is cut
there into chunks (a group never crosses such a cut either). A slice of documents is coded as its different chunks and the
sequence of chunk numbers: a chunk is tokenized and aligned once per slice. A tokenizer whose vocabulary could
join chunks is given whole texts.

Counts of id pairs are summed up over all slices, and each slice gets back only the counts of its own pairs. A slice is
written as many small rows: blocks of its chunks, of its pairs and of its documents.

Defined results: null and empty texts, and texts whose tokens of A or of B do not spell ``space + text``, have no tokens; texts of
any length are one row; repeated rows give repeated results and count each time; ties for the best partner are all
best; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import column_of, slices, utf8
from graphloom.session import cut, spread

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 4 << 20
#: Chunks that are tokenized at once, and chunks, pairs and chunk numbers in a row.
STEP, ROW_PAIRS, ROW_CHUNKS = 4096, 4096, 1 << 16

#: Kinds of rows of a slice, in the order in which they are read again: ``at`` is the number of a row's first chunk, pair or document.
CHUNKS, PAIRS, DOCUMENTS = range(3)
SLICED = "slice long, kind int, at int, doc_id array<long>, chunks binary, chunk binary, a binary, a_n binary, b binary, b_n binary, pair array<long>, times array<long>"
LINKS = "doc_id long, a array<int>, b array<int>, a_group array<int>, b_group array<int>, link_a array<int>, link_b array<int>, link_count array<long>, link_best array<boolean>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _join(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all parts behind each other, their lengths and starts."""
    n = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), n, np.cumsum(n) - n


def _letters() -> dict[str, int]:
    """Letter → byte of the byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer file; texts get the space in front here."""

    def __init__(self, path: str = BYTE_LEVEL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = _letters()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        parts = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            parts[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.data, self.length, self.start = _join(parts)
        state = json.loads(self.model.to_str())
        before = state["pre_tokenizer"] or {}
        self.splits = before.get("type") == "ByteLevel" and before.get("use_regex") and state["normalizer"] is None

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch(chunks, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model; it adds the space itself."""

    def __init__(self, path: str = PIECES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            parts.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.data, self.length, self.start = _join(parts)
        self.splits = not any(b" " in p.lstrip(b" ") for p in parts)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode([c[1:] for c in chunks], num_threads=1)


@cache
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """The two tokenizers of a worker."""
    return ByteLevel(a), Pieces(b)


def cuts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where chunks start: the starts of texts, and single spaces between two characters that are no white space.

    Next to the space only ASCII 0x21 … 0x7E and characters of lead bytes without any white space count.
    """
    n = len(data)
    lead = np.zeros(256, bool)
    lead[0xC3:0xE0] = lead[0xE4:0xF5] = True
    plain = np.zeros(256, bool)
    plain[0x21:0x7F] = True
    back = lambda k: np.concatenate([np.zeros(min(k, n), np.uint8), data[: max(0, n - k)]])
    one, two, three, four = back(1), back(2), back(3), back(4)
    tail = lambda x: (x & 0xC0) == 0x80
    before = plain[one] | tail(one) & ((two >= 0xC3) & (two < 0xE0) | tail(two) & ((three >= 0xE4) & (three < 0xF0) | tail(three) & (four >= 0xF0)))
    after = np.zeros(n, bool)
    after[:-1] = (plain | lead)[data[1:]]
    inner = (data == 0x20) & before & after
    bounds = np.zeros(n + 1, bool)
    bounds[first] = True
    inner &= ~bounds[1:]  # a space at the end of a text
    return np.flatnonzero(inner | bounds[:-1])


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends])[:-1]


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each A and of each B token, given where they end; both sides cover the same bytes."""
    starts = np.concatenate([_starts(a_end), _starts(b_end)])
    ends = np.concatenate([a_end, b_end])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order]) if len(ends) else ends
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group[: len(a_end)], group[len(a_end) :], int(opens.sum())


def expand(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(A token, B token)``: all pairs that share a byte, in order."""
    if not len(b_end):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_start, b_start = _starts(a_end), _starts(b_end)
    low, high = np.searchsorted(a_end, b_start, side="right"), np.searchsorted(a_start, b_end, side="left")
    n = high - low
    b = np.repeat(np.arange(len(b_end)), n)
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum())), b


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between bounds."""
    return np.diff(_bounds(values)[at])


def _spelled(side, ids: np.ndarray) -> np.ndarray:
    n = side.length[ids]
    return side.data[np.repeat(side.start[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


@dataclass
class Aligned:
    """Groups and links of all different chunks of a slice; ``*_at`` are bounds by chunk."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_at: np.ndarray
    pair: np.ndarray
    texts: list[bytes] | None = None


def align_chunks(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray, left, right) -> Aligned:
    """All chunks lie behind each other on one line of bytes, so one pass aligns them; a group never crosses their ends."""
    a_end, b_end = np.cumsum(left.length[a]), np.cumsum(right.length[b])
    a_group, b_group, groups = coalesce(a_end, b_end)
    link_a, link_b = expand(a_end, b_end)
    a_at, b_at = _bounds(a_n), _bounds(b_n)
    first = np.append(a_group, groups)[a_at]
    link_at = np.searchsorted(link_b, b_at)
    pair = a[link_a].astype(np.int64) << 32 | b[link_b]
    return Aligned(a, b, a_at, b_at, a_group, b_group, first, link_a, link_b, link_at, pair)


def _tokenized(side, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks and how many each has; a tokenizer's own objects live for a few chunks only."""
    ids, n = [], []
    for at in range(0, len(chunks), STEP):
        made = side.encode(chunks[at : at + STEP])
        n.append(np.fromiter(map(len, made), np.int64, len(made)))
        ids.append(np.fromiter(itertools.chain.from_iterable(made), np.int64, int(n[-1].sum())))
    return np.concatenate(ids), np.concatenate(n)


def data_of(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of all values behind each other, and where each begins."""
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].tobytes(), bounds - bounds[0]


def encode_slice(texts: pa.Array, left, right) -> tuple[np.ndarray, ...]:
    """``(chunks per text, chunk numbers, a, a_n, b, b_n)`` with the tokens of each different chunk; texts without tokens have no chunks."""
    raw, offsets = utf8(texts)
    sizes = np.diff(offsets)
    full = sizes > 0
    own = _bounds(np.where(full, sizes + 1, 0))
    data = np.full(int(own[-1]), 0x20, np.uint8)
    data[np.repeat(own[:-1][full] + 1, sizes[full]) + np.arange(len(raw)) - np.repeat(offsets[:-1][full], sizes[full])] = raw
    first = own[:-1][full]
    if not len(first):
        none = np.zeros(0, np.int64)
        return np.zeros(len(texts), np.int64), none, none, none, none, none
    at = cuts(data, np.append(first, len(data))) if left.splits and right.splits else first
    bounds = np.append(at, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    chunks = coded.dictionary.cast(pa.large_string()).to_pylist()
    a, a_n = _tokenized(left, chunks)
    b, b_n = _tokenized(right, chunks)
    number = coded.indices.to_numpy().astype(np.int64)
    per_text = np.diff(np.searchsorted(at, own))
    # texts that one side does not spell; other chunks of theirs may be used by other texts
    bad = np.zeros(len(chunks), bool)
    spelled, want = data_of(coded.dictionary)
    for side, ids, n in ((left, a, a_n), (right, b, b_n)):
        made = _bounds(_sums(side.length[ids], _bounds(n)))
        line = _spelled(side, ids).tobytes()
        if line != spelled or not np.array_equal(made, want):
            bad |= [line[made[i] : made[i + 1]] != spelled[want[i] : want[i + 1]] for i in range(len(chunks))]
    if bad.any():
        text_of = np.repeat(np.arange(len(texts)), per_text)
        a_at, b_at = _bounds(a_n), _bounds(b_n)
        drop = np.zeros(len(texts), bool)
        for r in np.unique(text_of[bad[number]]):
            mine = number[text_of == r]
            whole = data[own[r] : own[r + 1]].tobytes()
            spell = lambda side, ids, bounds: b"".join(_spelled(side, ids[bounds[c] : bounds[c + 1]]).tobytes() for c in mine)  # noqa: B023, E731
            drop[r] = spell(left, a, a_at) != whole or spell(right, b, b_at) != whole
        stay = ~drop[text_of]
        if (bad[number] & stay).any():
            raise ValueError("tokens of a chunk do not spell it, those of its text do")
        number, per_text = number[stay], np.where(drop, 0, per_text)
        # chunks that no text uses any more
        used = np.unique(number)
        keep = np.zeros(len(chunks), bool)
        keep[used] = True
        a, b = a[np.repeat(keep, a_n)], b[np.repeat(keep, b_n)]
        a_n, b_n = a_n[keep], b_n[keep]
        number = np.searchsorted(used, number)
    return per_text, number, a, a_n, b, b_n


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_bounds(np.array([len(r) for r in rows])).astype(np.int32)), pa.array(np.concatenate(rows) if rows else [], kind))


def _frequent_first(per_text: np.ndarray, chunk: np.ndarray, a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same chunks numbered by falling frequency, which packs better."""
    order = np.argsort(-np.bincount(chunk, minlength=len(a_n)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))

    def moved(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, own = (np.cumsum(n) - n)[order], n[order]
        return ids[np.repeat(start - np.cumsum(own) + own, own) + np.arange(int(own.sum()))], own

    return per_text, number[chunk], *moved(a, a_n), *moved(b, b_n)


def pack(values: np.ndarray) -> bytes:
    """Integers from 0 to 2**32 - 1 by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _rows(number: int, kind: int, at: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of one kind of a slice; the columns of other kinds are null."""
    n = len(at)
    made = {"slice": pa.array(np.full(n, number, np.int64)), "kind": pa.array(np.full(n, kind, np.int32)), "at": pa.array(at.astype(np.int32)), **columns}
    types = {x: pa.list_(pa.int64()) for x in ("doc_id", "pair", "times")}
    names = [x.split()[0] for x in SLICED.split(", ")]
    return pa.RecordBatch.from_arrays([made[x] if x in made else pa.nulls(n, types.get(x, pa.binary())) for x in names], names)


def _split(values: pa.Array, at: np.ndarray) -> pa.ListArray:
    """A list per stretch between bounds."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def _packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array([pack(values[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())


def _blocks(n: int, size: int) -> np.ndarray:
    return np.append(np.arange(0, n, size), n)


def sliced(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, size: int = SLICE_BYTES) -> DataFrame:
    """Per slice of documents its different chunks with their tokens, the id pairs that its links hold, and each document's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = tokenizers(a, b)
        number = TaskContext.get().partitionId() << 32
        for part in slices(_gathered(batches, size), size=size):
            per_text, chunk, a_ids, a_n, b_ids, b_n = _frequent_first(*encode_slice(column_of(part, "text"), left, right))
            found = align_chunks(a_ids, a_n, b_ids, b_n, left, right)
            times = np.bincount(chunk, minlength=len(a_n)).astype(np.int64)
            pair, place = np.unique(found.pair, return_inverse=True)
            weight = np.zeros(len(pair), np.int64)
            np.add.at(weight, place, np.repeat(times, np.diff(found.link_at)))
            at = _blocks(len(a_n), ROW_CHUNKS)
            a_at, b_at = _bounds(a_n)[at], _bounds(b_n)[at]
            yield _rows(number, CHUNKS, at[:-1], a=_packed(a_ids, a_at), a_n=_packed(a_n, at), b=_packed(b_ids, b_at), b_n=_packed(b_n, at))
            at = _blocks(len(pair), ROW_PAIRS)
            yield _rows(number, PAIRS, at[:-1], pair=_split(pa.array(pair), at), times=_split(pa.array(weight), at))
            ids, ends = column_of(part, "doc_id").cast(pa.int64()), _bounds(per_text)
            at = np.append(np.flatnonzero(np.diff(ends[:-1] // ROW_CHUNKS, prepend=-1)), len(ids))
            yield _rows(number, DOCUMENTS, at[:-1], doc_id=_split(ids, at), chunks=_packed(per_text, at), chunk=_packed(chunk, ends[at]))
            number += 1

    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SLICED)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``size`` bytes where there are enough rows, so that slices do not follow the batches of the reader."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from rest


def pair_counts(slices_: DataFrame) -> DataFrame:
    """``(pair, count, best)``: links of all documents that hold a pair of ids (``a << 32 | b``), and whether no A id meets the B id more often."""
    each = slices_.where(F.col("kind") == PAIRS).select(F.explode(F.arrays_zip("pair", "times")).alias("p")).select("p.pair", "p.times")
    counts = cut(each.groupBy("pair").agg(F.sum("times").alias("count")))
    other = (F.col("pair").bitwiseAND(0xFFFFFFFF)).alias("b")
    top = counts.groupBy(other).agg(F.max("count").alias("most"))
    return counts.withColumn("b", other).join(top, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


class _Slice:
    """What the rows of a slice have given so far."""

    def __init__(self, left, right):
        self.sides, self.parts, self.known, self.found = (left, right), {x: [] for x in ("a", "a_n", "b", "b_n")}, [], None

    def add(self, kind: int, rows: pa.RecordBatch) -> None:
        if kind == CHUNKS:
            for name, held in self.parts.items():
                held += [unpack(x) for x in column_of(rows, name).to_pylist()]
        else:
            self.known.append(column_of(rows, "known").flatten())

    def ready(self) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """The aligned chunks, and for each link the count of its pair and whether that is the best."""
        if self.found is None:
            none = np.zeros(0, np.int64)
            found = align_chunks(*(np.concatenate([none, *x]) for x in self.parts.values()), *self.sides)
            pair, place = np.unique(found.pair, return_inverse=True)
            count, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
            for given in self.known:
                at = given.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
                count[at] = given.field("count").to_numpy(zero_copy_only=False)
                best[at] = given.field("best").to_numpy(zero_copy_only=False)
            self.found = found, count[place], best[place]
        return self.found


def align(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, digest: bool = False, size: int = SLICE_BYTES) -> DataFrame:
    """Per document the tokens, the group of each, and the links with the corpus-wide count of their id pairs.

    ``a`` and ``b``: ids; ``a_group`` and ``b_group``: the group of each token; ``link_a`` and ``link_b``: positions of
    the linked tokens; ``link_count``: links of all documents with the same two ids; ``link_best``: whether that is
    the most for the B id. With ``digest`` their numbers and a hash of the groups instead.
    """
    rows = cut(sliced(docs, a, b, size))
    own = rows.where(F.col("kind") == PAIRS).select("slice", F.col("at").alias("first"), F.posexplode("pair").alias("i", "pair"))
    entry = F.struct((F.col("first") + F.col("i")).alias("at"), "count", "best")
    known = own.join(pair_counts(rows), "pair").groupBy("slice", "first").agg(F.collect_list(entry).alias("known"))
    known = known.select("slice", F.lit(PAIRS).alias("kind"), F.col("first").alias("at"), "known")
    both = rows.where(F.col("kind") != PAIRS).drop("pair", "times").unionByName(known, allowMissingColumns=True)
    dealt = both.repartition("slice").sortWithinPartitions("slice", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = tokenizers(a, b)
        number, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            which, kinds = column_of(batch, "slice").to_numpy(), column_of(batch, "kind").to_numpy()
            edges = np.flatnonzero((which[1:] != which[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                if which[start] != number:
                    number, held = which[start], _Slice(left, right)
                if kinds[start] != DOCUMENTS:
                    held.add(int(kinds[start]), part)
                    continue
                make = _digested if digest else _linked
                for i in range(part.num_rows):
                    own = [unpack(column_of(part, name)[i].as_py()) for name in ("chunks", "chunk")]
                    yield from make(column_of(part, "doc_id")[i].values, *own, *held.ready())

    return dealt.mapInArrow(run, DIGEST if digest else LINKS)


def _digested(ids: pa.Array, per_text: np.ndarray, chunk: np.ndarray, found: Aligned, count: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = _bounds(per_text)
    each = [np.diff(found.a_at), np.diff(found.b_at), np.diff(found.group_at), np.diff(found.link_at), _sums(best.astype(np.int64), found.link_at), _sums(count, found.link_at)]
    columns = [pa.array(_sums(x[chunk], at)) for x in each]
    if found.texts is None:
        found.texts = _group_texts(found)
    spelled = found.texts
    picked = chunk.tolist()
    hashes = [hashlib.sha256(b";".join([spelled[c] for c in picked[s:e]])).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(hashes, pa.string())], [x.split()[0] for x in DIGEST.split(", ")])


def _group_texts(found: Aligned) -> list[bytes]:
    """Groups of each chunk as ``a1,a2|b1;a3|b2,b3``."""
    groups = int(found.group_at[-1]) if len(found.group_at) else 0
    a = np.searchsorted(found.a_group, np.arange(groups + 1)).tolist()
    b = np.searchsorted(found.b_group, np.arange(groups + 1)).tolist()
    left, right = [b"%d" % x for x in found.a.tolist()], [b"%d" % x for x in found.b.tolist()]
    each = [b",".join(left[a[g] : a[g + 1]]) + b"|" + b",".join(right[b[g] : b[g + 1]]) for g in range(groups)]
    at = found.group_at.tolist()
    return [b";".join(each[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]


def _linked(ids: pa.Array, per_text: np.ndarray, chunk: np.ndarray, found: Aligned, count: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = _bounds(per_text)
    for i in range(len(per_text)):
        own = chunk[at[i] : at[i + 1]]

        def taken(bounds: np.ndarray) -> np.ndarray:
            n = np.diff(bounds)[own]  # noqa: B023
            return np.repeat(bounds[:-1][own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))  # noqa: B023

        def moved(values: np.ndarray, places: np.ndarray, bounds: np.ndarray, by: np.ndarray) -> np.ndarray:
            """Numbers counted from the slice's start, as numbers counted from the document's."""
            size = np.diff(by)[own]  # noqa: B023
            return values[places] + np.repeat(np.cumsum(size) - size - by[:-1][own], np.diff(bounds)[own])  # noqa: B023

        a, b, links = taken(found.a_at), taken(found.b_at), taken(found.link_at)
        arrays = [
            (found.a[a], pa.int32()), (found.b[b], pa.int32()),
            (moved(found.a_group, a, found.a_at, found.group_at), pa.int32()), (moved(found.b_group, b, found.b_at, found.group_at), pa.int32()),
            (moved(found.link_a, links, found.link_at, found.a_at), pa.int32()), (moved(found.link_b, links, found.link_at, found.b_at), pa.int32()),
            (count[links], pa.int64()), (best[links], pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays([ids.slice(i, 1), *[_lists([x], kind) for x, kind in arrays]], [x.split()[0] for x in LINKS.split(", ")])
