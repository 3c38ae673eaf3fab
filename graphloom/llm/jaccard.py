"""Jaccard join of word n-gram sets with prefix trees.

Sets are ordered by one global order, rare n-grams first (counted over all documents in a sketch of
fixed size; ties by hash). Sets that are similar enough share an n-gram of their prefixes, so the
prefixes, packed and dealt by n-gram, give groups of sets that may be linked. Groups with the same
members are one group, and equal sets are one set throughout.

A group is first compared with its lowest member. Whoever is linked to it needs no further comparison with
others of the same component; only groups that still hold several components are looked at in full, in
cells of two blocks of bounded size: first by parity signatures (an eighth of a byte an n-gram, and a lower
bound of the difference of two sets). Whoever possible pairs connect, over all groups, makes one group then, so that a set
is sent once and not with every n-gram it shares. Every comparison stores one side of a cell in a trie of
the ordered sets, walks it once per set of the other side with the partial overlap of each shared path, and
leaves a subtree when the lengths that remain cannot reach the overlap that is needed. A cell emits a forest of
its links, never all pairs.

Defined results: a document under ``size`` words has its whole sequence as only n-gram; without words or text
its set is empty, and it is linked with nothing; equal sets are linked; rows with the same ``doc_id`` are
one node; a null ``doc_id`` counts as largest and is never a component's id unless alone; an empty table
gives no rows; other columns are ignored (``representatives`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.repeats import LAST, identified
from graphloom.llm.tables import unused
from graphloom.llm.tokens import Words, column_of, grams, int64s, join_hash, mix, slices
from graphloom.operators.components import connected_components
from graphloom.session import cut

SIZE = 5
PERCENT = 80
SKETCH_BITS = 18
SKETCH_BLOCKS = 16
DEAL_ROWS = 1_000_000
FLUSH = 1_000_000
HOT = 2_000
STAR_CELL = 512
BLOCK = 512
FILTER_BITS = 24


def least_overlap(p: np.ndarray | int, n: np.ndarray | int, percent: int = PERCENT):
    """Smallest overlap with which sets of these sizes are linked."""
    return -(-(percent * (p + n)) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-(percent * n) // 100) + 1


class Sets:
    """Distinct n-grams of each text of a slice: ``tokens`` by row, ``bounds``, sizes and set keys."""

    def __init__(self, column: pa.Array, size: int = SIZE):
        words = Words(column, "lower")
        count = words.counts
        parts = [grams(words.hashes, words.first, size)]
        for n in range(1, size):
            if (count == n).any():
                value, at = grams(words.hashes, words.first, n)
                own = count[np.searchsorted(words.first, at, side="right") - 1] == n
                parts.append((value[own], at[own]))
        token = np.concatenate([p[0] for p in parts])
        row = np.searchsorted(words.first, np.concatenate([p[1] for p in parts]), side="right") - 1
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        self.tokens, self.rows = token[fresh], row[fresh]
        self.bounds = np.searchsorted(self.rows, np.arange(len(count) + 1))
        self.sizes = np.diff(self.bounds)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.tokens ^ np.uint64(0xA5)), dtype=np.uint64)])
        self.keys = mix(total[self.bounds[1:]] - total[self.bounds[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def signatures(self) -> list[bytes]:
        """Parity bits of each set: bit ``token mod m`` for a power of two ``m`` of at least the set's size and 64.

        Two signatures, the longer one folded, differ in at most as many bits as their sets in n-grams.
        """
        bits = 1 << np.ceil(np.log2(np.maximum(self.sizes, 64))).astype(np.int64)
        start = np.cumsum(bits) - bits
        at = start[self.rows] + (self.tokens & (bits[self.rows] - 1).astype(np.uint64)).astype(np.int64)
        packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
        return [packed[a : a + b].tobytes() for a, b in zip((start // 8).tolist(), (bits // 8).tolist(), strict=True)]

    def ordered(self, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens in the global order within each row, and their sketched counts."""
        seen = sketch[self.tokens & np.uint64(len(sketch) - 1)]
        order = np.lexsort((self.tokens, seen, self.rows))
        return self.tokens[order], seen[order]


def set_keys(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(d, h, n, k, sig)``: size, key and signature of each row's set; equal sets have equal keys."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = Sets(column_of(batch, "text"), size)
            yield pa.RecordBatch.from_arrays([column_of(batch, "d"), column_of(batch, "h"), pa.array(sets.sizes), pa.array(sets.keys), pa.array(sets.signatures(), pa.binary())], ["d", "h", "n", "k", "sig"])

    return identified(docs).mapInArrow(find, "d long, h long, n long, k long, sig binary")


def sketch_counts(docs: DataFrame, size: int = SIZE, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of n-grams over all documents by the low bits of their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in slices(batches):
            total += np.bincount((Sets(column_of(batch, "text"), size).tokens & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        parts = np.split(total, SKETCH_BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in rows["counts"].to_pylist())
        return pa.table({"block": rows["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = identified(docs).select("text").mapInArrow(count, "block int, counts binary")
    rows = parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros((SKETCH_BLOCKS, (1 << bits) // SKETCH_BLOCKS), np.int64)
    for row in rows:
        out[row.block] = np.frombuffer(row.counts, np.int64)
    return out.ravel()


_ENTRY = np.dtype([("token", "<u8"), ("k", "<i8"), ("n", "<i4"), ("hot", "<i4")])


def _dealt_prefixes(docs: DataFrame, sketch: np.ndarray, size: int, percent: int, parts: int) -> DataFrame:
    """``(part, entries)``: prefix n-grams of all sets, packed; all of one n-gram have one part, a hot one several."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in slices(batches):
            sets = Sets(column_of(batch, "text"), size)
            tokens, seen = sets.ordered(held.value)
            rank = np.arange(len(tokens)) - np.repeat(sets.bounds[:-1], sets.sizes)
            use = np.flatnonzero(rank < np.repeat(prefix_length(sets.sizes, percent), sets.sizes))
            made = np.empty(len(use), _ENTRY)
            made["token"], made["k"], made["n"] = tokens[use], sets.keys[sets.rows[use]], sets.sizes[sets.rows[use]]
            # an estimate far above the sketch's level is that of a frequent n-gram
            level = held.value.mean()
            made["hot"] = np.maximum(0, (seen[use] - 4 * level) // HOT)
            waiting.append(made)
            if sum(map(len, waiting)) >= FLUSH:
                yield _packed(np.concatenate(waiting), parts)
                waiting = []
        if waiting:
            yield _packed(np.concatenate(waiting), parts)

    return identified(docs).select("text").mapInArrow(deal, "part int, entries binary")


def _packed(entries: np.ndarray, parts: int) -> pa.RecordBatch:
    spread = mix(entries["k"].view(np.uint64)) % np.maximum(entries["hot"], 1).astype(np.uint64)
    part = (mix(entries["token"] + spread) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, entries = part[order], entries[order]
    at = np.flatnonzero(np.r_[True, np.diff(part) != 0]) if len(part) else np.zeros(0, np.int64)
    blobs = [e.tobytes() for e in np.split(entries, at[1:])] if len(part) else []
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "entries"])


MEMBER = "gid long, top long, k long, n long, pivot long, pivot_n long"


def _members(entries: np.ndarray) -> pa.RecordBatch:
    """Rows of ``MEMBER`` of one part: groups of sets that share a prefix n-gram, each group once.

    A hot n-gram's sets are spread over parts: each part's own group joins the whole (``top``) by
    its lowest member, in a row without pivot.
    """
    entries = entries[np.lexsort((entries["k"], entries["token"]))]
    fresh = np.ones(len(entries), bool)
    fresh[1:] = (entries["token"][1:] != entries["token"][:-1]) | (entries["k"][1:] != entries["k"][:-1])
    entries = entries[fresh]
    at = np.flatnonzero(np.r_[True, entries["token"][1:] != entries["token"][:-1]]) if len(entries) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(entries)))
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix(entries["k"].view(np.uint64)), at) if len(at) else np.zeros(0, np.uint64)
    hot = entries["hot"][at] > 1
    whole = join_hash(entries["token"][at], count.astype(np.uint64) * np.uint64(0), 11)
    gid = np.where(hot, join_hash(whole, total, 12), join_hash(total, count.astype(np.uint64), 13))
    top = np.where(hot, whole, gid)
    use = np.flatnonzero((count > 1) | hot)
    use = use[np.unique(gid[use], return_index=True)[1]]
    n = count[use]
    place = np.repeat(at[use] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    first = np.repeat(at[use], n)
    columns = [np.repeat(gid[use], n), np.repeat(top[use], n), entries["k"][place], entries["n"][place], entries["k"][first], entries["n"][first]]
    lead = use[hot[use]]
    columns = [np.concatenate([c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), e]) for c, e in zip(columns, [
        join_hash(whole[lead], whole[lead], 14).view(np.int64), whole[lead].view(np.int64), entries["k"][at[lead]].astype(np.int64), entries["n"][at[lead]].astype(np.int64),
        np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64),
    ], strict=True)]
    arrays = [pa.array(c) for c in columns]
    no_pivot = pa.array(np.r_[np.zeros(int(n.sum()), bool), np.ones(len(lead), bool)])
    arrays[4] = pa.array(columns[4], mask=no_pivot.to_numpy(zero_copy_only=False))
    arrays[5] = pa.array(columns[5], mask=no_pivot.to_numpy(zero_copy_only=False))
    return pa.RecordBatch.from_arrays(arrays, ["gid", "top", "k", "n", "pivot", "pivot_n"])


def candidate_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Distinct rows of ``MEMBER``."""
    sketch = sketch_counts(docs, size)
    parts = max(1, int(sketch.sum()) * (100 - percent) // 100 // DEAL_ROWS)
    dealt = _dealt_prefixes(docs, sketch, size, percent, parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part and held:
                    yield from _bounded(_members(np.concatenate(held)))
                    held = []
                part = p
                held.append(np.frombuffer(blob.as_buffer(), _ENTRY).copy())
        if held:
            yield from _bounded(_members(np.concatenate(held)))

    sorted_parts = dealt.repartition(parts, "part").sortWithinPartitions("part")
    return sorted_parts.mapInArrow(gather, MEMBER).distinct(), sketch


def _bounded(batch: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Trie:
    """Compressed prefix tree of sets of ranks, frequent ranks first."""

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray):
        self.values, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        seen = sketch[self.values & np.uint64(len(sketch) - 1)]
        place = np.empty(len(self.values), np.int64)
        place[np.lexsort((self.values, -seen))] = np.arange(len(self.values))
        self.place = place
        bounds = np.cumsum([0, *map(len, sets)])
        own = [np.sort(place[ranks[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        keys = [r.astype(">u4").tobytes() for r in own]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        parent, start, stop, owner, depth = [0], [0], [0], [0], [0]
        low, high, leaf_of = [1 << 60], [0], np.zeros(len(sets), np.int64)
        path, before = [0], np.zeros(0, np.int64)
        for i in self.order:
            now = own[i]
            m = min(len(before), len(now))
            differs = np.flatnonzero(before[:m] != now[:m])
            shared = int(differs[0]) if len(differs) else m
            last = 0
            while stop[path[-1]] > shared:
                last = path.pop()
            if stop[path[-1]] < shared:  # part of the edge to `last` is shared
                parent.append(path[-1])
                start.append(stop[path[-1]])
                stop.append(shared)
                owner.append(owner[last])
                low.append(low[last])
                high.append(high[last])
                parent[last], start[last] = len(parent) - 1, shared
                path.append(len(parent) - 1)
            parent.append(path[-1])
            start.append(stop[path[-1]])
            stop.append(len(now))
            owner.append(i)
            low.append(len(now))
            high.append(len(now))
            path.append(len(parent) - 1)
            leaf_of[i] = path[-1]
            for node in path:
                low[node], high[node] = min(low[node], len(now)), max(high[node], len(now))
            before = now
        self.parent, self.low, self.high, self.stop = (np.array(x) for x in (parent, low, high, stop))
        edges = [own[o][a:b] for o, a, b in zip(owner, start, stop, strict=True)]
        edges[0] = edges[0][:0]
        self.edge_length = np.array([len(e) for e in edges])
        self.edge_start = np.cumsum(self.edge_length) - self.edge_length
        self.edge = np.concatenate(edges)
        self.last_rank = np.array([own[o][b - 1] if b else -1 for o, b in zip(owner, stop, strict=True)])
        self.leaf_of, self.sizes = leaf_of, np.array([len(o) for o in own])
        self.set_at = np.full(len(parent), -1, np.int64)
        self.set_at[leaf_of] = np.arange(len(sets))
        self.same_leaf = len(sets) != len(np.unique(leaf_of))
        children: list[list[int]] = [[] for _ in parent]
        for node, p in enumerate(parent[1:], 1):
            children[p].append(node)
        self.child_start = np.cumsum([0, *map(len, children)])
        self.child = np.array([c for cs in children for c in cs], np.int64)

    def linked(self, tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Indices of the stored sets that are linked to this one."""
        p = len(tokens)
        at = np.minimum(np.searchsorted(self.values, tokens), len(self.values) - 1)
        member = np.zeros(len(self.values) + 1, bool)
        member[self.place[at[self.values[at] == tokens]]] = True
        upto = np.cumsum(member)
        known = int(upto[-1])
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            sets = self.set_at[nodes]
            here = sets >= 0
            ok = overlap[here] * (100 + percent) >= percent * (p + self.sizes[sets[here]])
            found.append(sets[here][ok])
            n = self.child_start[nodes + 1] - self.child_start[nodes]
            children = self.child[np.repeat(self.child_start[nodes] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            if len(children) == 0:
                break
            shared = np.repeat(overlap, n)
            # lengths alone: before the edge is read
            fits = (100 * self.high[children] >= percent * p) & (percent * self.low[children] <= 100 * p)
            children, shared = children[fits], shared[fits]
            n = self.edge_length[children]
            inside = np.concatenate([[0], np.cumsum(member[self.edge[np.repeat(self.edge_start[children] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]])])
            ends = np.cumsum(n)
            shared = shared + inside[ends] - inside[ends - n]
            rest = np.minimum(known - upto[np.maximum(self.last_rank[children], 0)], self.high[children] - self.stop[children])
            alive = shared + rest >= least_overlap(p, self.low[children], percent)
            nodes, overlap = children[alive], shared[alive]
        return np.concatenate(found)


def cell_links(stored: list[tuple[int, np.ndarray]], probes: list[tuple[int, np.ndarray]], sketch: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the links between the probes and the stored sets of a cell."""
    trie = Trie([t for _, t in stored], sketch)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, tokens in probes:
        for j in trie.linked(tokens, percent).tolist():
            a, b = find(k), find(stored[j][0])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((k, stored[j][0]))
    return out


def _key_filter(wanted: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of a key's low bits, set where a wanted key has it; of fixed size."""
    x = F.pmod(F.col("k"), F.lit(1 << bits)) + 1
    rows = wanted.groupBy(F.bitmap_bucket_number(x).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bitmap")).collect()
    out = np.zeros((max(1, (1 << bits) // 32_768), 4_096), np.uint8)
    for row in rows:
        out[row.bucket - 1] = np.frombuffer(row.bitmap, np.uint8)
    return out.ravel()


def _set_tokens(docs: DataFrame, wanted: DataFrame, sketch: np.ndarray, size: int) -> DataFrame:
    """``(k, tokens)`` of the wanted sets and, where low bits agree, of some others.

    Texts stay where they are read: a filter of fixed size tells which sets to send at all.
    """
    held = docs.sparkSession.sparkContext.broadcast((sketch, _key_filter(wanted)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, bitmap = held.value
        for batch in slices(batches):
            sets = Sets(column_of(batch, "text"), size)
            low = sets.keys & (len(bitmap) * 8 - 1)
            use = np.flatnonzero((bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool) & (sets.sizes > 0))
            if len(use) == 0:
                continue
            use = use[np.unique(sets.keys[use], return_index=True)[1]]
            tokens, _ = sets.ordered(sketch)
            blobs = [tokens[sets.bounds[i] : sets.bounds[i + 1]].tobytes() for i in use]
            yield pa.RecordBatch.from_arrays([pa.array(sets.keys[use]), pa.array(blobs, pa.binary())], ["k", "tokens"])

    return identified(docs).select("text").mapInArrow(find, "k long, tokens binary").dropDuplicates(["k"])


def _folded(signatures: list[bytes], words: int) -> np.ndarray:
    """Signatures of one length as rows of 64-bit words, folded to ``words`` of them."""
    out = np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)
    while out.shape[1] > words:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def may_be_linked(stored: list[tuple], probes: list[tuple], percent: int = PERCENT) -> np.ndarray:
    """Which of the stored sets ``(k, component, n, signature)`` may be linked to which of the probes.

    A pair is possible if it has two components, sizes near enough, and signatures that differ in no more
    bits than linked sets can differ in n-grams.
    """
    out = np.zeros((len(stored), len(probes)), bool)
    by_length: list[dict[int, list[int]]] = [{}, {}]
    for side, rows in enumerate((stored, probes)):
        for i, row in enumerate(rows):
            by_length[side].setdefault(len(row[3]), []).append(i)
    for a, own in by_length[0].items():
        for b, others in by_length[1].items():
            words = min(a, b) // 8
            one, two = _folded([stored[i][3] for i in own], words), _folded([probes[j][3] for j in others], words)
            c1, n1 = (np.array([stored[i][x] for i in own]) for x in (1, 2))
            c2, n2 = (np.array([probes[j][x] for j in others]) for x in (1, 2))
            near = 100 * np.minimum(n1[:, None], n2[None]) >= percent * np.maximum(n1[:, None], n2[None])
            near &= c1[:, None] != c2[None]
            step = max(1, (1 << 20) // (len(others) * words))
            for at in range(0, len(own), step):
                part = slice(at, at + step)
                if near[part].any():
                    differ = np.bitwise_count(one[part, None, :] ^ two[None]).sum(2, dtype=np.int64)
                    near[part] &= differ <= (100 - percent) * (n1[part, None] + n2[None]) // (100 + percent)
            out[np.ix_(own, others)] = near
    return out


def _classes(possible: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a matrix of possible pairs."""
    left = possible.any(1)
    while left.any():
        rows = np.zeros(len(left), bool)
        rows[np.argmax(left)] = True
        while True:
            columns = possible[rows].any(0)
            more = possible[:, columns].any(1)
            if (more == rows).all():
                break
            rows = more
        left &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


def _grouped(batches: Iterator[pa.RecordBatch], values) -> Iterator[tuple[int, list, list]]:
    """``(cell, stored, probes)`` of rows sorted by cell; ``values(batch)`` gives an iterator of row values."""
    cell, sides = None, ([], [])
    for batch in batches:
        for c, probe, value in zip(int64s(column_of(batch, "cell")).tolist(), column_of(batch, "probe").to_pylist(), values(batch), strict=True):
            if c != cell:
                if sides[0] and sides[1]:
                    yield cell, *sides
                cell, sides = c, ([], [])
            sides[probe].append(value)
    if sides[0] and sides[1]:
        yield cell, *sides


def _signed_rows(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """``cells(cell, probe, k, c)`` with sizes and signatures, sorted by cell."""
    signs = keys.join(cells.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    return cells.join(signs, "k").repartition("cell").sortWithinPartitions("cell").select("cell", "probe", "k", "c", "n", "sig")


def _values(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column_of(batch, c).to_pylist() for c in ("k", "c", "n", "sig")), strict=True)


def _in_batches(rows: Iterator[tuple], schema: dict[str, pa.DataType], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), schema.values(), strict=True)], list(schema))


def _possible(cells: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """The rows of ``cells(cell, probe, k, c)`` that have a possible partner, as ``(cell, probe, k)``."""

    def rows_of(batches):
        for cell, stored, probes in _grouped(batches, _values):
            pairs = may_be_linked(stored, probes, percent)
            yield from ((cell, False, stored[i][0]) for i in np.flatnonzero(pairs.any(1)))
            yield from ((cell, True, probes[j][0]) for j in np.flatnonzero(pairs.any(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(rows_of(batches), {"cell": pa.int64(), "probe": pa.bool_(), "k": pa.int64()})

    return _signed_rows(cells, keys).mapInArrow(run, "cell long, probe boolean, k long")


def _possible_groups(cells: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """``(top, k)``: the sets that possible pairs of any cell connect, each set in one group."""

    def rows_of(batches):
        for _, stored, probes in _grouped(batches, _values):
            for rows, columns in _classes(may_be_linked(stored, probes, percent)):
                own = {stored[i][0] for i in rows} | {probes[j][0] for j in columns}
                lowest = min(own)
                yield from ((lowest, k) for k in own if k != lowest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(rows_of(batches), {"id1": pa.int64(), "id2": pa.int64()})

    found = cut(_components(_signed_rows(cells, keys).mapInArrow(run, "id1 long, id2 long").distinct()))
    return found.select(F.col("root").alias("top"), "k").unionByName(found.select(F.col("root").alias("top"), F.col("root").alias("k")).distinct())


def _linked(cells: DataFrame, docs: DataFrame, keys: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """``(id1, id2)``: links found in ``cells(cell, probe, k, c)`` between sets of different components."""
    cells = cut(_possible(cells, keys, percent))
    sets = _set_tokens(docs, cells, sketch, size)
    rows = cells.join(sets, "k").repartition("cell").sortWithinPartitions("cell")
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values(batch):
            return ((k, np.frombuffer(b.as_py(), np.uint64)) for k, b in zip(int64s(column_of(batch, "k")).tolist(), column_of(batch, "tokens"), strict=True))

        links = (link for _, stored, probes in _grouped(batches, values) for link in cell_links(stored, probes, held.value, percent))
        yield from _in_batches(links, {"id1": pa.int64(), "id2": pa.int64()})

    return rows.select("cell", "probe", "k", "tokens").mapInArrow(run, "id1 long, id2 long")


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links.select(F.lit(0).alias("graph_id"), "id1", "id2"))
    return found.select(F.col("node_id").alias("k"), "root")


def _star_cells(members: DataFrame, percent: int) -> DataFrame:
    """Each group's lowest member against the others, in cells of at most about ``STAR_CELL`` sets."""
    known = members.where("pivot IS NOT NULL").select("pivot", "pivot_n", "k", "n")
    lead = members.where("pivot IS NULL")
    lowest = lead.groupBy("gid").agg(F.min(F.struct("k", "n")).alias("low"))
    tied = lead.join(lowest, "gid").select(F.col("low.k").alias("pivot"), F.col("low.n").alias("pivot_n"), "k", "n")
    edges = known.unionByName(tied).where("k <> pivot").where(F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent)
    edges = edges.select("pivot", "k").distinct()
    size = edges.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR_CELL).alias("cells"))
    placed = edges.join(size, "pivot").select("pivot", "k", F.xxhash64("pivot", F.pmod(F.xxhash64("k"), "cells")).alias("cell"))
    cells = placed.select("cell", F.lit(False).alias("probe"), "k").unionByName(placed.select("cell", F.lit(True).alias("probe"), F.col("pivot").alias("k")).distinct())
    return cells.withColumn("c", F.col("k"))


def _block_cells(members: DataFrame, components: DataFrame, least: int) -> DataFrame:
    """Groups of at least ``least`` sets that still hold several components, in cells of two blocks."""
    own = members.select("top", "k").distinct().join(components, "k", "left").select("top", "k", F.coalesce("root", "k").alias("c"))
    own = cut(own)
    size = own.groupBy("top").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("c0"), F.max("c").alias("c1")).where((F.col("rows") >= least) & (F.col("c0") < F.col("c1")))
    blocks = own.join(size.select("top", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "top")
    block = F.pmod(F.xxhash64("k"), "blocks").cast("int")
    paired = blocks.select("top", "k", "c", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    cell = F.xxhash64("top", F.least("b", "o"), F.greatest("b", "o"))
    placed = paired.select(cell.alias("cell"), "k", "c", "b", "o")
    stored, probes = placed.where("b <= o"), placed.where("b >= o")
    return stored.select("cell", F.lit(False).alias("probe"), "k", "c").unionByName(probes.select("cell", F.lit(True).alias("probe"), "k", "c"))


def _classed(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``keys`` with the class ``c`` of their linked sets."""
    keys = cut(set_keys(docs, size))
    members, sketch = candidate_groups(docs, size, percent)
    members = cut(members)
    stars = cut(_linked(_star_cells(members, percent), docs, keys, sketch, size, percent))
    known = cut(_components(stars))
    # a group of two has been compared already
    groups = cut(_possible_groups(_block_cells(members, known, 3), keys, percent))
    blocks = _linked(_block_cells(groups, known, 2), docs, keys, sketch, size, percent)
    # rows of one doc_id are one node: their sets are linked too
    filled = keys.where("n > 0")
    several = filled.groupBy("d").agg(F.min("k").alias("id1"), F.max("k").alias("top")).where((F.col("id1") < F.col("top")) & (F.col("d") < LAST))
    same = filled.join(several, "d").where("k <> id1").select("id1", F.col("k").alias("id2")).distinct()
    found = _components(stars.unionByName(blocks).unionByName(same))
    return keys.join(found, "k", "left").withColumn("c", F.coalesce("root", "k"))


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``(d, h, n, component)`` of every row of ``docs``."""
    classed = _classed(docs, size, percent)
    lowest = classed.where("n > 0").groupBy("c").agg(F.min("d").alias("m"))
    lone = classed.where("n = 0").select("d", "h", "n", F.col("d").alias("component"))
    return classed.where("n > 0").join(lowest, "c").select("d", "h", "n", F.col("m").alias("component")).unionByName(lone)


def _id(column: str):
    return F.when(F.col(column) < LAST, F.col(column))


def digest(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    return components(docs, size, percent).select(_id("d").alias("doc_id"), F.col("n").alias("n_shingles"), _id("component").alias("component_id"))


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest ``doc_id`` (null last), then text hash; of equal rows any.

    Texts without words are alone: one row for each of their ids, and without an id one for each text.
    """
    classed = _classed(docs, size, percent)
    least = F.min(F.struct("d", "h")).alias("_k")
    one = classed.where("n > 0").groupBy("c").agg(least).select("_k.d", "_k.h")
    lone = classed.where("n = 0").groupBy("d", F.when(F.col("d") == LAST, F.col("h")).alias("own")).agg(least).select("_k.d", "_k.h")
    d, h = unused(docs, "_d", "_h")
    keep = one.unionByName(lone).select(F.col("d").alias(d), F.col("h").alias(h)).distinct()
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), h: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(keep, [d, h], "left_semi").dropDuplicates([d, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
