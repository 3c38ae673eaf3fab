"""Near duplicates among embeddings by a pivot-permutation index.

Every vector is described by its ``PREFIX`` nearest reference points, nearest first. Vectors whose cosine is high see the
same points near them, so candidates are the pairs that share at least ``SHARED`` of them. The inverted lists are
kept by sets of ``SHARED`` pivots: a list holds the vectors with these pivots in their prefix, a pair meets in a list
if and only if its count of shared pivots reaches ``SHARED``, and lists stay short as the table grows (there are about
``PIVOTS ** SHARED / 6`` of them). The members of a list are compared by matrix products in blocks of bounded size, in double
precision; a pair is counted in the list of its three smallest shared pivots only. No pairs leave a task: per vector
the number of its links, and a star for each group of linked vectors.

Reference points come from a bounded sample (the ``SAMPLE`` distinct vectors of smallest id hash), thinned so that
no two have a cosine above ``APART``, and are filled up to ``PIVOTS`` with random directions; so their number is the same at every
size, and a group of near copies never holds more than one. All vectors are indexed.

Links are those pairs found with cosine >= threshold; pairs that share fewer pivots are missed (the tests hold recall against
brute force). Equal vectors count as one with a weight, so copies are never compared.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors
of different lengths with each other; rows with one ``vec_id`` are one vector, the smallest usable one; rows without id are left
out; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import column_of
from graphloom.operators.components import connected_components, join_labels
from graphloom.session import cut, spread

PIVOTS = 1024
PREFIX = 7
SHARED = 3
SAMPLE = 4096
APART = 0.6
BLOCK = 4096
TILE = 1024
SEED = 11
#: Linked pairs of a tile whose shared pivots are compared at once.
STEP = 1 << 17


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)``: ``v`` is null where a vector can link with nothing."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    own = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    return own.groupBy("vec_id").agg(F.min(F.when(good, F.col("v"))).alias("v"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reference_points(sample: np.ndarray, pivots: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Sampled unit vectors that lie apart from each other, filled up with random directions."""
    nearest = np.full(len(sample), -1.0)
    chosen = []
    for i in range(len(sample)):
        if nearest[i] < apart and len(chosen) < pivots:
            chosen.append(i)
            nearest = np.maximum(nearest, sample @ sample[i])
    rest = np.random.default_rng([SEED, sample.shape[1]]).normal(size=(pivots - len(chosen), sample.shape[1]))
    return np.concatenate([sample[chosen], unit(rest)]) if len(rest) else sample[chosen]


def prefixes(x: np.ndarray, points: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """The nearest reference points of each row, nearest first, ties to the smaller number."""
    far = -(x @ points.T)
    edge = np.partition(far, length - 1, axis=1)[:, length - 1 : length]
    out = np.empty((len(x), length), np.int64)
    many = (far <= edge).sum(axis=1) > length
    if (~many).any():
        near = np.argpartition(far[~many], length - 1, axis=1)[:, :length]
        near.sort(axis=1)
        out[~many] = np.take_along_axis(near, np.argsort(np.take_along_axis(far[~many], near, axis=1), axis=1, kind="stable"), axis=1)
    if many.any():
        out[many] = np.argsort(far[many], axis=1, kind="stable")[:, :length]
    return out


def lists(prefix: np.ndarray, width: int, pivots: int = PIVOTS, shared: int = SHARED) -> np.ndarray:
    """Numbers of the inverted lists that each vector is in: one per set of ``shared`` pivots of its prefix."""
    own = np.sort(prefix, axis=1)
    out = []
    for chosen in itertools.combinations(range(prefix.shape[1]), shared):
        key = np.full(len(own), width, np.int64)
        for c in chosen:
            key = key * pivots + own[:, c]
        out.append(key)
    return np.stack(out, axis=1) if out else np.zeros((len(own), 0), np.int64)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(column.offsets.to_numpy())
    for width in np.unique(sizes):
        yield int(width), np.flatnonzero(sizes == width)


class Index:
    """Reference points per vector length; a length the sample does not hold has random ones."""

    def __init__(self, sample: list[list[float]]):
        by_length: dict[int, list] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        self.points = {width: reference_points(unit(np.array(rows))) for width, rows in by_length.items()}

    def at(self, width: int) -> np.ndarray:
        if width not in self.points:
            self.points[width] = reference_points(np.zeros((0, width)))
        return self.points[width]


def indexed(reps: DataFrame) -> DataFrame:
    """``(vec_id, v, copies, prefix, lists)`` of ``(vec_id, v, copies)``."""
    sample = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v")
    held = reps.sparkSession.sparkContext.broadcast(Index([r.v for r in sample.toLocalIterator()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            v = column_of(batch, "v")
            for width, rows in _by_length(v):
                part = batch.take(pa.array(rows))
                prefix = prefixes(unit(_matrix(column_of(part, "v"))), index.at(width))
                keys = lists(prefix, width)
                columns = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), kind), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((prefix.astype(np.int32), pa.int32()), (keys, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], ["vec_id", "v", "copies", "prefix", "lists"])

    kind = reps.schema["v"].dataType.simpleString()
    return spread(reps).select("vec_id", "v", "copies").mapInArrow(run, f"vec_id long, v {kind}, copies long, prefix array<int>, lists array<long>")


def compare(ids: np.ndarray, x: np.ndarray, copies: np.ndarray, prefix: np.ndarray, side: np.ndarray, key: int, threshold: float, pivots: int = PIVOTS, shared: int = SHARED):
    """``(vec_id, n, root)`` of the vectors of one pair of blocks that have links: their weight, and the smallest id linked with it here.

    A pair whose three smallest shared pivots are others belongs to another list: it shares a pivot that is
    smaller than the largest of this list and none of its own.
    """
    own = [key // pivots**k % pivots for k in range(shared)]
    others = np.sort(prefix, axis=1)
    others = np.where((others < max(own)) & ~np.isin(others, own), others, -1 - np.arange(len(ids))[:, None])
    triangle = not (side == 2).any()
    left = np.flatnonzero(side != 2)
    right = left if triangle else np.flatnonzero(side == 2)
    n, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i in range(0, len(left), TILE):
        rows = left[i : i + TILE]
        for j in range(i if triangle else 0, len(right), TILE):
            cols = right[j : j + TILE]
            keep = x[rows] @ x[cols].T >= threshold
            if triangle and i == j:
                keep = np.triu(keep, k=1)
            r, c = np.nonzero(keep)
            r, c = rows[r], cols[c]
            labels = join_labels(labels, r, c)
            for s in range(0, len(r), STEP):
                a, b = r[s : s + STEP], c[s : s + STEP]
                here = ~(others[a][:, :, None] == others[b][:, None, :]).any(axis=(1, 2))
                np.add.at(n, a[here], copies[b[here]])
                np.add.at(n, b[here], copies[a[here]])
    groups = np.bincount(labels, minlength=len(ids))
    linked = np.flatnonzero((n > 0) | (groups[labels] > 1))
    return ids[linked], n[linked], ids[labels[linked]]


def _tasks(index: DataFrame, block: int) -> DataFrame:
    """The members of each inverted list of two or more, by pairs of blocks of bounded size."""
    entries = index.select("vec_id", F.explode("lists").alias("list"))
    sizes = entries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    listed = entries.join(sizes, "list").select("list", "vec_id", blocks.alias("blocks")).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    b, i = F.col("b"), F.col("i")
    side = F.when(F.col("blocks") == 1, 0).when(i == b, 0).when(b < i, 1).otherwise(2)
    return listed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "vec_id", "list", F.least(i, b).alias("bi"), F.greatest(i, b).alias("bj"), side.cast("int").alias("side")
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of a sorted partition; only the last key's rows wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [column_of(batch, k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in own], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        if held and any(column_of(held[-1], k)[-1].as_py() != x[0] for k, x in zip(keys, own, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for edge in edges.tolist():
            yield pa.Table.from_batches([*held, batch.slice(at, edge - at)])
            held, at = [], edge
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def found_links(reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n, root)``: links of a vector in one task, by weight, and the smallest id of its group there."""
    index = cut(indexed(reps))
    tasks = _tasks(index.select("vec_id", "lists"), block).join(index.drop("lists"), "vec_id")
    keys = ["list", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, keys):
            get = lambda name: rows.column(name).to_numpy()  # noqa: B023, E731
            prefix = _matrix(rows.column("prefix").combine_chunks()).astype(np.int64)
            x = unit(_matrix(rows.column("v").combine_chunks()))
            made = compare(get("vec_id"), x, get("copies"), prefix, get("side"), rows.column("list")[0].as_py(), threshold)
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], ["vec_id", "n", "root"])

    dealt = tasks.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select("vec_id", "v", "copies", "prefix", *keys, "side").mapInArrow(run, "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per vector: links found, the smallest id of its group, and whether it is that."""
    rows = cut(usable(vectors))
    copies = rows.where("v IS NOT NULL").groupBy(F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(SEED), "v").alias("k2"))
    reps = cut(copies.agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    found = cut(found_links(reps, threshold, block))
    n = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    links = found.where("vec_id <> root").select(F.lit(0).alias("graph_id"), F.col("vec_id").alias("id1"), F.col("root").alias("id2"))
    roots = connected_components(links).select(F.col("node_id").alias("vec_id"), "root")
    known = reps.drop("v").join(n, "vec_id", "left").join(roots, "vec_id", "left")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    keyed = rows.where("v IS NOT NULL").select("vec_id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(SEED), "v").alias("k2"))
    out = keyed.join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
