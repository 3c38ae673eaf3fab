"""Nearest neighbours by collision counting over single projections.

Vectors are dealt into blocks. A block keeps, for each of ``m`` random projections, its vectors
in sorted order. A query opens a window around its own projection in every array; the windows
grow with a search radius (virtual rehashing: nothing is hashed again) and every vector that comes
into a window collides once more. A vector with ``threshold`` collisions is verified: its exact distance
is computed. A block is done once ``k`` verified vectors lie within the radius, or once
``k + budget`` vectors are verified, or all are. The nearest of all blocks are merged.

Blocks and groups of queries have bounded sizes, and each pair of them is one task group, so no task
grows with the table. Of equal vectors only the ``k + 1`` smallest ids can be among the nearest
of any query; the others are left out as candidates (never as queries) before the search.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do those of another length than the most frequent one; rows with the same ``vec_id`` count
once (the smallest vector); ties go to the smaller ``vec_id``; with fewer candidates than ``k`` all that were
found are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16_384
QUERY_GROUP = 8_192
RATIO = 2.0
BUDGET = 2000
GROWTH = 1.2
SEED = 7


def parameters(n: int, ratio: float = RATIO) -> tuple[int, int, float]:
    """``(projections, collision threshold, window width)`` for ``n`` vectors.

    A vector at distance R falls into a window of width wR with probability p1, one at distance
    ratio·R with p2; the number of projections makes the threshold between both hold with error 1/e
    for near vectors and 100/n for far ones.
    """
    width = math.sqrt(8 * ratio**2 * math.log(ratio) / (ratio**2 - 1))
    p1, p2 = (math.erf(width / r / 2 / math.sqrt(2)) for r in (1, ratio))
    far, near = math.sqrt(math.log(2 / min(1.0, 100 / max(n, 1)))), 1.0
    m = math.ceil((far + near) ** 2 / (2 * (p1 - p2) ** 2))
    return m, math.ceil(m * (far * p1 + near * p2) / (far + near)), width


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part, of any length."""
    v = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.where(finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, budget: int = BUDGET, ratio: float = RATIO) -> list[tuple]:
    """``(query, vector, distance)``: for each query the ``k`` nearest found in one block."""
    n, d = x.shape
    m, threshold, width = parameters(n, ratio)
    axes = np.random.default_rng([SEED, d, m]).normal(size=(d, m))
    projected, centre = x @ axes, q @ axes
    order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
    arrays = np.take_along_axis(projected, order.T.astype(np.int64), axis=0).T
    spread = max(float(np.median(arrays.std(axis=1))), 1e-300)
    reach = max(float(np.abs(arrays).max()), float(np.abs(centre).max()), spread)
    radii = spread / 32 * GROWTH ** np.arange(math.ceil(math.log(64 * reach / spread + 64) / math.log(GROWTH)) + 1)
    out = []
    for at in range(0, len(q), 256):
        some = centre[at : at + 256]
        sides = some[None] + np.concatenate([-radii, radii])[:, None, None] * width / 2
        place = np.stack([np.searchsorted(arrays[i], sides[:, :, i], side="left") for i in range(m)], axis=2)
        low, high = place[: len(radii)], place[len(radii) :]
        for r in range(len(some)):
            collisions = np.zeros(n, np.int32)
            pending = np.ones(n, bool)
            pending[ids == query_ids[at + r]] = False
            total = int(pending.sum())
            found, distance = np.zeros(0, np.int64), np.zeros(0)
            a = b = None
            for step, radius in enumerate(radii):
                lo, hi = low[step, r], high[step, r]
                if a is None:
                    pieces = [order[i, lo[i] : hi[i]] for i in range(m)]
                else:
                    pieces = [order[i, lo[i] : a[i]] for i in range(m)] + [order[i, b[i] : hi[i]] for i in range(m)]
                a, b = lo, hi
                collisions += np.bincount(np.concatenate(pieces), minlength=n).astype(np.int32)
                fresh = np.flatnonzero(pending & (collisions >= threshold))
                if len(fresh):
                    pending[fresh] = False
                    found = np.concatenate([found, fresh])
                    distance = np.concatenate([distance, np.sqrt(((x[fresh] - q[at + r]) ** 2).sum(axis=1))])
                if len(found) >= min(k + budget, total) or (distance <= radius).sum() >= k:
                    break
            best = np.lexsort((ids[found], distance))[:k]
            out += [(int(query_ids[at + r]), int(ids[found[j]]), float(distance[j])) for j in best]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, group: int = QUERY_GROUP, budget: int = BUDGET) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest vectors found for each query.

    ``queries`` holds rows of the same form as ``vectors``; a query never finds its own id.
    """
    data = usable(vectors)
    top = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    of_length = F.size("v") == (top.d if top else 0)
    data = data.where(of_length)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    data = data.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    asked = usable(queries).where(of_length)
    blocks = max(1, -(-data.count() // block))
    groups = max(1, -(-asked.count() // group))
    side = F.array([F.lit(g) for g in range(groups)]) if groups < 1000 else F.sequence(F.lit(0), F.lit(groups - 1))
    cells = data.select(F.lit(False).alias("is_query"), "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(side).alias("part")).unionByName(
        asked.select(
            F.lit(True).alias("is_query"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part")
        )
    )

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, asks = rows["vec_id"].to_numpy(), rows["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        found = search_block(ids[~asks], v[~asks], ids[asks], v[asks], k, budget) if asks.any() and (~asks).any() else []
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = cells.groupBy("block", "part").applyInArrow(search, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
