"""Connected components of similarity links, for all graphs at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

NODE = ["graph_id", "u"]


def _with_lowest(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Each edge beside the lowest neighbour of ``u``; a hub's edges may split over tasks."""
    return edges.join(lowest, NODE)


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the lowest id around that node."""
    both = edges.unionByName(edges.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy(*NODE).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return (
        _with_lowest(both, lowest)
        .where("v > u")
        .select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the lowest of them."""
    lowest = edges.groupBy(*NODE).agg(F.min("v").alias("m"))
    siblings = _with_lowest(edges, lowest).where("v <> m").select("graph_id", F.col("v").alias("u"), F.col("m").alias("v"))
    own = lowest.select("graph_id", "u", F.col("m").alias("v"))
    return siblings.unionByName(own).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("graph_id", "u", "v")).alias("x")).first()
    return row.n, row.x


def connected_components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(graph_id, node_id, root)`` for every linked node that is not its own root.

    Alternating large-star and small-star rounds: a logarithmic number of rounds, and the
    edge set never grows beyond its start. Each round is written to the checkpoint folder.
    """
    edges = links.select("graph_id", F.greatest("id1", "id2").alias("u"), F.least("id1", "id2").alias("v"))
    edges = cut(edges.where("u <> v").distinct())
    seen = _signature(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        edges = cut(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return edges.select("graph_id", F.col("u").alias("node_id"), F.col("v").alias("root"))


def canonical_ids(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``(graph_id, node_id, canonical_id)`` for every node; an unmerged node is its own."""
    return (
        nodes.select("graph_id", "node_id")
        .join(components, ["graph_id", "node_id"], "left")
        .select("graph_id", "node_id", F.coalesce("root", "node_id").alias("canonical_id"))
    )


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows ``a`` with rows ``b``; a label is the lowest row of its group."""
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        low, high = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        target = np.arange(len(labels))
        np.minimum.at(target, high, low)
        while True:
            shorter = target[target]
            if np.array_equal(shorter, target):
                break
            target = shorter
        labels = target[labels]
    return labels
