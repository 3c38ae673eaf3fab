"""Star graphs made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graphs


def star_graphs(documents: DataFrame, node_count: int = 10) -> Graphs:
    """``documents(graph_id, text)`` → a ROOT with ``node_count`` scored items around it."""
    items = documents.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(node_count - 1))).alias("i"))
    if node_count < 1:
        items = items.where(F.lit(False))
    name = F.concat(F.lit("NODE_"), F.col("i").cast("string"))
    root = documents.select(
        "graph_id",
        F.lit("ROOT").alias("node_id"),
        F.lit(0).alias("ord"),
        F.lit("Seed").alias("label"),
        F.create_map(F.lit("source"), F.substring("text", 1, 10)).alias("attrs"),
    )
    leaves = items.select(
        "graph_id",
        name.alias("node_id"),
        (F.col("i") + 1).alias("ord"),
        F.concat(F.lit("Item "), F.col("i").cast("string")).alias("label"),
        F.create_map(F.lit("score"), (F.col("i") % 10 / 10.0).cast("string")).alias("attrs"),
    )
    edges = items.select(
        "graph_id",
        F.concat(F.lit("e"), F.col("i").cast("string")).alias("edge_id"),
        F.col("i").alias("ord"),
        F.lit("ROOT").alias("source"),
        name.alias("target"),
        F.lit("generated").alias("relation"),
    )
    return Graphs.of(root.unionByName(leaves), edges, documents.select("graph_id"))
