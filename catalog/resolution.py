"""Queries on similarity, components, fusion and increments."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import (
    COMPONENTS,
    epoch_seconds,
    FUSED,
    ORDER,
    increment_sql,
    order_graphs,
    order_increment,
    supply_graph,
    SUPPLY,
    vector_nodes,
    vector_sql,
)
from graphloom.functions import slots
from graphloom.functions.vectors import cosine
from graphloom.model import Graphs
from graphloom.operators import components, increments, resolve, similarity, topology


@query(
    "cosine_to_next",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def cosine_to_next(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return v.join(after, "vec_id").select("vec_id", F.round(cosine("embedding", "following"), 6).alias("sim"))


def _pairs_query(name: str, by_label: bool) -> None:
    sql = f"WITH {vector_sql(by_label, 0.3)} SELECT graph_id, id1, id2, round(sim, 6) AS sim FROM pairs"

    @query(name, sql)
    def run(spark, sf):
        find = similarity.every_pair if by_label else similarity.similar_pairs
        pairs = find(vector_nodes(spark, sf, by_label), 0.3)
        return pairs.withColumn("sim", F.round("sim", 6))


_pairs_query("similar_pairs", False)
_pairs_query("similar_pairs_by_label", True)


@query(
    "similarity_components",
    f"WITH RECURSIVE {vector_sql(False, 0.3)}, {COMPONENTS} SELECT graph_id, node_id, root AS canonical_id FROM roots",
)
def similarity_components(spark, sf):
    nodes = vector_nodes(spark, sf)
    roots = components.connected_components(similarity.similar_links(nodes, 0.3))
    return components.canonical_ids(nodes, roots)


@query(
    "semantic_dedup",
    f"WITH RECURSIVE {vector_sql(True, 0.3)}, {COMPONENTS} SELECT graph_id, root AS node_id, root AS canonical_id, count(*) AS members FROM roots GROUP BY graph_id, root",
)
def semantic_dedup(spark, sf):
    nodes = vector_nodes(spark, sf, by_label=True)
    chain = nodes.select("graph_id", F.col("node_id").alias("source"), F.col("node_id").alias("target"))
    merged, _ = resolve.semantic_dedup(Graphs.of(nodes, chain), 0.3)
    members = merged.edges.groupBy("graph_id", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("members"))
    return merged.nodes.join(members, ["graph_id", "node_id"]).select(
        "graph_id", "node_id", slots.attr("canonical_id").alias("canonical_id"), "members"
    )


@query("union_nodes", f"WITH {ORDER} SELECT graph_id, node_id, label, node_type, origin, ord FROM f_nodes")
def union_nodes(spark, sf):
    union = topology.union_graphs(*order_graphs(spark, sf))
    return union.nodes.select("graph_id", "node_id", "label", "node_type", slots.meta("source").alias("origin"), "ord")


@query("union_edges", f"WITH {ORDER} SELECT graph_id, source, target, relation, origin FROM f_edges")
def union_edges(spark, sf):
    union = topology.union_graphs(*order_graphs(spark, sf))
    return union.edges.select("graph_id", "source", "target", "relation", slots.meta("source").alias("origin"))


@query(
    "fuse_nodes",
    f"""WITH RECURSIVE {FUSED}
SELECT graph_id, node_id, label, origin, node_id AS canonical_id FROM f_nodes
WHERE (graph_id, node_id) NOT IN (SELECT graph_id, node_id FROM moved)""",
)
def fuse_nodes(spark, sf):
    fused, _ = resolve.fuse(*order_graphs(spark, sf), threshold=0.3)
    return fused.nodes.select(
        "graph_id",
        "node_id",
        "label",
        slots.meta("source").alias("origin"),
        slots.attr("canonical_id").alias("canonical_id"),
    )


@query(
    "fuse_edges",
    f"""WITH RECURSIVE {FUSED}
SELECT f.graph_id, coalesce(s.root, f.source) AS source, coalesce(t.root, f.target) AS target, f.relation, f.origin
FROM f_edges f LEFT JOIN moved s ON s.graph_id = f.graph_id AND s.node_id = f.source
LEFT JOIN moved t ON t.graph_id = f.graph_id AND t.node_id = f.target""",
)
def fuse_edges(spark, sf):
    fused, _ = resolve.fuse(*order_graphs(spark, sf), threshold=0.3)
    return fused.edges.select("graph_id", "source", "target", "relation", slots.meta("source").alias("origin"))


@query("fuse_mapping", f"WITH RECURSIVE {FUSED} SELECT graph_id, node_id, root AS new_id FROM moved")
def fuse_mapping(spark, sf):
    _, mapping = resolve.fuse(*order_graphs(spark, sf), threshold=0.3)
    return mapping


@query(
    "fuse_headers",
    "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS graph_id, 'fused' AS source, 1 AS depth, 'semantic_dedup' AS fusion_method FROM customer",
)
def fuse_headers(spark, sf):
    union = topology.union_graphs(*order_graphs(spark, sf))
    return union.graphs.select("graph_id", "source", "depth", slots.meta("fusion_method").alias("fusion_method"))


@query(
    "fuse_by_mapping",
    f"""WITH {ORDER}, pairs AS (SELECT graph_id, 'fused_T_' || node_id AS node_id, 'fused_B_' || node_id AS new_id FROM people)
SELECT f.graph_id, coalesce(s.new_id, f.source) AS source, coalesce(t.new_id, f.target) AS target, f.relation
FROM f_edges f LEFT JOIN pairs s ON s.graph_id = f.graph_id AND s.node_id = f.source
LEFT JOIN pairs t ON t.graph_id = f.graph_id AND t.node_id = f.target""",
)
def fuse_by_mapping(spark, sf):
    b, t = order_graphs(spark, sf)
    mapping = t.nodes.where("node_type = 'customer'").select(
        "graph_id",
        F.concat(F.lit("fused_T_"), "node_id").alias("node_id"),
        F.concat(F.lit("fused_B_"), "node_id").alias("new_id"),
    )
    fused, _ = resolve.fuse(b, t, mapping=mapping)
    return fused.edges.select("graph_id", "source", "target", "relation")


@query(
    "rewrite_edges_by_brand",
    f"""WITH {SUPPLY}, mapping AS (
  SELECT n.graph_id, n.node_id, 'P' || min(p2.p_partkey) AS new_id
  FROM nodes n JOIN part p1 ON n.node_id = 'P' || p1.p_partkey
  JOIN part p2 ON p2.p_brand = p1.p_brand GROUP BY n.graph_id, n.node_id)
SELECT e.graph_id, e.source, coalesce(m.new_id, e.target) AS target, e.relation, e.ord
FROM edges e LEFT JOIN mapping m ON m.graph_id = e.graph_id AND m.node_id = e.target""",
)
def rewrite_edges_by_brand(spark, sf):
    g = supply_graph(spark, sf)
    part = spark.read.parquet(f"{sf}/part.parquet")
    first = part.groupBy("p_brand").agg(F.concat(F.lit("P"), F.min("p_partkey")).alias("new_id"))
    brands = part.select(F.concat(F.lit("P"), "p_partkey").alias("node_id"), "p_brand").join(first, "p_brand")
    mapping = g.nodes.select("graph_id", "node_id").join(brands, "node_id").select("graph_id", "node_id", "new_id")
    edges = topology.rewrite_ends(g.edges, mapping, required=False)
    return edges.select("graph_id", "source", "target", "relation", "ord")


@query(
    "remap_edges_required",
    f"""WITH {SUPPLY}, kept AS (SELECT graph_id, node_id FROM nodes WHERE score >= 0.5)
SELECT e.graph_id, 'k_' || source AS source, 'k_' || target AS target, relation FROM edges e
WHERE (graph_id, source) IN (SELECT graph_id, node_id FROM kept) AND (graph_id, target) IN (SELECT graph_id, node_id FROM kept)""",
)
def remap_edges_required(spark, sf):
    g = supply_graph(spark, sf)
    kept = g.nodes.where(slots.attr("score").cast("double") >= 0.5)
    mapping = kept.select("graph_id", "node_id", F.concat(F.lit("k_"), "node_id").alias("new_id"))
    return topology.rewrite_ends(g.edges, mapping, required=True).select("graph_id", "source", "target", "relation")


def _line_nodes(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_linestatus").alias("graph_id"),
        F.concat(F.lit("P"), "l_partkey").alias("node_id"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("spread"),
        (epoch_seconds("l_shipdate") * 1000000 + F.col("l_orderkey")).alias("ord"),
    )


def _dedup_query(keep: str, pick: str) -> None:
    sql = f"""SELECT l_linestatus AS graph_id, 'P' || l_partkey AS node_id,
  {pick}(epoch(l_shipdate)::BIGINT * 1000000 + l_orderkey) AS ord FROM lineitem GROUP BY ALL"""

    @query(f"dedup_nodes_{keep}", sql)
    def run(spark, sf):
        return topology.dedup_nodes(_line_nodes(spark, sf), keep).select("graph_id", "node_id", "ord")


_dedup_query("last", "max")
_dedup_query("first", "min")


@query(
    "duplicate_nodes",
    "SELECT l_linestatus AS graph_id, 'P' || l_partkey AS node_id, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_nodes(spark, sf):
    return topology.duplicate_nodes(_line_nodes(spark, sf))


@query(
    "increment_clean_edges",
    f"WITH {increment_sql(['O'])} SELECT graph_id, source, target, relation FROM valid1",
)
def increment_clean_edges(spark, sf):
    current, (step,) = order_increment(spark, sf, ["O"])
    clean = increments.clean_increment(current, step)
    return clean.edges.select("graph_id", "source", "target", "relation")


@query("increment_new_nodes", f"WITH {increment_sql(['O'])} SELECT graph_id, node_id, label FROM add1")
def increment_new_nodes(spark, sf):
    current, (step,) = order_increment(spark, sf, ["O"])
    return increments.new_nodes(current, step).select("graph_id", "node_id", "label")


@query(
    "increment_skipped_edges",
    f"""WITH {increment_sql(['O'])}, r AS (SELECT graph_id, count(*) AS total FROM raw1 GROUP BY graph_id),
k AS (SELECT graph_id, count(*) AS kept FROM valid1 GROUP BY graph_id)
SELECT graph_id, total - coalesce(kept, 0) AS skipped FROM r LEFT JOIN k USING (graph_id)""",
)
def increment_skipped_edges(spark, sf):
    current, (step,) = order_increment(spark, sf, ["O"])
    merged = current.nodes.unionByName(increments.new_nodes(current, step))
    _, skipped = increments.admit_edges(step.edges, merged)
    return skipped


@query(
    "increment_merged_nodes",
    f"""WITH {increment_sql(['O'])}
SELECT graph_id, node_id, label, CASE WHEN p.node_id IS NULL THEN 'true' ELSE 'false' END AS expandable,
  CASE WHEN p.node_id IS NULL THEN 'false' ELSE 'true' END AS expanded
FROM cur1 LEFT JOIN parent p USING (graph_id, node_id)""",
)
def increment_merged_nodes(spark, sf):
    current, (step,) = order_increment(spark, sf, ["O"])
    merged, _ = increments.merge_increment(current, step)
    return merged.nodes.select(
        "graph_id",
        "node_id",
        "label",
        slots.state("expandable", "true").alias("expandable"),
        slots.state("expanded", "false").alias("expanded"),
    )


@query("increment_merged_edges", f"WITH {increment_sql(['O', 'P'])} SELECT graph_id, source, target, relation FROM edge2")
def increment_merged_edges(spark, sf):
    current, steps = order_increment(spark, sf, ["O", "P"])
    for k, step in enumerate(steps, start=1):
        current, _ = increments.merge_increment(current, step, k)
    return current.edges.select("graph_id", "source", "target", "relation")


@query(
    "increment_trace",
    f"""WITH {increment_sql(['O'])}, i AS (SELECT graph_id, count(*) AS new_nodes FROM inc1 GROUP BY graph_id),
a AS (SELECT graph_id, count(*) AS added_nodes FROM add1 GROUP BY graph_id)
SELECT graph_id, 1 AS iteration, coalesce(new_nodes, 0) AS new_nodes, coalesce(added_nodes, 0) AS added_nodes, p.node_id AS parent_node
FROM parent p LEFT JOIN i USING (graph_id) LEFT JOIN a USING (graph_id)""",
)
def increment_trace(spark, sf):
    current, (step,) = order_increment(spark, sf, ["O"])
    _, trace = increments.merge_increment(current, step)
    return trace
