"""Degrees, neighbours, subgraphs, unions and edge rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import slots
from graphloom.model import Graphs, stable_id

KEY = ["graph_id", "node_id"]
PIECE = 1_000


def incident_counts(edges: DataFrame) -> DataFrame:
    """Edges per touched node; a self-loop counts once. Partial counts precede the shuffle."""
    ends = F.array_distinct(F.array("source", "target"))
    return (
        edges.select("graph_id", F.explode(ends).alias("node_id"))
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def degrees(g: Graphs) -> DataFrame:
    """``(graph_id, node_id, degree)`` for every node, 0 when isolated."""
    return with_degree(g.nodes.select(*KEY), g.edges)


def with_degree(nodes: DataFrame, edges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``nodes`` with their degree: from ``edges``, or from ``counts`` of them that are kept elsewhere."""
    counts = incident_counts(edges) if counts is None else counts
    return nodes.join(counts, KEY, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def add_counts(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of :func:`incident_counts` after ``edges`` have come in; the earlier ones are not read again."""
    return counts.unionByName(incident_counts(edges)).groupBy(*KEY).agg(F.sum("degree").alias("degree"))


def neighbor_pairs(g: Graphs, direction: str = "both") -> DataFrame:
    """``(graph_id, node_id, neighbor)`` rows.

    ``both`` is a set of undirected neighbours; ``out`` and ``in`` keep parallel edges and
    carry ``ord``. Long form, so that a hub never has to fit in one row.
    """
    e = g.edges
    out = e.select("graph_id", F.col("source").alias("node_id"), F.col("target").alias("neighbor"), "ord")
    back = e.select("graph_id", F.col("target").alias("node_id"), F.col("source").alias("neighbor"), "ord")
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction != "both":
        raise ValueError(f"direction must be both, out or in, not {direction!r}")
    return out.unionByName(back).select("graph_id", "node_id", "neighbor").distinct()


def neighbors(g: Graphs, direction: str = "both", part_size: int = 10_000) -> DataFrame:
    """Neighbour lists ``(graph_id, node_id, part, neighbors)``.

    Lists come in hash parts of about ``part_size`` entries, so a hub spreads over several
    rows; the concatenation of a node's parts is its whole neighbourhood.
    """
    pairs = neighbor_pairs(g, direction)
    keys = ["graph_id", "node_id"]
    spread = F.pmod(F.xxhash64("neighbor") if direction == "both" else F.xxhash64("neighbor", "ord"), F.lit(1 << 20))
    slices = pairs.withColumn("slice", spread.cast("int"))
    sizes = slices.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(part_size)).alias("parts"))
    parted = slices.join(sizes, keys).withColumn("part", F.pmod("slice", F.col("parts")).cast("int"))
    if direction == "both":
        packed = F.sort_array(F.collect_list("neighbor"))
    else:
        packed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "neighbor"))), lambda s: s["neighbor"])
    return parted.groupBy(*keys, "part").agg(packed.alias("neighbors"))


def keep_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids(graph_id, node_id)``."""
    sources = ids.select("graph_id", F.col("node_id").alias("source"))
    targets = ids.select("graph_id", F.col("node_id").alias("target"))
    return edges.join(sources, ["graph_id", "source"], "left_semi").join(
        targets, ["graph_id", "target"], "left_semi"
    )


def induced_subgraph(g: Graphs, cond: Column, suffix: str = "") -> Graphs:
    """Nodes that satisfy ``cond`` and the edges between them."""
    nodes = g.nodes.where(cond)
    out = Graphs(g.graphs, nodes, keep_edges(g.edges, nodes.select(*KEY)).select(*g.edges.columns))
    if not suffix:
        return out
    return out.map_tables(lambda df: df.withColumn("graph_id", F.concat("graph_id", F.lit(suffix))))


def score_filter(g: Graphs, threshold: float = 0.5, suffix: str = "_filtered") -> Graphs:
    """Induced subgraph of the nodes whose score reaches ``threshold``; no score keeps a node."""
    score = F.coalesce(F.try_element_at("attrs", F.lit("score")).try_cast("double"), F.lit(1.0))
    out = induced_subgraph(g, score >= threshold, suffix)
    fresh = out.graphs.select(
        "graph_id", F.lit("unknown").alias("source"), F.lit(0).alias("depth"), F.create_map().cast("map<string,string>").alias("meta")
    )
    return Graphs(fresh, out.nodes, out.edges)


def dedup_nodes(nodes: DataFrame, keep: str = "last") -> DataFrame:
    """One row per node id: the last (overwrite) or the first (merge) by ``ord``."""
    if keep not in ("last", "first"):
        raise ValueError(f"keep must be last or first, not {keep!r}")
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in nodes.columns if c not in KEY]
    row = nodes.groupBy(*KEY).agg(pick(F.struct(*rest), F.col("ord")).alias("row"))
    return row.select(*[F.col(c) if c in KEY else F.col(f"row.{c}").alias(c) for c in nodes.columns])


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Ids that occur more than once: the rows a strict (no overwrite) insert refuses."""
    return nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def rewrite_ends(edges: DataFrame, mapping: DataFrame, required: bool) -> DataFrame:
    """Replace both ends by ``mapping(graph_id, node_id, new_id)``.

    ``required`` drops edges with an unmapped end; otherwise such an end stays as it is.
    Self-loops and parallel edges that arise are kept.
    """
    how = "inner" if required else "left"
    out = edges
    for end in ("source", "target"):
        side = mapping.select("graph_id", F.col("node_id").alias(end), F.col("new_id").alias(f"new_{end}"))
        new = F.col(f"new_{end}") if required else F.coalesce(f"new_{end}", end)
        out = out.join(side, ["graph_id", end], how).withColumn(end, new).drop(f"new_{end}")
    return out.select(*edges.columns)


def prefixed(g: Graphs, side: str) -> Graphs:
    """Node ids of one fusion side: ``fused_B_…``/``fused_T_…`` with provenance; the status is
    reset, edges with a missing end go, the other ends are renamed.
    """
    origin = {"B": "bottom_up", "T": "top_down"}[side]
    ids = g.nodes.select("graph_id", "node_id")
    rename = lambda end: F.concat(F.lit(f"fused_{side}_"), F.col(end))
    nodes = (
        g.nodes.withColumn("node_id", rename("node_id"))
        .withColumn("status", F.lit(""))
        .withColumn("meta", slots.put("meta", source=origin))
    )
    edges = (
        keep_edges(g.edges, ids)
        .select(*g.edges.columns)
        .withColumn("source", rename("source"))
        .withColumn("target", rename("target"))
        .withColumn("meta", slots.put("meta", source=origin))
        .withColumn("edge_id", stable_id(F.lit(side), "graph_id", "edge_id", "ord", length=8))
    )
    return Graphs(g.graphs, nodes, edges)


def union_graphs(b: Graphs, t: Graphs) -> Graphs:
    """Bag union of two prefixed sides; depth is the larger one and the source is ``fused``.

    The second side comes after the first in ``ord``.
    """
    left, right = prefixed(b, "B"), prefixed(t, "T")
    graphs = (
        b.graphs.withColumn("side", F.lit("G_B"))
        .unionByName(t.graphs.withColumn("side", F.lit("G_T")))
        .groupBy("graph_id")
        .agg(
            F.lit("fused").alias("source"),
            F.max("depth").alias("depth"),
            F.max(F.when(F.col("side") == "G_B", F.try_element_at("meta", F.lit("goal")))).alias("goal_b"),
            F.max(F.when(F.col("side") == "G_T", F.try_element_at("meta", F.lit("goal")))).alias("goal_t"),
        )
    )
    goal = F.coalesce("goal_t", "goal_b")
    origins = F.to_json(F.struct(F.lit("G_B").alias("G_B"), F.lit("G_T").alias("G_T")))
    base = F.create_map(F.lit("source_graphs"), origins, F.lit("fusion_method"), F.lit("semantic_dedup"))
    graphs = graphs.select(
        "graph_id",
        "source",
        "depth",
        F.when(goal.isNull(), base).otherwise(F.map_concat(base, F.create_map(F.lit("goal"), goal))).alias("meta"),
    )

    return Graphs(
        graphs,
        left.nodes.unionByName(after(right.nodes, 1)),
        left.edges.unionByName(after(right.edges, 1)),
    )


def after(df: DataFrame, steps: int) -> DataFrame:
    """Move rows behind those of earlier additions: one step leaves room for 2**45 positions."""
    return df.withColumn("ord", F.col("ord") + F.lit(steps) * F.lit(1 << 45))


def ordinals(
    df: DataFrame, keys: list[str], coarse: Column, chunk: list[Column], order: list[Column], out: str, base: int = 0
) -> DataFrame:
    """Number the rows of each key by ``order`` without gathering a key in one task.

    ``chunk`` coarsens ``order`` and ``coarse`` coarsens ``chunk`` (all rows of a smaller one
    come first). Rows are numbered inside their chunk, chunk counts are added up inside their
    coarse chunk, and only the coarse counts of a key meet in one place.
    """
    names = [f"__chunk{i}" for i in range(len(chunk))]
    # a struct of nulls equals itself, so that rows with a null key are numbered like others
    marked = df.withColumns({"__coarse": coarse, **dict(zip(names, chunk, strict=True))})
    whole, place = F.struct(*keys, "__coarse"), F.struct(*keys, "__coarse", *names)

    def before(count: str, part: list[str], by: list[str]) -> Column:
        window = Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(count).over(window), F.lit(0))

    counts = marked.groupBy(*keys, "__coarse", *names).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*keys, "__coarse").agg(F.sum("__n").alias("__total"))
    starts = totals.withColumn("__start", before("__total", keys, ["__coarse"])).drop("__total")
    offsets = (
        counts.withColumn("__inner", before("__n", [*keys, "__coarse"], names))
        .withColumn("__whole", whole)
        .join(starts.select(whole.alias("__whole"), "__start"), "__whole")
        .select(place.alias("__place"), (F.col("__start") + F.col("__inner")).alias("__offset"))
    )
    # numbered and joined by one column, so that the rows are shuffled once
    within = Window.partitionBy("__place").orderBy(*order)
    return (
        marked.withColumn("__place", place)
        .withColumn("__row", F.row_number().over(within))
        .join(offsets, "__place")
        .withColumn(out, F.col("__offset") + F.col("__row") - 1 + base)
        .drop("__row", "__offset", "__place", "__coarse", *names)
    )


def joined_pieces(entries: DataFrame, keys: list[str], size: int = PIECE) -> DataFrame:
    """``(…keys, piece, text)`` of ``entries(…keys, number, json)``: ``size`` numbers after another, joined by commas.

    A task that collects holds many lists at a time, so lists of single entries have to be short; the long ones are of texts of pieces.
    """
    entries = entries.select(*keys, F.floor(F.col("number") / size).alias("piece"), F.struct("number", "json").alias("entry"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["json"]), ",")
    return entries.groupBy(*keys, "piece").agg(text.alias("text"))
