"""Graphs as JSON: reader, writer, service form and display elements.

A document holds ``part_size`` elements of each kind, by their number in the graph; an ordinary graph
is one document, a huge one several, and the reader puts the parts together again, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import slots
from graphloom.model import Graphs, as_edges, as_graphs, as_nodes, stable_id
from graphloom.operators.topology import joined_pieces, ordinals

PART_SIZE = 100_000

_SLOTS = "attributes:map<string,string>,metrics:map<string,double>,metadata:map<string,string>"
DOCUMENT = (
    "graph_id string, depth int, source string, metadata map<string,string>, "
    f"nodes array<struct<id:string,label:string,status:string,{_SLOTS},state:map<string,string>,embedding:array<float>>>, "
    f"edges array<struct<id:string,source:string,target:string,relation:string,{_SLOTS}>>"
)


def read_graph_json(df: DataFrame, col: str = "json") -> Graphs:
    """Graphs from JSON documents in ``df.col``; a ``part`` column orders parts of one graph.

    Labels fall back to the top level and then to ``Unknown``, relations to ``related_to``.
    """
    part = F.col("part") if "part" in df.columns else F.lit(0)
    doc = df.select(part.cast("bigint").alias("part"), F.col(col).alias("json"), F.from_json(col, DOCUMENT).alias("g"))
    if "part" in df.columns:
        # counts are added up beside the documents: a window over the documents themselves would hold all parts of a graph
        size = lambda kind: F.greatest(F.size(f"g.{kind}"), F.lit(0))
        keys = [F.struct("g.graph_id", "part").alias("place"), F.xxhash64("json").alias("hash")]
        sizes = doc.select(*keys, size("nodes").alias("nodes"), size("edges").alias("edges")).groupBy("place", "hash").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
        before = Window.partitionBy("place.graph_id").orderBy("place.part", "hash").rowsBetween(Window.unboundedPreceding, -1)
        count = lambda kind: F.coalesce(F.sum(kind).over(before), F.lit(0)).alias(f"{kind}_before")
        offsets = sizes.select("place", "hash", count("nodes"), count("edges"))
        doc = doc.withColumns({"place": keys[0], "hash": keys[1]}).drop("g").join(offsets, ["place", "hash"]).withColumn("g", F.from_json("json", DOCUMENT))
    else:
        doc = doc.withColumns({"nodes_before": F.lit(0), "edges_before": F.lit(0)})
    graph_id = F.col("g.graph_id").alias("graph_id")
    empty = F.create_map()
    order = (F.col("before") + F.col("pos")).cast("bigint").alias("ord")

    def slot(name: str, kind: str = "string") -> Column:
        return F.coalesce(F.col(name), empty.cast(f"map<string,{kind}>"))

    def without(name: str, *keys: str) -> Column:
        return F.map_filter(slot(name), lambda k, _v: ~k.isin(list(keys)))

    rows = doc.select(graph_id, "part", F.col("nodes_before").alias("before"), F.posexplode("g.nodes").alias("pos", "n"))
    nodes = rows.select(
        "graph_id",
        F.col("n.id").alias("node_id"),
        order,
        slots.first_filled(F.try_element_at("n.attributes", F.lit("label")), F.coalesce("n.label", F.lit("Unknown"))).alias("label"),
        F.try_element_at("n.attributes", F.lit("node_type")).alias("node_type"),
        F.coalesce("n.status", F.lit("")).alias("status"),
        without("n.attributes", "label", "node_type").alias("attrs"),
        slot("n.metrics", "double").alias("metrics"),
        slot("n.state").alias("state"),
        slot("n.metadata").alias("meta"),
        F.col("n.embedding").alias("embedding"),
    )
    rows = doc.select(graph_id, "part", F.col("edges_before").alias("before"), F.posexplode("g.edges").alias("pos", "e"))
    edges = rows.select(
        "graph_id",
        F.coalesce("e.id", stable_id("graph_id", "part", "pos", length=8)).alias("edge_id"),
        order,
        "e.source",
        "e.target",
        slots.first_filled(F.try_element_at("e.attributes", F.lit("relation")), F.coalesce("e.relation", F.lit("related_to"))).alias(
            "relation"
        ),
        without("e.attributes", "relation").alias("attrs"),
        slot("e.metrics", "double").alias("metrics"),
        slot("e.metadata").alias("meta"),
    )
    head = doc.groupBy(graph_id).agg(F.min_by("g", "part").alias("g"))
    graphs = head.select(
        "graph_id",
        F.coalesce("g.source", F.lit("unknown")).alias("source"),
        F.coalesce("g.depth", F.lit(0)).alias("depth"),
        slot("g.metadata").alias("meta"),
    )
    return Graphs(as_graphs(graphs), as_nodes(nodes), as_edges(edges))


def _packed(df: DataFrame, text: Column, name: str, part_size: int) -> DataFrame:
    """JSON entries joined per graph and part, by position and then by their own text."""
    entries = df.select("graph_id", "ord", text.alias("json"))
    coarse, chunk = F.shiftright("ord", 40), F.shiftright("ord", 16)
    numbered = ordinals(entries, ["graph_id"], coarse, [chunk], [F.col("ord"), F.col("json")], "number")
    part = F.floor(F.col("number") / part_size).alias("part")
    pieces = joined_pieces(numbered.select("graph_id", part, (F.col("number") % part_size).alias("number"), "json"), ["graph_id", "part"])
    return pieces.groupBy("graph_id", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda e: e["text"]), ",").alias(name)
    )


def _documents(g: Graphs, node: Column, edge: Column, part_size: int, keyed: bool) -> DataFrame:
    """One document per graph and part; ``keyed`` writes nodes as an object and skips empty metadata."""
    text = F.concat(_quoted(F.col("node_id")), F.lit(":"), F.to_json(node)) if keyed else F.to_json(node)
    nodes = _packed(g.nodes, text, "nodes", part_size)
    edges = _packed(g.edges, F.to_json(edge), "edges", part_size)
    parts = nodes.join(edges, ["graph_id", "part"], "full")
    header = F.to_json(F.struct("graph_id", "depth", "source"))
    rows = g.graphs.select("graph_id", header.alias("header"), "meta").join(parts, "graph_id", "left")
    opening, closing = ("{", "}") if keyed else ("[", "]")
    meta = F.concat(F.lit(',"metadata":'), F.to_json("meta"))
    if keyed:
        meta = F.when(F.size("meta") > 0, meta).otherwise(F.lit(""))
    document = F.concat(
        F.substring("header", F.lit(1), F.length("header") - 1),
        F.lit(f',"nodes":{opening}'),
        F.coalesce("nodes", F.lit("")),
        F.lit(f'{closing},"edges":['),
        F.coalesce("edges", F.lit("")),
        F.lit("]"),
        meta,
        F.lit("}"),
    )
    return rows.select("graph_id", F.coalesce("part", F.lit(0)).alias("part"), document.alias("json"))


def _quoted(col: Column) -> Column:
    array = F.to_json(F.array(col))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _node_attributes() -> Column:
    typed = F.map_filter(F.create_map(F.lit("node_type"), F.col("node_type")), lambda _k, v: v.isNotNull())
    return slots.merge(F.col("attrs"), F.map_concat(F.create_map(F.lit("label"), F.col("label")), typed))


def _edge_attributes() -> Column:
    return slots.put("attrs", relation=F.col("relation"))


def graph_json(g: Graphs, part_size: int = PART_SIZE) -> DataFrame:
    """``(graph_id, part, json)``: the plain document form that :func:`read_graph_json` reads."""
    node = F.struct(
        F.col("node_id").alias("id"),
        "status",
        _node_attributes().alias("attributes"),
        "metrics",
        "state",
        F.col("meta").alias("metadata"),
        F.col("subgraph_id").isNotNull().alias("has_subgraph"),
        "embedding",
    )
    edge = F.struct(
        F.col("edge_id").alias("id"),
        "source",
        "target",
        _edge_attributes().alias("attributes"),
        "metrics",
        F.col("meta").alias("metadata"),
    )
    return _documents(g, node, edge, part_size, keyed=False)


def service_json(g: Graphs, part_size: int = PART_SIZE) -> DataFrame:
    """``(graph_id, part, json)`` in service form: nodes keyed by id, flat basics beside the slots.

    Runtime keys of the metadata show up in the state. A nested graph is given by reference:
    it lives in the same tables under its own id.
    """
    moved = g.with_nodes(slots.runtime_to_state(g.nodes))
    node = F.struct(
        F.col("node_id").alias("id"),
        "label",
        F.coalesce("node_type", F.lit("mixed")).alias("node_type"),
        slots.flag("expandable", True).alias("expandable"),
        _node_attributes().alias("attributes"),
        "metrics",
        "state",
        F.col("meta").alias("metadata"),
        F.when(
            F.col("subgraph_id").isNotNull(), F.struct(F.col("subgraph_id").alias("graph_id"), F.lit(True).alias("_ref"))
        ).alias("subgraph"),
        F.nullif(F.try_element_at("attrs", F.lit("canonical_id")), F.lit("")).alias("canonical_id"),
    )
    edge = F.struct(
        "source",
        "target",
        "relation",
        slots.metric("weight").alias("weight"),
        _edge_attributes().alias("attributes"),
        "metrics",
        F.col("meta").alias("metadata"),
    )
    return _documents(moved, node, edge, part_size, keyed=True)


def display_elements(g: Graphs) -> DataFrame:
    """``(graph_id, group, id, json)``: one display element per node and edge."""
    pick = lambda slot, key: F.try_element_at(slot, F.lit(key))
    filled = lambda key: slots.first_filled(pick("attrs", key), pick("state", key), pick("meta", key))
    given = lambda key: F.coalesce(pick("attrs", key), pick("state", key), pick("meta", key))
    measured = lambda key: F.coalesce(pick("metrics", key), pick("meta", key).try_cast("double"))
    status = slots.first_filled(F.col("status"), pick("state", "status"), pick("attrs", "status"), pick("meta", "status"))
    data = F.struct(
        F.col("node_id").alias("id"),
        slots.first_filled(F.col("label"), pick("attrs", "label"), F.lit("Unknown")).alias("label"),
        F.coalesce(status, F.lit("")).alias("status"),
        filled("color").alias("color"),
        filled("borderColor").alias("borderColor"),
        given("opacity").alias("opacity"),
        filled("borderStyle").alias("borderStyle"),
        given("borderWidth").alias("borderWidth"),
        _node_attributes().alias("attributes"),
        "metrics",
        "state",
        F.col("meta").alias("metadata"),
        measured("ablation_value").alias("ablationValue"),
        measured("uncertainty").alias("uncertainty"),
        measured("confidence").alias("confidence"),
        F.coalesce(pick("state", "halt_reason"), pick("meta", "halt_reason")).alias("haltReason"),
        slots.first_filled(pick("state", "source"), pick("meta", "source"), F.lit("unknown")).alias("source"),
        F.nullif(pick("state", "parentNodeId"), F.lit("")).alias("parent"),
    )
    nodes = g.nodes.select(
        "graph_id",
        F.lit("nodes").alias("group"),
        F.col("node_id").alias("id"),
        F.to_json(F.struct(data.alias("data"), F.lit("nodes").alias("group"))).alias("json"),
    )
    edge_id = F.concat_ws("-", "source", "target", "relation")
    link = F.struct(
        edge_id.alias("id"),
        "source",
        "target",
        "relation",
        _edge_attributes().alias("attributes"),
        "metrics",
        F.col("meta").alias("metadata"),
    )
    edges = g.edges.select(
        "graph_id",
        F.lit("edges").alias("group"),
        edge_id.alias("id"),
        F.to_json(F.struct(link.alias("data"), F.lit("edges").alias("group"))).alias("json"),
    )
    return nodes.unionByName(edges)
