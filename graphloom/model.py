"""Tables of the graph model.

Many graphs live side by side: every table is keyed by ``graph_id``. ``ord`` carries the
insertion order of nodes and edges inside a graph, because several operators ("first
seen", "last wins", "first five") depend on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_all

TEXT_MAP = "map<string,string>"
METRIC_MAP = "map<string,double>"

GRAPH_FIELDS = {"graph_id": "string", "source": "string", "depth": "int", "meta": TEXT_MAP}
NODE_FIELDS = {
    "graph_id": "string",
    "node_id": "string",
    "ord": "bigint",
    "label": "string",
    "node_type": "string",
    "status": "string",
    "attrs": TEXT_MAP,
    "metrics": METRIC_MAP,
    "state": TEXT_MAP,
    "meta": TEXT_MAP,
    "subgraph_id": "string",
    "embedding": "array<float>",
}
EDGE_FIELDS = {
    "graph_id": "string",
    "edge_id": "string",
    "ord": "bigint",
    "source": "string",
    "target": "string",
    "relation": "string",
    "attrs": TEXT_MAP,
    "metrics": METRIC_MAP,
    "meta": TEXT_MAP,
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def _default(name: str, kind: str) -> Column:
    if kind.startswith("map"):
        return F.create_map()
    if name in ("status", "relation"):
        return F.lit("")
    if name == "source":
        return F.lit("unknown")
    if name in ("depth", "ord"):
        return F.lit(0)
    return F.lit(None)


def _conform(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    present = set(df.columns)


    def column(name: str, kind: str) -> Column:
        if name not in present:
            return _default(name, kind).cast(kind)
        given = F.col(name).cast(kind)
        return F.coalesce(given, _default(name, kind).cast(kind)) if kind.startswith("map") else given

    return df.select(*[column(name, kind).alias(name) for name, kind in fields.items()])


def as_graphs(df: DataFrame) -> DataFrame:
    """``df`` with the columns of the graph table; missing ones get their default."""
    return _conform(df, GRAPH_FIELDS)


def as_nodes(df: DataFrame) -> DataFrame:
    """``df`` with the columns of the node table; an empty label falls back to the id."""
    out = _conform(df, NODE_FIELDS)
    return out.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "node_id"))


def as_edges(df: DataFrame) -> DataFrame:
    """``df`` with the columns of the edge table."""
    return _conform(df, EDGE_FIELDS)


def stable_id(*cols: Column | str, length: int = 10) -> Column:
    """A short id that is the same on every retry of a task."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *cols), 256), 1, length)


@dataclass(frozen=True)
class Graphs:
    """Three tables that together hold any number of graphs."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, graphs: DataFrame | None = None) -> Graphs:
        if graphs is None:
            graphs = nodes.select("graph_id").distinct()
        return cls(as_graphs(graphs), as_nodes(nodes), as_edges(edges))

    def with_nodes(self, nodes: DataFrame) -> Graphs:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graphs:
        return replace(self, edges=edges)

    def map_tables(self, step: Callable[[DataFrame], DataFrame]) -> Graphs:
        """The same step on all three tables (a filter on ``graph_id``, a column…)."""
        return Graphs(step(self.graphs), step(self.nodes), step(self.edges))

    def cut(self) -> Graphs:
        """The three tables written to the checkpoint folder, without their lineage."""
        return Graphs(*cut_all(self.graphs, self.nodes, self.edges))

    def only(self, ids: DataFrame) -> Graphs:
        """The graphs whose id is in ``ids``."""
        keys = ids.select("graph_id")
        return self.map_tables(lambda df: df.join(keys, "graph_id", "left_semi"))

    def union(self, other: Graphs) -> Graphs:
        return Graphs(
            self.graphs.unionByName(other.graphs),
            self.nodes.unionByName(other.nodes),
            self.edges.unionByName(other.edges),
        )
