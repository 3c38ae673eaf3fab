"""Node scoring strategies and per-graph halting decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import slots
from graphloom.model import Graphs
from graphloom.operators.topology import with_degree
from graphloom.settings import param


@dataclass(frozen=True)
class Limits:
    max_depth: int = param(3, "depth from which every node halts", 0)
    max_nodes: int = param(50, "nodes from which a graph halts", 0)
    max_iterations: int = param(10, "rounds from which a graph halts", 0)


@dataclass(frozen=True)
class Strategy:
    """A value per node, the two cut-offs and the metrics written beside it."""

    value: Callable[[], Column]
    hi: float
    lo: float
    metrics: Callable[[Column], dict[str, Column]]


def _degree() -> Column:
    return F.col("degree").cast("double")


def _label_length() -> Column:
    return F.length("label").cast("double")


# Cut-offs and metric constants of the scoring strategies.
STRATEGIES: dict[str, Strategy] = {
    "asi": Strategy(
        _degree,
        5,
        1,
        lambda v: {
            "structural_importance": _degree(),
            "uncertainty": F.lit(0.3),
            "confidence": F.least(F.lit(1.0), v / 10),
        },
    ),
    "psg": Strategy(
        lambda: F.lit(1.0),
        0.8,
        0.2,
        lambda v: {"probabilistic_score": v, "uncertainty": F.lit(0.5), "confidence": v},
    ),
    "scd": Strategy(
        _label_length,
        15,
        3,
        lambda v: {
            "semantic_consistency": v / 10,
            "uncertainty": F.lit(0.4),
            "confidence": F.least(F.lit(1.0), v / 20),
        },
    ),
    "ucb": Strategy(
        lambda: F.lit(0.5),
        0.7,
        0.3,
        lambda v: {"ucb_score": v, "uncertainty": F.lit(0.6), "confidence": v},
    ),
    "rules": Strategy(
        _degree,
        5,
        1,
        lambda v: {"structural_importance": _degree(), "uncertainty": F.lit(0.5), "confidence": F.lit(0.5)},
    ),
}


def register(name: str, strategy: Strategy) -> None:
    """Add a caller's own strategy."""
    STRATEGIES[name.lower()] = strategy


def _state(graphs: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is not None:
        return state.select("graph_id", "depth", "iteration")
    return graphs.select("graph_id", F.lit(0).alias("depth"), F.lit(0).alias("iteration"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("node_count"))


def _rule_based(limits: Limits) -> tuple[Column, Column]:
    """Status and reason of the rule-based mode, in this order of precedence."""
    value = _degree()
    halted = (
        F.when(F.col("depth") >= limits.max_depth, "max_depth")
        .when(F.col("node_count") >= limits.max_nodes, "max_nodes")
        .when(F.col("iteration") >= limits.max_iterations, "max_iterations")
    )
    expandable = slots.flag("expandable", True)
    reason = (
        F.when(halted.isNotNull(), halted)
        .when(F.col("node_count") < 3, "insufficient_nodes")
        .when(F.col("degree") == 0, "isolated_node")
        .when(value > 5, "high_value")
        .when(value < 1, "low_value")
        .when(~expandable, "not_expandable")
        .otherwise("continue_expansion")
    )
    status = (
        F.when(halted.isNotNull(), F.when(value > 2, "HALT-ACCEPT").otherwise("HALT-DROP"))
        .when(reason.isin("insufficient_nodes", "isolated_node", "low_value"), "HALT-DROP")
        .when(reason.isin("high_value", "not_expandable"), "HALT-ACCEPT")
        .otherwise("LOOP")
    )
    return status, reason


def score_nodes(
    g: Graphs, mode: str = "rule_based", state: DataFrame | None = None, limits: Limits = Limits(), counts: DataFrame | None = None
) -> Graphs:
    """Write status, metrics and (rule-based) ``halt_reason`` on every node.

    ``mode`` is ``always_loop``, ``always_halt``, ``rule_based`` or a strategy name; any
    other name leaves the graph unchanged. ``counts`` holds the degrees of touched nodes where a caller
    keeps them (:func:`~graphloom.operators.topology.add_counts`); else they are counted from the edges.
    """
    mode = mode.lower()
    columns = g.nodes.columns
    if mode not in ("always_loop", "always_halt", "rule_based") and mode not in STRATEGIES:
        return g
    if mode in STRATEGIES:
        chosen = STRATEGIES[mode]
        value = chosen.value()
        nodes = with_degree(g.nodes, g.edges, counts)
        status = F.when(value > chosen.hi, "HALT-ACCEPT").when(value < chosen.lo, "HALT-DROP").otherwise("LOOP")
        metrics = {"ablation_value": value, **chosen.metrics(value)}
        extra = {}
    elif mode == "rule_based":
        per_graph = node_counts(g.nodes)
        if state is None:
            per_graph = per_graph.withColumns({"depth": F.lit(0), "iteration": F.lit(0)})
        else:
            per_graph = per_graph.join(state.select("graph_id", "depth", "iteration"), "graph_id")
        nodes = with_degree(g.nodes, g.edges, counts).join(per_graph, "graph_id")
        status, reason = _rule_based(limits)
        value = _degree()
        metrics = {
            "ablation_value": value,
            "structural_importance": value,
            "uncertainty": F.lit(0.3),
            "confidence": F.least(F.lit(1.0), value / 10),
        }
        extra = {"state": slots.put("state", halt_reason=reason)}
    else:
        nodes = with_degree(g.nodes, g.edges, counts)
        status = F.lit("LOOP" if mode == "always_loop" else "HALT-ACCEPT")
        metrics, extra = {"ablation_value": _degree()}, {}
    updates = {"status": status, "metrics": slots.put("metrics", "double", **metrics), **extra}
    return g.with_nodes(nodes.select(*[updates.get(c, F.col(c)).alias(c) for c in columns]))


def status_counts(nodes: DataFrame) -> DataFrame:
    """Status histogram per graph in long form."""
    return nodes.groupBy("graph_id", "status").agg(F.count(F.lit(1)).alias("count"))


def decide_global(g: Graphs, state: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """``(graph_id, decision, reason)`` from the hard limits, then from the node statuses.

    A graph without nodes has no status at all and is dropped as terminal.
    """
    totals = g.nodes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if(F.col("status") == "LOOP").alias("looping"),
        F.count_if(F.col("status") == "HALT-ACCEPT").alias("accepted"),
    )
    rows = _state(g.graphs, state).join(totals, "graph_id", "left").fillna(0, ["node_count", "looping", "accepted"])
    note = lambda what, col: F.concat(F.lit(f"{what} reached ("), F.col(col).cast("string"), F.lit(")"))
    decision = (
        F.when(F.col("depth") >= limits.max_depth, "HALT")
        .when(F.col("node_count") >= limits.max_nodes, "HALT")
        .when(F.col("iteration") >= limits.max_iterations, "HALT")
        .when(F.col("looping") > 0, "CONTINUE")
        .when(F.col("accepted") > 0, "HALT")
        .otherwise("DROP")
    )
    reason = (
        F.when(F.col("depth") >= limits.max_depth, note("max_depth", "depth"))
        .when(F.col("node_count") >= limits.max_nodes, note("max_nodes", "node_count"))
        .when(F.col("iteration") >= limits.max_iterations, note("max_iterations", "iteration"))
        .when(F.col("looping") > 0, F.lit("ongoing_expansion"))
        .otherwise(F.lit("all_nodes_terminal"))
    )
    return rows.select("graph_id", decision.alias("decision"), reason.alias("reason"))


def decide_strategy(g: Graphs, name: str) -> DataFrame:
    """CONTINUE while any node is LOOP, else HALT."""
    looping = g.nodes.groupBy("graph_id").agg(F.bool_or(F.col("status") == "LOOP").alias("looping"))
    return (
        g.graphs.select("graph_id")
        .join(looping, "graph_id", "left")
        .select(
            "graph_id",
            F.when(F.col("looping"), "CONTINUE").otherwise("HALT").alias("decision"),
            F.lit(f"strategy: {name}").alias("reason"),
        )
    )


def decision_history(g: Graphs, state: DataFrame) -> DataFrame:
    """One row per evaluated graph and status, with the size and goal of the graph."""
    edges = g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"))
    goal = F.try_element_at("meta", F.lit("goal")).alias("goal")
    return (
        state.select("graph_id", "iteration", "depth")
        .join(g.graphs.select("graph_id", goal), "graph_id", "left")
        .join(node_counts(g.nodes), "graph_id", "left")
        .join(edges, "graph_id", "left")
        .join(status_counts(g.nodes), "graph_id", "left")
        .fillna(0, ["node_count", "edge_count", "count"])
    )


def explain(nodes: DataFrame) -> DataFrame:
    """A sentence per node: id, status and value with three decimals."""
    text = F.format_string(
        "Node %s: status=%s, value=%.3f", F.col("node_id"), F.col("status"), slots.metric("ablation_value")
    )
    return nodes.select("graph_id", "node_id", text.alias("explanation"))
