"""Queries on the topology and halting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import SUPPLY, supply_graph, supply_scored
from graphloom.functions import slots
from graphloom.operators import halting, summary, topology
from graphloom.operators.halting import Limits

WIDE = Limits(max_nodes=10_000_000)


@query("node_degree", f"WITH {SUPPLY} SELECT graph_id, node_id, degree FROM degrees")
def node_degree(spark, sf):
    return topology.degrees(supply_graph(spark, sf))


@query(
    "neighbors_undirected",
    f"""WITH {SUPPLY},
pairs AS (SELECT graph_id, source AS node_id, target AS neighbor FROM edges
          UNION SELECT graph_id, target, source FROM edges)
SELECT graph_id, node_id, count(*) AS neighbors, min(neighbor) AS first_neighbor, max(neighbor) AS last_neighbor
FROM pairs GROUP BY graph_id, node_id""",
)
def neighbors_undirected(spark, sf):
    lists = topology.neighbors(supply_graph(spark, sf))
    return lists.groupBy("graph_id", "node_id").agg(
        F.sum(F.size("neighbors")).cast("bigint").alias("neighbors"),
        F.min(F.array_min("neighbors")).alias("first_neighbor"),
        F.max(F.array_max("neighbors")).alias("last_neighbor"),
    )


@query("successors", f"WITH {SUPPLY} SELECT graph_id, source AS node_id, target AS neighbor, ord FROM edges")
def successors(spark, sf):
    return topology.neighbor_pairs(supply_graph(spark, sf), "out")


@query("predecessors", f"WITH {SUPPLY} SELECT graph_id, target AS node_id, source AS neighbor, ord FROM edges")
def predecessors(spark, sf):
    return topology.neighbor_pairs(supply_graph(spark, sf), "in")


@query(
    "score_filter_nodes",
    f"WITH {SUPPLY} SELECT graph_id || '_filtered' AS graph_id, node_id, label FROM nodes WHERE score >= 0.5",
)
def score_filter_nodes(spark, sf):
    return topology.score_filter(supply_graph(spark, sf)).nodes.select("graph_id", "node_id", "label")


@query(
    "score_filter_edges",
    f"""WITH {SUPPLY}, kept AS (SELECT graph_id, node_id FROM nodes WHERE score >= 0.5)
SELECT e.graph_id || '_filtered' AS graph_id, e.edge_id, e.source, e.target, e.relation
FROM edges e
WHERE EXISTS (SELECT 1 FROM kept k WHERE k.graph_id = e.graph_id AND k.node_id = e.source)
  AND EXISTS (SELECT 1 FROM kept k WHERE k.graph_id = e.graph_id AND k.node_id = e.target)""",
)
def score_filter_edges(spark, sf):
    return topology.score_filter(supply_graph(spark, sf)).edges.select(
        "graph_id", "edge_id", "source", "target", "relation"
    )


def _scored(spark, sf, mode="rule_based", limits=WIDE):
    return halting.score_nodes(supply_graph(spark, sf), mode, limits=limits)


@query(
    "score_rule_based",
    f"""WITH {supply_scored(WIDE.max_nodes)}
SELECT graph_id, node_id, status, halt_reason, CAST(degree AS DOUBLE) AS ablation_value,
       least(1.0, degree / 10.0)::DOUBLE AS confidence FROM scored""",
)
def score_rule_based(spark, sf):
    return _scored(spark, sf).nodes.select(
        "graph_id",
        "node_id",
        "status",
        slots.state("halt_reason").alias("halt_reason"),
        slots.metric("ablation_value").alias("ablation_value"),
        slots.metric("confidence").alias("confidence"),
    )


@query(
    "score_rule_based_default_limits",
    f"WITH {supply_scored(50)} SELECT graph_id, node_id, status, halt_reason FROM scored",
)
def score_rule_based_default_limits(spark, sf):
    return _scored(spark, sf, limits=Limits()).nodes.select(
        "graph_id", "node_id", "status", slots.state("halt_reason").alias("halt_reason")
    )


def _strategy_sql(value: str, hi: float, lo: float, metrics: dict[str, str]) -> str:
    columns = ", ".join(f"CAST({expr} AS DOUBLE) AS {name}" for name, expr in metrics.items())
    return f"""WITH {SUPPLY}, valued AS (
  SELECT graph_id, node_id, label, degree, CAST({value} AS DOUBLE) AS v FROM nodes JOIN degrees USING (graph_id, node_id))
SELECT graph_id, node_id, v AS ablation_value, {columns},
  CASE WHEN v > {hi} THEN 'HALT-ACCEPT' WHEN v < {lo} THEN 'HALT-DROP' ELSE 'LOOP' END AS status FROM valued"""


_STRATEGY_CHECKS = {
    "asi": ("degree", 5, 1, {"structural_importance": "degree", "uncertainty": "0.3", "confidence": "least(1.0, v / 10)"}),
    "psg": ("1.0", 0.8, 0.2, {"probabilistic_score": "v", "uncertainty": "0.5", "confidence": "v"}),
    "scd": (
        "length(label)",
        15,
        3,
        {"semantic_consistency": "v / 10", "uncertainty": "0.4", "confidence": "least(1.0, v / 20)"},
    ),
    "ucb": ("0.5", 0.7, 0.3, {"ucb_score": "v", "uncertainty": "0.6", "confidence": "v"}),
    "rules": ("degree", 5, 1, {"structural_importance": "degree", "uncertainty": "0.5", "confidence": "0.5"}),
}


def _add_strategy(name: str) -> None:
    value, hi, lo, metrics = _STRATEGY_CHECKS[name]

    @query(f"score_{name}", _strategy_sql(value, hi, lo, metrics))
    def run(spark, sf):
        nodes = _scored(spark, sf, name).nodes
        names = ["ablation_value", *metrics]
        return nodes.select("graph_id", "node_id", "status", *[slots.metric(m).alias(m) for m in names])


for _name in _STRATEGY_CHECKS:
    _add_strategy(_name)


@query("score_placeholder", f"WITH {SUPPLY} SELECT graph_id, node_id, '' AS status FROM nodes")
def score_placeholder(spark, sf):
    return _scored(spark, sf, "placeholder").nodes.select("graph_id", "node_id", "status")


def _add_mode(mode: str, status: str) -> None:
    sql = f"WITH {SUPPLY} SELECT graph_id, node_id, '{status}' AS status, CAST(degree AS DOUBLE) AS ablation_value FROM degrees"

    @query(f"score_{mode}", sql)
    def run(spark, sf):
        return _scored(spark, sf, mode).nodes.select(
            "graph_id", "node_id", "status", slots.metric("ablation_value").alias("ablation_value")
        )


_add_mode("always_loop", "LOOP")
_add_mode("always_halt", "HALT-ACCEPT")


@query(
    "status_histogram",
    f"WITH {supply_scored(WIDE.max_nodes)} SELECT graph_id, status, count(*) AS count FROM scored GROUP BY graph_id, status",
)
def status_histogram(spark, sf):
    return halting.status_counts(_scored(spark, sf).nodes)


def _decision_sql(max_nodes: int) -> str:
    return f"""WITH {supply_scored(max_nodes)}, totals AS (
  SELECT graph_id, count(*) AS n, count(*) FILTER (status = 'LOOP') AS looping,
         count(*) FILTER (status = 'HALT-ACCEPT') AS accepted FROM scored GROUP BY graph_id)
SELECT graph_id,
  CASE WHEN n >= {max_nodes} THEN 'HALT' WHEN looping > 0 THEN 'CONTINUE' WHEN accepted > 0 THEN 'HALT' ELSE 'DROP' END AS decision,
  CASE WHEN n >= {max_nodes} THEN 'max_nodes reached (' || n || ')' WHEN looping > 0 THEN 'ongoing_expansion'
       ELSE 'all_nodes_terminal' END AS reason FROM totals"""


@query("decide_global", _decision_sql(WIDE.max_nodes))
def decide_global(spark, sf):
    return halting.decide_global(_scored(spark, sf), limits=WIDE)


@query("decide_global_default_limits", _decision_sql(50))
def decide_global_default_limits(spark, sf):
    return halting.decide_global(_scored(spark, sf, limits=Limits()))


@query(
    "decide_strategy",
    f"""WITH {SUPPLY}, valued AS (SELECT graph_id, degree BETWEEN 1 AND 5 AS looping FROM degrees)
SELECT graph_id, CASE WHEN bool_or(looping) THEN 'CONTINUE' ELSE 'HALT' END AS decision, 'strategy: ASI' AS reason
FROM valued GROUP BY graph_id""",
)
def decide_strategy(spark, sf):
    return halting.decide_strategy(_scored(spark, sf, "asi"), "ASI")


@query(
    "decision_history",
    f"""WITH {supply_scored(WIDE.max_nodes)}, e AS (SELECT graph_id, count(*) AS edge_count FROM edges GROUP BY graph_id),
h AS (SELECT graph_id, status, count(*) AS count FROM scored GROUP BY graph_id, status)
SELECT h.graph_id, 0 AS iteration, 0 AS depth, CAST(NULL AS VARCHAR) AS goal, s.node_count,
       coalesce(e.edge_count, 0) AS edge_count, h.status, h.count
FROM h JOIN sizes s USING (graph_id) LEFT JOIN e USING (graph_id)""",
)
def decision_history(spark, sf):
    g = _scored(spark, sf)
    start = g.graphs.select("graph_id", F.lit(0).alias("depth"), F.lit(0).alias("iteration"))
    return halting.decision_history(g, start)


@query(
    "node_explanation",
    f"""WITH {supply_scored(WIDE.max_nodes)}
SELECT graph_id, node_id, 'Node ' || node_id || ': status=' || status || ', value=' || degree || '.000' AS explanation FROM scored""",
)
def node_explanation(spark, sf):
    return halting.explain(_scored(spark, sf).nodes)


@query(
    "stage_stats",
    f"""WITH {SUPPLY}, e AS (SELECT graph_id, count(*) AS edge_count FROM edges GROUP BY graph_id)
SELECT graph_id, 'G_B' AS stage, node_count, coalesce(edge_count, 0) AS edge_count, 0 AS depth, 'unknown' AS source
FROM sizes LEFT JOIN e USING (graph_id)""",
)
def stage_stats(spark, sf):
    return summary.stage_stats(supply_graph(spark, sf), "G_B")


@query(
    "graph_summary",
    f"""WITH {SUPPLY}, e AS (SELECT graph_id, count(*) AS edge_count FROM edges GROUP BY graph_id),
head AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY ord) AS position, node_id, label, node_type FROM nodes)
SELECT s.graph_id, node_count, coalesce(edge_count, 0) AS edge_count, 0 AS depth, 'unknown' AS source,
       CAST(position AS INTEGER) AS position, node_id, label, node_type
FROM sizes s LEFT JOIN e USING (graph_id) JOIN head h ON h.graph_id = s.graph_id AND position <= 5""",
)
def graph_summary(spark, sf):
    return summary.graph_summary(supply_graph(spark, sf))
