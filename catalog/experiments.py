"""Queries on graph documents, result buckets and strategy analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import ORDER, RUNS, SUPPLY, order_graphs, run_data, runs, supply_graph, table
from graphloom.functions import slots
from graphloom.model import Graphs
from graphloom.operators import analysis
from graphloom.session import checkpoint_dir
from graphloom.sources import graph_json as GJ
from graphloom.sources import results


def _goal_graph(spark, sf) -> Graphs:
    _, goal = order_graphs(spark, sf)
    return goal.with_nodes(goal.nodes.withColumn("embedding", F.lit(None).cast("array<float>")))


def _document_sql(node: str, edge: str, opening: str, closing: str, meta: str) -> str:
    return f"""WITH {ORDER},
te AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS graph_id, 't' || c_custkey AS edge_id, c_custkey AS ord, 'M' || c_mktsegment AS source, 'C' || c_custkey AS target, 'targets' AS relation FROM customer
  UNION ALL
  SELECT CAST(c_nationkey AS VARCHAR), 'c' || o_orderkey, o_orderkey, 'M' || c_mktsegment, 'O' || o_orderkey, 'covers' FROM o),
nj AS (SELECT graph_id, ord, j, (row_number() OVER (PARTITION BY graph_id ORDER BY ord, j) - 1) // 500 AS part FROM (SELECT graph_id, ord, {node} AS j FROM t_nodes)),
n AS (SELECT graph_id, part, string_agg(j, ',' ORDER BY ord, j) AS nodes FROM nj GROUP BY ALL),
ej AS (SELECT graph_id, ord, j, (row_number() OVER (PARTITION BY graph_id ORDER BY ord, j) - 1) // 500 AS part FROM (SELECT graph_id, ord, {edge} AS j FROM te)),
e AS (SELECT graph_id, part, string_agg(j, ',' ORDER BY ord, j) AS edges FROM ej GROUP BY ALL)
SELECT coalesce(n.graph_id, e.graph_id) AS graph_id, coalesce(n.part, e.part) AS part,
  '{{"graph_id":"' || coalesce(n.graph_id, e.graph_id) || '","depth":1,"source":"gpt_expander","nodes":{opening}' || coalesce(nodes, '')
  || '{closing},"edges":[' || coalesce(edges, '') || ']{meta}}}' AS json
FROM n FULL JOIN e ON n.graph_id = e.graph_id AND n.part = e.part"""


_PLAIN_NODE = """'{"id":"' || node_id || '","status":"","attributes":{"label":"' || label || '","node_type":"' || node_type || '"},"metrics":{},"state":{},"metadata":{},"has_subgraph":false}'"""
_PLAIN_EDGE = """'{"id":"' || edge_id || '","source":"' || source || '","target":"' || target || '","attributes":{"relation":"' || relation || '"},"metrics":{},"metadata":{}}'"""
_SERVICE_NODE = """'"' || node_id || '":{"id":"' || node_id || '","label":"' || label || '","node_type":"' || node_type || '","expandable":true,"attributes":{"label":"' || label || '","node_type":"' || node_type || '"},"metrics":{},"state":{},"metadata":{}}'"""
_SERVICE_EDGE = """'{"source":"' || source || '","target":"' || target || '","relation":"' || relation || '","weight":0.0,"attributes":{"relation":"' || relation || '"},"metrics":{},"metadata":{}}'"""


@query("graph_json", _document_sql(_PLAIN_NODE, _PLAIN_EDGE, "[", "]", ',"metadata":{}'))
def graph_json(spark, sf):
    return GJ.graph_json(_goal_graph(spark, sf), part_size=500)


@query("service_json", _document_sql(_SERVICE_NODE, _SERVICE_EDGE, "{", "}", ""))
def service_json(spark, sf):
    return GJ.service_json(_goal_graph(spark, sf), part_size=500)


@query("read_graph_json_nodes", f"WITH {ORDER} SELECT graph_id, node_id, label, node_type, '' AS status FROM t_nodes")
def read_graph_json_nodes(spark, sf):
    g = GJ.read_graph_json(GJ.graph_json(_goal_graph(spark, sf), part_size=500))
    return g.nodes.select("graph_id", "node_id", "label", "node_type", "status")


@query("read_graph_json_edges", f"WITH {SUPPLY} SELECT graph_id, edge_id, source, target, relation, weight FROM edges")
def read_graph_json_edges(spark, sf):
    g = GJ.read_graph_json(GJ.graph_json(supply_graph(spark, sf)))
    return g.edges.select("graph_id", "edge_id", "source", "target", "relation", slots.metric("weight").alias("weight"))


@query(
    "display_elements",
    f"""WITH {SUPPLY}
SELECT graph_id, 'nodes' AS "group", node_id AS id, label, 'unknown' AS source FROM nodes
UNION ALL SELECT graph_id, 'edges', source || '-' || target || '-' || relation, NULL, source FROM edges""",
)
def display_elements(spark, sf):
    data = F.from_json("json", "data struct<label:string,source:string>")["data"]
    elements = GJ.display_elements(supply_graph(spark, sf))
    return elements.select("graph_id", "group", "id", data["label"].alias("label"), data["source"].alias("source"))


@query(
    "runtime_keys_to_state",
    f"WITH {SUPPLY} SELECT graph_id, node_id, 'done' AS state_status, node_type AS state_source, label AS meta_note, CAST(NULL AS VARCHAR) AS meta_source FROM nodes",
)
def runtime_keys_to_state(spark, sf):
    meta = F.create_map(F.lit("status"), F.lit("done"), F.lit("source"), F.col("node_type"), F.lit("note"), F.col("label"))
    state = F.create_map(F.lit("source"), F.lit("old"))
    nodes = supply_graph(spark, sf).nodes.withColumns({"meta": meta, "state": state})
    return slots.runtime_to_state(nodes).select(
        "graph_id",
        "node_id",
        F.try_element_at("state", F.lit("status")).alias("state_status"),
        F.try_element_at("state", F.lit("source")).alias("state_source"),
        slots.meta("note").alias("meta_note"),
        slots.meta("source").alias("meta_source"),
    )


@query(
    "slot_reads_and_writes",
    f"""WITH {SUPPLY} SELECT graph_id, node_id, 0.0::DOUBLE AS missing_metric, 2.5::DOUBLE AS written_metric, 'none' AS missing_attr, node_type AS written_attr,
'' AS status, 'x' AS written_state FROM nodes""",
)
def slot_reads_and_writes(spark, sf):
    nodes = supply_graph(spark, sf).nodes
    nodes = nodes.withColumn("metrics", slots.put("metrics", "double", weight=1, other=0))
    nodes = nodes.withColumns(
        {"metrics": slots.put("metrics", "double", weight=2.5), "attrs": slots.put("attrs", score=F.col("node_type"))}
    )
    nodes = slots.put_state(nodes, F.create_map(F.lit("status"), F.lit("LOOP"), F.lit("step"), F.lit("x")))
    return nodes.select(
        "graph_id",
        "node_id",
        slots.metric("nothing").alias("missing_metric"),
        slots.metric("weight").alias("written_metric"),
        slots.attr("nothing", "none").alias("missing_attr"),
        slots.attr("score").alias("written_attr"),
        slots.state("status").alias("status"),
        slots.state("step").alias("written_state"),
    )


@query(
    "build_nodes",
    """SELECT CAST(doc_id AS VARCHAR) AS node_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE lang END AS label,
CASE WHEN doc_id % 2 = 0 THEN 'LOOP' ELSE 'NEW' END AS status, source AS kept FROM documents""",
)
def build_nodes(spark, sf):
    inner = F.when(F.col("doc_id") % 2 == 0, F.lit("LOOP")).otherwise(F.lit(""))
    loose = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("node_id"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang")).alias("label"),
        F.lit("NEW").alias("status"),
        F.create_map(F.lit("status"), inner, F.lit("kept"), F.col("source")).alias("state"),
    )
    return slots.build_nodes(loose).select("node_id", "label", "status", F.try_element_at("state", F.lit("kept")).alias("kept"))


@query(
    "enrich_nodes",
    f"""WITH {SUPPLY} SELECT graph_id, node_id, CASE WHEN node_type = 'part' THEN '[E] ' || label ELSE label END AS label,
CASE WHEN node_type = 'part' THEN '0.7' ELSE 'old' END AS score, 'true' AS enriched FROM nodes""",
)
def enrich_nodes(spark, sf):
    nodes = supply_graph(spark, sf).nodes
    seen = F.when(F.col("node_type") == "supplier", F.create_map(F.lit("enriched"), F.lit("true"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    half = F.when(F.col("node_id") < "P5", F.concat(F.lit("[E] "), "label")).otherwise(F.col("label"))
    nodes = nodes.withColumns(
        {
            "state": seen,
            "attrs": slots.put("attrs", score="old"),
            "label": F.when(F.col("node_type") == "part", half).otherwise(F.col("label")),
        }
    )
    return slots.enrich(nodes, 1.5).select(
        "graph_id", "node_id", "label", slots.attr("score").alias("score"), slots.state("enriched").alias("enriched")
    )


@query(
    "bucket_rows",
    f"""WITH {RUNS}
SELECT experiment_id, 'trace' AS category, 'execution_trace' AS key, part, count(*) AS entries, CAST(NULL AS VARCHAR) AS value FROM trace GROUP BY ALL
UNION ALL SELECT experiment_id, 'logs', 'execution_logs', event_id // 1000, count(*), NULL FROM ev WHERE event_type = 'error' GROUP BY ALL
UNION ALL SELECT experiment_id, 'stats', 'intermediate_telemetry', 0, NULL,
  '{{' || string_agg('"' || stage || '":{{"node_count":' || node_count || ',"edge_count":' || edge_count || ',"depth":0,"source":"events"}}', ',' ORDER BY stage) || '}}'
  FROM stats GROUP BY experiment_id
UNION ALL SELECT experiment_id, 'metric', 'events', 0, NULL, CAST(iterations AS VARCHAR) FROM trace_totals
UNION ALL SELECT experiment_id, 'metric', 'note', 0, NULL, 'plain "text"' FROM experiments
UNION ALL SELECT experiment_id, 'graph', 'G_B', 0, NULL, '{{"nodes":[]}}' FROM experiments
UNION ALL SELECT experiment_id, 'graph', 'G_T', 0, NULL, '{{cut off' FROM experiments""",
)
def bucket_rows(spark, sf):
    lists = F.col("category").isin("trace", "logs")
    return run_data(spark, sf).select(
        "experiment_id",
        "category",
        "key",
        "part",
        F.when(lists, F.json_array_length("value")).cast("bigint").alias("entries"),
        F.when(~lists, F.col("value")).alias("value"),
    )


@query(
    "reassembled_trace",
    f"WITH {RUNS} SELECT experiment_id, part, CAST(row_number() OVER (PARTITION BY experiment_id, part ORDER BY seq) - 1 AS INTEGER) AS pos, action FROM trace",
)
def reassembled_trace(spark, sf):
    return analysis.trace_rows(run_data(spark, sf)).drop("entry")


@query(
    "reassembled_metrics",
    rf"""WITH {RUNS} SELECT experiment_id, 'events' AS key, CAST(iterations AS VARCHAR) AS value FROM trace_totals
UNION ALL SELECT experiment_id, 'note', '"plain \"text\""' FROM experiments""",
)
def reassembled_metrics(spark, sf):
    return analysis.metric_rows(run_data(spark, sf))


@query("reassembled_stats", f"WITH {RUNS} SELECT * FROM stats")
def reassembled_stats(spark, sf):
    return analysis.stat_rows(run_data(spark, sf))


@query(
    "reassembled_graphs",
    f"WITH {RUNS} SELECT experiment_id, 'G_B' AS stage, CAST(0 AS BIGINT) AS part, '{{\"nodes\":[]}}' AS json FROM experiments",
)
def reassembled_graphs(spark, sf):
    return analysis.graph_rows(run_data(spark, sf))


@query(
    "reassembled_logs",
    f"WITH {RUNS} SELECT experiment_id, 'event ' || event_id AS message, 'ERROR' AS level FROM ev WHERE event_type = 'error'",
)
def reassembled_logs(spark, sf):
    logs = analysis.log_rows(run_data(spark, sf))
    return logs.select(
        "experiment_id",
        F.get_json_object("entry", "$.message").alias("message"),
        F.get_json_object("entry", "$.level").alias("level"),
    )


@query(
    "experiment_details",
    f"""WITH {RUNS}, parts AS (SELECT experiment_id, part FROM trace GROUP BY ALL UNION ALL SELECT experiment_id, event_id // 1000 FROM ev WHERE event_type = 'error' GROUP BY ALL),
d AS (SELECT experiment_id, count(*) + 5 AS data_count FROM parts GROUP BY experiment_id)
SELECT experiment_id, name, halting_strategy, status, coalesce(node_count, 0) AS node_count, data_count, iterations
FROM experiments LEFT JOIN node_totals USING (experiment_id) LEFT JOIN trace_totals USING (experiment_id) LEFT JOIN d USING (experiment_id)""",
)
def experiment_details(spark, sf):
    r = runs(spark, sf)
    out = analysis.experiment_details(r["experiments"], r["nodes"], run_data(spark, sf))
    return out.select("experiment_id", "name", "halting_strategy", "status", "node_count", "data_count", "iterations")


@query(
    "compare_experiments",
    f"""WITH {RUNS} SELECT experiment_id, name, halting_strategy AS strategy, coalesce(node_count, 0) AS node_count, iterations
FROM experiments LEFT JOIN node_totals USING (experiment_id) LEFT JOIN trace_totals USING (experiment_id) WHERE experiment_id IN ('3', '5', '999999')""",
)
def compare_experiments(spark, sf):
    r = runs(spark, sf)
    return analysis.compare(r["experiments"], r["nodes"], run_data(spark, sf), ["3", "5", "999999"])


@query(
    "compare_actions",
    f"WITH {RUNS} SELECT experiment_id, action, count(*) AS count FROM trace WHERE experiment_id IN ('3', '5', '999999') GROUP BY ALL",
)
def compare_actions(spark, sf):
    return analysis.compare_actions(runs(spark, sf)["experiments"], run_data(spark, sf), ["3", "5", "999999"])


@query(
    "strategy_performance",
    f"""WITH {RUNS} SELECT halting_strategy AS strategy, count(*) AS count, CAST(sum(coalesce(node_count, 0)) AS BIGINT) AS total_nodes,
CAST(sum(iterations) AS BIGINT) AS total_iterations, avg(coalesce(node_count, 0)) AS avg_nodes, avg(iterations) AS avg_iterations
FROM experiments LEFT JOIN node_totals USING (experiment_id) LEFT JOIN trace_totals USING (experiment_id)
WHERE status IN ('completed', 'success') GROUP BY halting_strategy""",
)
def strategy_performance(spark, sf):
    r = runs(spark, sf)
    return analysis.strategy_performance(r["experiments"], r["nodes"], run_data(spark, sf))


@query(
    "strategy_actions",
    f"""WITH {RUNS} SELECT halting_strategy AS strategy, action, count(*) AS count FROM trace JOIN experiments USING (experiment_id)
WHERE status IN ('completed', 'success') GROUP BY ALL""",
)
def strategy_actions(spark, sf):
    return analysis.strategy_actions(runs(spark, sf)["experiments"], run_data(spark, sf))


@query("finished_by_strategy", f"WITH {RUNS} SELECT * FROM experiments WHERE status IN ('completed', 'success') AND halting_strategy = 'asi'")
def finished_by_strategy(spark, sf):
    return analysis.finished(runs(spark, sf)["experiments"], "asi")


@query("list_experiments", f"WITH {RUNS} SELECT experiment_id, name, goal, status, created_at FROM experiments")
def list_experiments(spark, sf):
    return analysis.list_experiments(runs(spark, sf)["experiments"])


@query(
    "delete_experiments",
    f"WITH {RUNS} SELECT experiment_id, node_id FROM nodes WHERE experiment_id NOT IN (SELECT experiment_id FROM experiments WHERE status = 'running')",
)
def delete_experiments(spark, sf):
    r = runs(spark, sf)
    gone = r["experiments"].where("status = 'running'")
    _, nodes = analysis.without(gone, r["experiments"], r["nodes"])
    return nodes.select("experiment_id", "node_id")


@query(
    "available_stages",
    f"""WITH {RUNS}, named AS (
  SELECT experiment_id, CASE stage WHEN 'click' THEN 'Final' WHEN 'error' THEN 'G_T' WHEN 'purchase' THEN 'iteration_10' WHEN 'signup' THEN 'iteration_9' ELSE stage END AS stage FROM stats WHERE node_count > 0)
SELECT experiment_id, stage, CAST(row_number() OVER (PARTITION BY experiment_id ORDER BY CASE stage WHEN 'Final' THEN 9 WHEN 'G_T' THEN 0 WHEN 'iteration_9' THEN 1 WHEN 'iteration_10' THEN 2 ELSE 3 END) AS INTEGER) AS position FROM named""",
)
def available_stages(spark, sf):
    names = {"click": "Final", "error": "G_T", "purchase": "iteration_10", "signup": "iteration_9"}
    return analysis.available_stages(runs(spark, sf)["stats"].replace(names, subset=["stage"]))


@query(
    "stored_node_rows",
    f"""WITH {SUPPLY} SELECT graph_id AS experiment_id, node_id, label, CAST(ord % 5 AS INTEGER) AS level,
'{{"kind":"' || node_type || '","_meta":{{"source":"test"}}}}' AS attributes, '{{}}' AS metrics, CASE WHEN node_type = 'part' THEN 'S0' END AS parent_node_id FROM nodes""",
)
def stored_node_rows(spark, sf):
    nodes = supply_graph(spark, sf).nodes.withColumns(
        {
            "attrs": F.create_map(F.lit("kind"), F.col("node_type")),
            "meta": F.create_map(F.lit("source"), F.lit("test")),
            "state": F.when(
                F.col("node_type") == "part",
                F.create_map(F.lit("level"), (F.col("ord") % 5).cast("string"), F.lit("parentNodeId"), F.lit("S0")),
            ).otherwise(F.create_map(F.lit("level"), (F.col("ord") % 5).cast("string"))),
        }
    )
    return analysis.node_rows(nodes).drop("state")


@query(
    "run_metrics",
    f"""WITH {RUNS}, t AS (SELECT experiment_id, min(floor(epoch(ts)))::DOUBLE AS a, max(floor(epoch(ts)))::DOUBLE AS b, CAST(max(event_id % 50) AS BIGINT) AS m FROM ev GROUP BY experiment_id)
SELECT experiment_id, m AS total_iterations, coalesce(node_count, 0) AS final_node_count, b - a AS duration FROM t LEFT JOIN node_totals USING (experiment_id)""",
)
def run_metrics(spark, sf):
    r = runs(spark, sf)
    times = r["trace"].groupBy("experiment_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    evaluations = r["trace"].select("experiment_id", (F.col("seq") % 50).alias("iteration"))
    return analysis.run_metrics(times, evaluations, r["nodes"])


@query(
    "fusion_convergence",
    f"""WITH {RUNS} SELECT experiment_id, max(CASE WHEN stage = 'click' THEN node_count END) AS evidence_nodes, max(CASE WHEN stage = 'view' THEN node_count END) AS goal_nodes,
max(CASE WHEN stage = 'signup' THEN node_count END) AS fused_nodes FROM stats GROUP BY experiment_id
HAVING evidence_nodes IS NOT NULL AND goal_nodes IS NOT NULL AND fused_nodes IS NOT NULL""",
)
def fusion_convergence(spark, sf):
    return analysis.convergence(runs(spark, sf)["stats"], ("click", "view", "signup"))


@query(
    "compare_stats",
    f"""WITH {RUNS} SELECT experiment_id, CASE stage WHEN 'click' THEN 'G_B' WHEN 'view' THEN 'G_T' ELSE 'G_F' END AS stage, node_count, edge_count, depth, source
FROM stats WHERE experiment_id IN ('3', '5', '999999') AND stage IN ('click', 'view', 'signup')""",
)
def compare_stats(spark, sf):
    r = runs(spark, sf)
    named = r["stats"].replace({"click": "G_B", "view": "G_T", "signup": "G_F"}, subset=["stage"])
    return analysis.compare_stats(r["experiments"], analysis.stats_bucket(named), ["3", "5", "999999"])


@query(
    "publish_replace_delete",
    f"""WITH {RUNS}, kept AS (SELECT * FROM experiments WHERE CAST(experiment_id AS BIGINT) % 5 <> 3),
n AS (SELECT experiment_id, count(*) AS nodes FROM nodes GROUP BY experiment_id),
t AS (SELECT experiment_id, count(*) AS steps FROM trace GROUP BY experiment_id)
SELECT k.experiment_id, CASE WHEN k.status = 'running' THEN 'failed' ELSE k.status END AS status,
  CASE WHEN k.status = 'running' THEN 0 ELSE coalesce(n.nodes, 0) END AS nodes, coalesce(t.steps, 0) AS steps
FROM kept k LEFT JOIN n USING (experiment_id) LEFT JOIN t USING (experiment_id)""",
)
def publish_replace_delete(spark, sf):
    """All experiments are published; running ones again as failed, without nodes; those of one strategy are deleted; what shows nothing is removed."""
    store = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    r = runs(spark, sf)
    first = results.publish(store, "all", r["experiments"], r["trace"], r["nodes"])
    running = r["experiments"].where("status = 'running'")
    again = running.withColumn("status", F.lit("failed"))
    results.publish(store, "again", again, r["trace"].join(running, "experiment_id", "left_semi"), r["nodes"].where("false"), base=first)
    results.publish(store, "spare", running, r["trace"].where("false"), r["nodes"].where("false"))
    results.publish(store, "last", again, r["trace"].join(running, "experiment_id", "left_semi"), r["nodes"].where("false"))
    results.delete(spark, store, "gone", r["experiments"].where("CAST(experiment_id AS BIGINT) % 5 = 3"))
    results.vacuum(spark, store, 0.0)
    seen = results.read_published(spark, store)
    count = lambda name, out: seen[name].groupBy("experiment_id").agg(F.count(F.lit(1)).alias(out))
    found = seen["experiments"].join(count("nodes", "nodes"), "experiment_id", "left").join(count("data", "steps"), "experiment_id", "left")
    return found.select("experiment_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "steps")])


@query("exported_csv", f"WITH {RUNS} SELECT experiment_id AS id, name, status FROM experiments")
def exported_csv(spark, sf):
    folder = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    results.export(runs(spark, sf)["experiments"], folder, "csv")
    return spark.read.option("header", True).csv(folder)


@query("exported_json", f"WITH {RUNS} SELECT experiment_id, name, goal, halting_strategy, status FROM experiments")
def exported_json(spark, sf):
    folder = f"{checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    results.export(runs(spark, sf)["experiments"], folder)
    return spark.read.schema("experiment_id string, name string, goal string, halting_strategy string, status string").json(folder)


@query(
    "stage_snapshots",
    f"""WITH {SUPPLY} SELECT 'G_B' AS stage, '20240101' AS run_ts, graph_id, node_id, label FROM nodes
UNION ALL SELECT 'G_F', '20240102', graph_id, node_id, upper(label) FROM nodes WHERE node_type = 'part'""",
)
def stage_snapshots(spark, sf):
    """Two stages of one run kept side by side, and read back with their names and times."""
    folder = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    nodes = supply_graph(spark, sf).nodes.select("graph_id", "node_id", "label", "node_type")
    results.snapshot(nodes.drop("node_type"), folder, "G_B", "20240101", "trace")
    results.snapshot(nodes.where("node_type = 'part'").drop("node_type").withColumn("label", F.upper("label")), folder, "G_F", "20240102", "trace")
    fields = "graph_id string, node_id string, label string, stage string, run_ts string"
    return spark.read.schema(fields).json(f"{folder}/trace").select("stage", "run_ts", "graph_id", "node_id", "label")


@query(
    "safe_values",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS plain, '[' || o_orderkey || ',' || o_custkey || ']' AS listed,
  '{"k":"' || o_orderstatus || '"}' AS nested, CASE WHEN o_custkey % 2 = 0 THEN '{"a":' || o_custkey || '}' END AS named FROM orders""",
)
def safe_values(spark, sf):
    """Values of any kind as text that can be stored: containers as JSON, a missing one stays missing."""
    from graphloom.functions.values import as_text

    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("plain"), F.array("o_orderkey", "o_custkey").alias("listed"), F.create_map(F.lit("k"), "o_orderstatus").alias("nested"),
        F.when(F.col("o_custkey") % 2 == 0, F.struct(F.col("o_custkey").alias("a"))).alias("named"),
    )
    return rows.select("o_orderkey", *[as_text(F.col(n), k).alias(n) for n, k in rows.dtypes[1:]])
