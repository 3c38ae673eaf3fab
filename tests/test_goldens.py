"""Small known inputs and their results."""

import pytest
from pyspark.sql import functions as F

from graphloom import Graphs
from graphloom.functions import slots, values
from graphloom.operators import analysis, expansion, halting, increments, resolve, summary, topology
from graphloom.operators.halting import Limits
from graphloom.sources import graph_json as GJ


def graph(spark, nodes, edges, **columns):
    n = spark.createDataFrame([("g", i, k) for k, i in enumerate(nodes)], "graph_id string, node_id string, ord long")
    e = spark.createDataFrame(
        [("g", f"e{k}", k, *x) for k, x in enumerate(edges)],
        "graph_id string, edge_id string, ord long, source string, target string, relation string",
    )
    return Graphs.of(n.withColumns(columns) if columns else n, e)


def test_simple_graph(spark):
    g = graph(spark, ["n1", "n2"], [("n1", "n2", "connects")])
    stats = summary.stage_stats(g, "G_B").first()
    assert (stats.node_count, stats.edge_count, stats.depth, stats.source) == (2, 1, 0, "unknown")
    assert {r.node_id: r.label for r in g.nodes.collect()} == {"n1": "n1", "n2": "n2"}


def test_self_loop_counts_once_and_isolated_is_zero(spark):
    g = graph(spark, ["a", "b", "c"], [("a", "a", "r"), ("a", "b", "r"), ("a", "b", "r")])
    assert {r.node_id: r.degree for r in topology.degrees(g).collect()} == {"a": 3, "b": 2, "c": 0}


def test_neighbour_lists_keep_order_and_come_in_parts(spark):
    g = graph(spark, ["a", "b"], [("a", "b", "r"), ("a", "c", "r"), ("a", "b", "s"), ("c", "a", "r")])
    out = topology.neighbors(g, "out").where("node_id = 'a'").first()
    assert out.neighbors == ["b", "c", "b"]
    assert topology.neighbors(g).where("node_id = 'a'").first().neighbors == ["b", "c"]
    hub = graph(spark, ["h"], [("h", f"x{i}", "r") for i in range(500)])
    parts = topology.neighbors(hub, part_size=100).where("node_id = 'h'").collect()
    assert len(parts) > 1 and sorted(x for p in parts for x in p.neighbors) == sorted(f"x{i}" for i in range(500))
    with pytest.raises(ValueError):
        topology.neighbor_pairs(g, "sideways")


def test_halting_modes(spark):
    g = graph(spark, ["n1", "n2"], [("n1", "n2", "related_to")])
    for mode, status, decision in [("always_loop", "LOOP", "CONTINUE"), ("always_halt", "HALT-ACCEPT", "HALT"), ("rule_based", "HALT-DROP", "DROP")]:
        scored = halting.score_nodes(g, mode)
        assert {r.status for r in scored.nodes.collect()} == {status}
        assert halting.decide_global(scored).first().decision == decision
    scored = halting.score_nodes(g, "rule_based")
    assert {r.state["halt_reason"] for r in scored.nodes.collect()} == {"insufficient_nodes"}
    assert halting.decide_global(scored).first().reason == "all_nodes_terminal"


def test_limits_come_in_order_and_not_expandable_is_accepted(spark):
    state = F.when(F.col("node_id") == "a", F.create_map(F.lit("expandable"), F.lit("false"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    g = graph(spark, ["a", "b", "c"], [("a", "b", "r"), ("b", "c", "r")], state=state)
    reasons = {r.node_id: r.state["halt_reason"] for r in halting.score_nodes(g, "rule_based").nodes.collect()}
    assert reasons == {"a": "not_expandable", "b": "continue_expansion", "c": "continue_expansion"}
    at = spark.createDataFrame([("g", 3, 10)], "graph_id string, depth int, iteration int")
    assert halting.decide_global(g, at).first().reason == "max_depth reached (3)"
    assert halting.decide_global(g, at, Limits(9, 3, 10)).first().reason == "max_nodes reached (3)"
    assert halting.decide_global(g, at, Limits(9, 9, 10)).first().reason == "max_iterations reached (10)"
    empty = Graphs(g.graphs, g.nodes.where("false"), g.edges.where("false"))
    assert halting.decide_global(empty).first().decision == "DROP"
    assert halting.decide_strategy(empty, "ASI").first().decision == "HALT"


def test_own_strategy(spark):
    halting.register("flat", halting.Strategy(lambda: F.lit(2.0), 1, 0, lambda v: {"mine": v}))
    scored = halting.score_nodes(graph(spark, ["a"], []), "FLAT").nodes.first()
    assert scored.status == "HALT-ACCEPT" and scored.metrics["mine"] == 2.0
    del halting.STRATEGIES["flat"]


def test_fusion(spark):
    vector = F.array(F.lit(1.0).cast("float"), F.when(F.col("node_id") == "b2", -9.0).otherwise(0.1).cast("float"))
    b = graph(spark, ["b1", "b2"], [("b1", "b2", "r"), ("b1", "gone", "r")], embedding=vector)
    t = graph(spark, ["t1"], [], embedding=vector, status=F.lit("LOOP"))
    fused, mapping = resolve.fuse(b, t)
    assert {r.node_id for r in fused.nodes.collect()} == {"fused_B_b1", "fused_B_b2"}
    assert [(r.node_id, r.new_id) for r in mapping.collect()] == [("fused_T_t1", "fused_B_b1")]
    assert {r.attrs["canonical_id"] for r in fused.nodes.collect()} == {"fused_B_b1", "fused_B_b2"}
    assert [(e.source, e.target) for e in fused.edges.collect()] == [("fused_B_b1", "fused_B_b2")]
    none = Graphs(b.graphs, b.nodes.where("false"), b.edges.where("false"))
    empty, mapping = resolve.fuse(none, none)
    assert empty.nodes.count() == 0 and mapping.count() == 0


def test_merge_keeps_self_loops_and_ignores_missing_ends(spark):
    g = graph(spark, ["a", "b"], [("a", "b", "r"), ("b", "a", "r")])
    mapping = spark.createDataFrame([("g", "b", "a"), ("g", "x", "a"), ("g", "a", "nowhere")], "graph_id string, node_id string, new_id string")
    merged = resolve.apply_mapping(g, mapping)
    assert [r.node_id for r in merged.nodes.collect()] == ["a"]
    assert [(e.source, e.target) for e in merged.edges.collect()] == [("a", "a"), ("a", "a")]


def test_increment_leaves_no_dangling_edge(spark):
    current = graph(spark, ["a", "b"], [])
    inc = graph(spark, ["b", "c"], [("a", "c", "r"), ("c", "x", "r"), ("x", "y", "r")])
    header = inc.graphs.withColumn("meta", F.create_map(F.lit("parent_node_id"), F.lit("a")))
    merged, trace = increments.merge_increment(current, Graphs(header, inc.nodes, inc.edges), 2)
    assert sorted(r.node_id for r in merged.nodes.collect()) == ["a", "b", "c"]
    assert [(e.source, e.target) for e in merged.edges.collect()] == [("a", "c")]
    parent = merged.nodes.where("node_id = 'a'").first()
    assert parent.state == {"expandable": "false", "expanded": "true"}
    row = trace.first()
    assert (row.iteration, row.new_nodes, row.added_nodes, row.parent_node) == (2, 2, 1, "a")


def test_response(spark):
    answers = [
        ("g", '{"nodes":[{"id":"t1","type":"concept"},{"id":"t2","type":"concept"}],"edges":[{"source":"t1","target":"t2","relation":"depends_on"}]}'),
        ("bad", "no json at all"),
        ("twice", '{"nodes":[{"id":"x","label":"old"},{"id":"x","label":"new"}]}'),
    ]
    g = expansion.responses_to_graphs(spark.createDataFrame(answers, "graph_id string, response string"))
    assert {(r.graph_id, r.node_id, r.label) for r in g.nodes.collect()} >= {("g", "t2", "节点_1"), ("twice", "x", "new")}
    assert g.nodes.where("graph_id = 'twice'").count() == 1
    assert g.edges.count() == 1 and g.graphs.count() == 3


def test_frontier_takes_the_best_open_node(spark):
    metrics = F.create_map(F.lit("ablation_value"), F.when(F.col("node_id") == "a", 9.0).otherwise(2.0))
    state = F.when(F.col("node_id") == "a", F.create_map(F.lit("expanded"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    g = graph(spark, ["a", "b", "c"], [], metrics=metrics, state=state)
    assert expansion.expansion_frontier(g).first().node_id == "b"


def test_graph_json_round_trip(spark):
    g = graph(spark, ["a", "b"], [("a", "b", "likes")], status=F.lit("LOOP"), subgraph_id=F.lit("inner"))
    doc = GJ.graph_json(g)
    back = GJ.read_graph_json(doc)
    assert {(r.node_id, r.status) for r in back.nodes.collect()} == {("a", "LOOP"), ("b", "LOOP")}
    assert back.edges.first().relation == "likes"
    loose = spark.createDataFrame([('{"graph_id":"h","nodes":[{"id":"1"}],"edges":[{"source":"1","target":"2"}]}',)], "json string")
    read = GJ.read_graph_json(loose)
    assert read.nodes.first().label == "Unknown" and read.edges.first().relation == "related_to"
    assert (read.graphs.first().source, read.graphs.first().depth) == ("unknown", 0)
    import json

    shown = json.loads(GJ.service_json(g).first().json)
    assert shown["nodes"]["a"]["subgraph"] == {"graph_id": "inner", "_ref": True}
    assert shown["nodes"]["a"]["expandable"] is True and shown["edges"][0]["weight"] == 0.0


def test_value_helpers(spark):
    df = spark.createDataFrame([("0.95", 1.5, 3.0), ("plain", 0.0, 0.25)], "v string, a double, b double")
    rows = df.select(values.json_or_text("v").alias("j"), values.elapsed_ms("a", "b").alias("ms")).collect()
    assert [(r.j, r.ms) for r in rows] == [("0.95", 1500), ('"plain"', 250)]
    day = spark.sql("SELECT timestamp'2024-03-09 10:00:00' AS t").select(values.date_stamp("t").alias("d")).first().d
    assert day == "09-03-2024"


def test_slots(spark):
    df = spark.createDataFrame([("n", "", "", {"status": "LOOP", "x": "1"})], "node_id string, label string, status string, state map<string,string>")
    row = slots.build_nodes(df).first()
    assert (row.label, row.status, row.state) == ("n", "LOOP", {"x": "1"})
    merged = df.select(slots.put("state", x="2", y=F.lit(3)).alias("s")).first().s
    assert merged == {"status": "LOOP", "x": "2", "y": "3"}


EXPERIMENTS = "experiment_id string, name string, halting_strategy string, status string"
DATA = "experiment_id string, category string, key string, part long, value string"


def test_compare_and_performance(spark):
    exp = spark.createDataFrame([("1", "One", "rule_based", "completed"), ("9", "Nine", "asi", "running")], EXPERIMENTS)
    nodes = spark.createDataFrame([("1",), ("1",)], "experiment_id string")
    data = spark.createDataFrame([("1", "trace", "execution_trace", 0, '[{"action":"EXPAND"},{"action":"HALT"},{"x":1}]')], DATA)
    row = analysis.compare(exp, nodes, data, ["1", "2"]).first()
    assert (row.node_count, row.iterations, row.strategy) == (2, 3, "rule_based")
    actions = {r.action: r["count"] for r in analysis.compare_actions(exp, data, ["1", "2"]).collect()}
    assert actions == {"EXPAND": 1, "HALT": 1, "UNKNOWN": 1}
    perf = analysis.strategy_performance(exp, nodes, data).collect()
    assert [(p.strategy, p["count"], p.total_nodes, p.total_iterations) for p in perf] == [("rule_based", 1, 2, 3)]
    with pytest.raises(ValueError):
        analysis.compare(exp, nodes, data, ["1"])


def test_reassembly(spark):
    rows = [
        ("1", "graph", "G_B", 0, '{"nodes":[]}'),
        ("1", "trace", "execution_trace", 0, '[{"action":"EXPAND"}]'),
        ("1", "trace", "execution_trace", 1, '{"action":"ALONE"}'),
        ("1", "metric", "accuracy", 0, "0.95"),
        ("1", "metric", "note", 0, "text"),
        ("1", "stats", "a", 0, '{"G_B":{"node_count":1}}'),
        ("1", "stats", "b", 1, '{"G_B":{"node_count":2}}'),
    ]
    exp = spark.createDataFrame([("1", "One", "s", "success")], EXPERIMENTS)
    data = spark.createDataFrame(rows, DATA)
    got = analysis.get_experiment(exp, data, "1")
    assert {r.key: r.value for r in got["metrics"].collect()} == {"accuracy": "0.95", "note": '"text"'}
    assert [r.action for r in got["trace"].orderBy("part", "pos").collect()] == ["EXPAND", "ALONE"]
    assert got["stats"].first().node_count == 2
    assert got["graphs"].count() == 1
    assert all(df.count() == 0 for df in analysis.get_experiment(exp, data, "none").values())
