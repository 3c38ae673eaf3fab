"""Whole plans and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom import checkpoint_dir, cut, settings, tune
from graphloom.model import Graphs
from graphloom.operators import halting
from graphloom.plans.linear import linear
from graphloom.plans.loop import grow, run
from graphloom.plans.run import RunConfig
from graphloom.sources import results
from graphloom.streaming import telemetry as TM


def start(spark, sizes):
    """A path graph of the given number of nodes per graph."""
    nodes = [(g, f"n{i}", i) for g, n in sizes.items() for i in range(n)]
    edges = [(g, f"e{i}", i, f"n{i}", f"n{i + 1}", "next") for g, n in sizes.items() for i in range(n - 1)]
    return Graphs.of(
        spark.createDataFrame(nodes, "graph_id string, node_id string, ord long"),
        spark.createDataFrame(edges, "graph_id string, edge_id string, ord long, source string, target string, relation string"),
        spark.createDataFrame([(g,) for g in sizes], "graph_id string"),
    )


def one_more(g: Graphs, iteration: int) -> Graphs:
    nodes = g.graphs.select("graph_id", F.lit(f"new{iteration}").alias("node_id"), F.lit(0).alias("ord"))
    edges = g.graphs.select(
        "graph_id",
        F.lit(f"x{iteration}").alias("edge_id"),
        F.lit(0).alias("ord"),
        F.lit("n0").alias("source"),
        F.explode(F.array(F.lit(f"new{iteration}"), F.lit("missing"))).alias("target"),
        F.lit("contains").alias("relation"),
    )
    head = g.graphs.select("graph_id", F.create_map(F.lit("parent_node_id"), F.lit("n1")).alias("meta"))
    return Graphs.of(nodes, edges, head)


def test_loop_freezes_graphs_that_halt(spark, tmp_path):
    run = grow(start(spark, {"tiny": 2, "mid": 5, "full": 60}), one_more, RunConfig(max_iterations=5, max_depth=3))
    decisions = {}
    for r in run.trace.where("action = 'halting_evaluation'").collect():
        d = json.loads(r.details)
        decisions.setdefault(r.experiment_id, []).append((d["iteration"], d["decision"], d["reason"]))
    assert decisions["tiny"] == [(1, "DROP", "all_nodes_terminal")]
    assert decisions["full"] == [(1, "HALT", "max_nodes reached (60)")]
    assert [d[1] for d in sorted(decisions["mid"])] == ["CONTINUE"] * 3
    counts = {r.graph_id: r["count"] for r in run.final.nodes.groupBy("graph_id").count().collect()}
    assert counts == {"tiny": 2, "mid": 8, "full": 60}
    ends = run.final.edges.where("target = 'missing'").count()
    assert ends == 0 and run.final.edges.where("graph_id = 'mid'").count() == 7
    outcome = {r.experiment_id: (r.status, r.decision) for r in run.outcome.collect()}
    assert outcome == {"tiny": ("success", "DROP"), "mid": ("success", "CONTINUE"), "full": ("success", "HALT")}
    assert {r.stage for r in run.stats.collect()} == {"LOOP_1", "LOOP_2", "LOOP_3"}
    # The record can be stored and read back.
    data = run.data()
    assert {r.category for r in data.select("category").distinct().collect()} == {"graph", "trace", "metric", "metadata", "stats", "logs"}
    experiments = run.experiments(run.outcome.select("experiment_id"))
    results.publish(str(tmp_path), "r1", experiments, data, run.node_rows())
    assert results.read_published(spark, str(tmp_path))["nodes"].count() == 70


def test_loop_ends_within_both_limits(spark):
    for iterations, depth, rounds in [(1, 3, 1), (5, 2, 2), (0, 3, 0)]:
        run = grow(start(spark, {"mid": 5}), one_more, RunConfig(max_iterations=iterations, max_depth=depth))
        assert run.trace.where("action = 'halting_evaluation'").count() == rounds
        assert run.final.nodes.count() == 5 + rounds


def test_unscored_strategy_halts_at_once(spark):
    run = grow(start(spark, {"mid": 5}), one_more, RunConfig(mode="asi", score_first=False))
    assert run.outcome.first().decision == "HALT" and run.final.nodes.count() == 5


def test_linear(spark):
    inputs = spark.createDataFrame([("1", "goal", "some long text")], "experiment_id string, goal string, text string")
    run = linear(inputs, enrich_ts=5.0)
    labels = {r.node_id: r.label for r in run.final.nodes.collect()}
    assert labels == {"ROOT": "[E] Seed", **{f"NODE_{i}": f"[E] Item {i}" for i in range(5, 10)}}
    assert run.outcome.first().decision == "COMPLETED"


def test_config():
    cfg = RunConfig.from_json('{"mode": "asi", "limits": {"max_nodes": 9}, "windows": {"overlap": 1}}')
    assert (cfg.mode, cfg.limits.max_nodes, cfg.limits.max_depth, cfg.windows.overlap, cfg.similarity_threshold) == ("asi", 9, 3, 1, 0.9)
    with pytest.raises(ValueError):
        RunConfig.from_json('{"max_nodes": 3}')


def test_cut_keeps_rows_and_drops_lineage(spark):
    df = spark.range(100).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    out = cut(df)
    assert out.count() == 100 and checkpoint_dir(spark) in out.inputFiles()[0]


def envelope(**fields):
    return (json.dumps(fields),)


def test_events_without_parts_are_dropped(spark):
    rows = [
        envelope(experimentId="1", type="LOG", payload={"message": "m", "level": "INFO"}, timestamp=1.0),
        envelope(type="LOG", payload={}),
        envelope(experimentId="1", payload={}),
        envelope(experimentId="1", type="LOG"),
        envelope(experimentId="1", type="TELEMETRY", payload={"intermediate_stats": {"G_B": {"node_count": 3}}}),
        ("broken",),
    ]
    events = TM.parse_events(spark.createDataFrame(rows, "value string"), now=F.lit(7.0))
    routed = {(r.type, r.channel, r.ts) for r in TM.route(events).collect()}
    assert routed == {("LOG", "log", 1.0), ("TELEMETRY", "telemetry", 7.0)}
    assert TM.log_entries(events).first().message == "m"


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = []
    for i in range(60):
        stats = {f"S{i % 3}": {"node_count": i, "edge_count": 1, "depth": 0, "source": "x"}}
        rows.append({"experimentId": str(i % 4), "type": "TELEMETRY", "timestamp": float(i // 7), "seq": i, "payload": {"intermediate_stats": stats}})
    for k in range(3):
        (source / f"{k}.txt").write_text("\n".join(json.dumps(r) for r in rows[k::3]))
    batch = TM.latest_stats(TM.stage_events(TM.parse_events(spark.read.text(str(source)))))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    stream = TM.latest_stats(TM.stage_events(TM.parse_events(lines)))
    TM.table_sink(stream, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    table = TM.read_table(spark, str(tmp_path / "table"), ["experiment_id", "stage"])
    key = lambda df: sorted(map(tuple, df.select("experiment_id", "stage", "node_count").collect()))
    assert key(table) == key(batch) and len(key(batch)) == 12


def test_status(spark):
    rows = [("1", "running", 1.0, 0), ("1", "success", 2.0, 1), ("2", "failed", 1.0, 0), ("2", "running", 1.0, 1)]
    df = spark.createDataFrame(rows, "experiment_id string, status string, ts double, seq long")
    assert {(r.experiment_id, r.status, r.refresh) for r in TM.latest_status(df).collect()} == {("1", "success", True), ("2", "running", False)}


def test_degrees_are_kept_over_rounds(spark, monkeypatch):
    """Graphs that halt in different rounds: kept counts give what all edges give, and scoring reads no edges."""
    nodes = [(g, f"{g}{i}", i, f"n{i}") for g in "abc" for i in range(3)]
    edges = [(g, f"e{i}{k}", i, f"{g}{i}", f"{g}{(i + k) % 3}", "r") for g in "abc" for i in range(3) for k in (0, 1)]
    start = Graphs.of(
        spark.createDataFrame(nodes, "graph_id string, node_id string, ord long, label string"),
        spark.createDataFrame(edges, "graph_id string, edge_id string, ord long, source string, target string, relation string"),
    )

    def expand(g, iteration):
        fresh = g.graphs.select("graph_id", F.concat("graph_id", F.lit(f"x{iteration}")).alias("node_id"), F.lit(0).alias("ord"), F.lit("x").alias("label"))
        new = fresh.select(
            "graph_id", F.lit(f"i{iteration}").alias("edge_id"), F.lit(0).alias("ord"), F.col("node_id").alias("source"), F.concat("graph_id", F.lit("0")).alias("target"), F.lit("r").alias("relation")
        )
        return Graphs.of(fresh, new, g.graphs)

    def decide(g, state):
        stops = {"a": 2, "b": 3, "c": 9}
        at = F.create_map(*[F.lit(x) for pair in stops.items() for x in pair])[F.col("graph_id")]
        return state.select("graph_id", F.when(F.col("iteration") >= at, "HALT").otherwise("CONTINUE").alias("decision"), F.lit("").alias("reason"))

    cfg = RunConfig(max_iterations=4, max_depth=4)
    made = grow(start, expand, cfg, decide=decide)
    sizes = {r.graph_id: r["count"] for r in made.final.edges.groupBy("graph_id").count().collect()}
    assert sizes == {"a": 7, "b": 8, "c": 10} and made.final.edges.select("graph_id", "edge_id").distinct().count() == 25
    seen = []
    scored = halting.score_nodes
    monkeypatch.setattr(halting, "score_nodes", lambda g, mode, state, limits, counts: (seen.append(counts), scored(g, mode, state, limits))[1])
    plain = grow(start, expand, cfg, decide=decide)
    rows = lambda run: sorted((r.graph_id, r.node_id, r.status, sorted(r.metrics.items())) for r in run.final.nodes.collect())
    assert rows(made) == rows(plain)
    # what the last round scored with is the sum of all rounds before it, of the graphs that went on
    last = {(r.graph_id, r.node_id): r.degree for r in seen[-1].collect()}
    assert last == {("c", "c0"): 6, ("c", "c1"): 3, ("c", "c2"): 3, **{("c", f"cx{i}"): 1 for i in (1, 2, 3)}}


def test_declared_settings(spark):
    names = {s.name: s for s in settings.specs(RunConfig)}
    assert names["limits.max_nodes"].default == 50 and names["windows.overlap"].low == 0 and all(s.text for s in names.values())
    listed = {r.name: r for r in settings.table(spark, RunConfig).collect()}
    assert set(listed) == set(names) and listed["similarity_threshold"].high == 1.0 and listed["mode"].kind == "string"
    made = RunConfig.from_json('{"max_depth": 2, "limits": {"max_nodes": 7}, "similarity_threshold": 1}')
    assert (made.max_depth, made.limits.max_nodes, made.limits.max_depth, made.similarity_threshold) == (2, 7, 3, 1)
    texts = [
        "{}", '{"max_depth": 2, "limits": {"max_nodes": 7}, "windows": {}}', '{"max_depth": -1, "nothing": 3, "mode": 5}', '{"max_depth": "2"}', '{"max_depth": 2.5}',
        '{"max_depth": true, "align_sentences": 1, "score_first": false}', '{"similarity_threshold": 1}', '{"similarity_threshold": 1.5, "block": 0}', '{"limits": 3}',
        '{"limits": {"max_nodes": -1, "x": {"y": 1}}, "windows": {"overlap": null}}', "[1]", '"text"', '{"max_iterations": 1e0}', '{"similarity_threshold": 1e-3}',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "no json", None])], "i int, t string")
    found = {r.i: r.p for r in rows.select("i", settings.problems("t", RunConfig).alias("p")).collect()}
    for i, text in enumerate(texts):
        try:
            RunConfig.from_json(text)
            wanted = []
        except ValueError as error:
            wanted = str(error).split("; ")
        assert found[i] == wanted, text
    assert found[len(texts)] == ["settings is no object"] and found[len(texts) + 1] == []
    assert found[2] == ["max_depth is out of range", "mode is no string", "nothing is unknown"]


def test_vectors_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def vectors(labels: pd.Series) -> pd.Series:
        made.add(len(labels))
        return labels.map(lambda text: [float(len(text)), 1.0])

    def embed(nodes):
        return nodes.withColumn("embedding", F.pandas_udf(vectors, "array<float>")("label"))

    inputs = spark.createDataFrame([("a", "goal", "one two three"), ("b", "goal", "four five six")], "experiment_id string, goal string, text string")
    decode = lambda texts: texts.map(lambda t: f"<triplet> {t.split()[0]} <subj> {t.split()[-1]} <obj> has")
    generate = lambda prompts: prompts.map(lambda p: '{"nodes":[{"id":"x","label":"topic"}],"edges":[]}')
    result = run(inputs, decode, generate, embed, RunConfig(max_depth=0))
    assert made.value == result.stages["G_B"].nodes.count() + result.stages["G_T"].nodes.count() == 6


def test_files_count_for_more_than_their_size(spark):
    """Two million ids fit 10 MB of files, but no broadcast of 10 MB."""
    rows = cut(tune(spark).range(2_000_000).select(F.col("id").alias("k"), F.concat(F.lit("entity_"), F.col("id") % 50).alias("node_id")))
    joined = rows.join(rows.select("k", F.col("node_id").alias("other")), "k")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
