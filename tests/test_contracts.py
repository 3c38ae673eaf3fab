"""What must hold for real inputs: one answer per graph, order over round trips, odd ids, null slots, chains."""

import json
import subprocess
import sys
import textwrap

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom import cut
from graphloom.functions import slots
from graphloom.model import Graphs
from graphloom.operators import corpora, expansion, resolve, topology
from graphloom.sources import graph_json as GJ


def graph(spark, nodes, edges):
    return Graphs.of(
        spark.createDataFrame([("g", n, i) for i, n in enumerate(nodes)], "graph_id string, node_id string, ord long").withColumn("label", F.col("node_id")),
        spark.createDataFrame([("g", f"e{i}", i, a, b, "r") for i, (a, b) in enumerate(edges)], "graph_id string, edge_id string, ord long, source string, target string, relation string"),
        spark.createDataFrame([("g",)], "graph_id string"),
    )


@pytest.fixture(scope="module")
def fused(spark):
    left, right = graph(spark, ["b1", "b2"], [("b1", "b2")]), graph(spark, ["t1", "t2"], [("t1", "t2"), ("t2", "t1")])
    return topology.union_graphs(left, right)


def test_one_prompt_and_one_header_for_a_fused_graph(spark, fused):
    context = expansion.graph_context(fused).collect()
    assert len(context) == 1
    assert [n["id"] for n in json.loads(context[0].context)["nodes"]] == ["fused_B_b1", "fused_B_b2", "fused_T_t1", "fused_T_t2"]
    asked = spark.sparkContext.accumulator(0)

    def generate(prompts: pd.Series) -> pd.Series:
        asked.add(len(prompts))
        return prompts.map(lambda p: json.dumps({"nodes": [{"id": "n", "label": "new"}], "edges": [{"source": "n", "target": "fused_B_b1"}]}))

    grown = expansion.expand_graphs(fused, generate)
    assert grown.graphs.count() == 1 and grown.nodes.count() == 1 and asked.value == 1


def test_different_answers_have_different_edge_ids(spark):
    answers = [json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": s, "target": t}]}) for s, t in (("a", "b"), ("b", "a"))]
    ids = [expansion.responses_to_graphs(spark.createDataFrame([("g", a)], "graph_id string, response string")).edges.first().edge_id for a in answers]
    assert ids[0] != ids[1]


@pytest.mark.parametrize("part_size", [1, 3, 100])
def test_round_trips_keep_the_order(fused, part_size):
    nodes = [r.node_id for r in fused.nodes.orderBy("ord").collect()]
    edges = [r.edge_id for r in fused.edges.orderBy("ord").collect()]
    g = fused
    for _ in range(3):
        g = GJ.read_graph_json(cut(GJ.graph_json(g, part_size)))
    assert [r.node_id for r in g.nodes.orderBy("ord").collect()] == nodes
    assert [r.edge_id for r in g.edges.orderBy("ord").collect()] == edges
    assert g.nodes.agg(F.max("ord")).first()[0] == len(nodes) - 1
    assert GJ.graph_json(fused, 100).count() == 1


def test_rows_with_null_keys_are_numbered(spark):
    df = spark.createDataFrame([(None, 5), (None, 3), ("a", 9), ("a", 1)], "k string, o long")
    numbered = topology.ordinals(df, ["k"], F.shiftright("o", 2), [F.shiftright("o", 1)], [F.col("o")], "i")
    assert sorted((str(r.k), r.o, r.i) for r in numbered.collect()) == [("None", 3, 0), ("None", 5, 1), ("a", 1, 0), ("a", 9, 1)]


def test_chained_mapping_leaves_no_dangling_edge(spark):
    g = graph(spark, list("abcdefxyz"), [("a", "d"), ("b", "d"), ("x", "y"), ("e", "f"), ("z", "a")])
    pairs = [("a", "b"), ("b", "c"), ("e", "f"), ("e", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "missing")]
    mapping = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id string, node_id string, new_id string")
    merged = resolve.apply_mapping(g, mapping)
    nodes = {r.node_id for r in merged.nodes.collect()}
    assert nodes == {"c", "d", "x"}
    assert sorted((r.source, r.target) for r in merged.edges.collect()) == [("c", "d"), ("c", "d"), ("d", "d"), ("x", "c"), ("x", "x")]


def test_null_slots_count_as_empty(spark):
    df = spark.createDataFrame([(None,), ({"a": "1"},)], "attrs map<string,string>")
    out = [r[0] for r in df.select(slots.put("attrs", b=F.lit("2"))).collect()]
    assert out == [{"b": "2"}, {"a": "1", "b": "2"}]
    assert [r[0] for r in df.select(slots.merge(F.col("attrs"), F.create_map(F.lit("a"), F.lit("3")))).collect()] == [{"a": "3"}, {"a": "3"}]


@pytest.mark.parametrize("doc_id, cited, expected", [("", ["7"], "T\n\nline"), ("x", ["7"], "T\n\nline"), ("7", [], "T\n\nline"), ("0", ["y"], "claim"), (None, None, "claim")])
def test_abstracts_by_text_ids(spark, doc_id, cited, expected):
    claims = spark.createDataFrame([("claim", doc_id, cited, 0)], "claim string, evidence_doc_id string, cited_doc_ids array<string>, idx long")
    corpus = corpora.corpus_documents(spark.createDataFrame([("7", "T", ["line"], 0)], "doc_id string, title string, abstract array<string>, idx long"))
    assert corpora.normalize(claims, "scifact", "train", corpus).first().context == expected


def test_odd_sentence_ids_keep_the_whole_page(spark):
    page = "First. " + "word " * 50_000
    pages = corpora.wiki_pages(spark.createDataFrame([("P", page)], "title string, text string"))
    claims = spark.createDataFrame([("c0", "P", "0", 0), ("c1", "P", "x", 1), ("c2", "P", None, 2)], "claim string, evidence_wiki_url string, evidence_sentence_id string, idx long")
    rows = {r["query"]: r for r in corpora.normalize(claims, "fever", "train", pages).collect()}
    assert rows["c0"].context == "First." and rows["c1"].context == rows["c2"].context == page.strip()
    assert json.loads(rows["c1"].evidence)["evidence_sentence_id"] == "x"


def test_workers_import_the_package_from_any_folder(tmp_path):
    code = """
        import sys
        sys.path.insert(0, {root!r})
        from graphloom import build_session
        from graphloom.functions.text import sentence_spans
        spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {folder!r}}})
        print("spans", spark.createDataFrame([("One. Two.",)], "t string").select(sentence_spans("t")).first()[0][1].text)
        spark.stop()
    """
    root = __file__.rsplit("/tests/", 1)[0]
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(code.format(root=root, folder=str(tmp_path))))
    # a file, not a pipe: processes that outlive the script would keep a pipe open
    with open(tmp_path / "out", "w") as out:
        subprocess.run([sys.executable, str(script)], cwd=tmp_path, stdout=out, stderr=out, timeout=150, check=False)
    assert "spans Two." in (tmp_path / "out").read_text()


def test_run_takes_the_callers_parts(spark):
    from graphloom.plans.loop import run
    from graphloom.plans.run import RunConfig

    inputs = spark.createDataFrame([("e1", "goal one", "Alpha beats beta. Gamma helps delta."), ("e2", "goal two", "One.")], "experiment_id string, goal string, text string")
    decode = lambda t: t.map(lambda x: f"<triplet> {x.split()[0]} <subj> {x.split()[-1]} <obj> leads to")
    generate = lambda p: p.map(lambda x: json.dumps({"nodes": [{"id": "n0", "label": "a"}, {"id": "n1", "label": "b"}], "edges": [{"source": "n0", "target": "n1"}]}))
    embed = lambda nodes: nodes.withColumn("embedding", F.array(F.lit(1.0).cast("float"), F.length("label").cast("float")))
    seen = []

    def rename(g):
        seen.append("processor")
        return g.with_nodes(g.nodes.withColumn("label", F.upper("label")))

    def decide(g, state):
        seen.append("decide")
        return g.graphs.select("graph_id", F.when(F.col("graph_id") == "e1", "CONTINUE").otherwise("HALT").alias("decision"), F.lit("own").alias("reason"))

    def fusion(left, right):
        seen.append("fusion")
        return topology.union_graphs(left, right)

    done = run(inputs, decode, generate, embed, RunConfig(max_iterations=2, max_depth=2), lambda texts: [len(t) for t in texts], fusion, [rename], decide)
    assert seen == ["fusion", "processor", "decide", "decide"]
    decisions = [(r.experiment_id, json.loads(r.details)["decision"]) for r in done.trace.where("action = 'halting_evaluation'").collect()]
    assert sorted(decisions) == [("e1", "CONTINUE"), ("e1", "CONTINUE"), ("e2", "HALT")]
    assert done.data().where("category LIKE 'log%'").count() == 2
    assert {r.experiment_id for r in done.final_graph().collect()} == {"e1", "e2"}
    assert done.stages["loop_2_increment"].graphs.count() == 1


def test_context_of_a_large_graph_is_put_together_from_pieces(spark, capsys):
    n = 2500
    nodes = spark.createDataFrame([("g", f"n{i:04}", i // 7) for i in reversed(range(n))], "graph_id string, node_id string, ord long").withColumn("label", F.concat(F.lit('"'), "node_id"))
    edges = spark.createDataFrame([("g", f"e{i}", 0, f"n{i:04}", "n0000", "r") for i in range(n)], "graph_id string, edge_id string, ord long, source string, target string, relation string")
    graphs = spark.createDataFrame([("g", {"goal": 'a "b"'}), ("empty", {})], "graph_id string, meta map<string,string>")
    context = expansion.graph_context(Graphs.of(nodes, edges, graphs))
    found = {r.graph_id: json.loads(r.context) for r in context.collect()}
    assert found["empty"] == {"goal": "", "nodes": [], "edges": []}
    assert found["g"]["goal"] == 'a "b"'
    assert [x["id"] for x in found["g"]["nodes"]] == [f"n{i:04}" for i in range(n)]
    assert [x["source"] for x in found["g"]["edges"]] == [f"n{i:04}" for i in range(n)]
    # what meets in one task are texts of pieces, never the single nodes and edges of a graph
    context.explain("formatted")
    lists = [line for line in capsys.readouterr().out.splitlines() if line.startswith("Functions") and "collect_list" in line]
    assert lists and all("entry" in line for line in lists)


def test_prompts_hold_the_context_of_their_graph(spark):
    """Elements of one graph over several pieces and partitions, in order; a graph of its own without elements; ids that are null."""
    nodes = [("g", f"n{i}", i % 700, f"label {i}") for i in range(2500)] + [("h", "x", 0, 'with "quotes"'), (None, "y", 0, "lost")]
    edges = [("g", f"e{i}", i, f"n{i}", f"n{i + 1}", "next") for i in range(2100)]
    nodes = spark.createDataFrame(nodes, "graph_id string, node_id string, ord long, label string").repartition(7)
    edges = spark.createDataFrame(edges, "graph_id string, edge_id string, ord long, source string, target string, relation string").repartition(5)
    g = Graphs.of(nodes, edges, spark.createDataFrame([("g",), ("h",), ("alone",)], "graph_id string"))
    texts = expansion.graph_context(g)
    context = {r.graph_id: r.context for r in texts.collect()}
    assert set(context) == {"g", "h", "alone"} and json.loads(context["alone"]) == {"goal": "", "nodes": [], "edges": []}
    read = json.loads(context["g"])
    assert [n["id"] for n in read["nodes"]] == [f"n{i}" for i in sorted(range(2500), key=lambda i: (i % 700, f"n{i}"))]
    assert [e["source"] for e in read["edges"]] == [f"n{i}" for i in range(2100)]
    assert json.loads(context["h"])["nodes"][0]["label"] == 'with "quotes"'
    # elements are shuffled as they are, and their JSON is made behind that
    lines = expansion.graph_context(g)._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [below for line, below in zip(lines, lines[1:]) if "rangepartitioning(graph_id" in line]
    assert len(sent) == 2 and not any("ToJson" in line for line in sent)
    prompts = {r.graph_id: r.prompt for r in expansion.graph_prompts(g, 3).collect()}
    assert prompts == {r.graph_id: r.prompt for r in texts.select("graph_id", expansion.expansion_prompt("context", 3).alias("prompt")).collect()}
