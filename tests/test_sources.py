"""Readers, sinks and corpora."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from graphloom.operators import corpora
from graphloom.sources import datasets, results, splits

SAMPLE = {"title": "Test Title", "sents": [["This", "is", "sentence", "one", "."], ["Sentence", "two", "."]], "vertexSet": [], "labels": []}


def test_docred_files(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps([SAMPLE, {**SAMPLE, "title": "B"}]))
    (tmp_path / "test.json").write_text(json.dumps({"data": [SAMPLE, {**SAMPLE, "title": "B"}, SAMPLE]}))
    (tmp_path / "train_annotated.json").write_text(json.dumps({"other": 1}))
    assert [(r.idx, r.title) for r in datasets.read_docred(spark, str(tmp_path), "dev").orderBy("idx").collect()] == [(0, "Test Title"), (1, "B")]
    wrapped = datasets.read_docred(spark, str(tmp_path), "test")
    assert [r.idx for r in wrapped.orderBy("idx").collect()] == [0, 1, 2]
    row = corpora.normalize(wrapped, "docred", "test").orderBy("index").first()
    assert row["query"] == "Test Title" and row.context == "This is sentence one . Sentence two ." and row.label == "relation_extraction"
    with pytest.raises(Exception, match="unsupported"):
        datasets.read_docred(spark, str(tmp_path), "train_annotated").collect()
    with pytest.raises(KeyError):
        datasets.read_docred(spark, str(tmp_path), "other")
    with pytest.raises(FileNotFoundError):
        datasets.read_docred(spark, str(tmp_path), "train_distant")


def test_catalogue(spark):
    assert {r.dataset_id for r in datasets.catalogue(spark).collect()} == {"docred", "fever", "cuad", "scifact"}
    assert datasets.spec("docred")["source"] == "local"
    with pytest.raises(KeyError):
        datasets.spec("nothing")


def test_splits(spark, tmp_path):
    names = lambda d: {r.split for r in datasets.list_splits(spark, str(tmp_path), d).collect()}
    assert names("docred") == set(datasets.DOCRED_FILES)
    assert names("cuad") == {"train", "test"} and names("fever") == {"train", "validation", "test"}
    rows = spark.range(1000).select(F.concat(F.lit("q"), "id").alias("question")).repartition(3)
    rows.write.parquet(datasets.split_path(str(tmp_path), "cuad", "train"))
    assert names("cuad") == {"train"}
    read = datasets.read_split(spark, str(tmp_path), "cuad", "train").collect()
    assert sorted(r.idx for r in read) == list(range(1000))
    again = {r.question: r.idx for r in datasets.read_split(spark, str(tmp_path), "cuad", "train").collect()}
    assert again == {r.question: r.idx for r in read}
    with pytest.raises(RuntimeError):
        datasets.read_split(spark, str(tmp_path), "fever", "train")


def test_missing_fields(spark):
    df = spark.createDataFrame([(0, None, "REFUTES", None, None)], "idx int, claim string, label string, evidence_wiki_url string, evidence_sentence_id int")
    row = corpora.normalize(df, "fever", "train", include_raw=True).first()
    assert row["query"] is None and row.context is None and json.loads(row.evidence)["evidence_wiki_url"] is None
    assert json.loads(row.raw) == {"label": "REFUTES"}


def test_fever_context_order(spark):
    rows = [(0, "c0", "T", 1), (1, "c1", "T", 99), (2, "c2", "Empty", 0), (3, "c3", "None", 0)]
    df = spark.createDataFrame(rows, "idx int, claim string, evidence_wiki_url string, evidence_sentence_id int")
    pages = corpora.wiki_pages(spark.createDataFrame([(" T ", "One.\n\n\n\nTwo."), ("Empty", " ")], "title string, text string"))
    got = {r["index"]: r for r in corpora.normalize(df, "fever", "train", pages).collect()}
    assert [got[i].context for i in range(4)] == ["Two.", "One.\n\nTwo.", "c2", "c3"]
    assert json.loads(got[0].evidence)["evidence_text"] == "Two." and "evidence_text" not in json.loads(got[3].evidence)


def test_caps_and_pages(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "index int, context string")
    full = {r["index"]: r for r in corpora.cap_context(df, 5).collect()}
    assert full[5].context == "xxxxx" and not full[5].context_truncated
    assert full[6].context == "xxxxx..." and full[6].context_truncated and full[6].context_total_chars == 6
    assert {r.context for r in corpora.cap_context(df, 0).collect()} == {""}
    assert [r["index"] for r in corpora.sample_page(df, 2, 4).orderBy("index").collect()] == [4, 5, 6, 7]
    assert corpora.sample_page(df, 9, 4).count() == 0
    assert corpora.sample_at(df, 3).first().context == "xxx"
    for bad in (lambda: corpora.sample_page(df, 0), lambda: corpora.sample_page(df, 1, 101), lambda: corpora.sample_at(df, -1)):
        with pytest.raises((ValueError, IndexError)):
            bad()


def test_publish_replace_delete(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda ids, status: spark.createDataFrame([(i, "n", status) for i in ids], "experiment_id string, name string, status string")
    data = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "experiment_id string, value string")
    assert 1 == results.publish(path, "r1", make("ab", "success"), data("ab", "1"), data("aab", "1"))
    assert 2 == results.publish(path, "r2", make("b", "failed"), data("b", "2"), data("b", "2"))
    seen = results.read_published(spark, path)
    assert {(r.experiment_id, r.value) for r in seen["data"].collect()} == {("a", "1"), ("b", "2")}
    assert seen["nodes"].count() == 3
    # Rows without a commit stay invisible.
    data("c", "9").write.parquet(f"{path}/data/run_id=r3")
    assert results.read_published(spark, path)["data"].count() == 2
    assert results.delete(spark, path, "r4", data("a", "")) == 3
    assert {r.experiment_id for r in results.read_published(spark, path)["nodes"].collect()} == {"b"}


def _result(spark, ids, value):
    make = lambda names: spark.createDataFrame([(i, value, "success") for i in ids], f"experiment_id string, {names} string, status string")
    return make("name"), make("value"), make("label")


def test_writers_at_the_same_time(spark, tmp_path):
    """Each gets a version of its own; of two that are based on one version only the first may touch an experiment."""
    path = str(tmp_path / "store")
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: results.publish(path, f"w{i}", *_result(spark, ["x", f"e{i}"], str(i))), range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    seen = {r.experiment_id: r.value for r in results.read_published(spark, path)["data"].collect()}
    assert seen == {"x": str(versions.index(6)), **{f"e{i}": str(i) for i in range(6)}}
    base = results.current(spark, path)

    def attempt(i):
        try:
            return results.publish(path, f"b{i}", *_result(spark, ["x", f"f{i}"], f"b{i}"), base=base)
        except results.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        tried = list(pool.map(attempt, range(4)))
    assert sorted(v for v in tried if v) == [7] and results.publish(path, "c", *_result(spark, ["new"], "c"), base=base) == 8
    seen = {r.experiment_id: r.value for r in results.read_published(spark, path)["data"].collect()}
    assert seen["x"] == f"b{tried.index(7)}" and set(seen) == {"x", "new", f"f{tried.index(7)}", *[f"e{i}" for i in range(6)]}


def test_publishing_again_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "store")
    assert all(t.isEmpty() for t in results.read_published(spark, path).values()) and results.vacuum(spark, path, 0) == []
    shown = lambda: {(r.experiment_id, r.value) for r in results.read_published(spark, path)["data"].collect()}
    assert results.publish(path, "r1", *_result(spark, "ab", "1")) == 1
    assert results.publish(path, "r2", *_result(spark, "ab", "2")) == 2
    assert results.publish(path, "r1", *_result(spark, "ab", "other")) == 1
    assert results.delete(spark, path, "r3", _result(spark, "b", "")[0]) == 3
    _result(spark, "c", "9")[1].write.parquet(f"{path}/data/run_id=lost")
    assert results.vacuum(spark, path) == [] and shown() == {("a", "2")}
    assert results.vacuum(spark, path, 0) == ["lost", "r1"] and shown() == {("a", "2")}
    assert results.vacuum(spark, path, 0) == []
    assert results.delete(spark, path, "r4", _result(spark, "a", "")[0]) == 4
    assert results.vacuum(spark, path, 0) == ["r2"] and results.current(spark, path) == 4
    assert all(t.isEmpty() for t in results.read_published(spark, path).values())
    assert results.publish(path, "r5", *_result(spark, "b", "5")) == 5 and shown() == {("b", "5")}
    for bad in ("", "a/b", "a=b", "_x"):
        with pytest.raises(ValueError):
            results.publish(path, bad, *_result(spark, "b", "5"))


def test_export_and_snapshot(spark, tmp_path):
    exp = spark.createDataFrame([("1", "One", "success", "g")], "experiment_id string, name string, status string, goal string")
    results.export(exp, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().asDict() == {"id": "1", "name": "One", "status": "success"}
    results.export(exp, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().goal == "g"
    with pytest.raises(KeyError):
        results.export(exp.where("false"), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        results.export(exp, str(tmp_path / "none"), "xml")
    folder = results.snapshot(exp, str(tmp_path / "snap"), "G_B", "20240101", "trace")
    assert spark.read.json(folder).count() == 1


def test_stored_split_opens_the_files_of_a_page(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(1000).select(F.col("id").alias("idx"), F.concat(F.lit("q"), "id").alias("question")).repartition(7)
    splits.store_split(rows, root, "cuad", "train", file_rows=100)
    page = splits.read_page(spark, root, "cuad", "train", 18, 20)
    assert sorted((r.idx, r.question) for r in page.collect()) == [(i, f"q{i}") for i in range(340, 360)]
    assert len(page.inputFiles()) <= 2 < 10 <= len(datasets.read_split(spark, root, "cuad", "train").inputFiles())
    assert splits.read_page(spark, root, "cuad", "train", 50, 20).count() == 20
    beyond = splits.read_page(spark, root, "cuad", "train", 51, 20)
    assert beyond.count() == 0 and beyond.columns == ["idx", "question"]
    assert splits.stored(spark, root, "cuad") == ["train"]
    assert [tuple(r) for r in splits.totals(spark, root, ["cuad", "fever"]).collect()] == [("cuad", "train", 1000, 50)]
    with pytest.raises(RuntimeError):
        splits.read_page(spark, root, "cuad", "test")
    with pytest.raises(ValueError):
        splits.read_page(spark, root, "cuad", "train", 0)


def test_stored_split_of_nothing_and_of_gaps(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(0, "a"), (1, None), (3, "c")], "idx bigint, question string")
    splits.store_split(rows.where("false"), root, "cuad", "test")
    empty = splits.read_page(spark, root, "cuad", "test")
    assert empty.count() == 0 and empty.columns == ["idx", "question"]
    for bad in (rows, rows.where("idx < 2").unionByName(rows.where("idx = 0")), rows.where("idx > 0"), rows.where("idx = 1"), spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "idx bigint, question string"), rows.withColumn("idx", F.when(F.col("idx") < 2, F.col("idx")))):
        with pytest.raises(ValueError):
            splits.store_split(bad, root, "cuad", "train")
        assert splits.read_page(spark, root, "cuad", "train").count() == 0
    splits.store_split(rows.where("idx < 2"), root, "cuad", "train")
    assert {tuple(r) for r in splits.read_page(spark, root, "cuad", "train").collect()} == {(0, "a"), (1, None)}


def test_parts_of_a_graph_are_put_together_by_counts_alone(spark):
    from graphloom.model import Graphs
    from graphloom.sources import graph_json as GJ

    n = 2_500
    nodes = spark.range(n).selectExpr("'g' AS graph_id", "concat('n', id) AS node_id", "id AS ord", "concat('n', id) AS label")
    edges = spark.range(n).selectExpr("'g' AS graph_id", "concat('e', id) AS edge_id", "id AS ord", "'n0' AS source", "concat('n', id) AS target", "'r' AS relation")
    back = GJ.read_graph_json(GJ.graph_json(Graphs.of(nodes, edges), part_size=1_100))
    assert [r.target for r in back.edges.orderBy("ord").collect()] == [f"n{i}" for i in range(n)]
    assert [r.ord for r in back.nodes.orderBy("ord").collect()] == list(range(n))

    def windows(node):
        children = [node.children().apply(i) for i in range(node.children().length())]
        return ([node] if node.nodeName() == "Window" else []) + [w for c in children for w in windows(c)]

    # no window holds documents
    found = windows(back.edges._jdf.queryExecution().optimizedPlan())
    names = [{w.output().apply(i).name() for i in range(w.output().length())} for w in found]
    assert found and not any("g" in n for n in names)


@pytest.mark.parametrize("dataset_id", ["fever", "scifact"])
def test_samples_without_a_page_are_spread(spark, dataset_id):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        claims = spark.range(4000).select(F.col("id").alias("idx"), F.lit("c").alias("claim"))
        if dataset_id == "fever":
            side = corpora.wiki_pages(spark.createDataFrame([("T", "One.")], "title string, text string"))
            rows = claims.withColumn("evidence_wiki_url", F.when(F.col("idx") == 1, "T").when(F.col("idx") % 4 == 0, " "))
        else:
            side = spark.createDataFrame([(7, "T", ["One."]), (-3, "U", ["Two."])], "doc_id int, title string, abstract array<string>")
            rows = claims.withColumn("evidence_doc_id", F.when(F.col("idx") == 1, 7).when(F.col("idx") % 2 == 0, -3))
        out = corpora.normalize(rows, dataset_id, "train", side)
        got = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("context").alias("count")).collect()
        found = out.where("context <> 'c'").select("index").collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sum(r["count"] for r in got) == 4000 and max(r["count"] for r in got) < 2000
    assert [r["index"] for r in found] == [1]
