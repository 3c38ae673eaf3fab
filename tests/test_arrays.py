"""Array files that are split over many tasks, against the json module."""

import json
import random

import pytest

from graphloom.sources import arrays

SCHEMA = "n int, s string, o struct<a:string,b:array<struct<c:string>>>"
ODD = ["", "plain", '"', "\\", '\\"', "}", "{", "]},{[", "a\nb", "\\\\", 'end\\"}', "é}ü", '","data":[{']


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    yield spark
    for name, value in old.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def samples(count, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(ODD, k=rng.randrange(4)))
    return [{"n": i, "s": word(), "o": {"a": word(), "b": [{"c": word()} for _ in range(rng.randrange(3))]}} for i in range(count)]


def plain(rows):
    return [(r.idx, r.n, r.s, r.o.a, [b.c for b in r.o.b]) for r in sorted(rows, key=lambda r: r.idx)]


def wanted(rows):
    return [(i, r["n"], r["s"], r["o"]["a"], [b["c"] for b in r["o"]["b"]]) for i, r in enumerate(rows)]


FORMS = {
    "array": lambda rows: json.dumps(rows),
    "lines": lambda rows: json.dumps(rows, indent=1, ensure_ascii=False) + "\n",
    "wrapped": lambda rows: json.dumps({"data": rows}),
    "between": lambda rows: json.dumps({"version": "1", "meta": {"x": {"y": 1}}, "data": rows, "more": [{"n": 5}, {"n": 6}], "end": 3}) + "\n",
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_split_arrays(small_splits, tmp_path, form):
    rows = samples(60, len(form))
    path = tmp_path / "file.json"
    path.write_text(FORMS[form](rows), encoding="utf-8")
    assert small_splits.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    assert plain(arrays.read_array(small_splits, str(path), SCHEMA).collect()) == wanted(rows)


def test_several_files_and_empty_ones(spark, tmp_path):
    for name, count in (("a", 3), ("b", 0), ("c", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps(samples(count, 1)))
    (tmp_path / "d.json").write_text('{"data": []}')
    rows = arrays.read_array(spark, str(tmp_path), SCHEMA).collect()
    assert sorted((r.file[-6:], r.idx, r.n) for r in rows) == [("a.json", 0, 0), ("a.json", 1, 1), ("a.json", 2, 2), ("c.json", 0, 0)]


@pytest.mark.parametrize("text", ['{"other": 1}', '{"other": [{"n": 1}]}', "[1, 2]", '[{"n": 1}, 2]', '[{"n": 1}, {"n": 2', '"text"', '[{"n": 1}, {"n": }]', '[1, {"n": 1}]', '[{"n": 1}', '[{"n": 1},', '{"data": [{"n": 1}, {"n": 2', '{"data": [{"n": 1},'])
def test_other_forms_raise(spark, tmp_path, text):
    (tmp_path / "file.json").write_text(text)
    with pytest.raises(Exception, match="unsupported|MALFORMED|Malformed"):
        arrays.read_array(spark, str(tmp_path / "file.json"), SCHEMA).collect()
