"""The pipeline's stages one by one against plain versions, each on what its predecessor kept."""

import hashlib
import random

import brute
import pytest

import corpus_pipeline
from graphloom.llm import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean, junk, copied, near-copied, repeating and leaked documents, as tables in a folder."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices(["ba", "lo", "mi", "ne", "ru", "to"], k=rng.randrange(2, 5))) for _ in range(n)]
    rows = {i: words(rng.randrange(60, 200)) for i in range(80)}
    passage, leak = words(60), words(25)
    rows |= {100: list(rows[3]), 101: [*rows[4][:50], "baba", *rows[4][50:]], 102: words(30) + passage + words(30), 103: words(40) + passage + words(20), 104: words(30) + leak + words(30)}
    texts = {i: " ".join(w) for i, w in rows.items()}
    texts |= {200 + i: " ".join("".join(rng.choices("#$%&@", k=7)) for _ in range(60)) for i in range(4)}
    texts |= {300: None, 301: ""}
    folder = str(tmp_path_factory.mktemp("planted"))
    tables = {
        "documents": (list((i, t, "aa", "s", None if t is None else len(t)) for i, t in texts.items()), SCHEMA),
        "labels": ([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, " ".join(leak)), (2, " ".join(words(15)))], "item_id long, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, texts, tables["benchmark"][0]


def test_stages(spark, planted):
    folder, texts, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        rows = out.collect()
        if number < 4:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert len(after) == len(rows)
        if number == 0:
            assert set(after) == {i for i in texts if i < 200}
        elif number == 1:
            before = sorted(kept.items())
            assert set(after) == {d for d, _, c in brute.components(before) if d == c} and not {100, 101} & set(after)
        elif number == 2:
            for (doc_id, _, n, digest), (_, old) in zip(brute.removed_words(sorted(kept.items())), sorted(kept.items()), strict=True):
                assert (after[doc_id] != old) == (n > 0)
                assert n == 0 or hashlib.sha256(after[doc_id].encode()).hexdigest() == digest
            assert len(after[103]) < len(kept[103]) and after[102] == kept[102]
            assert all(r.n_chars == len(r.text) for r in rows)
        elif number == 3:
            assert set(after) == {e[0] for e in brute.contamination(list(kept.items()), items) if not e[5]} == set(kept) - {104}
        else:
            decoder = pieces.Decoder(pieces.Vocabulary())
            import pyarrow as pa

            assert {r.doc_id for r in rows} == set(kept) and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
            decoded = decoder.decode(pa.array([r.ids for r in rows], pa.list_(pa.int32()))).to_pylist()
            assert {r.doc_id: t for r, t in zip(rows, decoded, strict=True)} == kept
            break
        kept, docs = after, spark.createDataFrame(rows, docs.schema)
    assert name.startswith("SentencePiece")


def test_empty_tables(spark, planted, tmp_path):
    folder = planted[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHES = ["_d", "_h", "_s", "_n", "_l", "_w", "_k", "_ranges", "_D", "ids", "decoded", "contamination", "_contamination", "_ids", "_decoded", "d", "h", "c", "n", "component", "mean", "whole", "k", "r"]


def test_any_column_names_repeated_rows_and_rows_without_id(spark, planted):
    """Columns of the caller keep their values through every stage."""
    from pyspark.sql import functions as F

    folder, _, _ = planted
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        more = docs.where("doc_id IN (5, 6, 102)")
        docs = docs.unionByName(more).unionByName(more).unionByName(docs.where("doc_id IN (7, 103)").withColumn("doc_id", F.lit(None).cast("long")))
        docs = docs.withColumns({c: F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            rows = out.collect()
            if number == 4:
                assert all(r.round_trip for r in rows)
                break
            assert out.columns == docs.columns and len(rows) > 50
            assert all(r[c] == f"{c}/{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
            assert {5, 102} <= {r.doc_id for r in rows}
            if number:
                assert len({r.doc_id for r in rows}) == len(rows)
            docs = spark.createDataFrame(rows, docs.schema)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
