"""A cleaning pipeline for training documents, built from the operators of ``graphloom.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of
``documents``, under any names. ``run`` writes what a stage returns as Parquet in the checkpoint folder and gives it to the next.

Nulls, empty texts, repeated rows and texts of any length: the first stage rejects texts without words (null and empty ones); it
keeps or rejects repeated rows alike, and rows without id by their text. The second leaves one of the rows that repeat an id and text,
and of a group of near copies the one with the smallest id, rows without id last. In the third, rows of one id do not take
passages from each other, nor do rows without id. The fourth and fifth judge and encode each row by itself. Empty tables give
empty results.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard, pieces, quality, recompression
from graphloom.llm.tables import table, unused
from graphloom.session import checkpoint_dir, tune


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return jaccard.representatives(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in a document with a smaller id; ``n_chars`` follows the text."""
    stripped = recompression.strip(docs)
    return stripped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else stripped


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    (report,) = unused(docs, "_contamination")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), report=report)
    return found.where(F.col(report).n_hit == 0).drop(report)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_pieces, ids, round_trip)``: the piece ids of each text, and whether they decode to it."""
    ids, decoded = unused(docs, "_ids", "_decoded")
    encoded = pieces.decode(pieces.encode(docs, ids=ids), ids=ids, text=decoded)
    return encoded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_pieces"), F.col(ids).alias("ids"), F.col(decoded).eqNullSafe(F.col("text")).alias("round_trip"))


def _tuned(stage):
    """The stage in a session with the settings that the operators are made for."""
    return wraps(stage)(lambda spark, docs, sf_dir: stage(tune(spark), docs, sf_dir))


STAGES = [
    ("quality classifier", _tuned(keep_good)),
    ("n-gram Jaccard join", _tuned(keep_one_of_each)),
    ("substring dedup", _tuned(remove_repeats)),
    ("benchmark decontamination", _tuned(remove_benchmark)),
    ("SentencePiece encoding and decoding", _tuned(encode_pieces)),
]

# Perplexities of a fitted model, components and a segmentation are not expressed in SQL here;
# tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
