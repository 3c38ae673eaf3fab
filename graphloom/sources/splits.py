"""Corpora stored by position, so that a page of samples opens the files that hold it and no others.

A split is a folder of Parquet files, each a run of positions ``idx``; beside it, in ``_bounds``, lies one row per file with
its first and last position. Splits are found by their folders, without opening a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import corpora
from graphloom.session import children, exists
from graphloom.sources import datasets

BOUNDS = "file string, first bigint, last bigint, total bigint"
FILE_ROWS = 100_000


def _bounds_path(root: str, dataset_id: str, split: str) -> str:
    config = datasets.spec(dataset_id)["hf_config"]
    folder, _, name = datasets.split_path(root, dataset_id, split, config).rpartition("/")
    return f"{folder}/_bounds/{name}"


def store_split(rows: DataFrame, root: str, dataset_id: str, split: str, file_rows: int = FILE_ROWS) -> None:
    """Write ``rows`` as a split with their positions ``idx``; rows without them are numbered in file order.

    Files hold about ``file_rows`` neighbouring rows, sorted. The bounds are read back from what was written, so
    they hold whatever tasks were repeated, and they come last: until then the split has no rows for readers.
    Positions must be whole: distinct, from 0 without gaps.
    """
    spark = rows.sparkSession
    path = datasets.split_path(root, dataset_id, split, datasets.spec(dataset_id)["hf_config"])
    numbered = rows if "idx" in rows.columns else datasets.with_index(rows)
    bounds = _bounds_path(root, dataset_id, split)
    spark.createDataFrame([], BOUNDS).write.mode("overwrite").parquet(bounds)
    files = max(1, -(-numbered.count() // file_rows))
    numbered.repartitionByRange(files, "idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "idx")
    spans = stored.groupBy("file").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("total"), F.count_distinct("idx").alias("distinct"))
    spans.write.mode("overwrite").parquet(bounds)
    written = spark.read.schema(f"{BOUNDS}, distinct bigint").parquet(bounds)
    whole = (F.col("distinct") == F.col("total")) & (F.col("last") - F.col("first") + 1 == F.col("total"))
    found = written.agg(F.min(whole), F.min("first"), F.max("last"), F.sum("total")).first()
    if found[3] is not None and not (found[0] and found[1] == 0 and found[2] + 1 == found[3]):
        spark.createDataFrame([], BOUNDS).write.mode("overwrite").parquet(bounds)
        raise ValueError("positions must run from 0 without gaps or repeats")


def read_between(spark: SparkSession, root: str, dataset_id: str, split: str, first: int, last: int) -> DataFrame:
    """The rows at positions ``first`` to ``last``: only files that hold some are listed and opened.

    The driver gets the names of these files, at most one per row asked for.
    """
    path = datasets.split_path(root, dataset_id, split, datasets.spec(dataset_id)["hf_config"])
    bounds = _bounds_path(root, dataset_id, split)
    if not exists(spark, f"{bounds}/_SUCCESS"):
        raise RuntimeError(f"no stored split={split} of dataset={dataset_id}")
    spans = spark.read.schema(BOUNDS).parquet(bounds)
    names = [r.file for r in spans.where((F.col("first") <= last) & (F.col("last") >= first)).select("file").collect()]
    if not names:  # beyond the end: the columns, and no rows
        any_file = spans.select("file").first()
        return spark.read.parquet(f"{path}/{any_file.file}" if any_file else path).limit(0)
    return spark.read.parquet(*[f"{path}/{n}" for n in names]).where(F.col("idx").between(first, last))


def read_page(spark: SparkSession, root: str, dataset_id: str, split: str, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of a stored split."""
    first, last = corpora.page_range(page, page_size)
    return read_between(spark, root, dataset_id, split, first, last)


def totals(spark: SparkSession, root: str, dataset_ids: list[str], page_size: int = 20) -> DataFrame:
    """``(dataset_id, split, total, total_pages)`` of the stored splits, from their bounds alone."""
    parts = []
    for dataset_id in dataset_ids:
        for split in stored(spark, root, dataset_id):
            spans = spark.read.schema(BOUNDS).parquet(_bounds_path(root, dataset_id, split))
            total = F.coalesce(F.sum("total"), F.lit(0))
            parts.append(spans.agg(total.alias("total"), F.ceil(total / page_size).alias("total_pages")).select(F.lit(dataset_id).alias("dataset_id"), F.lit(split).alias("split"), "*"))
    empty = spark.createDataFrame([], "dataset_id string, split string, total bigint, total_pages bigint")
    return reduce(DataFrame.unionByName, parts, empty)


def stored(spark: SparkSession, root: str, dataset_id: str) -> list[str]:
    """Names of the splits whose bounds are written, sorted."""
    folder = _bounds_path(root, dataset_id, "").rpartition("/")[0]
    names = [n.partition("=")[2] for n in children(spark, folder) if n.startswith("split=")]
    return sorted(n for n in names if exists(spark, f"{folder}/split={n}/_SUCCESS"))
