"""A table that a stream keeps: one folder per micro-batch, folded into a snapshot from time to time.

A folder counts once its ``_SUCCESS`` file is there, and a repeated micro-batch overwrites its own
folder, so a restart neither loses nor doubles rows. What a snapshot replaces is deleted when
the next one is complete: a reader that listed the folders just before still finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import exists, file_system


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that writes the folder has ended."""
    return exists(spark, f"{path}/_SUCCESS")


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``(kind, number)`` of the complete folders, ``batch`` or ``snapshot``, by number."""
    target, fs = file_system(spark, path)
    if not fs.exists(target):
        return []
    found = []
    for entry in fs.listStatus(target):
        kind, _, number = entry.getPath().getName().partition("-")
        if kind in ("batch", "snapshot") and complete(spark, entry.getPath().toString()):
            found.append((kind, int(number)))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _name(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}-{number:012d}"


def _rows(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The last snapshot and the batches behind it."""
    known = [(k, n) for k, n in folders(spark, path) if upto is None or n <= upto]
    base = max((n for k, n in known if k == "snapshot"), default=-1)
    own = [_name(path, k, n) for k, n in known if (k == "snapshot" and n == base) or (k == "batch" and n > base)]
    if not own:
        raise FileNotFoundError(f"no complete batch in {path}")
    return spark.read.parquet(*own)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return last.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def read(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The current rows: the last change of each key."""
    return _last(_rows(spark, path), keys).drop("_batch")


def write(batch: DataFrame, batch_id: int, path: str, keys: list[str] | None = None, every: int = 16) -> None:
    """Add the rows that a micro-batch changed, at most one per key; with ``keys`` every 16th folds the folders into a snapshot."""
    batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(_name(path, "batch", batch_id))
    if keys and (batch_id + 1) % every == 0:
        compact(batch.sparkSession, path, keys, batch_id)


def compact(spark: SparkSession, path: str, keys: list[str], upto: int) -> None:
    """Fold all folders up to a batch into one, and delete what the snapshot before had replaced."""
    known = folders(spark, path)
    before = max((n for k, n in known if k == "snapshot" and n < upto), default=-1)
    if ("snapshot", upto) not in known:
        _last(_rows(spark, path, upto), keys).write.mode("overwrite").parquet(_name(path, "snapshot", upto))
    for kind, number in known:
        if number < before or (number == before and kind == "batch"):
            target, fs = file_system(spark, _name(path, kind, number))
            fs.delete(target, True)
