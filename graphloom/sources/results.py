"""Storing and exporting experiment results.

A store is a folder. Each run writes its tables to folders of its own and the experiments it speaks for to ``staged``; then it claims
the next version by giving a file of ``versions`` a name that nobody else can take, with its run as content. That file alone makes
the run visible, all of it at once. Of several commits of an experiment the highest version counts.
"""

from __future__ import annotations

import os
import time
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import children, exists, file_system

TABLES = ("experiments", "data", "nodes")
STAGED = "experiment_id string, status string"


class Conflict(Exception):
    """Experiments were committed by another run since the version a run was based on."""


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """``(version, run_id)`` of the claimed versions."""
    if not exists(spark, f"{path}/versions"):
        return spark.createDataFrame([], "version bigint, run_id string")
    rows = spark.read.option("wholetext", True).text(f"{path}/versions")
    return rows.select(F.col("_metadata.file_name").cast("bigint").alias("version"), F.col("value").alias("run_id"))


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """``(experiment_id, status, run_id, version)``: every commit of every experiment."""
    claimed = _versions(spark, path)
    if not exists(spark, f"{path}/staged"):
        return claimed.select(F.lit("").alias("experiment_id"), F.lit("").alias("status"), "run_id", "version").where("false")
    staged = spark.read.schema(f"{STAGED}, run_id string").parquet(f"{path}/staged")
    return staged.join(claimed, "run_id").select("experiment_id", "status", "run_id", "version")


def current(spark: SparkSession, path: str) -> int:
    """The highest version, 0 for a new store; what a run read before it may be named as its ``base``."""
    return max([int(n) for n in children(spark, f"{path}/versions") if n.isdigit()], default=0)


def _claim(spark: SparkSession, path: str, version: int, run_id: str) -> bool:
    """Give the version to the run unless it has been taken: the file gets its name, content included, in one step.

    A rename does that where it does not replace files, as in HDFS; on a local disk it does, so a link is made there.
    """
    folder, files = file_system(spark, f"{path}/versions")
    files.mkdirs(folder)
    own, _ = file_system(spark, f"{path}/versions/.{run_id}")
    out = files.create(own, True)
    out.write(bytearray(run_id.encode()))
    out.close()
    place = urlparse(files.resolvePath(own).toString())
    if place.scheme != "file":
        return files.rename(own, file_system(spark, f"{path}/versions/{version:012d}")[0])
    local = unquote(place.path)
    try:
        os.link(local, os.path.join(os.path.dirname(local), f"{version:012d}"))
    except FileExistsError:
        return False
    return True


def _commit(spark: SparkSession, path: str, run_id: str, base: int | None) -> int:
    """Claim the next version; the loser of a race looks at what the winner has committed, and tries the one after."""
    while True:
        seen = current(spark, path)
        if base is not None and seen > base:
            own = spark.read.schema(STAGED).parquet(f"{path}/staged/run_id={run_id}")
            others = _commits(spark, path).where((F.col("version") > base) & (F.col("version") <= seen))
            if not own.join(others, "experiment_id", "left_semi").isEmpty():
                raise Conflict(f"run {run_id} is based on version {base}")
        if _claim(spark, path, seen + 1, run_id):
            return seen + 1


def _known(spark: SparkSession, path: str, run_id: str) -> int | None:
    if not run_id or set(run_id) & set("/=%:") or run_id[0] in "._":
        raise ValueError(f"a run id must do as the name of a folder: {run_id!r}")
    found = _versions(spark, path).where(F.col("run_id") == run_id).agg(F.min("version")).first()
    return found[0]


def publish(path: str, run_id: str, experiments: DataFrame, data: DataFrame, nodes: DataFrame, base: int | None = None) -> int:
    """Write results so that readers see all of an experiment or nothing of it; returns the version of the commit.

    A lost executor or a failed job leaves at most folders that no version names. A run that is
    published again, as after a lost driver, keeps its version. With ``base`` the run is refused (:class:`Conflict`) if another
    has committed one of its experiments since that version.
    """
    spark = experiments.sparkSession
    done = _known(spark, path, run_id)
    if done is not None:
        return done
    staged = experiments.select(F.col("experiment_id").cast("string").alias("experiment_id"), F.col("status").cast("string").alias("status"))
    for name, table in (("data", data), ("nodes", nodes), ("experiments", experiments), ("staged", staged)):
        table.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")
    return _commit(spark, path, run_id, base)


def delete(spark: SparkSession, path: str, run_id: str, ids: DataFrame, base: int | None = None) -> int:
    """Make experiments invisible, with their data and nodes; returns the version of the commit."""
    done = _known(spark, path, run_id)
    if done is not None:
        return done
    gone = ids.select(F.col("experiment_id").cast("string").alias("experiment_id"), F.lit("deleted").alias("status")).distinct()
    gone.write.mode("overwrite").parquet(f"{path}/staged/run_id={run_id}")
    return _commit(spark, path, run_id, base)


def _last(spark: SparkSession, path: str) -> DataFrame:
    """The commit that counts for each experiment."""
    last = _commits(spark, path).groupBy("experiment_id").agg(F.max_by(F.struct("run_id", "status"), "version").alias("c"))
    return last.select("experiment_id", "c.*")


def read_published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The visible ``experiments``, ``data`` and ``nodes``; only folders of runs that show something are listed and read.

    A store that no run has written a table to, or of which nothing is left, gives empty tables of ``experiment_id`` alone.
    """
    visible = _last(spark, path).where("status <> 'deleted'").select("experiment_id", "run_id")
    runs = sorted(r.run_id for r in visible.select("run_id").distinct().collect())
    out = {}
    for name in TABLES:
        if not any(n.startswith("run_id=") for n in children(spark, f"{path}/{name}")):
            out[name] = spark.createDataFrame([], "experiment_id string")
            continue
        folders = [f"{path}/{name}/run_id={r}" for r in runs] or [f"{path}/{name}"]
        table = spark.read.option("basePath", f"{path}/{name}").parquet(*folders)
        table = table.withColumn("run_id", F.col("run_id").cast("string"))
        out[name] = table.join(visible, ["experiment_id", "run_id"], "left_semi").drop("run_id")
    return out


def vacuum(spark: SparkSession, path: str, older_than_seconds: float = 7 * 86400.0) -> list[str]:
    """Remove runs that show nothing any more, and folders that no version names; returns the removed runs.

    A run stays while it is the last word on any experiment, a deletion too. Folders younger than ``older_than_seconds`` stay:
    they may belong to a run that has yet to commit, or be read by someone who looked before. The
    highest version stays, so that no number is given twice.
    """
    numbers = {r.run_id: r.version for r in _versions(spark, path).collect()}
    shown = {r.run_id for r in _last(spark, path).select("run_id").distinct().collect()}
    top = max(numbers, key=numbers.get, default=None)
    found = {n.partition("=")[2] for t in ("staged", *TABLES) for n in children(spark, f"{path}/{t}") if n.startswith("run_id=")}
    mark, gone = (time.time() - older_than_seconds) * 1000, []
    for run_id in sorted(found - shown - {top}):
        folders = [file_system(spark, f"{path}/{t}/run_id={run_id}") for t in (*TABLES, "staged")]
        present = [(folder, files) for folder, files in folders if files.exists(folder)]
        if any(files.getFileStatus(folder).getModificationTime() > mark for folder, files in present):
            continue
        # the version goes first: without it nothing of the run can be seen
        claims = [f"{path}/versions/{numbers[run_id]:012d}"] if run_id in numbers else []
        for folder, files in [file_system(spark, c) for c in claims] + present:
            files.delete(folder, True)
        gone.append(run_id)
    return gone


def export(experiment: DataFrame, path: str, form: str = "json") -> None:
    """Experiments as JSON lines, or id, name and status as CSV. An unknown id is an error."""
    if form not in ("json", "csv"):
        raise ValueError(f"form must be json or csv, not {form!r}")
    if experiment.isEmpty():
        raise KeyError("experiment not found")
    if form == "csv":
        rows = experiment.select(F.col("experiment_id").alias("id"), "name", "status")
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        experiment.write.mode("overwrite").json(path)


def snapshot(df: DataFrame, path: str, stage: str, run_ts: str, sub_dir: str = "", extension: str = "json") -> str:
    """A named, time-stamped copy of a stage as JSON lines, or as text where rows are one string."""
    target = "/".join(p for p in (path, sub_dir) if p)
    rows = df.withColumns({"stage": F.lit(stage), "run_ts": F.lit(run_ts)})
    writer = rows.write.mode("append").partitionBy("stage", "run_ts")
    if extension == "json":
        writer.json(target)
    else:
        writer.text(target)
    return f"{target}/stage={stage}/run_ts={run_ts}"
