"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import importlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


# Settings that may change while a session runs. A hot graph or hub makes one join partition
# huge: adaptive execution splits it even where that costs one more shuffle of the
# aggregated rows behind the join.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # files are taken for so many times their size in memory: ids and vectors shrink that far on disk, and
    # a table that is broadcast on the size of its files would fill the driver
    "spark.sql.sources.fileCompressionFactor": "16",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches of long texts stay small; what a task holds does not follow the length of a text
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app_name: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partition counts are left to the cluster: adaptive execution coalesces small
    partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Give a session that was built elsewhere the runtime settings."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return ship(spark)


_SHIPPED: set[tuple[str, str]] = set()


def ship(spark: SparkSession, package: str = "graphloom") -> SparkSession:
    """Give the executors the source of a package, once per application.

    Functions that run on Arrow batches are sent by name, so each worker imports the package,
    from whatever folder it was started in.
    """
    context = spark.sparkContext
    mark = (context.applicationId, package)
    if mark not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(importlib.import_module(package).__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix=f"{package}-"), f"{package}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join(package, os.path.relpath(path, root)))
        context.addPyFile(archive)
        _SHIPPED.add(mark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (``local``, ``local[n]``) gets a
    temporary folder without that setting; on a cluster, also one on this machine, a folder of one
    machine would be lost with it, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


@contextmanager
def state_partitions(spark: SparkSession, per_core: int = 2) -> Iterator[None]:
    """Streams started inside share their state among ``per_core`` partitions a core, if the session does not ask for fewer.

    Each micro-batch loads, commits and (with Python) serves every state partition of every operator, also without
    rows, and adaptive execution joins none of them. A stream that goes on from a checkpoint keeps the number it began with.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), per_core * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share out an input that comes in fewer splits than there are cores.

    Heavy work per row would otherwise run in a few tasks. An input with enough splits,
    the normal case on large data, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Unlike a checkpointed RDD the table keeps column pruning, filter pushdown and a known
    size, so later joins are planned on facts. It outlives executors; :func:`drop_cuts`
    removes it.
    """
    spark = df.sparkSession
    path = f"{_cut_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*cuts: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote, once nothing reads them any more.

    Spark's cleaner removes the shuffle files of finished jobs when their objects are collected as garbage;
    asking for that here keeps a long operator's files from adding up until the driver happens to collect.
    """
    for df in cuts:
        _delete(df.sparkSession, df._cut_path)
    gc.collect()
    for df in cuts[:1]:
        df.sparkSession.sparkContext._jvm.System.gc()


def file_system(spark: SparkSession, path: str):
    """``path`` and the file system it lies in, as the session's objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = file_system(spark, path)
    return files.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    target, files = file_system(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []


def _delete(spark: SparkSession, path: str) -> None:
    target, files = file_system(spark, path)
    files.delete(target, True)


def cut_all(*frames: DataFrame) -> list[DataFrame]:
    """:func:`cut` of several independent frames at once; their jobs share the cluster."""
    if len(frames) == 1:
        return [cut(frames[0])]
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(inheritable_thread_target(frames[0].sparkSession)(cut), frames))


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables this application has cut; frames that still read them end here."""
    _delete(spark, _cut_folder(spark))


def _cut_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"
