"""Stored logs first, live ones behind them: each log of a feed once, also after a restart.

The feed of a client is a folder. ``history`` holds the logs that were stored when the feed began; it is written once
and everything else follows from what was written, so a restart meets the same hand-over. ``floor`` and ``tail`` are
made from it: the time per experiment up to which the history alone counts, and the logs behind that time which a
late source may still send. ``live`` is what the stream adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import exists
from graphloom.streaming import store
from graphloom.streaming import telemetry as TM

COLUMNS = ["experiment_id", "seq", "ts", "level", "message"]
SCHEMA = "experiment_id string, seq bigint, ts double, level string, message string"


def hand_over(stored: DataFrame, path: str, delay_seconds: float) -> None:
    """Pin the history of the feed at ``path`` to the rows of ``stored(experiment_id, seq, ts, level, message)``.

    A feed that has been pinned stays as it is; a part that a lost driver left unfinished is written again.
    Rows that agree in every column are one log.
    """
    spark = stored.sparkSession

    def once(name: str, rows: DataFrame) -> DataFrame:
        folder = f"{path}/{name}"
        if not store.complete(spark, folder):
            rows.write.mode("overwrite").parquet(folder)
        return spark.read.schema(rows.schema).parquet(folder)

    history = once("history", stored.select(COLUMNS).distinct())
    floor = once("floor", history.groupBy("experiment_id").agg((F.max("ts") - delay_seconds).alias("floor")))
    once("tail", history.join(floor, "experiment_id").where("ts > floor").select(COLUMNS))


def unseen(live: DataFrame, path: str) -> DataFrame:
    """Rows of ``live``, a batch or a stream, that the pinned history does not hold.

    At or before the floor of an experiment the history is whole, so such a row is a repeat, or later than the delay allows.
    Between floor and mark both sources may hold a log; these rows, as many as one delay brings, are compared.
    """
    spark = live.sparkSession
    floor = spark.read.schema("experiment_id string, floor double").parquet(f"{path}/floor")
    tail = spark.read.schema(SCHEMA).parquet(f"{path}/tail")
    named = tail.select([F.col(c).alias(f"tail_{c}") for c in COLUMNS])
    ahead = live.select(COLUMNS).join(floor, "experiment_id", "left").where("floor IS NULL OR ts > floor").drop("floor")
    same = [F.col(c).eqNullSafe(F.col(f"tail_{c}")) for c in COLUMNS]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return ahead.join(named, on, "left_anti")


def replay_sink(stored: DataFrame, live: DataFrame, path: str, checkpoint: str, delay_seconds: float = 600.0):
    """Replay stored logs into the feed at ``path`` and go on with ``live``, a stream of log rows; returns the running query.

    The live source must begin at or before the logs that ``stored`` lacks, at most ``delay_seconds`` of event time out of order; the
    more it repeats of the history, the more is read for nothing, but nothing comes twice. Logs that
    the live source itself repeats within the delay are dropped too. To follow some experiments only, filter both inputs.
    """
    hand_over(stored, path, delay_seconds)
    once = TM.bounded(unseen(live, path), f"{delay_seconds} seconds", COLUMNS)
    return TM.append_sink(once.select(COLUMNS), f"{path}/live", checkpoint)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """What the feed holds so far; ``(ts, seq)`` is its order."""
    read = lambda name: spark.read.schema(SCHEMA).parquet(f"{path}/{name}")
    return read("history").unionByName(read("live")) if exists(spark, f"{path}/live") else read("history")
