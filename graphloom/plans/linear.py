"""The linear plan: generate, filter, enrich."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import slots
from graphloom.operators.summary import stage_stats
from graphloom.operators.topology import score_filter
from graphloom.plans.run import Run, together, trace_rows
from graphloom.sources.stars import star_graphs


def linear(
    inputs: DataFrame, node_count: int = 10, threshold: float = 0.5, enrich_ts: float | None = None
) -> Run:
    """``inputs(experiment_id, goal, text)`` through three stages, all experiments at once."""
    now = time.time() if enrich_ts is None else enrich_ts
    documents = inputs.select(F.col("experiment_id").alias("graph_id"), "text")
    raw = star_graphs(documents, node_count)
    kept = score_filter(raw, threshold, suffix="")
    final = kept.with_nodes(slots.enrich(kept.nodes, now))
    stats = together(
        [
            stage_stats(raw, "Stage1_Gen").withColumn("dropped", F.lit(None).cast("bigint")),
            stage_stats(kept, "Stage2_Filter", raw),
            stage_stats(final, "Stage3_Final").withColumn("dropped", F.lit(None).cast("bigint")),
        ]
    ).withColumnRenamed("graph_id", "experiment_id")
    ids = inputs.select("experiment_id")
    return Run(
        final=final,
        stages={"raw_generated": raw, "filtered": kept},
        trace=trace_rows(ids.withColumnRenamed("experiment_id", "graph_id"), 0, now, "linear").where(F.lit(False)),
        stats=stats,
        outcome=ids.select("experiment_id", F.lit("success").alias("status"), F.lit("COMPLETED").alias("decision")),
        metrics=ids.select("experiment_id", F.lit("").alias("key"), F.lit("").alias("value")).where(F.lit(False)),
        metadata=inputs.select("experiment_id", F.create_map(F.lit("goal"), F.col("goal")).alias("meta")),
    )
