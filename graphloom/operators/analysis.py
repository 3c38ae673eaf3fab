"""Experiments: result buckets, reassembly and comparison by strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.values import json_or_text

# Bucket names, known stages, statuses of a finished run.
TRACE = ("trace", "execution_trace")
METADATA = ("metadata", "runtime_metadata")
STATS = ("stats", "intermediate_telemetry")
LOGS = ("logs", "execution_logs")
KNOWN_STAGES = ["G_B", "G_T", "G_F"]
FINISHED = ("completed", "success")
DATA = ["experiment_id", "category", "key", "part", "value"]
PART_SIZE = 1000


def _row(category: Column, key: Column, part: Column, value: Column) -> list[Column]:
    return [
        F.col("experiment_id"),
        category.alias("category"),
        key.alias("key"),
        part.cast("bigint").alias("part"),
        value.alias("value"),
    ]


def graph_bucket(graphs: DataFrame) -> DataFrame:
    """Buckets of stage graphs ``(experiment_id, stage, part, json)``."""
    return graphs.select(*_row(F.lit("graph"), F.col("stage"), F.col("part"), F.col("json")))


def _list_bucket(rows: DataFrame, entry: Column, names: tuple[str, str], part_size: int) -> DataFrame:
    """JSON lists in parts by ``floor(seq / part_size)``: a long history is several rows."""
    part = F.floor(F.col("seq") / part_size).alias("part")
    keyed = rows.select("experiment_id", part, F.struct("seq", entry.alias("json")).alias("e"))
    lists = keyed.groupBy("experiment_id", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["json"]), ",").alias("items")
    )
    value = F.concat(F.lit("["), "items", F.lit("]"))
    return lists.select(*_row(F.lit(names[0]), F.lit(names[1]), F.col("part"), value))


def trace_bucket(trace: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Buckets of trace rows ``(experiment_id, seq, ts, action, details)``; details is a JSON object."""
    head = F.to_json(F.struct(F.col("ts").alias("timestamp"), "action"))
    inner = F.substring("details", F.lit(2), F.length("details") - 2)
    extra = F.when(F.length(F.trim(inner)) > 0, F.concat(F.lit(","), inner)).otherwise(F.lit(""))
    entry = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.coalesce(extra, F.lit("")), F.lit("}"))
    return _list_bucket(trace, entry, TRACE, part_size)


def log_bucket(logs: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Buckets of log rows ``(experiment_id, seq, ts, level, message)``."""
    entry = F.to_json(F.struct("message", "level", F.col("ts").alias("timestamp")))
    return _list_bucket(logs, entry, LOGS, part_size)


def metric_bucket(metrics: DataFrame) -> DataFrame:
    """Buckets of metrics ``(experiment_id, key, value)``; the value is already text or JSON."""
    return metrics.select(*_row(F.lit("metric"), F.col("key"), F.lit(0), F.col("value").cast("string")))


def metadata_bucket(metadata: DataFrame) -> DataFrame:
    """Buckets of run metadata ``(experiment_id, meta map)``."""
    return metadata.select(*_row(F.lit(METADATA[0]), F.lit(METADATA[1]), F.lit(0), F.to_json("meta")))


def stats_bucket(stats: DataFrame) -> DataFrame:
    """Buckets of stage statistics ``(experiment_id, stage, node_count, edge_count, depth, source)``.

    An experiment has one row per stage, so the object stays small.
    """
    item = F.struct("node_count", "edge_count", "depth", "source")
    packed = F.sort_array(F.collect_list(F.struct("stage", item.alias("s"))))
    maps = stats.groupBy("experiment_id").agg(F.map_from_entries(packed).alias("m"))
    return maps.select(*_row(F.lit(STATS[0]), F.lit(STATS[1]), F.lit(0), F.to_json("m")))


def node_rows(nodes: DataFrame) -> DataFrame:
    """Final nodes as stored rows: level and parent from the state, metadata under ``_meta``."""
    attrs = F.to_json("attrs")
    sep = F.when(F.size("attrs") > 0, F.lit(",")).otherwise(F.lit(""))
    folded = F.concat(F.substring(attrs, F.lit(1), F.length(attrs) - 1), sep, F.lit('"_meta":'), F.to_json("meta"), F.lit("}"))
    label = F.coalesce(F.nullif("label", F.lit("")), F.nullif(F.try_element_at("attrs", F.lit("label")), F.lit("")), F.lit("Unknown"))
    return nodes.select(
        F.col("graph_id").alias("experiment_id"),
        "node_id",
        label.alias("label"),
        F.coalesce(F.try_element_at("state", F.lit("level")).try_cast("int"), F.lit(0)).alias("level"),
        folded.alias("attributes"),
        F.to_json("metrics").alias("metrics"),
        F.to_json("state").alias("state"),
        F.try_element_at("state", F.lit("parentNodeId")).alias("parent_node_id"),
    )


def _entries(data: DataFrame, category: str) -> DataFrame:
    """Entries of JSON lists in order ``(experiment_id, part, pos, entry)``; a lone value is a list of one."""
    rows = data.where(F.col("category") == category).where(F.try_parse_json("value").isNotNull())
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    items = F.when(is_list, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return rows.select("experiment_id", "key", "part", F.posexplode(items).alias("pos", "entry"))


def trace_rows(data: DataFrame) -> DataFrame:
    """Trace entries with their action; an entry without one counts as ``UNKNOWN``."""
    action = F.coalesce(F.nullif(F.get_json_object("entry", "$.action"), F.lit("")), F.lit("UNKNOWN"))
    return _entries(data, TRACE[0]).select("experiment_id", "part", "pos", action.alias("action"), "entry")


def log_rows(data: DataFrame) -> DataFrame:
    return _entries(data, LOGS[0]).select("experiment_id", "part", "pos", "entry")


def metric_rows(data: DataFrame) -> DataFrame:
    """Metrics as JSON; what is no JSON stays as a string. The last part of a key wins."""
    rows = data.where("category = 'metric'").groupBy("experiment_id", "key").agg(F.max_by("value", "part").alias("value"))
    return rows.select("experiment_id", "key", json_or_text("value").alias("value"))


def graph_rows(data: DataFrame) -> DataFrame:
    """Readable stage graphs; unreadable ones are left out."""
    rows = data.where("category = 'graph'").where(F.try_parse_json("value").isNotNull())
    return rows.select("experiment_id", F.col("key").alias("stage"), "part", F.col("value").alias("json"))


def stat_rows(data: DataFrame) -> DataFrame:
    """Stage statistics in long form; later buckets overwrite a stage."""
    rows = data.where(F.col("category") == STATS[0])
    parsed = rows.select("experiment_id", "part", F.explode(F.from_json("value", "map<string,string>")).alias("stage", "s"))
    last = parsed.groupBy("experiment_id", "stage").agg(F.max_by("s", "part").alias("s"))
    fields = F.from_json("s", "node_count bigint, edge_count bigint, depth int, source string")
    return last.select("experiment_id", "stage", fields.alias("f")).select("experiment_id", "stage", "f.*")


def reassemble(data: DataFrame) -> dict[str, DataFrame]:
    """Every bucket back in table form."""
    return {
        "graphs": graph_rows(data),
        "stats": stat_rows(data),
        "metrics": metric_rows(data),
        "trace": trace_rows(data),
        "logs": log_rows(data),
    }


def get_experiment(experiments: DataFrame, data: DataFrame, experiment_id: str) -> dict[str, DataFrame]:
    """One experiment with all its buckets; every table is empty when the id is unknown."""
    one = lambda df: df.where(F.col("experiment_id") == experiment_id)
    return {"experiment": one(experiments), **reassemble(one(data))}


def _node_totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("node_count"))


def _trace_totals(data: DataFrame) -> DataFrame:
    """Trace lengths, without taking the lists apart."""
    rows = data.where(F.col("category") == TRACE[0]).where(F.try_parse_json("value").isNotNull())
    length = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.json_array_length("value")).otherwise(1)
    return rows.groupBy("experiment_id").agg(F.sum(length).alias("iterations"))


def experiment_details(experiments: DataFrame, nodes: DataFrame, data: DataFrame) -> DataFrame:
    """Experiments with node and bucket totals; children are counted before the join."""
    rows = data.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("data_count"))
    out = experiments.join(_node_totals(nodes), "experiment_id", "left").join(rows, "experiment_id", "left")
    return out.join(_trace_totals(data), "experiment_id", "left").fillna(0, ["node_count", "data_count", "iterations"])


def _wanted(ids: list[str]) -> Column:
    if len(ids) < 2:
        raise ValueError("at least two experiment ids are needed")
    return F.col("experiment_id").isin(list(ids))


def compare(experiments: DataFrame, nodes: DataFrame, data: DataFrame, ids: list[str]) -> DataFrame:
    """Name, strategy, nodes and trace length of the given experiments."""
    chosen = _wanted(ids)
    return (
        experiments.where(chosen)
        .join(_node_totals(nodes.where(chosen)), "experiment_id", "left")
        .join(_trace_totals(data.where(chosen)), "experiment_id", "left")
        .fillna(0, ["node_count", "iterations"])
        .select("experiment_id", "name", F.col("halting_strategy").alias("strategy"), "node_count", "iterations")
    )


def compare_actions(experiments: DataFrame, data: DataFrame, ids: list[str]) -> DataFrame:
    """Actions per given experiment, in long form."""
    chosen = _wanted(ids)
    actions = trace_rows(data.where(chosen)).groupBy("experiment_id", "action").agg(F.count(F.lit(1)).alias("count"))
    return actions.join(experiments.where(chosen).select("experiment_id"), "experiment_id", "left_semi")


def compare_stats(experiments: DataFrame, data: DataFrame, ids: list[str]) -> DataFrame:
    """Statistics of the three fusion stages per given experiment."""
    chosen = _wanted(ids)
    stats = stat_rows(data.where(chosen)).where(F.col("stage").isin(KNOWN_STAGES))
    return stats.join(experiments.where(chosen).select("experiment_id"), "experiment_id", "left_semi")


def finished(experiments: DataFrame, strategy: str | None = None, statuses: tuple[str, ...] = FINISHED) -> DataFrame:
    rows = experiments.where(F.col("status").isin(list(statuses)))
    return rows if strategy is None else rows.where(F.col("halting_strategy") == strategy)


def strategy_performance(
    experiments: DataFrame,
    nodes: DataFrame,
    data: DataFrame,
    strategy: str | None = None,
    statuses: tuple[str, ...] = FINISHED,
) -> DataFrame:
    """Runs, nodes and trace lengths per strategy, total and average."""
    runs = (
        finished(experiments, strategy, statuses)
        .join(_node_totals(nodes), "experiment_id", "left")
        .join(_trace_totals(data), "experiment_id", "left")
        .fillna(0, ["node_count", "iterations"])
    )
    return runs.groupBy(F.col("halting_strategy").alias("strategy")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("node_count").alias("total_nodes"),
        F.sum("iterations").alias("total_iterations"),
        F.avg("node_count").alias("avg_nodes"),
        F.avg("iterations").alias("avg_iterations"),
    )


def strategy_actions(
    experiments: DataFrame, data: DataFrame, strategy: str | None = None, statuses: tuple[str, ...] = FINISHED
) -> DataFrame:
    """Actions per strategy; counted per experiment first, so the join sees few rows."""
    runs = finished(experiments, strategy, statuses).select("experiment_id", F.col("halting_strategy").alias("strategy"))
    actions = trace_rows(data).groupBy("experiment_id", "action").agg(F.count(F.lit(1)).alias("n"))
    return actions.join(runs, "experiment_id").groupBy("strategy", "action").agg(F.sum("n").alias("count"))


def list_experiments(experiments: DataFrame) -> DataFrame:
    """Newest first, then by id."""
    columns = ["experiment_id", "name", "goal", "status", "created_at"]
    return experiments.select(*columns).orderBy(F.col("created_at").desc(), "experiment_id")


def without(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the experiments in ``ids``: a delete that reaches every table."""
    keys = ids.select("experiment_id").distinct()
    return [t.join(keys, "experiment_id", "left_anti") for t in tables]


def stage_order(col: Column | str) -> list[Column]:
    """Sort keys of stage names: known ones, others (iterations by number), ``Final`` last."""
    key = F.col(col) if isinstance(col, str) else col
    numbered = key.startswith("iteration_")
    number = F.coalesce(F.nullif(F.regexp_extract(key, r"\d+", 0), F.lit("")).try_cast("bigint"), F.lit(0))
    return [
        F.when(key == "Final", 2).when(key.isin(KNOWN_STAGES), 0).otherwise(1),
        F.when(numbered, F.lit("iteration_")).otherwise(F.lower(key)),
        F.when(numbered, number).otherwise(F.lit(0)),
        key,
    ]


def available_stages(stats: DataFrame) -> DataFrame:
    """Stages that hold nodes, numbered in display order; an experiment has few stages."""
    position = F.row_number().over(Window.partitionBy("experiment_id").orderBy(*stage_order("stage")))
    return stats.where("node_count > 0").select("experiment_id", "stage", position.alias("position"))


def run_metrics(runs: DataFrame, evaluations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Iterations, final nodes and duration of runs ``(experiment_id, start_ts, end_ts)``."""
    last = evaluations.groupBy("experiment_id").agg(F.max("iteration").alias("total_iterations"))
    final = _node_totals(nodes).withColumnRenamed("node_count", "final_node_count")
    out = runs.join(last, "experiment_id", "left").join(final, "experiment_id", "left")
    return out.fillna(0, ["total_iterations", "final_node_count"]).select(
        "experiment_id", "total_iterations", "final_node_count", (F.col("end_ts") - F.col("start_ts")).alias("duration")
    )


def convergence(stats: DataFrame, stages: tuple[str, str, str] = ("G_B", "G_T", "G_F")) -> DataFrame:
    """Nodes before and after fusion, where all three stages are known."""
    count = lambda s: F.max(F.when(F.col("stage") == s, F.col("node_count")))
    names = ["evidence_nodes", "goal_nodes", "fused_nodes"]
    wide = stats.groupBy("experiment_id").agg(*[count(s).alias(n) for s, n in zip(stages, names, strict=True)])
    return wide.dropna(subset=names)
