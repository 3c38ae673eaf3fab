"""Queries on the whole plans: linear, dynamic halting, telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import TELEMETRY, epoch_seconds, increment_sql, order_increment, table, telemetry
from graphloom.functions import slots
from graphloom.model import Graphs
from graphloom.operators.halting import Limits
from graphloom.plans.linear import linear
from graphloom.plans.loop import grow, run
from graphloom.plans.run import RunConfig
from graphloom.session import checkpoint_dir
from graphloom.settings import problems
from graphloom.sources.stars import star_graphs
from graphloom.streaming import live, replay
from graphloom.streaming import telemetry as TM


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("graph_id"), "text")


STAR = """
d AS (SELECT CAST(doc_id AS VARCHAR) AS graph_id, left(text, 10) AS head FROM documents),
i AS (SELECT unnest(range(10)) AS i),
star AS (
  SELECT graph_id, 'ROOT' AS node_id, 'Seed' AS label, head AS source, CAST(NULL AS VARCHAR) AS score FROM d
  UNION ALL SELECT graph_id, 'NODE_' || i, 'Item ' || i, NULL, CAST(i / 10.0 AS VARCHAR) FROM d, i)"""


@query("star_nodes", f"WITH {STAR} SELECT graph_id, node_id, label, source, CAST(score AS DOUBLE) AS score FROM star")
def star_nodes(spark, sf):
    nodes = star_graphs(_documents(spark, sf)).nodes
    return nodes.select(
        "graph_id", "node_id", "label", slots.attr("source").alias("source"), slots.attr("score").cast("double").alias("score")
    )


@query("star_edges", f"WITH {STAR} SELECT graph_id, 'ROOT' AS source, 'NODE_' || i AS target, 'generated' AS relation FROM d, i")
def star_edges(spark, sf):
    return star_graphs(_documents(spark, sf)).edges.select("graph_id", "source", "target", "relation")


def _linear(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("experiment_id"), F.col("lang").alias("goal"), "text")
    return linear(docs, enrich_ts=1.0)


@query(
    "linear_nodes",
    f"WITH {STAR} SELECT graph_id, node_id, '[E] ' || label AS label, '0.7' AS score FROM star WHERE coalesce(CAST(score AS DOUBLE), 1.0) >= 0.5",
)
def linear_nodes(spark, sf):
    return _linear(spark, sf).final.nodes.select("graph_id", "node_id", "label", slots.attr("score").alias("score"))


@query(
    "linear_stats",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS experiment_id FROM documents)
SELECT experiment_id, stage, CAST(n AS BIGINT) AS node_count, CAST(e AS BIGINT) AS edge_count, 0 AS depth, 'unknown' AS source, CAST(x AS BIGINT) AS dropped
FROM d, (VALUES ('Stage1_Gen', 11, 10, NULL), ('Stage2_Filter', 6, 5, 5), ('Stage3_Final', 6, 5, NULL)) AS s(stage, n, e, x)""",
)
def linear_stats(spark, sf):
    return _linear(spark, sf).stats


@query(
    "linear_buckets",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS experiment_id, lang FROM documents)
SELECT experiment_id, category, key, CAST(CASE category WHEN 'graph' THEN n END AS BIGINT) AS nodes, CASE WHEN category = 'metadata' THEN '{"goal":"' || lang || '"}' END AS meta
FROM d, (VALUES ('graph', 'raw_generated', 11), ('graph', 'filtered', 6), ('metadata', 'runtime_metadata', 0), ('stats', 'intermediate_telemetry', 0)) AS b(category, key, n)""",
)
def linear_buckets(spark, sf):
    """The stored form of the linear run."""
    data = _linear(spark, sf).data()
    nodes = F.size(F.map_keys(F.from_json(F.get_json_object("value", "$.nodes"), "map<string,string>")))
    return data.select(
        "experiment_id",
        "category",
        "key",
        F.when(F.col("category") == "graph", nodes).cast("bigint").alias("nodes"),
        F.when(F.col("category") == "metadata", F.col("value")).alias("meta"),
    )


_ROUNDS = 2


def _scripted_loop(spark, sf):
    """Halting rounds over the order graphs with one prepared increment per round."""
    current, steps = order_increment(spark, sf, ["O", "P"])

    def expand(g: Graphs, iteration: int) -> Graphs:
        return steps[iteration - 1].only(g.graphs)

    # halfway between the smallest and the largest graph: at every scale some halt and some grow
    sizes = current.nodes.groupBy("graph_id").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).first()
    cfg = RunConfig(max_iterations=5, max_depth=_ROUNDS, limits=Limits(max_nodes=(sizes.a + sizes.b) // 2))
    return grow(current, expand, cfg)


def _loop_sql() -> str:
    rounds = [increment_sql(["O", "P"])]
    for k in range(1, _ROUNDS + 1):
        at = k - 1
        alive = "(SELECT DISTINCT graph_id FROM parent)" if k == 1 else f"(SELECT graph_id FROM decision{k - 1} WHERE decision = 'CONTINUE')"
        grown = "FALSE" if k == 1 else "(n.graph_id, n.node_id) IN (SELECT graph_id, node_id FROM parent)"
        rounds.append(f"""
touch{k} AS (SELECT graph_id, source AS node_id FROM edge{at} UNION ALL SELECT graph_id, target FROM edge{at} WHERE target <> source),
size{k} AS (SELECT graph_id, count(*) AS node_count FROM cur{at} GROUP BY graph_id),
deg{k} AS (SELECT n.graph_id, n.node_id, count(t.node_id) AS degree FROM cur{at} n LEFT JOIN touch{k} t USING (graph_id, node_id) GROUP BY ALL),
stat{k} AS (
  SELECT n.graph_id, s.node_count, CASE WHEN s.node_count < 3 OR degree = 0 THEN 'HALT-DROP' WHEN degree > 5 OR {grown} THEN 'HALT-ACCEPT' ELSE 'LOOP' END AS status
  FROM deg{k} n JOIN size{k} s USING (graph_id)),
decision{k} AS (
  SELECT graph_id, {k} AS iteration, node_count,
    CASE WHEN node_count >= (SELECT (min(k) + max(k)) // 2 FROM (SELECT count(*) AS k FROM cur0 GROUP BY graph_id)) THEN 'HALT' WHEN count(*) FILTER (status = 'LOOP') > 0 THEN 'CONTINUE'
         WHEN count(*) FILTER (status = 'HALT-ACCEPT') > 0 THEN 'HALT' ELSE 'DROP' END AS decision,
    CASE WHEN node_count >= (SELECT (min(k) + max(k)) // 2 FROM (SELECT count(*) AS k FROM cur0 GROUP BY graph_id)) THEN 'max_nodes reached (' || node_count || ')' WHEN count(*) FILTER (status = 'LOOP') > 0 THEN 'ongoing_expansion'
         ELSE 'all_nodes_terminal' END AS reason
  FROM stat{k} WHERE graph_id IN {alive} GROUP BY graph_id, node_count)""")
    rounds.append(
        """
decisions AS (SELECT * FROM decision1 UNION ALL SELECT * FROM decision2),
last AS (SELECT graph_id, count(*) FILTER (decision = 'CONTINUE') AS merged, max(iteration) AS iterations, arg_max(decision, iteration) AS decision FROM decisions GROUP BY graph_id),
final_nodes AS (
  SELECT c.* FROM cur0 c JOIN last USING (graph_id) WHERE merged = 0
  UNION ALL SELECT c.* FROM cur1 c JOIN last USING (graph_id) WHERE merged = 1
  UNION ALL SELECT c.* FROM cur2 c JOIN last USING (graph_id) WHERE merged = 2),
final_edges AS (
  SELECT c.* FROM edge0 c JOIN last USING (graph_id) WHERE merged = 0
  UNION ALL SELECT c.* FROM edge1 c JOIN last USING (graph_id) WHERE merged = 1
  UNION ALL SELECT c.* FROM edge2 c JOIN last USING (graph_id) WHERE merged = 2)"""
    )
    return ",".join(rounds)


@query(
    "loop_decisions",
    f"WITH {_loop_sql()} SELECT graph_id AS experiment_id, CAST(iteration AS INTEGER) AS iteration, decision, reason, node_count FROM decisions",
)
def loop_decisions(spark, sf):
    trace = _scripted_loop(spark, sf).trace.where("action = 'halting_evaluation'")
    fields = F.from_json("details", "iteration int, decision string, reason string, node_count bigint")
    return trace.select("experiment_id", fields.alias("d")).select("experiment_id", "d.*")


@query("loop_final_nodes", f"WITH {_loop_sql()} SELECT graph_id, node_id, label FROM final_nodes")
def loop_final_nodes(spark, sf):
    return _scripted_loop(spark, sf).final.nodes.select("graph_id", "node_id", "label")


@query("loop_final_edges", f"WITH {_loop_sql()} SELECT graph_id, source, target, relation FROM final_edges")
def loop_final_edges(spark, sf):
    return _scripted_loop(spark, sf).final.edges.select("graph_id", "source", "target", "relation")


@query(
    "loop_outcome",
    f"""WITH {_loop_sql()}, n AS (SELECT graph_id, count(*) AS c FROM final_nodes GROUP BY graph_id)
SELECT graph_id AS experiment_id, decision, CAST(iterations AS VARCHAR) AS total_iterations, CAST(c AS VARCHAR) AS final_node_count FROM last JOIN n USING (graph_id)""",
)
def loop_outcome(spark, sf):
    result = _scripted_loop(spark, sf)
    wide = result.metrics.groupBy("experiment_id").pivot("key", ["total_iterations", "final_node_count"]).agg(F.max("value"))
    return result.outcome.join(wide, "experiment_id").select("experiment_id", "decision", "total_iterations", "final_node_count")


@query("full_run")
def full_run(spark, sf):
    """Every turn of a conversation as an experiment through the whole plan, with stand-in models."""

    def decode(texts):
        words = texts.str.split()
        return words.map(lambda w: f"<triplet> {w[0]} <subj> {w[-1]} <obj> {w[len(w) // 2]}" if w else "")

    def generate(prompts):
        def answer(prompt):
            n = len(prompt) % 5 + 1
            nodes = ",".join(f'{{"id":"g{n}_{i}","label":"topic {n} {i}"}}' for i in range(n))
            return f'{{"nodes":[{nodes}],"edges":[{{"source":"g{n}_0","target":"g{n}_{n - 1}","relation":"contains"}}]}}'

        return prompts.map(answer)

    from graphloom.functions.vectors import embed

    inputs = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("experiment_id"),
        F.concat(F.lit("understand the "), "role").alias("goal"),
        "text",
    )
    result = run(inputs, decode, generate, embed, RunConfig(max_depth=2, max_iterations=2))
    return result.outcome.join(
        result.metrics.where("key = 'final_node_count'").select("experiment_id", F.col("value").alias("nodes")), "experiment_id"
    )


def _events(spark, sf):
    return TM.parse_events(telemetry(table(spark, sf, "events")))


@query("telemetry_events", f"WITH {TELEMETRY} SELECT experiment_id, type, ts, seq, CASE type WHEN 'LOG' THEN 'log' ELSE 'telemetry' END AS channel FROM sent")
def telemetry_events(spark, sf):
    return TM.route(_events(spark, sf)).drop("payload")


@query(
    "telemetry_subscribed",
    f"""WITH {TELEMETRY} SELECT s.experiment_id, 'client ' || c_name AS client_id, seq FROM sent s JOIN customer ON s.experiment_id = CAST(c_custkey AS VARCHAR)""",
)
def telemetry_subscribed(spark, sf):
    clients = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("experiment_id"), F.concat(F.lit("client "), "c_name").alias("client_id")
    )
    return TM.subscribed(_events(spark, sf), clients).select("experiment_id", "client_id", "seq")


LATEST = f"""WITH {TELEMETRY} SELECT experiment_id, stage, arg_max(node_count, (ts, seq)) AS node_count, arg_max(seq, (ts, seq)) AS edge_count, 0 AS depth, 'events' AS source
FROM sent WHERE type = 'TELEMETRY' GROUP BY experiment_id, stage"""


@query("telemetry_latest_stats", LATEST)
def telemetry_latest_stats(spark, sf):
    return TM.latest_stats(TM.stage_events(_events(spark, sf)))


@query("telemetry_latest_status", f"WITH {TELEMETRY} SELECT experiment_id, arg_max(type, (ts, seq)) AS status, TRUE AS refresh FROM sent GROUP BY experiment_id")
def telemetry_latest_status(spark, sf):
    return TM.latest_status(_events(spark, sf).withColumnRenamed("type", "status"))


@query(
    "telemetry_logs",
    f"WITH {TELEMETRY} SELECT experiment_id, seq, ts, 'ERROR' AS level, 'event ' || seq AS message FROM sent WHERE type = 'LOG'",
)
def telemetry_logs(spark, sf):
    return TM.log_entries(_events(spark, sf))


def _stream(spark, sf):
    """The event table as a stream of envelopes."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("stream_latest_stats", LATEST)
def stream_latest_stats(spark, sf):
    """The running merge of stage statistics, driven to completion."""
    folder = _folder(spark)
    events = TM.parse_events(telemetry(_stream(spark, sf)))
    latest = TM.latest_stats(TM.stage_events(events))
    TM.table_sink(latest, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return TM.read_table(spark, f"{folder}/table", ["experiment_id", "stage"])


@query(
    "stream_log_sink",
    f"WITH {TELEMETRY} SELECT experiment_id, seq, ts, 'ERROR' AS level, 'event ' || seq AS message FROM sent WHERE type = 'LOG'",
)
def stream_log_sink(spark, sf):
    folder = _folder(spark)
    TM.log_sink(TM.parse_events(telemetry(_stream(spark, sf))), f"{folder}/logs", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/logs")


@query("stream_bounded_events", "SELECT event_id FROM events")
def stream_bounded_events(spark, sf):
    """Each event once, with state that a watermark clears."""
    folder = _folder(spark)
    rows = _stream(spark, sf).select("event_id", epoch_seconds("ts").alias("ts"))
    once = TM.bounded(rows.unionByName(rows), "365 days").select("event_id")
    (
        once.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{folder}/rows")


def _in_slices(spark, df, order: str, folder: str, run, slices: int = 4) -> None:
    """Write ``df`` as a stream source in slices of its order, and let ``run`` take up each slice after a restart."""
    edges = df.approxQuantile(order, [i / slices for i in range(1, slices)], 0.001)
    bounds = [None, *edges, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df if low is None else df.where(F.col(order) >= low)
        # in short files, which the tasks of the stream share evenly
        (part if high is None else part.where(F.col(order) < high)).write.option("maxRecordsPerFile", 100_000).mode("append").parquet(folder)
        run()


def _running(spark, sf, idle: float) -> str:
    """The state operator over all events, each sent twice, in four runs of the stream; its folder."""
    folder = _folder(spark)
    events = table(spark, sf, "events").withColumn("order", epoch_seconds("ts").cast("double"))

    def run() -> None:
        rows = telemetry(spark.readStream.schema(events.schema).parquet(f"{folder}/source"))
        TM.stats_sink(TM.parse_events(rows.unionByName(rows)), f"{folder}/table", f"{folder}/checkpoint", idle, "1 hour", every=3).awaitTermination()

    _in_slices(spark, events, "order", f"{folder}/source", run)
    return folder


@query("stream_running_stats", LATEST)
def stream_running_stats(spark, sf):
    """The running merge with bounded state: repeated events, restarts, a table that is folded."""
    folder = _running(spark, sf, 6 * 3600.0)
    return TM.read_table(spark, f"{folder}/table", ["experiment_id", "stage"]).drop("ts", "seq")


@query(
    "stream_state_size",
    f"""WITH {TELEMETRY}, keys AS (SELECT max(ts) AS ts FROM sent WHERE type = 'TELEMETRY' GROUP BY experiment_id, stage),
mark AS (SELECT max(ts) - 3600 AS mark FROM sent)
SELECT count(*) AS seen, CAST(count_if(ts + 6 * 3600 >= mark) AS BIGINT) AS held FROM keys, mark""",
)
def stream_state_size(spark, sf):
    """Stages that the running merge has seen, and those it still holds as state at the end."""
    folder = _running(spark, sf, 6 * 3600.0)
    held = live.held_stages(spark, f"{folder}/checkpoint").count()
    return TM.read_table(spark, f"{folder}/table", ["experiment_id", "stage"]).agg(F.count(F.lit(1)).alias("seen")).withColumn("held", F.lit(held).cast("long"))


FOLLOWING = """
timed AS (SELECT event_id AS seq, floor(epoch(ts)) AS t, event_type, CAST(user_id AS VARCHAR) AS client_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS VARCHAR) AS k FROM events),
requests AS (
  SELECT client_id, CASE WHEN event_type = 'click' THEN k END AS experiment_id, seq, t,
         lead(t) OVER w AS until, lag(CASE WHEN event_type = 'click' THEN k END) OVER w AS before
  FROM timed WHERE event_type IN ('click', 'signup') WINDOW w AS (PARTITION BY client_id ORDER BY t, seq)),
sent AS (SELECT CAST(seq % 20 AS VARCHAR) AS experiment_id, seq, t FROM timed WHERE event_type NOT IN ('click', 'signup')),
mark AS (SELECT least((SELECT max(t) FROM sent), (SELECT max(t) FROM requests WHERE experiment_id IS NOT NULL OR before IS NOT NULL)) - 3600 AS mark)"""


@query(
    "stream_subscribed",
    f"""WITH {FOLLOWING} SELECT e.experiment_id, r.client_id, e.seq FROM sent e JOIN mark ON e.t < mark
JOIN requests r ON r.experiment_id = e.experiment_id AND e.t >= r.t AND e.t < coalesce(least(r.until, r.t + 432000), r.t + 432000)""",
)
def stream_subscribed(spark, sf):
    """Clients follow the experiment of their last click until they sign up, or five days; events go to those who follow then."""
    folder, lapse = _folder(spark), 5 * 86400.0
    events = table(spark, sf, "events").withColumn("order", epoch_seconds("ts").cast("double"))
    at = F.timestamp_seconds("order")

    def run() -> None:
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/source")
        k = (F.get_json_object("props", "$.k").cast("long") % 20).cast("string")
        asked = source.where("event_type IN ('click', 'signup')").select(
            F.col("user_id").cast("string").alias("client_id"), F.when(F.col("event_type") == "click", k).alias("experiment_id"), F.col("event_id").alias("seq"), at.alias("at")
        )
        changes = live.subscription_changes(live.on_event_time(asked, "1 hour", F.col("at")), lapse)
        TM.append_sink(changes, f"{folder}/changes", f"{folder}/checkpoint/changes").awaitTermination()
        sent = source.where("event_type NOT IN ('click', 'signup')").select((F.col("event_id") % 20).cast("string").alias("experiment_id"), F.col("event_id").alias("seq"), at.alias("at"))
        moves = spark.readStream.schema(live.CHANGE).parquet(f"{folder}/changes")
        given = live.deliver(live.on_event_time(sent, "1 hour", F.col("at")), live.on_event_time(moves, "1 hour", F.col("at")), lapse)
        TM.append_sink(given, f"{folder}/delivered", f"{folder}/checkpoint/delivered").awaitTermination()

    _in_slices(spark, events, "order", f"{folder}/source", run)
    return spark.read.schema(live.DELIVERED).parquet(f"{folder}/delivered")


@query("stream_status", f"WITH {TELEMETRY} SELECT experiment_id, arg_max(type, (ts, seq)) AS status, TRUE AS refresh FROM sent GROUP BY experiment_id")
def stream_status(spark, sf):
    """The last status of each experiment, followed as a stream."""
    folder = _folder(spark)
    rows = TM.parse_events(telemetry(_stream(spark, sf))).withColumnRenamed("type", "status")
    TM.status_sink(rows, f"{folder}/status", f"{folder}/checkpoint").awaitTermination()
    return TM.read_table(spark, f"{folder}/status", ["experiment_id"])


@query(
    "stream_replay",
    f"WITH {TELEMETRY} SELECT experiment_id, seq, ts, 'ERROR' AS level, 'event ' || seq AS message FROM sent WHERE type = 'LOG'",
)
def stream_replay(spark, sf):
    """Logs of the first half of the time are stored; a feed replays them and follows a live source that begins within that half."""
    folder = _folder(spark)
    events = table(spark, sf, "events").withColumn("order", epoch_seconds("ts").cast("double"))
    logs = lambda rows: TM.log_entries(TM.parse_events(telemetry(rows)))
    half, quarter = events.approxQuantile("order", [0.5, 0.25], 0.001)
    TM.append_sink(
        logs(_stream(spark, sf).where(epoch_seconds("ts") <= half)), f"{folder}/logs", f"{folder}/checkpoint/logs"
    ).awaitTermination()
    stored = spark.read.schema(replay.SCHEMA).parquet(f"{folder}/logs")

    def run() -> None:
        live_logs = logs(spark.readStream.schema(events.schema).parquet(f"{folder}/source"))
        replay.replay_sink(stored, live_logs, f"{folder}/feed", f"{folder}/checkpoint/feed", 3600.0).awaitTermination()

    _in_slices(spark, events.where(F.col("order") >= quarter), "order", f"{folder}/source", run)
    return replay.read_feed(spark, f"{folder}/feed")


@query(
    "settings_problems",
    """WITH v AS (SELECT c_custkey, c_custkey % 6 - 1 AS depth, c_custkey % 4 AS kind, c_acctbal / 5000 AS t FROM customer)
SELECT c_custkey, concat_ws('; ', CASE WHEN kind = 3 THEN 'align_sentences is no boolean' END, CASE WHEN kind = 1 THEN 'limits.extra is unknown' END,
  CASE WHEN kind = 2 THEN 'limits.max_nodes is no integer' END, CASE WHEN depth < 0 THEN 'max_depth is out of range' END,
  CASE WHEN t > 1 OR t < -1 THEN 'similarity_threshold is out of range' END) AS problems FROM v""",
)
def settings_problems(spark, sf):
    """Stored settings held against what is declared."""
    key, other = F.col("c_custkey"), F.col("c_custkey") % 4
    text = F.concat(
        F.lit('{"max_depth": '), key % 6 - 1, F.lit(', "similarity_threshold": '), F.col("c_acctbal").cast("double") / 5000,
        F.lit(', "align_sentences": '), F.when(other == 3, '"yes"').otherwise("true"),
        F.lit(', "limits": {'), F.when(other == 1, '"extra": 1').when(other == 2, '"max_nodes": 1.5').otherwise('"max_nodes": 9'), F.lit("}}"),
    )
    return table(spark, sf, "customer").select("c_custkey", F.array_join(problems(text, RunConfig), "; ").alias("problems"))
