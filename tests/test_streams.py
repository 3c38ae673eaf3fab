"""Stateful stream operators, the kept table and subscriptions against plain replays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.session import checkpoint_dir
from graphloom.streaming import live, replay, store
from graphloom.streaming import telemetry as TM


def batches(spark, tmp_path, schema, parts, run):
    """Each part becomes a file of the source, and the stream is started again for it."""
    source = str(tmp_path / "source")
    progress = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = run(spark.readStream.schema(schema).parquet(source))
        query.awaitTermination()
        progress.append(query.recentProgress[-1])
    return progress


def envelope(i, stage, ts, seq, n):
    return (json.dumps({"experimentId": f"e{i}", "type": "TELEMETRY", "timestamp": ts, "seq": seq, "payload": {"intermediate_stats": {stage: {"node_count": n, "edge_count": 1}}}}),)


def test_running_stats_forget_what_is_silent(spark, tmp_path):
    rng = random.Random(3)
    parts, latest = [], {}
    for b in range(5):
        rows = []
        for j in range(60):
            # experiments 10 b … 10 b + 9 are active in part b, and the first is always
            i = 0 if j % 10 == 0 else 10 * b + rng.randrange(10)
            ts, seq, n = 10_000.0 * b + rng.randrange(9_000), 100 * b + j, rng.randrange(1000)
            rows += [envelope(i, f"s{j % 2}", ts, seq, n)] * rng.choice([1, 2])
            if (ts, seq) >= latest.get((f"e{i}", f"s{j % 2}"), (0, 0))[:2]:
                latest[f"e{i}", f"s{j % 2}"] = (ts, seq, n)
        rng.shuffle(rows)
        parts.append(rows)
    path, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    progress = batches(spark, tmp_path, "value string", parts, lambda rows: TM.stats_sink(TM.parse_events(rows), path, ck, 5000.0, "1000 seconds", every=4))
    made = {(r.experiment_id, r.stage): (r.ts, r.seq, r.node_count) for r in TM.read_table(spark, path, ["experiment_id", "stage"]).collect()}
    assert made == latest
    held = [op["numRowsTotal"] for op in progress[-1]["stateOperators"] if op["operatorName"] == "applyInPandasWithState"][0]
    assert 0 < held < len(latest) / 2
    assert any(kind == "snapshot" for kind, _ in store.folders(spark, path))


def test_state_partitions_follow_the_cores(spark, tmp_path):
    name = "spark.sql.shuffle.partitions"
    before, most = spark.conf.get(name), 2 * spark.sparkContext.defaultParallelism
    spark.conf.set(name, str(most + 5))
    try:
        rows = [envelope(1, "s", 10.0, 1, 7), envelope(2, "s", 20.0, 2, 8)]
        path, ck = str(tmp_path / "table"), str(tmp_path / "ck")
        progress = batches(spark, tmp_path, "value string", [rows], lambda df: TM.stats_sink(TM.parse_events(df), path, ck))
        assert spark.conf.get(name) == str(most + 5)
    finally:
        spark.conf.set(name, before)
    assert {op["numShufflePartitions"] for op in progress[-1]["stateOperators"]} == {most}
    assert TM.read_table(spark, path, ["experiment_id", "stage"]).count() == 2


def test_running_stats_keep_stages_in_shares(spark, tmp_path):
    """One row of state and one call per share, not per stage; what is silent is forgotten stage by stage."""
    path, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    early = [envelope(i, f"s{j}", 100.0 + i, 10 * i + j, i) for i in range(20) for j in range(3)]
    late = [envelope(i, f"s{j}", 5000.0 + i, 1000 + 10 * i + j, 7) for i in range(0, 20, 4) for j in range(3)]
    # older than what is known, but not late
    late += [envelope(0, "s0", 4999.0, 2000, 1)]

    def run(rows):
        once = TM.bounded(TM.parse_events(rows), "100 seconds", ["experiment_id", "type", "seq"])
        return TM.table_sink(live.running_stats(TM.stage_events(once), 600.0, shares=4), path, ck, ["experiment_id", "stage"], "append")

    progress = batches(spark, tmp_path, "value string", [early, late], run)
    state = [op["numRowsTotal"] for op in progress[-1]["stateOperators"] if op["operatorName"] == "applyInPandasWithState"]
    assert 0 < state[0] <= 4
    want = {(f"e{i}", f"s{j}"): (5000.0 + i, 1000 + 10 * i + j) for i in range(0, 20, 4) for j in range(3)}
    assert {(r.experiment_id, r.stage): (r.ts, r.seq) for r in live.held_stages(spark, ck).collect()} == want
    made = {(r.experiment_id, r.stage): (r.ts, r.seq, r.node_count, r.depth, r.source) for r in TM.read_table(spark, path, ["experiment_id", "stage"]).collect()}
    first = {(f"e{i}", f"s{j}"): (100.0 + i, 10 * i + j, i, None, None) for i in range(20) for j in range(3)}
    assert made == first | {k: (*v, 7, None, None) for k, v in want.items()}


def test_envelopes_are_parsed_once(spark):
    text = F.concat(F.lit('{"experimentId":"e'), F.col("id").cast("string"), F.lit('","type":"LOG","timestamp":1.5,"payload":{"a":1},"seq":3}'))
    rows = TM.parse_events(spark.range(2).select(text.alias("value")).unionByName(spark.createDataFrame([(None,), ("{",), ('{"type":"LOG"}',)], "value string")))
    assert sorted(map(tuple, rows.collect())) == [(f"e{i}", "LOG", 1.5, '{"a":1}', 3) for i in range(2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("from_json(") <= 2  # one for each side of the union


def test_kept_table_is_folded_and_repeats_are_harmless(spark, tmp_path):
    path, want = f"{checkpoint_dir(spark)}/kept-{tmp_path.name}", {}
    for b in range(11):
        rows = [(k, f"{k}/{b}") for k in range(b, b + 5)]
        want |= dict(rows)
        frame = spark.createDataFrame(rows, "k int, v string")
        for _ in range(1 + (b % 3 == 2)):  # a repeated micro-batch, also of one that folds
            store.write(frame, b, path, ["k"], every=3)
        assert dict(store.read(spark, path, ["k"]).collect()) == want
    kinds = store.folders(spark, path)
    assert [n for k, n in kinds if k == "snapshot"] == [5, 8] and min(n for k, n in kinds if k == "batch") > 5
    # an unfinished folder does not count
    frame.write.parquet(f"{path}/batch-{99:012d}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-{99:012d}/_SUCCESS")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, False)
    assert dict(store.read(spark, path, ["k"]).collect()) == want


def test_status_sink(spark, tmp_path):
    parts = [[("1", "running", 1.0, 1), ("2", "running", 2.0, 2)], [("1", "success", 3.0, 3), ("1", "running", 1.5, 1)], [("2", "error", 4.0, 4)]]
    path, ck, ended = str(tmp_path / "status"), str(tmp_path / "ck"), []
    schema = "experiment_id string, status string, ts double, seq long"
    batches(spark, tmp_path, schema, parts, lambda rows: TM.status_sink(rows, path, ck, lambda df: ended.extend(r.experiment_id for r in df.collect())))
    assert {(r.experiment_id, r.status, r.refresh) for r in TM.read_table(spark, path, ["experiment_id"]).collect()} == {("1", "success", True), ("2", "error", True)}
    assert ended == ["1", "2"]


def plain_delivery(requests, events, lapse, mark):
    out = []
    for experiment, seq, at in events:
        if at >= mark:
            continue
        for client in {c for c, *_ in requests}:
            own = [(t, s, e) for c, e, s, t in requests if c == client and t <= at]
            if own:
                t, _, follows = max(own)
                if follows == experiment and at < t + lapse:
                    out.append((experiment, client, seq))
    return sorted(out)


@pytest.mark.parametrize("shares", [1, 3])
def test_subscriptions_come_and_go(spark, tmp_path, shares):
    """Requests and events of one time span, events in any order within the delay."""
    rng = random.Random(shares)
    lapse, delay, parts, requests, events = 900.0, 200, [], [], []
    seq = 0
    for b in range(4):
        rows = []
        for at in sorted(rng.randrange(1000 * b, 1000 * b + 800) for _ in range(60)):
            seq += 1
            if rng.random() < 0.4:
                requests.append((f"c{rng.randrange(6)}", rng.choice(["x", "y", None]), seq, at))
                rows.append(("r", *requests[-1]))
            else:
                events.append((rng.choice(["x", "y", "z"]), seq, at))
                rows.append(("e", None, *events[-1]))
        if b == 1:
            rows.append(rows[-1])
            events.append((rows[-1][2], rows[-1][3], rows[-1][4])) if rows[-1][0] == "e" else requests.append(rows[-1][1:])
        rng.shuffle(rows)
        parts.append(rows)
    changes, given, ck = str(tmp_path / "changes"), str(tmp_path / "given"), str(tmp_path / "ck")
    at = F.timestamp_seconds("t")

    def run(rows):
        asked = rows.where("kind = 'r'").select("client_id", "experiment_id", "seq", at.alias("at"))
        moves = live.subscription_changes(live.on_event_time(asked, f"{delay} seconds", F.col("at")), lapse)
        TM.append_sink(moves, changes, f"{ck}/1").awaitTermination()
        sent = rows.where("kind = 'e'").select("experiment_id", "seq", at.alias("at"))
        moves = spark.readStream.schema(live.CHANGE).parquet(changes)
        both = live.deliver(live.on_event_time(sent, f"{delay} seconds", F.col("at")), live.on_event_time(moves, f"{delay} seconds", F.col("at")), lapse, shares)
        return TM.append_sink(both, given, f"{ck}/2")

    batches(spark, tmp_path, "kind string, client_id string, experiment_id string, seq long, t long", parts, run)
    made = sorted(tuple(r) for r in spark.read.schema(live.DELIVERED).parquet(given).collect())
    last = spark.read.schema(live.CHANGE).parquet(changes).agg(F.max(F.unix_seconds("at"))).first()[0]
    mark = min(max(t for *_, t in events), last) - delay
    assert len(made) > 20
    assert made == plain_delivery(requests, events, lapse, mark)


def test_clients_are_kept_in_shares(spark, tmp_path):
    """One row of state per share of clients; each client is forgotten by its own last request."""
    path, ck = str(tmp_path / "changes"), str(tmp_path / "ck")
    parts = [
        [(f"c{i}", "x", i, 100 + i) for i in range(30)] + [(None, "x", 90, 100)],
        # c0 moves, c1 ends, an older request of c2 is ignored; the others lapse before they ask again
        [("c0", "y", 101, 700), ("c1", None, 102, 700), ("c2", "y", 104, 701), ("c2", "z", 103, 701), ("c29", "x", 105, 5000)],
        [("c5", "y", 106, 5000)],
    ]

    def run(rows):
        asked = live.on_event_time(rows.withColumn("at", F.timestamp_seconds("t")), "10 seconds", F.col("at"))
        return TM.append_sink(live.subscription_changes(asked, 1000.0, shares=2), path, ck)

    progress = batches(spark, tmp_path, "client_id string, experiment_id string, seq long, t long", parts, run)
    assert [op["numRowsTotal"] for op in progress[0]["stateOperators"]] == [2]
    made = {(r.experiment_id, r.client_id, r.joined, r.seq, int(r.at.timestamp())) for r in spark.read.schema(live.CHANGE).parquet(path).collect()}
    want = {("x", c, True, seq, t) for c, _, seq, t in parts[0]}
    want |= {("x", "c0", False, 101, 700), ("y", "c0", True, 101, 700), ("x", "c1", False, 102, 700), ("x", "c2", False, 103, 701), ("z", "c2", True, 103, 701)}
    want |= {("z", "c2", False, 104, 701), ("y", "c2", True, 104, 701), ("x", "c29", True, 105, 5000), ("y", "c5", True, 106, 5000)}
    assert made == want


def test_replay_hands_over_without_loss_or_repeat(spark, tmp_path):
    """Out of order within the delay, logs that only one source holds, repeats of the live source, a restart with other stored logs."""
    rng = random.Random(7)
    log = lambda i, t: (f"e{i}", t, float(t), None if t % 5 == 0 else "INFO", f"m{t}")
    logs = [log(rng.randrange(3), t) for t in range(400)] + [log(9, 395)]
    shaken = sorted(logs, key=lambda r: r[2] + rng.uniform(0, 20))
    # of the last logs before the hand-over, every third had not reached the store
    stored = [r for i, r in enumerate(shaken[:200]) if i < 170 or i % 3]
    parts = [shaken[100:220], shaken[210:300] + shaken[290:300], shaken[300:]]
    frame = lambda rows: spark.createDataFrame(rows, replay.SCHEMA)
    feed, ck, source = str(tmp_path / "feed"), str(tmp_path / "ck"), str(tmp_path / "source")
    replay.hand_over(frame(stored + stored[-3:]), feed, 60.0)
    assert sorted(map(str, replay.read_feed(spark, feed).collect())) == sorted(map(str, frame(stored).collect()))
    for n, part in enumerate(parts):
        frame(part).coalesce(1).write.mode("append").parquet(source)
        live_logs = spark.readStream.schema(replay.SCHEMA).parquet(source)
        # what is stored later does not move the hand-over
        replay.replay_sink(frame(stored + parts[n]), live_logs, feed, ck, 60.0).awaitTermination()
    made = [tuple(r) for r in replay.read_feed(spark, feed).collect()]
    assert len(made) == len(set(made)) and set(made) == set(logs)


def test_replay_without_stored_logs(spark, tmp_path):
    rows = spark.createDataFrame([("e", 1, 1.0, None, "m"), ("e", 2, 1.0, None, "m")], replay.SCHEMA)
    rows.write.parquet(str(tmp_path / "source"))
    live_logs = spark.readStream.schema(replay.SCHEMA).parquet(str(tmp_path / "source"))
    replay.replay_sink(rows.where("false"), live_logs, str(tmp_path / "feed"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.seq for r in replay.read_feed(spark, str(tmp_path / "feed")).collect()) == [1, 2]


def test_deliveries_come_in_pieces_however_many_follow():
    ready = [(0, i, live.JOINS, f"c{i}") for i in range(300)] + [(1, 300, live.LEAVES, "c0")] + [(2 + i, 301 + i, live.EVENT, None) for i in range(1000)]
    members, rows, largest = {}, 0, 0
    seen = set()
    for frame in live.in_pieces("e", ready, members, 902):
        largest, rows = max(largest, len(frame)), rows + len(frame)
        seen |= set(zip(frame["client_id"], frame["seq"]))
    # clients lapse 902 after they joined, and the first has left
    assert rows == len(seen) == 299 * 900 and len(members) == 299
    assert seen == {(f"c{c}", 301 + i) for c in range(1, 300) for i in range(900)}
    assert largest < live.PIECE + 300
