"""The life of alerts: by hand, and a stream over shuffled files with a restart against the batch."""

from datetime import datetime, timedelta

import pytest

from quillstone.plans.alerts import checks_of
from quillstone.plans.star import table
from quillstone.streaming import alerts as al
from quillstone.streaming.windows import read_events

CHECK = "key string, at timestamp, check_id long, severity string, delivered boolean, state string, rank int"
T0 = datetime(2024, 3, 1)


def lives(spark, checks):
    rows = [(key, None if h is None else T0 + timedelta(hours=h), i, severity, ok, "x", 9) for i, (key, h, severity, ok) in enumerate(checks)]
    got = al.transitions(spark.createDataFrame(rows, CHECK)).orderBy("check_id").collect()
    return [(r["check_id"], r["action"], r["sent"], r["severity"], r["notify_count"]) for r in got]


def test_new_remind_escalate_resolve(spark):
    got = lives(spark, [("a", 0, "warning", True), ("a", 1, "warning", True), ("a", 23.9, "warning", True), ("a", 24, "warning", True), ("a", 25, "critical", True), ("a", 26, None, True), ("a", 27, None, True), ("a", 28, "info", True), ("a", 29, None, True)])
    assert got == [
        (0, "new", True, "warning", 1), (1, "update", False, "warning", 1), (2, "update", False, "warning", 1), (3, "remind", True, "warning", 2), (4, "escalate", True, "critical", 3),
        (5, "resolve", True, "critical", 3), (7, "new", False, "info", 0), (8, "resolve", False, "info", 0),
    ]


def test_sendings_that_fail_are_tried_again(spark):
    got = lives(spark, [("a", 0, "warning", False), ("a", 1, "warning", True), ("a", 2, "critical", False), ("a", 3, "critical", True), ("a", 4, None, False), ("a", 5, None, False), ("a", 6, None, True), ("a", 7, None, True)])
    assert got == [(0, "new", False, "warning", 0), (1, "remind", True, "warning", 1), (2, "escalate", False, "critical", 1), (3, "escalate", True, "critical", 2), (4, "resolve", False, "critical", 2), (5, "recover", False, "critical", 2), (6, "recover", True, "critical", 2)]
    # A day later nobody wants to hear of it.
    assert [r[1] for r in lives(spark, [("a", 0, "warning", True), ("a", 1, None, False), ("a", 25, None, False), ("a", 25.1, None, True)])] == ["new", "resolve", "recover"]


def test_a_silent_fall_and_the_next_rise(spark):
    got = lives(spark, [("a", 0, "critical", True), ("a", 1, "warning", True), ("a", 2, "critical", True)])
    assert [(r[1], r[2]) for r in got] == [("new", True), ("update", False), ("escalate", True)]


def test_order_nulls_and_keys(spark):
    mixed = [("b", 5, None, True), ("a", 3, "warning", None), (None, 1, "critical", True), ("b", 4, "critical", True), ("a", None, "critical", True), ("a", 3, "odd", True)]
    assert lives(spark, mixed) == [(0, "resolve", True, "critical", 1), (1, "new", False, "warning", 0), (3, "new", True, "critical", 1), (5, "resolve", False, "warning", 0)]
    assert lives(spark, []) == []


def test_a_key_longer_than_an_arrow_batch(spark):
    """State is carried from batch to batch: one reminder a day over 30,000 checks of one key, and two alerts of another."""
    n = 30_000
    long = spark.range(n).selectExpr("'long' AS key", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS at", "id AS check_id", "'warning' AS severity", "true AS delivered")
    got = {(r["key"], r["action"]): r["count"] for r in al.transitions(long).groupBy("key", "action").count().collect()}
    days = (n - 1) // (24 * 60)
    assert got == {("long", "new"): 1, ("long", "remind"): days, ("long", "update"): n - 1 - days}


@pytest.mark.parametrize("parts", [6])
def test_stream_equals_batch_after_a_restart(spark, sf_dir, tmp_path, parts):
    events = table(spark, sf_dir, "events").selectExpr("user_id % 7 AS user_id", "event_id", "CAST(ts AS timestamp) AS ts", "event_type").toPandas().sort_values("ts")
    schema = "user_id long, event_id long, ts timestamp, event_type string"
    folder, size = tmp_path / "in", -(-len(events) // parts)
    cut = [events.iloc[i * size : (i + 1) * size] for i in range(parts)]
    end = events.iloc[:1].assign(user_id=-1, event_id=-1, ts=events["ts"].max() + timedelta(days=400), event_type="view")
    want = sorted(map(tuple, al.transitions(checks_of(spark.createDataFrame(events, schema))).collect()), key=str)

    def put(frame):
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = al.transitions(checks_of(read_events(spark, str(folder), checks.schema, 1)), late="25 days")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert not query.isActive

    checks = spark.createDataFrame([], schema)
    # Neighbouring files come the wrong way round; after half of them the query stops and starts again from its checkpoint.
    for i in (1, 0, 3):
        put(cut[i].sample(frac=1, random_state=i))
    run()
    for i in (2, 5, 4):
        put(cut[i].sample(frac=1, random_state=i))
    run()
    put(end)
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want
