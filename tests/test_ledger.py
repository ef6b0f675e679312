"""Every ledger query against its SQL, and the replays against hand-made cases."""

import datetime as dt

import pytest
from compare import difference

from quillstone import plans
from quillstone.operators.replay import average_cost, fifo, xirr
from quillstone.streaming import windows


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(plans.queries()[name](spark, sf_dir), plans.oracle_sql()[name], sf_dir) == ""


def test_every_query_runs(spark, sf_dir):
    for name in set(plans.queries()) - set(plans.oracle_sql()):
        assert plans.queries()[name](spark, sf_dir).count() > 0, name


def _events(spark, rows):
    return spark.createDataFrame([(1, 1, n, s, q, g, f, d) for n, (s, q, g, f, d) in enumerate(rows)], "user_id int, symbol int, n int, side string, qty double, gross double, fee double, trade_date date")


def test_fifo_by_hand(spark):
    day = dt.date(2025, 1, 1)
    rows = [("BUY", 100.0, 1000.0, 5.0, day), ("SELL", 50.0, 600.0, 3.0, day), ("SELL", 80.0, 1.0, 0.0, day)]
    r = fifo(_events(spark, rows), ["user_id", "symbol"], ["trade_date", "n"]).first()
    assert r.skipped == 1 and len(r.closed) == 1
    assert r.closed[0].proceeds - r.closed[0].cost == pytest.approx(94.5)
    assert r.lots[0].cost == pytest.approx(502.5)


def test_average_cost_by_hand(spark):
    day = dt.date(2025, 1, 1)
    rows = [("BUY", 10.0, 100.0, 0.0, day), ("BUY", 10.0, 200.0, 0.0, day), ("SELL", 5.0, 100.0, 0.0, day)]
    r = average_cost(_events(spark, rows), ["user_id", "symbol"], ["trade_date", "n"]).first()
    assert (r.qty, r.avg_cost, r.total_cost) == (15.0, 15.0, 225.0)


def test_xirr_by_hand(spark):
    """A year's tenth, a rate over eight decades, and flows without a rate."""
    day = dt.date
    flows = {1: [(day(2025, 1, 1), -1000.0), (day(2026, 1, 1), 1100.0)], 2: [(day(1900, 1, 1), -1000.0), (day(1981, 1, 1), -500.0), (day(1982, 1, 1), 2000.0)], 3: [(day(2025, 1, 1), 5.0)], 4: [(day(2025, 1, 1), -5.0), (day(2025, 1, 1), 5.0)]}
    df = spark.createDataFrame([(k, d, a) for k, part in flows.items() for d, a in part], "k int, d date, amount double")
    got = {r.k: r.xirr for r in xirr(df, ["k"]).collect()}
    assert got[1] == pytest.approx(0.10, abs=2e-4) and got[2] == pytest.approx(0.0049368537, abs=1e-6) and got[3] is None and got[4] is None


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), batch.schema, 1), "1 hour", late="400 days")
    query = stream.writeStream.format("memory").queryName("tumbling_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    key = lambda r: (r.start, r.event_type)
    assert sorted(spark.table("tumbling_out").collect(), key=key) == sorted(windows.tumbling(batch, "1 hour").collect(), key=key)
