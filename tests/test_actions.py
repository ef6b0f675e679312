"""Columns and operators over actions, notices, ranges and periods by hand: nulls, ties, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillstone.functions import actions as ac
from quillstone.operators import periods as pe
from quillstone.operators import valuation as va

D = dt.date


def test_notice_wordings(spark):
    texts = ["每 股 5.3HKD", "每 10 股 3HKD", "每股 RMB0.0908", "每 股 USD 1 HKD", "每 0 股 3HKD", "有待公佈", "", None]
    got = [r[0] and (float(r[0].amount), r[0].currency) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ac.per_share(F.col("t"))).collect()]
    assert got == [(5.3, "HKD"), (0.3, "HKD"), (0.0908, "CNY"), None, None, None, None, None]


def test_options(spark):
    rows = [("PYPL  260417P00040000", None), ("883", "29JAN26 20 P"), ("POP APR26 155 P", ""), ("0700", "Tencent"), (None, None)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string, t string").select(ac.is_option(F.col("s"), F.col("t"))).collect()] == [True, True, True, False, False]


def test_close_wins(spark):
    a, b = D(2026, 1, 1), D(2026, 1, 2)
    rows = [(None, a, "feed"), (a, None, "feed"), (a, b, "feed"), (b, a, "manual"), (a, a, "manual"), (a, a, None)]
    assert [r[0] for r in spark.createDataFrame(rows, "c date, q date, s string").select(ac.close_wins(F.col("c"), F.col("q"), F.col("s"))).collect()] == [False, True, False, True, False, True]


def test_lots_and_defects(spark):
    rows = [("OPENING_POSITION", 10, 2, 20), ("OPENING_POSITION", 10, 2, 25), ("OPENING_POSITION", 0, 2, None), ("OPENING_POSITION", 10, None, None), ("RIGHTS_ISSUE", 10, None, 7), ("RIGHTS_ISSUE", 10, 3, None), ("CASH_DIVIDEND", None, None, None)]
    c = F.col
    none = F.lit(None)
    df = spark.createDataFrame(rows, "k string, q int, p int, t int").select("k", *[c(n).cast("decimal(18,4)").alias(n) for n in "qpt"])
    got = df.select(ac.action_defect(c("k"), none.cast("string"), none, none.cast("string"), none, c("q"), c("p"), c("q"), c("p"), c("t")).alias("d"), F.coalesce(ac.opening_lot(c("k"), c("q"), c("t"), c("p")), ac.rights_lot(c("k"), c("q"), c("p"), c("t"))).alias("lot")).collect()
    assert [r.d for r in got] == [None, "cost", "opening", None, "subscription", None, None]
    assert [r.lot and (r.lot.cost is not None and float(r.lot.cost)) for r in got] == [20.0, 25.0, None, False, None, 30.0, None]


def test_clamp(spark):
    rows = [(None, None), (D(2025, 1, 1), D(2025, 6, 1)), (D(2000, 1, 1), D(2001, 1, 1)), (D(2030, 1, 1), D(2031, 1, 1)), (D(2000, 1, 1), None)]
    first, last = F.lit("2024-01-01").cast("date"), F.lit("2026-01-01").cast("date")
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "s date, e date").select(va.clamp(first, last, F.col("s"), F.col("e"))).collect()]
    a, b = D(2024, 1, 1), D(2026, 1, 1)
    assert got == [(a, b, False), (D(2025, 1, 1), D(2025, 6, 1), False), (a, a, True), (b, b, True), (a, b, True)]


def test_held_by_account(spark):
    rows = [(1, 1, 1, 5.0), (1, 2, 2, 3.0), (2, 1, 1, 5.0), (2, 2, 2, -3.0), (3, None, 1, 4.0)]
    df = spark.createDataFrame(rows, "k int, a int, n int, s double")
    got = {(r.k, r.a, r.quantity, r.basis) for r in va.held_by_account(df, ["k"], "a", F.col("s"), ["n"]).collect()}
    assert got == {(1, 1, 5.0, "per_account"), (1, 2, 3.0, "per_account"), (2, None, 2.0, "merged"), (3, None, 4.0, "per_account")}
    assert va.held_by_account(df.limit(0), ["k"], "a", F.col("s"), ["n"]).count() == 0


def test_long_only(spark):
    rows = [(1, 1, "B", 5.0, False), (1, 2, "S", 9.0, True), (1, 3, "S", 9.0, False), (1, 4, "B", 2.0, False), (1, 5, "S", 2.0, True)]
    df = spark.createDataFrame(rows, "k int, n int, side string, q double, f boolean")
    assert tuple(pe.long_only(df, ["k"], ["n"], F.col("side") == "B", F.col("q"), F.col("f")).first()) == (1, 0.0, 1)


def test_implemented(spark):
    day = D(2025, 7, 1)
    rows = [(1, D(2024, 12, 31), day, day, day, 1.0, None), (1, D(2025, 6, 30), day, day, day, 1.0, 0.0), (2, D(2024, 12, 31), day, day, day, 1.0, None), (2, D(2024, 12, 31), day, D(2025, 8, 1), day, 2.0, None), (3, D(2024, 12, 31), None, None, None, None, None), (3, D(2025, 12, 31), None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, end date, ex date, announced date, noticed date, amount double, stock double")
    got = sorted((r.k, r.end, r.amount, r.conflict, r.ends) for r in va.implemented(df, ["k"]).select("k", "end", F.coalesce("amount", F.lit(-1.0)).alias("amount"), "conflict", "ends").collect())
    assert got == [(1, D(2025, 6, 30), 1.0, False, 2), (2, D(2024, 12, 31), 2.0, True, 1), (3, D(2024, 12, 31), -1.0, False, 1), (3, D(2025, 12, 31), -1.0, False, 1)]


def test_settlement_and_trading_days(spark):
    from quillstone.functions import settlement as st

    rows = [(True, 5.0, -92.0, 10.0, 0.92), (True, 5.0, -92.0, 10.0, None), (True, 5.0, -92.0, 0.0, 0.92), (False, 5.0, 1.0, 0.0, None), (None, 5.0, 1.0, 1.0, 1.0)]
    c = F.col
    got = spark.createDataFrame(rows, "k boolean, p double, a double, q double, r double").select(st.settled_price(c("k"), c("p"), c("a"), c("q"), c("r")).alias("x")).collect()
    assert [r.x and round(r.x, 9) for r in got] == [10.0, None, None, 5.0, 5.0]
    rows = [("net", -5.0, 1.0, True), ("gross", 5.0, 1.0, True), ("gross", -5.0, 1.0, False), ("gross", 5.0, None, True), ("other", 5.0, 1.0, True), (None, 5.0, 1.0, True)]
    got = spark.createDataFrame(rows, "b string, a double, f double, buys boolean").select(st.settlement_flow(c("b"), c("a"), c("f"), c("buys")).alias("x")).collect()
    assert [r.x for r in got] == [-5.0, -6.0, 4.0, -5.0, None, None]
    rows = [(D(2026, 1, 5), None), (D(2026, 1, 4), None), (D(2026, 1, 3), None), (D(2026, 1, 6), D(2026, 1, 2)), (D(2026, 1, 6), D(2026, 1, 6))]
    got = spark.createDataFrame(rows, "d date, o date").select(st.last_trading_day(c("d"), c("o")).alias("x")).collect()
    assert [r.x for r in got] == [D(2026, 1, 2), D(2026, 1, 2), D(2026, 1, 2), D(2026, 1, 2), D(2026, 1, 5)]
    assert spark.sql("SELECT timestamp'2026-01-01 18:30:00' AS t").select(st.hours_open(c("t"), "Asia/Shanghai", 2, 6)).first()[0]
