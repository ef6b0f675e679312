"""Feeds, statement files and write policies on small payloads made here."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.functions import scalars as sc
from quillstone.sources import feeds, statements, writes


def raw(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p), "S") for p in payloads] + [(None, "S"), ("{broken", "S")], "payload string, symbol string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


D = dt.date(2026, 9, 28)


def test_central_parity_and_interbank(spark):
    good = {"head": {"rep_code": "200"}, "data": {"searchlist": ["HKD/CNY", "USD/CNY"]}, "records": [{"date": "2026-09-28", "values": ["0.91", "7.1"]}, {"date": "2026-09-29", "values": ["---", "7.2"]}, {"date": "x", "values": ["1", "1"]}]}
    bad = {"head": {"rep_code": "500"}, "records": [{"date": "2026-09-28", "values": ["9"]}]}
    got = rows(feeds.central_parity(raw(spark, good, bad), {"USD/CNY": "USD", "HKD/CNY": "HKD"}))
    assert got == [("HKD", D, Decimal("0.91")), ("USD", D, Decimal("7.1")), ("USD", dt.date(2026, 9, 29), Decimal("7.2"))]
    assert feeds.rejected(raw(spark, good, bad), feeds.PARITY).count() == 3
    shibor = {"head": {"rep_code": "200"}, "records": [{"showDateCN": "2026-09-28", "3M": "1.43", "1W": "1.4"}, {"showDateCN": "2026-09-29", "3M": "---"}]}
    assert rows(feeds.interbank_rates(raw(spark, shibor))) == [(D, Decimal("1.43"))]


def test_bill_rates(spark):
    feed = '<feed><entry><m:properties><d:INDEX_DATE m:type="t">2026-09-28T00:00:00</d:INDEX_DATE><d:R13>4.01</d:R13></m:properties></entry><entry><m:properties><d:INDEX_DATE>2026-09-29</d:INDEX_DATE><d:R13 m:null="true"/></m:properties></entry></feed>'
    assert rows(feeds.bill_rates(raw(spark, feed), "R13")) == [(D, Decimal("4.01"))]


def test_daily_bars(spark):
    bars = [{"date": "2026-09-28T00:00:00Z", "close": 2.0, "open": 1.5, "volume": 3}, {"date": "2026-09-28", "close": 2.5}, {"date": "2026-09-29", "close": None}, {"date": "2026-09-30", "close": 0}]
    got = feeds.daily_bars(raw(spark, bars)).collect()
    assert [(r.symbol, r.d, r.close, r.open) for r in got] == [("S", D, Decimal("2.5"), None)]


def test_filings_and_notices(spark):
    filings = {"cik": "1", "filings": {"recent": {"accessionNumber": ["a", "b"], "filingDate": ["2026-09-28", ""], "reportDate": ["2026-06-30", ""], "form": ["10-Q", "8-K"], "items": ["", "2.02"], "primaryDocument": ["x", "y"]}}}
    assert sorted(feeds.filings(raw(spark, filings)).collect(), key=lambda r: r.accession) == [("1", "a", D, dt.date(2026, 6, 30), "10-Q", None, "x"), ("1", "b", None, None, "8-K", "2.02", "y")]
    notice = [{"NEWS_ID": "7", "DATE_TIME": "28/09/2026 18:01", "TITLE": "t", "LONG_TEXT": "t - [a &#x2f; b]", "FILE_LINK": "/f", "STOCK_CODE": "00700<br/>80700"}]
    r = feeds.notices(raw(spark, notice)).first()
    assert (r.id, r.at, r.category, r.code) == ("7", dt.datetime(2026, 9, 28, 18, 1), "a / b", "00700")


def test_quotes_and_windows(spark):
    line = 'v="1~Name~600519~1500.5~1490~' + "~" * 24 + '~20260928"'
    assert feeds.quote_fields(raw(spark, line), time_at=30).first().price == Decimal("1500.5")
    df = spark.createDataFrame([(dt.date(2025, 1, 1), dt.date(2025, 1, 10)), (dt.date(2025, 2, 2), dt.date(2025, 2, 1))], "a date, b date")
    got = rows(feeds.date_windows(df, "a", "b", 4).select("window_start", "window_end"))
    assert got == [(dt.date(2025, 1, 1), dt.date(2025, 1, 4)), (dt.date(2025, 1, 5), dt.date(2025, 1, 8)), (dt.date(2025, 1, 9), dt.date(2025, 1, 10))]


def test_standard_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿symbol,market,transaction_type,quantity,price,transaction_date,fee\n00700,HK,buy,"1,000",10.5,2025-01-02,\n600519.0,A,SELL,0,x,never,1\n', encoding="utf-8")
    got = statements.trades(statements.read_csv(spark, str(tmp_path / "t.csv"))).orderBy("symbol").collect()
    assert (got[0].symbol, got[0].transaction_type, got[0].quantity, got[0].fee, got[0].currency, got[0].errors) == ("00700", "BUY", Decimal("1000"), Decimal("0"), "CNY", [])
    assert got[1].symbol == "600519" and got[1].errors == ["quantity isn't positive", "no price", "no date"]
    with pytest.raises(ValueError, match="price"):
        statements.trades(spark.createDataFrame([("A",)], "symbol string"))
    a = statements.actions(spark.createDataFrame([("A", "US", "split", "2025-04-15", "2")], "symbol string, market string, action_type string, ex_date string, split_ratio string")).first()
    assert (a.action_type, a.ex_date, a.split_ratio, a.receipt_confirmed, a.errors) == ("SPLIT", dt.date(2025, 4, 15), Decimal("2"), False, [])


def test_sections(spark):
    lines = ["Statement,Header,Field", "Trades,Header,Date,Symbol", 'Trades,Data,2025-01-02,"A,B"', "Trades,Header,Symbol,Date", "Trades,Data,C,2025-01-03", "Cash,Data,1"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, value string")
    got = statements.sections(df, "Trades").orderBy("line").collect()
    assert [(r.cells[2:], r.header[2:]) for r in got] == [(["2025-01-02", "A,B"], ["Date", "Symbol"]), (["C", "2025-01-03"], ["Symbol", "Date"])]


def test_sections_keep_empty_cells(spark):
    """A cell that is empty moves none of those behind it; lines may be of any width."""
    wide = ",".join(f"H{i}" for i in range(60))
    lines = ["T,Header,A,B,C", "T,Data,1,,3", 'T,Data,"x, y",,', f"T,Header,{wide}", "T,Data," + ",".join(str(i) for i in range(60)), "U,Data,9"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line int, value string")
    got = [r["values"] for r in statements.sections(df, "T").orderBy("line").collect()]
    assert got == [{"A": "1", "B": None, "C": "3"}, {"A": "x, y", "B": None, "C": None}, {f"H{i}": str(i) for i in range(60)}]
    assert statements.sections(df, "none").isEmpty()


def test_scalars_by_hand(spark):
    """Vectors worked out by hand for the functions of cells, ratios, dates and texts."""
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [one(sc.value_class(lit(t))) for t in ("1,234.56", "73.04南银转债", "A123", "")] == ["d,ddd.dd", "dd.dd<X:4>", "<X:1>ddd", ""]
    assert [one(sc.mask_code(lit(t))) for t in ("113050", "00700", "F", "")] == ["11****", "00***", "*", ""]
    assert [one(sc.number_cell(lit(t)).cast("string")) for t in ("(1,034)", "(1,034", "–", "2.50", "")] == ["-1034.00000000", None, None, "2.50000000", None]
    assert [one(sc.market_of(lit(s), lit(c), lit(h))) for s, c, h in (("200725", "HKD", None), ("00700", "CNY", None), ("AAPL", "USD", None), ("600519", "CNY", "A1"), ("x", "CNY", None), ("600519", "CNY", "H1"))] == ["B股", "港股", "美股", "A股", "其他", "港股"]
    assert [one(sc.counter_currency(lit(t))) for t in ("80700", "00700", "x")] == ["CNY", None, None]
    assert [one(sc.bonus_factor(lit(r), lit(b).cast("decimal(9,2)"), lit(h).cast("decimal(9,2)")).cast("double")) for r, b, h in (("10:2", None, 5), (None, 10, 100), ("0:2", None, 5), (None, 5, 0))] == [1.2, 1.1, None, None]
    assert [one(sc.split_factor(lit(r), lit(b).cast("decimal(9,2)"), lit(h).cast("decimal(9,2)")).cast("double")) for r, b, h in (("1:2", None, 5), (None, 50, 100), ("a:b", None, 5))] == [2.0, 0.5, None]
    assert [one(sc.clean_factor(lit(x))) for x in (10.05, 0.5, 2.4, 0.0, 0.2501)] == [10.0, 0.5, None, None, 0.25]
    assert [one(sc.magnitude_off(lit(x))) for x in (1000.0, 1.0, 0.0101, -5.0, 400.0)] == [3, None, -2, None, None]
    assert [one(sc.growth(lit(a), lit(b))) for a, b in ((120.0, 100.0), (-50.0, -100.0), (5.0, -1.0), (5.0, 0.0))] == [20.0, 50.0, None, None]
    assert [str(one(sc.day(lit(t)))) for t in ("2025-01-31", "2025/1/3", "20250131", "2025.02.01 10:00", "31.01.2025")] == ["2025-01-31", "2025-01-03", "2025-01-31", "2025-02-01", "None"]
    assert [one(sc.fiscal_year(lit(t), lit(f))) for t, f in (("20251231", None), ("2026-01-03", "FY"), ("20250630", "H1"), ("bad", "FY"))] == ["2025", "2025", None, None]
    assert one(sc.squash_spaced(lit("资 产 负 债 表 a b"))) == "资产负债表 a b" and one(sc.ideograph_share(lit("资产 ab"))) == 0.5
    assert one(sc.symbol_refs(lit("$腾讯(00700)$ $x(aapl)$"), lit("/S/SH600519/31"))) == ["00700", "AAPL", "SH600519"]
    assert one(sc.ratio_text(lit(" 1：2 "))) == "1:2" and one(sc.ratio_text(lit(" "))) is None
    assert str(one(sc.quote_day(lit(None).cast("date"), lit("2026-01-03 02:00:00").cast("timestamp"), lit("America/New_York")))) == "2026-01-02"
    fee = lambda cur, net: one(sc.fee_in_price_currency(lit(10.0), lit(20.0), lit(-100.0), lit(net), lit(-1.5), lit(cur)))
    assert [fee(True, -101.0), fee(False, -101.0), fee(False, None)] == [1.0, 2.0, 3.0]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 5, None), (3, "c", None, None)], "k int, name string, n int, m string")
    new = spark.createDataFrame([(1, "", 3, "y"), (2, "b", 4, None), (4, "d", 1, None)], "k int, name string, n int, m string")
    out = writes.upsert(old, new, ["k"], {"name": "text", "n": "greatest", "m": "new"})
    got = {r.k: r for r in out.collect()}
    assert {k: (r.name, r.n, r.change) for k, r in got.items()} == {1: ("a", 3, "updated"), 2: ("b", 5, "kept"), 3: ("c", None, "kept"), 4: ("d", 1, "inserted")}
    assert [r.k for r in writes.to_insert(old, new, ["k"]).collect()] == [4]
    assert [(r.k, r.n) for r in writes.newest(old.unionByName(new).where("k = 1"), ["k"], ["n"]).collect()] == [(1, 3)]
    # U has a fresh official row, W an old one, V none.
    day = lambda n: dt.date(2026, 9, n)
    rates = [("U", 28, "bank"), ("U", 28, "other"), ("U", 29, "other"), ("V", 29, "other"), ("W", 10, "bank"), ("W", 5, "other"), ("W", 15, "other")]
    df = spark.createDataFrame([(c, day(n), s, True) for c, n, s in rates], "cur string, d date, source string, active boolean")
    left = writes.deactivate_third_party(df, ["cur"], F.col("source") == "bank", "2026-09-01", "2026-09-30", "d", 3).where("not active")
    assert sorted((r.cur, r.d.day, r.source) for r in left.collect()) == [("U", 29, "other"), ("W", 5, "other")]


def test_scalars(spark):
    df = spark.createDataFrame([(" ﻿A ", "00700.0", "700", "1,234.5"), (None, None, None, "x")], "a string, b string, c string, d string")
    got = df.select(scalars.strip_text(F.col("a")), scalars.symbol_cell(F.col("b")), scalars.manual_symbol(F.col("c"), F.lit(True)), scalars.amount(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("A", "00700", "00700", Decimal("1234.5")), ("", "", "", None)]
