"""Rows of statements from lines of text: carried context, wrapped and empty cells, and what each kind must fulfil."""

import datetime as dt
from decimal import Decimal as D

from quillstone.sources import rows as sr

HEAD = "|".join([sr.DATE, sr.BUSINESS, sr.CODE, sr.NAME, sr.QUANTITY, sr.PRICE, sr.AMOUNT, *sr.FEES, *sr.STOCK_FEES, sr.BALANCE])
CONNECT = "|".join([sr.DATE, sr.BUSINESS, sr.CODE, sr.NAME, sr.QUANTITY, sr.PRICE, sr.RATE, sr.AMOUNT, *sr.FEES, *sr.CONNECT_FEES])


def read(spark, *texts, file=1):
    df = spark.createDataFrame([(file, i, t) for i, t in enumerate(texts)], "file int, n int, text string").repartition(3)
    return sr.statement_rows(df).orderBy("row").collect()


def flows(spark, *texts):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "file int, n int, text string")
    return sr.flow_rows(sr.statement_rows(df)).orderBy("row").collect()


def test_context_is_carried(spark):
    got = read(
        spark, "﻿资金账号： 123", "20250101|证券买入|before any title", HEAD, sr.ROWS_TITLE, "20250101|证券买入|before any header", HEAD, "2025/01/02|证券买入|600519|贵州|||||||", "|||茅台|1|2", "||||||-2|0|0|0|--",
        "资金账号：456", "查询区间：2025/01/01-2025/02/01", "20250103|证券卖出|1", "", "note", "|tail", HEAD, "|nothing open", "20250104|x", sr.OTHER_TITLES[0], "20250105|证券买入|600519", sr.ROWS_TITLE, "20250106|x", CONNECT, "20250107|港股通买入|00700|a|1|2|3|4|5|6|7|8|9|10|11|12",
    )
    assert [(r.row, r.account, r.warning) for r in got] == [(6, "123", None), (11, "456", None), (17, "456", None), (23, "456", "more cells than columns")]
    assert got[0].cells == ["2025/01/02", "证券买入", "600519", "贵州茅台", "1", "2", "-2", "0", "0", "0", "--"] and got[0].first_day is None
    assert got[1].cells[:3] == ["20250103", "证券卖出tail", "1"] and got[1].last_day == dt.date(2025, 2, 1)
    assert len(got[3].columns) == 15 and got[3].cells[6] == "3"


def test_files_don_t_meet(spark):
    df = spark.createDataFrame([(1, 1, "资金账号：1"), (1, 2, sr.ROWS_TITLE), (1, 3, HEAD), (2, 1, "20250101|证券买入|600519"), (3, 1, None)], "file int, n int, text string")
    assert sr.statement_rows(df).isEmpty() and sr.statement_rows(df.limit(0)).isEmpty()


def test_rows_are_put_together_without_an_aggregation(spark):
    """Lines of a row stand beside each other in the file's order; an aggregation of texts falls back to sorting its buffers."""
    df = spark.createDataFrame([(1, 1, sr.ROWS_TITLE)], "file int, n int, text string")
    assert "Aggregate" not in sr.statement_rows(df)._jdf.queryExecution().toString()


def test_what_rows_must_fulfil(spark):
    stock = [
        ("证券买入|600519|a|1,000|2.50|-2,505.00|5|0|0|--", "BUY", None, None),
        ("证券买入|600519|a|1000|2.50|-2,509.99|5|0|0|100", "BUY", None, None),  # the price shows two digits: five either way
        ("证券买入|600519|a|1000|2.50|-2510.03|5|0|0|--", "BUY", None, "amount apart"),
        ("证券买入|600519|a|1000|2.500|-2506.00|5|0|0|--", "BUY", None, "amount apart"),
        ("证券卖出|600519|a|0|2.5|0|0|0|0|--", "SELL", "invalid", "quantity or price"),
        ("证券卖出|00700|a|1|2.5|2.5|0|0|0|--", "SELL", "conflict", "conflict"),
        ("证券卖出|TSLA|a|1|2.5|99|0|0|0|--", "SELL", "unsupported", None),
        ("红利入账|600519|a|0|0|5|0|0|0|--", "DIVIDEND", None, None),
        ("红利入账|600519|a|0|0|-5|0|0|0|--", "DIVIDEND", "invalid", "dividend not above zero"),
        ("股息红利差异扣税|600519|a|0|0|5|0|0|0|--", "TAX", "invalid", "tax not below zero"),
        ("银行转存||a|0|0|5|0|0|0|--", None, "unsupported", None),
        ("港股通组合费||a|0|0|5|0|0|0|--", "FEE", "conflict", "conflict"),
        ("|600519|a|1|1|1|0|0|0|--", None, None, "no business"),
        ("证券买入|600519|a|1||-1|0||0|--", "BUY", None, "no number: 成交价格, 印花税"),
        ("证券买入|600519|a|1|1e3|-1|0|0|0|--", "BUY", None, "no number: 成交价格"),
        ("证券买入|600519|a|1|1|-1|0|0|0|lots", "BUY", None, "no balance"),
        ("证券买入|600519|a|1|1|-1|-1|1|0|--", "BUY", None, "negative fees"),
    ]
    got = flows(spark, sr.ROWS_TITLE, HEAD, *[f"20250101|{t}" for t, *_ in stock])
    assert [(r.kind, r.skip, r.error) for r in got] == [tuple(x[1:]) for x in stock]
    assert got[0].quantity == D(1000) and got[0].fees == D(5) and got[0].day == dt.date(2025, 1, 1) and got[0].statement == "stock"
    connect = [("港股通买入|00700|a|10|3.00|0.92|-30.04|0|0|0|0|0|0|0", None), ("港股通买入|00700|a|10|3.00|0.92|-30.06|0|0|0|0|0|0|0", "unit price apart"), ("港股通买入|00700|a|10|3.00|0|-30|0|0|0|0|0|0|0", "rate"), ("港股通组合费||a|0|0|0.92|-1|0|0|0|0|0|0|0", "fee not above zero"), ("港股通买入|600519|a|10|3.00|0.92|-30|0|0|0|0|0|0|0", "conflict")]
    got = flows(spark, sr.ROWS_TITLE, CONNECT, *[f"20250101|{t}" for t, _ in connect])
    assert [r.error for r in got] == [e for _, e in connect] and {r.statement for r in got} == {"hk_connect"}
