"""Statement files written from the ledger's lines and read back, and the SQL that knows what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import settlement as st
from ..operators.asof import asof
from ..sources import rows as sr
from .star import table

#: Fields of a row over file k, line j and supplier s, that Spark and SQL read alike.
_NAMES = ["证券买入", "证券卖出", "港股通买入", "港股通卖出", "红利入账", "股息红利差异扣税", "港股通组合费", "银行转存"]
_ROW = {
    "connect": "k % 3 = 0",
    "b": "(k + j) % 8",
    "code": "CASE WHEN (k + s) % 10 = 0 THEN 'X1' WHEN (k % 3 = 0) = ((k + j + s) % 12 > 0) THEN '00700' ELSE '600519' END",
    "q": "CASE WHEN s % 23 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(j * 1000 + k % 7 AS DECIMAL(18,2)) END",
    "p": "CAST(1 + s % 50 AS DECIMAL(18,2)) + CAST(0.25 AS DECIMAL(4,2))",
    "fee": "CASE WHEN s % 19 = 0 THEN CAST(-1 AS DECIMAL(18,2)) ELSE CAST(1 + j AS DECIMAL(18,2)) END",
}
_AMOUNT = """CASE WHEN connect THEN CASE WHEN b IN (0, 2) THEN -1 WHEN b = 5 THEN CASE WHEN s % 5 = 0 THEN 1 ELSE -1 END ELSE 1 END * q * (p + CASE WHEN s % 13 = 0 THEN CAST(0.5 AS DECIMAL(4,2)) ELSE CAST(0 AS DECIMAL(4,2)) END)
    ELSE CASE b WHEN 0 THEN -(q * p + fee) WHEN 2 THEN -(q * p + fee) WHEN 5 THEN CASE WHEN s % 5 = 0 THEN q ELSE -q END WHEN 4 THEN q WHEN 6 THEN q ELSE q * p - fee END + CASE WHEN s % 13 = 0 THEN CAST(9000 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END END"""
_EMPTY, _NO_BUSINESS = "s % 17 = 0", "s % 29 = 0"


def written(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("j"), F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("day"))
    for name, e in _ROW.items():
        x = x.withColumn(name, F.expr(e))
    return x.withColumn("amount", F.expr(_AMOUNT).cast("decimal(28,4)")).withColumn("name", F.concat(F.lit("股"), "s"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text: heads, headers, rows, wrapped names, and a table below another title."""
    x = written(spark, d)
    number = lambda c: F.format_number(c, 2)
    business = F.when(F.expr(_NO_BUSINESS), "").otherwise(F.get(F.array(*[F.lit(n) for n in _NAMES]), F.col("b").cast("int")))
    fee = F.when(F.expr(_EMPTY), "").otherwise(number("fee"))
    wrapped = (F.col("k") + F.col("j")) % 4 == 0
    name = F.when(wrapped, "股").otherwise(F.col("name"))
    dated = F.when(F.col("k") % 2 == 0, F.date_format("day", "yyyy/MM/dd")).otherwise(F.date_format("day", "yyyyMMdd"))
    stock = F.concat_ws("|", dated, business, "code", name, number("q"), F.col("p").cast("string"), F.col("amount").cast("string"), fee, F.lit("0.00"), F.lit("0.00"), F.when(F.col("s") % 31 == 0, "n/a").otherwise("--"))
    connect = F.concat_ws("|", dated, business, "code", name, number("q"), F.col("p").cast("string"), F.lit("0.92"), F.col("amount").cast("string"), fee, *[F.lit("0")] * 6)
    row = F.struct((F.col("j") * 10).alias("n"), F.when(F.col("connect"), connect).otherwise(stock).alias("text"))
    rest = F.struct((F.col("j") * 10 + 1).alias("n"), F.concat(F.lit("|||"), F.substring("name", 2, 20), F.lit("|||||||")).alias("text"))
    body = x.select(F.col("k").alias("file"), F.inline(F.when(wrapped, F.array(row, rest)).otherwise(F.array(row))))
    columns = lambda names: F.lit("|".join(names))
    head = [sr.DATE, sr.BUSINESS, sr.CODE, sr.NAME, sr.QUANTITY, sr.PRICE]
    header = F.when(F.col("k") % 3 == 0, columns([*head, sr.RATE, sr.AMOUNT, *sr.FEES, *sr.CONNECT_FEES])).otherwise(columns([*head, sr.AMOUNT, *sr.FEES, *sr.STOCK_FEES, sr.BALANCE]))
    texts = [F.concat(F.lit(f"{sr.ACCOUNT_LABEL}： 6"), F.col("k") % 1000), F.lit(f"{sr.PERIOD_LABEL}：1995/01/01 - 2001/12/31"), F.lit("姓名|单位"), F.lit(sr.ROWS_TITLE), F.lit("合计|1"), header]
    frame = x.select("k").distinct()
    tops = F.array(*[F.struct(F.lit(i).alias("n"), t.alias("text")) for i, t in enumerate(texts)])
    tails = F.array(*[F.struct(F.lit(1_000_000 + i).alias("n"), t.alias("text")) for i, t in enumerate([F.lit(sr.OTHER_TITLES[1]), header, F.lit("20000101|证券买入|600519|x|1|1|1|0|0|0|--")])])
    ends = frame.select(F.col("k").alias("file"), F.inline(F.concat(tops, tails)))
    return body.unionByName(ends)


def statement_flows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every statement: its fields, what it is booked as, or why it isn't."""
    f = sr.flow_rows(sr.statement_rows(lines(spark, d)))
    plain = lambda c: F.round(c, 4).cast("double").alias(c)
    return f.select("file", (F.col("row") / 10).cast("int").alias("line"), "account", "statement", F.col("day").cast("string").alias("day"), "business", "code", "name", plain("quantity"), plain("price"), plain("amount"), plain("fees"), "kind", "skip", "error")


def statement_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rows by statement, kind, reason and fault."""
    f = sr.flow_rows(sr.statement_rows(lines(spark, d)))
    return f.groupBy("statement", "kind", "skip", "error").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def settled_trades(spark: SparkSession, d: str) -> DataFrame:
    """Booked trades of the statements in the currency they settle in, by statement and side."""
    f = sr.flow_rows(sr.statement_rows(lines(spark, d))).where("error IS NULL AND skip IS NULL AND kind IN ('BUY', 'SELL')")
    connect = F.col("statement") == "hk_connect"
    rate = F.when(F.col("file") % 2 == 0, F.lit("0.92").cast("decimal(10,4)"))
    price = st.settled_price(connect, F.col("price"), F.col("amount"), F.col("quantity"), rate)
    flow = st.settlement_flow(F.when(connect, "gross").otherwise("net"), F.col("amount"), F.col("fees"), F.col("kind") == "BUY")
    return f.groupBy("statement", "kind").agg(F.count("*").alias("n"), F.count(price).alias("priced"), F.round(F.sum(price.cast("decimal(28,8)")), 3).cast("double").alias("prices"), F.round(F.sum(flow), 2).cast("double").alias("flow"))


def trading_days(spark: SparkSession, d: str) -> DataFrame:
    """Each day's last completed trading day: a calendar that ends early, else weekdays; and events of the night's hours."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.lit("X").alias("market"), "ts")
    calendar = e.where("dayofmonth(day) < 20 AND weekday(day) < 5 AND dayofmonth(day) % 5 > 0").select("market", F.date_add("day", 1).alias("from"), F.col("day").alias("opened")).distinct()
    days = e.groupBy("market", "day").agg(F.count_if(st.hours_open(F.col("ts"), "Asia/Shanghai", 2, 6)).alias("night"))
    r = asof(days, calendar, [("market", "market")], "day", "from", ["opened"])
    known = F.when(F.datediff("day", "opened") <= 20, F.col("opened"))
    return r.select(F.col("day").cast("string").alias("day"), st.last_trading_day(F.col("day"), F.when(F.dayofmonth("day") <= 22, known)).cast("string").alias("last"), "night")


QUERIES = {"statement_flows": statement_flows, "statement_errors": statement_errors, "settled_trades": settled_trades, "trading_days": trading_days}

_KNOWN = f"""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS j, l_suppkey AS s, CAST(l_shipdate AS DATE) AS day FROM lineitem),
 a AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _ROW.items())} FROM l),
 w AS (SELECT *, CAST({_AMOUNT} AS DECIMAL(28,4)) AS amount, CASE WHEN {_NO_BUSINESS} THEN '' ELSE {_NAMES}[b + 1] END AS business FROM a),
 t AS (SELECT *, business <> '' AND b < 4 AS trade, CASE WHEN business = '' OR b = 7 THEN 'unsupported' WHEN b = 6 THEN CASE WHEN NOT connect THEN 'conflict' END WHEN code = 'X1' THEN 'unsupported' WHEN connect <> (code = '00700') THEN 'conflict' END AS reason FROM w),
 e AS (SELECT *, trade AND reason IS NULL AS booked, CASE WHEN business = '' THEN 'no business' WHEN {_EMPTY} THEN 'no number: 手续费' WHEN NOT connect AND s % 31 = 0 THEN 'no balance' WHEN fee < 0 THEN 'negative fees' END AS early FROM t),
 i AS (SELECT *, CASE WHEN booked AND q <= 0 THEN 'quantity or price' WHEN business <> '' AND b = 4 AND amount <= 0 THEN 'dividend not above zero' WHEN business <> '' AND b = 5 AND amount >= 0 THEN 'tax not below zero' WHEN business <> '' AND b = 6 AND amount <= 0 THEN 'fee not above zero' END AS invalid,
   CASE WHEN booked AND NOT connect AND abs(amount - CASE WHEN b IN (0, 2) THEN -(q * p + fee) ELSE q * p - fee END) > q * 0.005 + 0.02 THEN 'amount apart' WHEN booked AND connect AND abs(abs(amount) / q - p) > 0.005 THEN 'unit price apart' END AS apart FROM e),
 f AS (SELECT k AS file, CAST(j AS INTEGER) AS line, concat('6', k % 1000) AS account, CASE WHEN connect THEN 'hk_connect' ELSE 'stock' END AS statement, CAST(day AS VARCHAR) AS day, business, code, concat('股', s) AS name, CAST(q AS DOUBLE) AS quantity, CAST(p AS DOUBLE) AS price, CAST(amount AS DOUBLE) AS amount, CAST(CASE WHEN {_EMPTY} THEN 0 ELSE fee END AS DOUBLE) AS fees,
   CASE WHEN business = '' THEN NULL WHEN b IN (0, 2) THEN 'BUY' WHEN b IN (1, 3) THEN 'SELL' WHEN b = 4 THEN 'DIVIDEND' WHEN b = 5 THEN 'TAX' WHEN b = 6 THEN 'FEE' END AS kind, CASE WHEN early IS NULL THEN CASE WHEN invalid IS NOT NULL THEN 'invalid' ELSE reason END END AS skip, coalesce(early, invalid, apart, CASE WHEN reason = 'conflict' THEN 'conflict' END) AS error FROM i)"""
ORACLE = {
    "statement_flows": _KNOWN + " SELECT * FROM f",
    "settled_trades": _KNOWN + """ SELECT statement, kind, count(*) AS n, count(px) AS priced, ROUND(SUM(px), 3) AS prices, CAST(ROUND(CAST(SUM(flow) AS DECIMAL(28,4)), 2) AS DOUBLE) AS flow
      FROM (SELECT *, CASE WHEN statement = 'stock' THEN price WHEN file % 2 = 0 THEN abs(amount) / quantity / 0.92::DOUBLE END AS px, CASE WHEN statement = 'stock' THEN amount WHEN kind = 'BUY' THEN -(abs(amount) + fees) ELSE abs(amount) - fees END AS flow FROM f WHERE error IS NULL AND skip IS NULL AND kind IN ('BUY', 'SELL')) GROUP BY 1, 2""",
    "trading_days": """WITH e AS (SELECT CAST(ts AS DATE) AS day, ts FROM events), c AS (SELECT DISTINCT day AS opened FROM e WHERE day(day) < 20 AND isodow(day) < 6 AND day(day) % 5 > 0),
      g AS (SELECT day, count(*) FILTER (hour(ts + INTERVAL 8 HOUR) BETWEEN 2 AND 5) AS night FROM e GROUP BY 1)
      SELECT CAST(day AS VARCHAR) AS day, CAST(coalesce(CASE WHEN day(day) <= 22 THEN (SELECT max(opened) FROM c WHERE opened < g.day AND g.day - opened <= 20) END, day - CASE isodow(day) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END) AS VARCHAR) AS last, night FROM g""",
    "statement_errors": _KNOWN + " SELECT statement, kind, skip, error, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY ALL",
}
