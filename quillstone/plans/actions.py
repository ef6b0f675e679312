"""Corporate actions, statement rows and dividend notices made from the tables, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions as ac
from .star import dbl, table

#: Fields of an action, each an expression over the order's key k and its date ex that Spark and SQL read alike.
_FIELDS = {
    "kind": "CASE k % 6 WHEN 0 THEN 'CASH_DIVIDEND' WHEN 1 THEN 'BONUS_ISSUE' WHEN 2 THEN 'STOCK_SPLIT' WHEN 3 THEN 'RIGHTS_ISSUE' WHEN 4 THEN 'OPENING_POSITION' ELSE 'STOCK_DIVIDEND' END",
    "status": "CASE WHEN k % 7 = 0 THEN 'UNVERIFIED' WHEN k % 7 < 4 THEN 'RECEIVED' END",
    "basis": "CASE WHEN k % 5 = 0 THEN 'NET_ONLY' WHEN k % 5 = 1 THEN 'GROSS' END",
    "ratio": "CASE k % 5 WHEN 0 THEN concat('10：', CAST(k % 9 AS VARCHAR(9))) WHEN 1 THEN '10/3' WHEN 2 THEN concat('10 : ', CAST(k % 9 + 1 AS VARCHAR(9))) WHEN 3 THEN '' END",
    "shares": "CASE WHEN k % 7 > 1 THEN CAST(k % 11 AS DECIMAL(18,4)) END",
    "quantity": "CASE WHEN k % 9 > 0 THEN CAST(k % 8 AS DECIMAL(18,4)) END",
    "price": "CASE WHEN k % 7 > 0 THEN CAST(k % 13 AS DECIMAL(18,4)) END",
    "paid_total": "CASE WHEN k % 11 > 3 THEN CAST((k % 8) * (k % 13 + (CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END)) AS DECIMAL(18,4)) END",
}
_ACTIONS_SQL = "WITH o AS (SELECT o_orderkey AS k, o_custkey AS owner, CAST(o_orderdate AS DATE) AS ex FROM orders), a AS (SELECT k, owner, ex, CASE WHEN k % 3 = 0 THEN ex + 20 END AS paid, " + ", ".join(f"{e} AS {n}" for n, e in _FIELDS.items()) + " FROM o)"


def actions(spark: SparkSession, d: str) -> DataFrame:
    """One action an order; fields that a kind needs are missing or unreadable in some."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("ex"))
    return o.select("k", "owner", "ex", F.when(F.col("k") % 3 == 0, F.date_add("ex", 20)).alias("paid"), *[F.expr(e).alias(n) for n, e in _FIELDS.items()])


def _lots() -> tuple:
    kind, q = F.col("kind"), F.col("quantity")
    return ac.opening_lot(kind, q, F.col("paid_total"), F.col("price")), ac.rights_lot(kind, q, F.col("price"), F.col("paid_total"))


def action_scope(spark: SparkSession, d: str) -> DataFrame:
    """Actions of a year by kind, dividends by the day of their cash, for owners whose number holds a text."""
    a = actions(spark, d).withColumn("day", ac.scope_day(F.col("kind"), F.col("paid"), F.col("ex")))
    found = a.where(F.col("day").between("1996-01-01", "1996-12-31") & F.lower(F.concat(F.lit("C"), F.col("owner").cast("string"))).contains("c1"))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"))


def received_dividends(spark: SparkSession, d: str) -> DataFrame:
    """Dividends whose cash has come by a day, and how many of them have complete amounts, by owner's group."""
    a = actions(spark, d).where(ac.received(F.col("kind"), F.col("status"), F.col("paid"), F.col("ex"), F.lit("1997-06-30").cast("date")))
    return a.groupBy((F.col("owner") % 10).alias("owner")).agg(F.count("*").alias("n"), F.count_if(ac.amounts_complete(F.col("basis"))).alias("complete"))


def action_lots(spark: SparkSession, d: str) -> DataFrame:
    """Lots that openings and rights bring: how many, their shares and cost, and those of unknown cost."""
    opening, rights = _lots()
    a = actions(spark, d).select("kind", F.coalesce(opening, rights).alias("lot")).where("lot IS NOT NULL")
    return a.groupBy("kind").agg(F.count("*").alias("n"), dbl(F.sum("lot.quantity")).alias("shares"), dbl(F.sum("lot.cost")).alias("cost"), F.count_if(F.col("lot.cost").isNull()).alias("unknown"))


def action_defects(spark: SparkSession, d: str) -> DataFrame:
    """Actions that can't change a quantity, by kind and reason, and those that work per share."""
    c = F.col
    defect = ac.action_defect(c("kind"), c("ratio"), c("shares"), c("ratio"), c("shares"), c("quantity"), c("price"), c("quantity"), c("price"), c("paid_total"))
    return actions(spark, d).select("kind", defect.alias("defect"), ac.by_ratio(c("kind"), c("ratio"), c("ratio")).alias("by_ratio")).groupBy("kind", "defect", "by_ratio").agg(F.count("*").alias("n"))


def action_steps(spark: SparkSession, d: str) -> DataFrame:
    """What a bucket of a hundred shares holds after each action, summed by kind."""
    c = F.col
    opening, rights = _lots()
    after = ac.quantity_after(c("kind"), F.lit(100).cast("decimal(18,4)"), c("ratio"), c("shares"), c("ratio"), c("shares"), rights, opening)
    a = actions(spark, d).select("kind", F.round(after.cast("decimal(28,8)"), 4).alias("after"))
    return a.groupBy("kind").agg(dbl(F.sum("after")).alias("after"), F.count_if(c("after") != 100).alias("changed"))


def option_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and descriptions that name option contracts, by how they are written."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select((k % 6).alias("form"), F.format_string("%05d", k % 99999).alias("n"))
    code = F.when(F.col("form") == 0, F.concat(F.lit("pypl  260417p000"), "n")).when(F.col("form") == 1, F.lit("883")).when(F.col("form") == 2, F.lit("CNC JAN26")).when(F.col("form") == 3, F.lit("FXE")).otherwise(F.col("n"))
    text = F.when(F.col("form") == 1, F.concat(F.lit("29JAN26 "), "n", F.lit(" P"))).when(F.col("form") == 2, F.concat("n", F.lit(".5 C"))).when(F.col("form") == 3, F.concat(F.lit("20XXX26 "), "n", F.lit(" P"))).when(F.col("form") == 4, F.lit("ABCDEFG 20MAR26 107 P"))
    return c.select("form", ac.is_option(code, text).alias("option")).groupBy("form", "option").agg(F.count("*").alias("n"))


def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows by the reason for which they aren't booked."""
    names = F.array(*[F.lit(n) for n in [*ac.TRADE_BUSINESS, *ac.DIVIDEND_BUSINESS, ac.CONNECT_FEE, "银行转存"]])
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.when(k % 2 == 0, "stock").otherwise("hk_connect").alias("statement"), F.get(names, (F.col("o_custkey") % 9).cast("int")).alias("business"), F.repeat(F.lit("6"), (k % 3 + 4).cast("int")).alias("code"))
    return o.select("statement", "business", ac.skip_reason(F.col("statement"), F.col("business"), F.col("code")).alias("reason")).groupBy("statement", "business", "reason").agg(F.count("*").alias("n"))


def notice_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts a share and exchange rates read from the wording of notices."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    amount = F.when(k % 4 == 0, F.concat(F.lit("每 10 股 "), n, F.lit("HKD"))).when(k % 4 == 1, F.concat(F.lit("每股RMB 1,"), F.format_string("%03d", k % 1000), F.lit(".5"))).when(k % 4 == 2, F.concat(F.lit("每 股 USD "), n, F.lit(" HKD"))).otherwise(F.lit("有待公佈"))
    phrase = F.when(k % 3 == 0, F.concat(F.lit("2 RMB ： "), n, F.lit(".5HKD"))).when(k % 3 == 1, F.concat(F.lit("0 USD : "), n, F.lit("HKD")))
    s = table(spark, d, "supplier").select(k, ac.per_share(amount).alias("a"), ac.rate_phrase(phrase).alias("r"))
    return s.select("s_suppkey", dbl("a.amount").alias("amount"), F.col("a.currency").alias("currency"), F.col("r.base").alias("base"), F.col("r.quote").alias("quote"), dbl("r.rate").alias("rate"))


def literal_search(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold a text as it stands: percent signs and underscores are no patterns."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.concat("p_brand", F.when(k % 3 == 0, F.lit("_50%")).when(k % 3 == 1, F.lit("x50%")).otherwise(F.lit("_50x"))).alias("name"))
    return p.where(F.lower("name").contains("_50%")).groupBy("name").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (action_scope, received_dividends, action_lots, action_defects, action_steps, option_contracts, skip_reasons, notice_amounts, literal_search)}

#: What the ratio texts say: the base is 10 where they are readable.
_READ = "CASE k % 5 WHEN 0 THEN k % 9 WHEN 2 THEN k % 9 + 1 END"
_LOT = "CASE WHEN kind = 'OPENING_POSITION' AND quantity > 0 THEN quantity WHEN kind = 'RIGHTS_ISSUE' AND quantity <> 0 AND price <> 0 THEN quantity END"
ORACLE = {
    "action_scope": _ACTIONS_SQL + """, s AS (SELECT *, CASE WHEN kind = 'CASH_DIVIDEND' AND paid IS NOT NULL THEN paid ELSE ex END AS day FROM a)
        SELECT kind, count(*) AS n, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM s WHERE year(day) = 1996 AND CAST(owner AS VARCHAR) LIKE '1%' GROUP BY 1""",
    "received_dividends": _ACTIONS_SQL + " SELECT owner % 10 AS owner, count(*) AS n, count(*) FILTER (k % 5 <> 0) AS complete FROM a WHERE k % 6 = 0 AND k % 7 <> 0 AND ifnull(paid, ex) <= DATE '1997-06-30' GROUP BY 1",
    "action_lots": _ACTIONS_SQL + f""", l AS (SELECT kind, {_LOT} AS q, CASE WHEN kind = 'OPENING_POSITION' THEN ifnull(paid_total, price * quantity) WHEN paid_total IS NULL OR paid_total = 0 THEN price * quantity ELSE paid_total END AS cost FROM a)
        SELECT kind, count(*) AS n, CAST(SUM(q) AS DOUBLE) AS shares, CAST(SUM(cost) AS DOUBLE) AS cost, count(*) FILTER (cost IS NULL) AS unknown FROM l WHERE q IS NOT NULL GROUP BY 1""",
    "action_defects": _ACTIONS_SQL + f""", x AS (SELECT *, {_READ} AS r FROM a)
        SELECT kind, CASE WHEN k % 6 IN (1, 2, 5) THEN CASE WHEN k % 5 = 1 OR r = 0 THEN 'ratio' WHEN k % 5 IN (3, 4) AND (shares IS NULL OR (shares = 0 AND k % 6 <> 2)) THEN 'missing' END
          WHEN k % 6 = 3 AND (ifnull(quantity, 0) = 0 OR ifnull(price, 0) = 0) THEN 'subscription'
          WHEN k % 6 = 4 AND ifnull(quantity, 0) <= 0 THEN 'opening' WHEN k % 6 = 4 AND abs(price * quantity - paid_total) > greatest(0.01 * quantity, 0.01) THEN 'cost' END AS defect,
          k % 6 IN (1, 2, 5) AND r IS NOT NULL AS by_ratio, count(*) AS n FROM x GROUP BY ALL""",
    "action_steps": _ACTIONS_SQL + f""", x AS (SELECT *, {_READ} AS r, {_LOT} AS q FROM a),
        y AS (SELECT kind, CASE WHEN k % 6 IN (1, 5) THEN CASE WHEN r IS NOT NULL THEN 100 + 10 * r ELSE 100 + ifnull(shares, 0) END WHEN k % 6 = 2 THEN CASE WHEN r IS NOT NULL THEN 10 * r ELSE ifnull(shares, 100) END ELSE 100 + ifnull(q, 0) END AS after FROM x)
        SELECT kind, CAST(SUM(after) AS DOUBLE) AS after, count(*) FILTER (after <> 100) AS changed FROM y GROUP BY 1""",
    "option_contracts": "SELECT c_custkey % 6 AS form, c_custkey % 6 < 3 AS option, count(*) AS n FROM customer GROUP BY ALL",
    "skip_reasons": """WITH x AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'stock' ELSE 'hk_connect' END AS statement, ['证券买入', '证券卖出', '港股通买入', '港股通卖出', '开放基金申购', '红利入账', '股息红利差异扣税', '港股通组合费', '银行转存'][o_custkey % 9 + 1] AS business, o_orderkey % 3 + 4 AS size FROM orders)
        SELECT statement, business, CASE business WHEN '银行转存' THEN 'unsupported' WHEN '港股通组合费' THEN CASE statement WHEN 'stock' THEN 'conflict' END
          ELSE CASE WHEN size = 4 THEN 'unsupported' WHEN (statement = 'stock') <> (size = 6) THEN 'conflict' END END AS reason, count(*) AS n FROM x GROUP BY ALL""",
    "notice_amounts": """SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey / 10 WHEN 1 THEN 1000.5 + s_suppkey % 1000 END AS DOUBLE) AS amount, CASE s_suppkey % 4 WHEN 0 THEN 'HKD' WHEN 1 THEN 'CNY' END AS currency,
        CASE WHEN s_suppkey % 3 = 0 THEN 'CNY' END AS base, CASE WHEN s_suppkey % 3 = 0 THEN 'HKD' END AS quote, CAST(CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey + 0.5) / 2 END AS DOUBLE) AS rate FROM supplier""",
    "literal_search": "SELECT p_brand || '_50%' AS name, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1",
}
