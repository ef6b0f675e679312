"""Cash receipts against booked and expected dividends, over the orders; and the SQL for them, pair by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import receipts as rc
from .star import dbl, table

#: Fields over the order's key k, customer c, day and price that Spark and SQL read alike; one security is hot.
_BASE = {"symbol": "CASE WHEN c % 20 = 0 THEN 0 ELSE c END", "account_id": "c % 3", "currency": "CASE WHEN c % 9 = 0 THEN 'USD' ELSE 'HKD' END", "gross": "CASE WHEN k % 4 = 1 THEN price + 10 END", "tax": "CASE WHEN k % 8 = 1 THEN CAST(10 AS DECIMAL(18,2)) END"}
_PAID = "10 + CAST(k % 25 AS INT)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")).select("k", "c", "day", "price", *[F.expr(e).alias(n) for n, e in _BASE.items()])


def receipts(spark: SparkSession, d: str) -> DataFrame:
    r = _orders(spark, d).where("k % 3 <> 0 OR k % 2 = 0").withColumn("part", F.explode(F.expr("CASE WHEN k % 30 = 0 THEN array(0, 1) ELSE array(0) END")))
    paid = F.expr(f"date_add(day, {_PAID} + CASE WHEN k % 60 = 0 THEN part ELSE 0 END)")
    return r.select((F.col("k") * 2 + F.col("part")).alias("receipt_id"), F.expr("concat(c, '-', year(day))").alias("batch"), "account_id", "symbol", paid.alias("payment_date"), "currency", F.col("price").alias("amount"), "gross", "tax")


def bookings(spark: SparkSession, d: str) -> DataFrame:
    b = _orders(spark, d).where("k % 6 < 2")
    return b.select(
        F.col("k").alias("booking_id"), "account_id", "symbol", F.expr("CASE WHEN k % 19 = 0 THEN 'UNVERIFIED' ELSE 'RECEIVED' END").alias("status"), F.expr("CASE WHEN k % 6 = 0 THEN 'LEGACY' WHEN k % 12 = 1 THEN 'GROSS_NET' ELSE 'NET_ONLY' END").alias("basis"),
        F.col("day").alias("ex_date"), F.expr(f"CASE WHEN k % 6 = 1 THEN date_add(day, {_PAID}) END").alias("payment_date"), "currency", F.expr("price + 10").alias("gross"), F.lit(10).cast("decimal(18,2)").alias("tax"), F.expr("CASE WHEN k % 18 <> 1 THEN price END").alias("net"),
        F.expr("CASE WHEN k % 72 = 1 THEN -1 WHEN k % 12 = 1 THEN k END").alias("notice_id"), F.expr("k % 17 = 0").alias("sourced"),
    )


def notices(spark: SparkSession, d: str) -> DataFrame:
    n = _orders(spark, d)
    return n.select(F.col("k").alias("notice_id"), F.expr("CASE WHEN k % 5 <> 0 THEN account_id END").alias("account_id"), "symbol", F.col("day").alias("ex_date"), F.expr("CASE WHEN k % 4 <> 0 THEN date_add(day, CAST(k % 40 AS INT)) END").alias("pay_date"), F.expr("CASE WHEN k % 6 = 0 THEN k END").alias("booking_id"), F.expr("k % 23 = 0").alias("ignored"), F.expr("k % 11 = 0").alias("complete"), F.expr("k % 13 = 0").alias("superseded"))


def receipt_plan(spark: SparkSession, d: str) -> DataFrame:
    """What each receipt belongs to, or why it is blocked."""
    p = rc.plan(receipts(spark, d), bookings(spark, d), notices(spark, d))
    return p.select("receipt_id", "booking_id", "notice_id", "state", "reason", "batch_blocked")


def receipt_bookings(spark: SparkSession, d: str) -> DataFrame:
    """The bookings that the receipts of unblocked batches make, with what is proved of gross and tax."""
    b = bookings(spark, d)
    s = rc.settled_amounts(rc.plan(receipts(spark, d), b, notices(spark, d)), b)
    return s.select("account_id", "symbol", "booking_id", "notice_id", F.col("payment_date").cast("string").alias("payment_date"), "currency", "receipts", *[dbl(c, 2).alias(c) for c in ("net", "gross", "tax")], "basis")


QUERIES = {"receipt_plan": receipt_plan, "receipt_bookings": receipt_bookings}

_PLAN = f"""WITH o AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _BASE.items())} FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)),
 r AS (SELECT k * 2 + part AS receipt_id, concat(c, '-', year(day)) AS batch, account_id, symbol, day + {_PAID} + CASE WHEN k % 60 = 0 THEN part ELSE 0 END AS payment_date, currency, price AS amount, gross, tax
  FROM (SELECT *, unnest(CASE WHEN k % 30 = 0 THEN [0, 1] ELSE [0] END) AS part FROM o WHERE k % 3 <> 0 OR k % 2 = 0)),
 b AS (SELECT k AS booking_id, account_id, symbol, CASE WHEN k % 6 = 0 THEN 'LEGACY' WHEN k % 12 = 1 THEN 'GROSS_NET' ELSE 'NET_ONLY' END AS basis, CASE WHEN k % 6 = 1 THEN day + {_PAID} ELSE day END AS cash_date, currency, price + 10 AS gross, CAST(10 AS DECIMAL(18,2)) AS tax,
   CASE WHEN k % 18 <> 1 THEN price ELSE price + 10 - 10 END AS net, CASE WHEN k % 72 = 1 THEN -1 WHEN k % 12 = 1 THEN k END AS link, k % 19 <> 0 AND k % 17 <> 0 AS usable FROM o WHERE k % 6 < 2),
 n AS (SELECT o.k AS notice_id, b.booking_id AS legacy, CASE WHEN b.booking_id IS NOT NULL THEN b.account_id WHEN o.k % 5 <> 0 THEN o.account_id END AS account_id, o.symbol, day - {rc.BEFORE} AS low, CASE WHEN o.k % 4 <> 0 THEN day + CAST(o.k % 40 AS INT) ELSE day END + {rc.AFTER} AS high
   FROM o LEFT JOIN b ON o.k = b.booking_id AND b.basis = 'LEGACY' AND b.usable WHERE o.k % 23 <> 0 AND o.k % 11 <> 0 AND o.k % 13 <> 0),
 m AS (SELECT r.receipt_id, count(*) AS n_manual, min(b.booking_id) AS manual_id, min_by(struct_pack(l := b.link), b.booking_id).l AS link FROM r JOIN b USING (account_id, symbol, currency)
   WHERE b.usable AND b.basis <> 'LEGACY' AND b.cash_date = r.payment_date AND (b.net = r.amount OR coalesce(r.gross = b.gross, false)) GROUP BY 1),
 h AS (SELECT r.receipt_id, count(*) AS many, count(legacy) AS booked, bool_or(n.account_id IS NULL) AS unnamed, min(n.notice_id) AS the_notice, min(legacy) AS the_legacy FROM r JOIN n ON r.symbol = n.symbol AND r.payment_date BETWEEN n.low AND n.high AND (n.account_id IS NULL OR n.account_id = r.account_id) GROUP BY 1),
 x AS (SELECT r.*, coalesce(n_manual, 0) AS n_manual, CASE WHEN n_manual = 1 THEN manual_id END AS manual_id, CASE WHEN n_manual = 1 THEN link END AS link, coalesce(many, 0) AS many, coalesce(booked, 0) AS booked, coalesce(unnamed, false) AS unnamed, the_notice, the_legacy FROM r LEFT JOIN m USING (receipt_id) LEFT JOIN h USING (receipt_id)),
 y AS (SELECT *, link IS NULL AND many = 1 AND NOT unnamed AS single FROM x),
 z AS (SELECT *, CASE WHEN single THEN the_legacy END AS advance FROM y),
 w AS (SELECT *, CASE WHEN n_manual > 1 THEN 'several bookings' WHEN link = -1 THEN 'its notice is gone' WHEN link IS NULL AND booked > 0 AND (many > 1 OR unnamed) THEN 'an advance booking among several notices or without an account' WHEN advance <> manual_id THEN 'booked by hand and in advance' END AS why FROM z),
 v AS (SELECT *, CASE WHEN why IS NULL THEN coalesce(manual_id, advance) END AS bk, CASE WHEN why IS NULL THEN coalesce(link, CASE WHEN single THEN the_notice END) END AS nt FROM w),
 u AS (SELECT *, coalesce(why, CASE WHEN bk IS NOT NULL AND count(*) OVER p > 1 AND (bool_or(manual_id IS NOT NULL) OVER p OR bool_or(gross IS NOT NULL) OVER p) THEN 'several receipts of one booking' WHEN bk IS NOT NULL AND (min(payment_date) OVER p <> max(payment_date) OVER p OR min(currency) OVER p <> max(currency) OVER p) THEN 'an advance booking received in parts' END) AS reason FROM v WINDOW p AS (PARTITION BY bk)),
 plan AS (SELECT *, CASE WHEN reason IS NULL THEN bk END AS booking_id, CASE WHEN reason IS NULL THEN nt END AS notice_id, CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN bk IS NOT NULL THEN 'booking' WHEN nt IS NOT NULL THEN 'notice' WHEN many > 0 THEN 'unlinked' ELSE 'new' END AS state, bool_or(reason IS NOT NULL) OVER (PARTITION BY batch) AS batch_blocked FROM u)
"""
ORACLE = {
    "receipt_plan": _PLAN + "SELECT receipt_id, booking_id, notice_id, state, reason, batch_blocked FROM plan",
    "receipt_bookings": _PLAN + """, g AS (SELECT account_id, symbol, booking_id, notice_id, payment_date, currency, count(*) AS receipts, sum(amount) AS net, bool_and(gross IS NOT NULL AND tax IS NOT NULL) AS stated, sum(gross) AS gross, sum(tax) AS tax FROM plan WHERE NOT batch_blocked GROUP BY account_id, symbol, booking_id, notice_id, payment_date, currency, CASE WHEN gross IS NOT NULL OR (booking_id IS NULL AND notice_id IS NULL) THEN receipt_id END)
SELECT g.account_id, g.symbol, g.booking_id, g.notice_id, CAST(payment_date AS VARCHAR) AS payment_date, g.currency, receipts, CAST(g.net AS DOUBLE) AS net, CAST(CASE WHEN stated THEN g.gross WHEN b.currency = g.currency THEN b.gross END AS DOUBLE) AS gross, CAST(CASE WHEN stated THEN g.tax WHEN b.currency = g.currency THEN b.tax END AS DOUBLE) AS tax, CASE WHEN stated OR coalesce(b.currency = g.currency, false) THEN 'GROSS_NET' ELSE 'NET_ONLY' END AS basis FROM g LEFT JOIN b ON b.booking_id = g.booking_id AND b.basis = 'GROSS_NET'""",
}
