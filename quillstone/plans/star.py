"""The ledger as a projection of the star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["user_id", "symbol"]
#: A total order of a key's events: date, buys before sells, then what tells lines apart.
ORDER = ["trade_date", "side", "order_id", "line", "supplier", "qty", "gross", "disc", "tax"]

# Rates to the base currency; one currency has none, one starts late.
FX = [("C0", "1990-01-01", 1.0), ("C1", "1990-01-01", 7.0), ("C1", "1996-01-01", 7.2), ("C1", "1999-01-01", 6.9), ("C2", "1997-06-01", 0.9), ("C4", "1990-01-01", 8.1), ("C4", "1998-01-01", 8.3)]

TRADES_SQL = """trades AS (
  SELECT n_regionkey AS user_id, 'C' || n_regionkey AS cur, l_suppkey % 3 AS account_id, l_partkey AS symbol,
    CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
    CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
    CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS fee,
    CAST(l_shipdate AS DATE) AS trade_date, l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS supplier,
    CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
FX_SQL = "fx AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', DATE '{d}', CAST({r} AS DECIMAL(12,6)))" for c, d, r in FX) + ") t(cur, eff, rate))"
ORDER_SQL = ", ".join(ORDER)
CLOSES_SQL = """closes AS (
  SELECT user_id % 50 AS symbol, CAST(ts AS DATE) AS d, max_by(value, struct_pack(a := ts, b := event_id)) AS close
  FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)"""
QUOTES_SQL = """fills AS (
  SELECT user_id % 50 AS symbol, CAST(ts AS DATE) AS d, event_id, ts,
    CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side,
    CAST(1 + event_id % 10 AS DOUBLE) AS qty, value AS price
  FROM events WHERE event_type IN ('purchase', 'error'))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; the dimension joins carry only their keys, so the lines alone are large."""
    t = lambda n: table(spark, sf_dir, n)
    owner = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_regionkey")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    return t("lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("n_regionkey").alias("user_id"), F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("cur"), (F.col("l_suppkey") % 3).alias("account_id"), F.col("l_partkey").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").cast("decimal(18,2)").alias("qty"), money.alias("gross"),
        F.round(money * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(18,2)").alias("fee"), F.to_date("l_shipdate").alias("trade_date"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"), F.col("l_discount").cast("decimal(4,2)").alias("disc"), F.col("l_tax").cast("decimal(4,2)").alias("tax"),
    )


def fx(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(FX, "cur string, eff string, rate double")
    return rows.select("cur", F.to_date("eff").alias("eff"), F.col("rate").cast("decimal(12,6)").alias("rate"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return e.groupBy((F.col("user_id") % 50).alias("symbol"), F.to_date("ts").alias("d")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select((F.col("user_id") % 50).alias("symbol"), F.to_date("ts").alias("d"), "event_id", "ts", F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"), (F.lit(1) + F.col("event_id") % 10).cast("double").alias("qty"), F.col("value").alias("price"))


def dbl(col, digits: int = 4):
    """Rounded (decimals exactly) and turned into a double at the sink."""
    return F.round(col, digits).cast("double")
