"""Windows to read again, from marks of the ledger; and the SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import progress as pg
from .star import table

_TODAY, _MOST = "1998-08-10", 40


def sync_windows(spark: SparkSession, d: str) -> DataFrame:
    """What each customer asks for, whose newest order marks how far it has been read; a few new ones a run."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    marks = table(spark, d, "orders").where("o_custkey % 10 < 7").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("last_ok"))
    w = pg.sync_windows(keys, marks, F.lit(_TODAY).cast("date"), most_new=_MOST)
    return w.select("key", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "mode")


QUERIES = {"sync_windows": sync_windows}

ORACLE = {
    "sync_windows": f"""WITH k AS (SELECT c_custkey AS key, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey AND o_custkey % 10 < 7) AS last_ok FROM customer),
 m AS (SELECT *, CASE WHEN last_ok IS NOT NULL THEN 'incremental' WHEN row_number() OVER (PARTITION BY last_ok IS NULL ORDER BY key) <= {_MOST} THEN 'backfill' ELSE 'deferred' END AS mode FROM k)
SELECT key, CAST(CAST(CASE mode WHEN 'incremental' THEN greatest(last_ok - {pg.LOOKBACK}, DATE '{_TODAY}' - {pg.LONGEST}) WHEN 'backfill' THEN DATE '{_TODAY}' - {pg.BACKFILL} END AS DATE) AS VARCHAR) AS start, CASE WHEN mode <> 'deferred' THEN '{_TODAY}' END AS "end", mode FROM m"""
}
