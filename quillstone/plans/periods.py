"""Changes between periods, cash legs, exercises and rules over the ledger and the tables, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions as ac
from ..functions import scalars as sc
from ..operators import periods as pe
from .fundamentals import _FACTS_SQL, _r, _rs, facts
from .performance import _CURVE, curve
from .star import KEY, ORDER, ORDER_SQL, TRADES_SQL, dbl, table, trades


def curve_periods(spark: SparkSession, d: str) -> DataFrame:
    """Profit of each week: what the book changed by plus what went out less what came in."""
    p = pe.period_change(curve(spark, d), F.date_trunc("week", "d").cast("date"))
    return p.select(F.col("period").cast("string").alias("period"), *[_r(c, 2).alias(c) for c in ("opening", "closing", "inflow", "outflow", "pnl")])


def exchange_legs(spark: SparkSession, d: str) -> DataFrame:
    """Cash that exchanges move, by currency; pairs that are in doubt move none."""
    k = F.col("o_orderkey")
    pair = F.when(k % 5 == 0, "eur.usd").when(k % 5 == 1, "USD.CNY").when(k % 5 == 2, "EURUSD").when(k % 5 == 3, "USD.HKD").otherwise("GB1.USD")
    legs = ac.exchange_legs(pair, (k % 100 - 50).cast("decimal(18,4)"), (F.col("o_custkey") % 7).cast("decimal(18,4)"), F.when(k % 4 == 0, "USD").when(k % 4 == 1, ""))
    x = table(spark, d, "orders").select(F.explode(legs).alias("leg")).select("leg.*")
    return x.groupBy("currency").agg(F.count("*").alias("n"), dbl(F.sum("amount")).alias("amount"))


def long_only_exercises(spark: SparkSession, d: str) -> DataFrame:
    """Shares left and exercises dropped by key; sells of one supplier's group are exercises."""
    t = trades(spark, d)
    r = pe.long_only(t, KEY, ORDER, F.col("side") == "BUY", F.col("qty"), F.col("supplier") % 2 == 0)
    return r.select(*KEY, F.round("held", 2).alias("held"), F.col("dropped").cast("long").alias("dropped"))


def share_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Years whose earnings a share don't fit their income, by company."""
    f = facts(spark, d).withColumn("eps", F.col("income") / F.when((F.col("company") + F.col("year")) % 5 == 0, 100.0).otherwise(1000.0))
    return pe.share_mismatch(f, ["company"], "income", "eps").groupBy("company").agg(F.count_if("mismatch").alias("n"), F.count("shares").alias("years"))


def balance_changes(spark: SparkSession, d: str) -> DataFrame:
    """Each company's newest month against the one before and that of a year ago."""
    t = trades(spark, d).where("(symbol % 97 + month(trade_date)) % 5 > 0").groupBy((F.col("symbol") % 97).alias("company"), F.last_day("trade_date").alias("end")).agg(F.sum("gross").alias("value"))
    n = pe.newest_against(t, ["company"], "end", "value", 45)
    c = F.col
    return n.select("company", c("end").cast("string").alias("end"), dbl("now").alias("now"), dbl("previous").alias("previous"), dbl("year_ago").alias("year_ago"), sc.direction(c("now"), c("previous")).alias("way"))


def merged_accounts(spark: SparkSession, d: str) -> DataFrame:
    """What was bought of each symbol across accounts."""
    held = trades(spark, d).where("side = 'BUY'").groupBy("user_id", "symbol", "account_id").agg(F.sum("qty").alias("qty"), F.sum(F.col("gross") + F.col("fee")).alias("cost"))
    return pe.merged_accounts(held, KEY).select(*KEY, dbl("qty").alias("qty"), dbl("cost").alias("cost"), _r("avg").alias("avg"), "accounts")


def excluded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that rules keep out of the books, and the others, by side."""
    rules = table(spark, d, "part").where("p_size % 10 = 0").select(F.col("p_partkey").alias("symbol"))
    return pe.archive_only(trades(spark, d), rules, "symbol").groupBy("side", "excluded").agg(F.count("*").alias("n"), dbl(F.sum("gross")).alias("gross"))


def mention_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that may name a security, by language."""
    docs = table(spark, d, "documents").where(ac.mentions(F.col("text"), F.col("source")))
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def current_versions(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of the expected version, by type of event."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(ac.versions_current(F.col("props"), k=1)).alias("current"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (curve_periods, exchange_legs, long_only_exercises, share_mismatches, balance_changes, merged_accounts, excluded_rows, mention_candidates, current_versions)}

ORACLE = {
    "curve_periods": _CURVE + f""", weeks AS (SELECT CAST(date_trunc('week', d) AS DATE) AS period, arg_max(mv, d) AS closing, SUM(inflow) AS inflow, SUM(outflow) AS outflow FROM k GROUP BY 1), changes AS (SELECT *, ifnull(lag(closing) OVER (ORDER BY period), 0.0::DOUBLE) AS opening FROM weeks)
        SELECT CAST(period AS VARCHAR) AS period, {_rs("opening", 2)} AS opening, {_rs("closing", 2)} AS closing, {_rs("inflow", 2)} AS inflow, {_rs("outflow", 2)} AS outflow, {_rs("closing - opening + outflow - inflow", 2)} AS pnl FROM changes""",
    "exchange_legs": """WITH x AS (SELECT o_orderkey % 5 AS p, o_orderkey % 100 - 50 AS q, o_custkey % 7 AS price, o_orderkey % 4 = 0 AS usd FROM orders), s AS (SELECT * FROM x WHERE p IN (0, 1, 3) AND q <> 0 AND price > 0 AND (NOT usd OR p = 0)),
        l AS (SELECT CASE p WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, q AS amount FROM s UNION ALL SELECT CASE p WHEN 0 THEN 'USD' WHEN 1 THEN 'CNY' ELSE 'HKD' END, -q * price FROM s)
        SELECT currency, count(*) AS n, CAST(SUM(amount) AS DOUBLE) AS amount FROM l GROUP BY 1""",
    "long_only_exercises": "WITH RECURSIVE " + TRADES_SQL + f""", n AS (SELECT user_id, symbol, side = 'BUY' AS b, CAST(qty AS DOUBLE) AS q, supplier % 2 = 0 AS f, row_number() OVER (PARTITION BY user_id, symbol ORDER BY {ORDER_SQL}) AS i FROM trades),
        w AS (SELECT DISTINCT user_id, symbol, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS held, CAST(0 AS BIGINT) AS dropped FROM n
          UNION ALL SELECT n.user_id, n.symbol, n.i, CASE WHEN b THEN held + q WHEN f AND q > held THEN held ELSE greatest(held - q, 0) END, dropped + CASE WHEN NOT b AND f AND q > held THEN 1 ELSE 0 END FROM w JOIN n ON n.user_id = w.user_id AND n.symbol = w.symbol AND n.i = w.i + 1)
        SELECT user_id, symbol, round(arg_max(held, i), 2) AS held, arg_max(dropped, i) AS dropped FROM w GROUP BY 1, 2""",
    "share_mismatches": _FACTS_SQL + """, s AS (SELECT company, year, CASE WHEN income <> 0 THEN CASE WHEN (company + year) % 5 = 0 THEN 100.0 ELSE 1000.0 END END AS shares FROM facts), l AS (SELECT company, arg_max(shares, year) FILTER (shares IS NOT NULL) AS ref FROM s GROUP BY 1)
        SELECT company, count(*) FILTER (shares / ref > 2 OR shares / ref < 0.5) AS n, count(shares) AS years FROM s JOIN l USING (company) GROUP BY 1""",
    "balance_changes": "WITH " + TRADES_SQL + """, t AS (SELECT symbol % 97 AS company, last_day(trade_date) AS e, SUM(gross) AS v FROM trades WHERE (symbol % 97 + month(trade_date)) % 5 > 0 GROUP BY ALL), n AS (SELECT company, max(e) AS e FROM t GROUP BY 1),
        p AS (SELECT n.company, n.e, max(t.e) AS pe FROM n LEFT JOIN t ON t.company = n.company AND t.e < n.e AND t.e >= n.e - 45 GROUP BY ALL)
        SELECT p.company, CAST(p.e AS VARCHAR) AS "end", CAST(a.v AS DOUBLE) AS now, CAST(b.v AS DOUBLE) AS previous, CAST(c.v AS DOUBLE) AS year_ago, CASE WHEN a.v > b.v THEN '上升' WHEN a.v < b.v THEN '下降' WHEN a.v = b.v THEN '持平' END AS way
        FROM p JOIN t a ON a.company = p.company AND a.e = p.e LEFT JOIN t b ON b.company = p.company AND b.e = p.pe LEFT JOIN t c ON c.company = p.company AND year(c.e) = year(p.e) - 1 AND month(c.e) = month(p.e)""",
    "merged_accounts": "WITH " + TRADES_SQL + f""", g AS (SELECT user_id, symbol, SUM(qty) AS q, SUM(gross + fee) AS c, count(DISTINCT account_id) AS accounts FROM trades WHERE side = 'BUY' GROUP BY 1, 2)
        SELECT user_id, symbol, CAST(q AS DOUBLE) AS qty, CAST(c AS DOUBLE) AS cost, {_rs("CAST(c AS DOUBLE) / CAST(q AS DOUBLE)")} AS avg, accounts FROM g""",
    "excluded_rows": "WITH " + TRADES_SQL + " SELECT side, symbol IN (SELECT p_partkey FROM part WHERE p_size % 10 = 0) AS excluded, count(*) AS n, CAST(SUM(gross) AS DOUBLE) AS gross FROM trades GROUP BY ALL",
    "mention_candidates": "SELECT lang, count(*) AS n, CAST(SUM(doc_id) AS BIGINT) AS ids FROM documents WHERE contains(text, '$') OR contains(source, '/S/') GROUP BY 1",
    "current_versions": "SELECT event_type, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) = 1) AS current, count(*) AS n FROM events GROUP BY 1",
}
