"""Statement analysis and write policies, over statements projected from the ledger's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fundamentals as fu
from ..sources import writes
from .star import TRADES_SQL, dbl, table, trades

#: Amounts of a company (symbol modulo 97) and year, each a conditional sum of exact decimals: name -> (line condition, value).
_AMOUNTS = {
    "revenue": ("true", "gross"), "receivable": ("line = 1", "gross"), "inventory": ("line = 2", "gross"), "cur_assets": ("line <= 3", "gross"), "ppe": ("line in (4, 5)", "gross"),
    "assets": ("true", "gross + fee"), "depreciation": ("line in (4, 5)", "fee"), "sga": ("true", "fee"), "liabilities": ("side = 'SELL'", "gross"), "cur_liabilities": ("side = 'SELL' and line <= 2", "gross"),
    "debt": ("side = 'SELL' and line = 6", "gross"), "costs": ("side = 'BUY'", "fee * 10"), "income": ("line <= 2", "gross * disc - fee"), "cash_flow": ("line <= 3", "gross * disc - fee"),
}
_FACTS_SQL = "WITH " + TRADES_SQL + ", f AS (SELECT symbol % 97 AS company, CAST(year(trade_date) AS INTEGER) AS year, " + ", ".join(f"CAST(SUM(CASE WHEN {c} THEN {v} END) AS DOUBLE) AS {n}" for n, (c, v) in _AMOUNTS.items()) + " FROM trades WHERE (symbol % 97 + year(trade_date)) % 13 <> 0 GROUP BY 1, 2), facts AS (SELECT *, 1 - costs / revenue AS margin FROM f)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row a company and year; some years are missing."""
    t = trades(spark, d).withColumn("company", F.col("symbol") % 97).withColumn("year", F.year("trade_date")).where("(company + year) % 13 <> 0")
    g = t.groupBy("company", "year").agg(*[F.sum(F.expr(f"CASE WHEN {c} THEN {v} END")).cast("double").alias(n) for n, (c, v) in _AMOUNTS.items()])
    return g.withColumn("margin", 1 - F.try_divide("costs", "revenue"))


def _r(col: str | Column, digits: int = 4) -> Column:
    """Rounded through a decimal: engines differ in how they round a double at half a unit."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("decimal(28,8)"), digits).cast("double")


def _rs(col: str, digits: int = 4) -> str:
    return f"CAST(ROUND(CAST({col} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def accruals_score(spark: SparkSession, d: str) -> DataFrame:
    m = fu.m_score(facts(spark, d), ["company"])
    return m.select("company", "year", *[_r(n).alias(n) for n in fu.M_SCORE], _r("score", 3).alias("score"), "flag")


def earnings_quality(spark: SparkSession, d: str) -> DataFrame:
    q = fu.earnings_quality(facts(spark, d), ["company"])
    return q.select("company", "year", _r("cash_cover").alias("cash_cover"), _r("accruals").alias("accruals"), _r("receivable_gap", 2).alias("receivable_gap"), _r("inventory_gap", 2).alias("inventory_gap"))


def profit_run(spark: SparkSession, d: str) -> DataFrame:
    return fu.newest_run(facts(spark, d), ["company"], "year", F.col("income") > 0)


def statement_gaps(spark: SparkSession, d: str) -> DataFrame:
    return fu.missing_years(facts(spark, d), ["company"]).select("company", "first", "last", F.array_join("missing", ",").alias("missing"))


def defensive_screen(spark: SparkSession, d: str) -> DataFrame:
    return fu.defensive_screen(facts(spark, d), ["company"])


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """Year-to-date revenue of each company and quarter; some quarters are missing."""
    from pyspark.sql import Window

    t = trades(spark, d).groupBy((F.col("symbol") % 97).alias("company"), F.year("trade_date").alias("year"), F.quarter("trade_date").alias("quarter")).agg(F.sum("gross").alias("g"))
    ytd = t.withColumn("ytd", F.sum("g").over(Window.partitionBy("company", "year").orderBy("quarter")))
    return ytd.where("(company + year + quarter) % 17 <> 0").drop("g")


_QUARTERS_SQL = "WITH " + TRADES_SQL + ", g AS (SELECT symbol % 97 AS company, CAST(year(trade_date) AS INTEGER) AS year, CAST(quarter(trade_date) AS INTEGER) AS quarter, SUM(gross) AS g FROM trades GROUP BY 1, 2, 3), y AS (SELECT company, year, quarter, SUM(g) OVER (PARTITION BY company, year ORDER BY quarter) AS ytd FROM g), q AS (SELECT * FROM y WHERE (company + year + quarter) % 17 <> 0)"


def single_quarters(spark: SparkSession, d: str) -> DataFrame:
    return fu.single_quarters(_quarters(spark, d), ["company"], "ytd").select("company", "year", "quarter", dbl("single").alias("single"))


def trailing_year(spark: SparkSession, d: str) -> DataFrame:
    return fu.trailing_year(_quarters(spark, d), ["company"], "ytd").select("company", "year", "quarter", dbl("trailing").alias("trailing"))


def upsert_policies(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue upsert: known name wins, segment is filled once, newest balance is the larger one."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.upper("c_name")).alias("name"), F.lower("c_mktsegment").alias("segment"), (F.col("c_acctbal") - (F.col("c_custkey") % 3 - 1)).alias("balance"))
    out = writes.upsert(old, new, ["c_custkey"], {"name": "text", "segment": "fill", "balance": "greatest"})
    return out.withColumn("balance", _r("balance", 2))


def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    stored = e.where("user_id % 2 = 0 and event_type <> 'error'")
    return writes.to_insert(stored, e, ["user_id", "event_type", "day"]).groupBy("event_type").agg(F.count("*").alias("inserted"))


def prune_newest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kept = writes.keep_newest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 30)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.sum("event_id").alias("checksum"))


def prune_stale(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("company", "year", "revenue")
    produced = f.where("year >= 1998 and company % 4 > 0 and (company + year) % 5 > 0")
    return writes.prune_stale(f, produced, ["company"], ["year"], "year").groupBy("company").agg(F.count("*").alias("n"), F.sum("year").alias("years"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field of a JSON column, parsed once and counted by type."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("parsed"), F.sum(k).alias("total"), F.max(k).alias("most"))


QUERIES = {f.__name__: f for f in (accruals_score, earnings_quality, profit_run, statement_gaps, defensive_screen, single_quarters, trailing_year, upsert_policies, insert_or_ignore, prune_newest, prune_stale, json_props)}

_PAIR = _FACTS_SQL + ", j AS (SELECT a.*, " + ", ".join(f"b.{n} AS p_{n}" for n in [*_AMOUNTS, "margin"]) + " FROM facts a LEFT JOIN facts b ON a.company = b.company AND a.year = b.year + 1)"
_SOFT = "(1 - ({p}cur_assets + {p}ppe) / nullif({p}assets, 0))"
_M = {
    "dsri": "(receivable / nullif(revenue, 0)) / nullif(p_receivable / nullif(p_revenue, 0), 0)", "gmi": "p_margin / nullif(margin, 0)",
    "aqi": _SOFT.format(p="") + " / nullif(" + _SOFT.format(p="p_") + ", 0)", "sgi": "revenue / nullif(p_revenue, 0)",
    "depi": "(p_depreciation / nullif(p_depreciation + p_ppe, 0)) / nullif(depreciation / nullif(depreciation + ppe, 0), 0)",
    "sgai": "(sga / nullif(revenue, 0)) / nullif(p_sga / nullif(p_revenue, 0), 0)", "tata": "(income - cash_flow) / nullif(assets, 0)", "lvgi": "(liabilities / nullif(assets, 0)) / nullif(p_liabilities / nullif(p_assets, 0), 0)",
}
_SCORE = f"{fu.M_INTERCEPT}::DOUBLE" + "".join(f" + ({w}::DOUBLE) * {n}" for n, w in fu.M_SCORE.items())
_RUN = _FACTS_SQL + """, s AS (SELECT company, year, income, CASE WHEN LAG(year) OVER w - year > 1 THEN 'gap' WHEN income IS NULL THEN 'unknown' WHEN income <= 0 THEN 'value' END AS stop FROM facts WINDOW w AS (PARTITION BY company ORDER BY year DESC)),
 e AS (SELECT company, max(year) FILTER (stop IS NOT NULL) AS last, max_by(stop, year) FILTER (stop IS NOT NULL) AS stop FROM s GROUP BY 1), run AS (SELECT s.company, count(*) FILTER (year > COALESCE(last, 0)) AS run, any_value(e.stop) AS stop FROM s JOIN e ON s.company = e.company GROUP BY 1)"""
_VERDICT = "CASE WHEN {0} IS NULL THEN 'indeterminate' WHEN {0} THEN 'pass' ELSE 'fail' END".format
_GROWTH = "(({0} - p_{0}) / nullif(abs(p_{0}), 0) * 100)".format
ORACLE = {
    "accruals_score": _PAIR + ", m AS (SELECT company, year, " + ", ".join(f"{e} AS {n}" for n, e in _M.items()) + f" FROM j), k AS (SELECT *, {_SCORE} AS score FROM m) SELECT company, year, " + ", ".join(f"{_rs(n)} AS {n}" for n in _M) + f", {_rs('score', 3)} AS score, score > {fu.M_FLAG}::DOUBLE AS flag FROM k WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in _M),
    "earnings_quality": _PAIR + f" SELECT company, year, {_rs('CASE WHEN income > 0 THEN cash_flow / income END')} AS cash_cover, {_rs('(income - cash_flow) / nullif(assets, 0)')} AS accruals, {_rs(_GROWTH('receivable') + ' - ' + _GROWTH('revenue'), 2)} AS receivable_gap, {_rs(_GROWTH('inventory') + ' - ' + _GROWTH('revenue'), 2)} AS inventory_gap FROM j",
    "profit_run": _RUN + " SELECT * FROM run",
    "statement_gaps": _FACTS_SQL + ", g AS (SELECT company, min(year) AS first, max(year) AS last, list(year) AS have FROM facts GROUP BY 1) SELECT company, first, last, array_to_string(list_filter(range(first, last + 1), lambda y: NOT list_contains(have, CAST(y AS INTEGER))), ',') AS missing FROM g",
    "defensive_screen": _RUN + f", n AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY company ORDER BY year DESC) = 1) SELECT n.company, n.year AS anchor, {_VERDICT('(n.cur_assets / nullif(n.cur_liabilities, 0) >= 2)')} AS liquidity, {_VERDICT('(n.debt <= n.cur_assets - n.cur_liabilities)')} AS debt, CASE WHEN run >= 5 THEN 'pass' WHEN stop = 'value' THEN 'fail' ELSE 'indeterminate' END AS steady, {_VERDICT('(CASE WHEN t.income > 0 THEN n.income / t.income >= 1.33::DOUBLE END)')} AS growth FROM n JOIN run ON run.company = n.company LEFT JOIN facts t ON t.company = n.company AND t.year = n.year - 4",
    "single_quarters": _QUARTERS_SQL + " SELECT company, year, quarter, CAST(ROUND(CASE WHEN quarter = 1 THEN ytd WHEN LAG(quarter) OVER w = quarter - 1 THEN ytd - LAG(ytd) OVER w END, 4) AS DOUBLE) AS single FROM q WINDOW w AS (PARTITION BY company, year ORDER BY quarter)",
    "trailing_year": _QUARTERS_SQL + " SELECT q.company, q.year, q.quarter, CAST(ROUND(CASE WHEN q.quarter = 4 THEN q.ytd ELSE f.ytd + q.ytd - s.ytd END, 4) AS DOUBLE) AS trailing FROM q LEFT JOIN q f ON f.company = q.company AND f.year = q.year - 1 AND f.quarter = 4 LEFT JOIN q s ON s.company = q.company AND s.year = q.year - 1 AND s.quarter = q.quarter",
    "upsert_policies": f"WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment, c_acctbal AS balance, true AS old FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END AS name, lower(c_mktsegment) AS segment, c_acctbal - (c_custkey % 3 - 1) AS balance, true AS new FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT c_custkey, CASE WHEN new IS NULL THEN o.name WHEN old IS NULL THEN n.name ELSE COALESCE(nullif(n.name, ''), o.name) END AS name, CASE WHEN new IS NULL THEN o.segment WHEN old IS NULL THEN n.segment ELSE COALESCE(o.segment, n.segment) END AS segment, GREATEST(o.balance, n.balance) AS balance, o.name AS b_name, o.segment AS b_segment, o.balance AS b_balance, old, new FROM o FULL JOIN n USING (c_custkey)) SELECT c_custkey, name, segment, {_rs('balance', 2)} AS balance, CASE WHEN old IS NULL THEN 'inserted' WHEN new IS NULL OR (name IS NOT DISTINCT FROM b_name AND segment IS NOT DISTINCT FROM b_segment AND balance IS NOT DISTINCT FROM b_balance) THEN 'kept' ELSE 'updated' END AS change FROM u",
    "insert_or_ignore": "WITH e AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) SELECT event_type, count(*) AS inserted FROM e WHERE NOT (user_id % 2 = 0 AND event_type <> 'error') GROUP BY 1",
    "prune_newest": "SELECT user_id, count(*) AS n, min(event_id) AS low, CAST(SUM(event_id) AS BIGINT) AS checksum FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30) GROUP BY 1",
    "prune_stale": _FACTS_SQL + ", p AS (SELECT * FROM facts WHERE year >= 1998 AND company % 4 > 0 AND (company + year) % 5 > 0), w AS (SELECT company, min(year) AS low FROM p GROUP BY 1) SELECT f.company, count(*) AS n, CAST(SUM(f.year) AS BIGINT) AS years FROM facts f LEFT JOIN w ON w.company = f.company LEFT JOIN p ON p.company = f.company AND p.year = f.year WHERE w.low IS NULL OR f.year < w.low OR p.year IS NOT NULL GROUP BY 1",
    "json_props": "WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS parsed, CAST(SUM(k) AS BIGINT) AS total, MAX(k) AS most FROM k GROUP BY 1",
}
