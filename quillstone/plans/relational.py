"""Filters, joins, set operations, paging, top-k and as-of joins over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import asof, forward_fill, multiset_match, window_match
from ..operators.ordered import latest_per_key, top_with_others
from .star import FX_SQL, TRADES_SQL, closes, dbl, fx, table, trades

T = "WITH " + TRADES_SQL
TF = T + ", " + FX_SQL


def with_rate(t: DataFrame, spark: SparkSession) -> DataFrame:
    return asof(t, fx(spark), [("cur", "cur")], "trade_date", "eff", ["rate"])


def by_period(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    t = with_rate(trades(spark, d), spark)
    base = F.col("gross") * F.coalesce("rate", F.lit(1).cast("decimal(12,6)"))
    return t.groupBy(F.date_format("trade_date", pattern).alias("period"), "side").agg(F.count("*").alias("n"), dbl(F.sum(base)).alias("gross_base"), dbl(F.sum("fee")).alias("fee"))


_ASOF = "FROM trades t ASOF LEFT JOIN fx f ON t.cur = f.cur AND t.trade_date >= f.eff"
_PERIOD = TF + " SELECT strftime(t.trade_date, '{p}') AS period, side, count(*) AS n, CAST(ROUND(SUM(gross * COALESCE(rate, CAST(1 AS DECIMAL(12,6)))), 4) AS DOUBLE) AS gross_base, CAST(ROUND(SUM(fee), 4) AS DOUBLE) AS fee " + _ASOF + " GROUP BY 1, 2"


def trades_by_month(spark: SparkSession, d: str) -> DataFrame:
    return by_period(spark, d, "yyyy-MM")


def trades_by_year(spark: SparkSession, d: str) -> DataFrame:
    return by_period(spark, d, "yyyy")


def ledger_trades(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select("user_id", "cur", "account_id", "symbol", "side", dbl("qty").alias("qty"), dbl("gross").alias("gross"), dbl("fee").alias("fee"), F.col("trade_date").cast("string").alias("trade_date"))


def ledger_closes(spark: SparkSession, d: str) -> DataFrame:
    return closes(spark, d).select("symbol", F.col("d").cast("string").alias("d"), "close")


def txn_filter_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 50 of a filtered list, newest first; the page is the feature, the order is total."""
    t = trades(spark, d).where((F.col("user_id") == 1) & (F.col("side") == "BUY") & F.col("trade_date").between("1996-01-01", "1998-12-31"))
    order = [F.col(c).desc() for c in ("trade_date", "order_id", "line", "symbol", "supplier", "qty", "gross", "disc", "tax")]
    return t.orderBy(*order).offset(100).limit(50).select("order_id", "line", "symbol", dbl("gross").alias("gross"), F.col("trade_date").cast("string").alias("trade_date"))


def txn_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts for paging, also of the null account's bucket."""
    t = trades(spark, d).withColumn("account", F.expr("nullif(supplier % 4, 3)"))
    return t.groupBy("user_id", "account").agg(F.count("*").alias("n"), F.count("account").alias("assigned"))


def topk_others(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.sum("gross").alias("gross"))
    return top_with_others(t, "symbol", "gross", 30).select("symbol", dbl("gross").alias("gross"), "members")


def topk_abs(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "SELL", F.col("gross") - F.col("fee")).otherwise(-F.col("gross") - F.col("fee"))).alias("net"))
    return t.orderBy(F.abs("net").desc(), "symbol").limit(20).select("symbol", dbl("net").alias("net"))


def semi_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite-key IN: trades of the keys that were sold in large lots."""
    t = trades(spark, d)
    keys = t.where((F.col("side") == "SELL") & (F.col("qty") >= 48)).select("user_id", "symbol")
    return t.join(keys, ["user_id", "symbol"], "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), dbl(F.sum("qty")).alias("qty"))


def anti_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Keys bought but never sold."""
    t = trades(spark, d)
    sold = t.where("side = 'SELL'").select("user_id", "symbol")
    return t.where("side = 'BUY'").join(sold, ["user_id", "symbol"], "left_anti").groupBy("user_id").agg(F.countDistinct("symbol").alias("symbols"), F.count("*").alias("n"))


def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    """Reported against computed positions with a tolerance and four statuses."""
    t = trades(spark, d)
    computed = t.groupBy("user_id", "symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("computed"))
    reported = computed.where("symbol % 23 <> 0").select("user_id", "symbol", F.when(F.col("symbol") % 19 == 0, F.col("computed") + 1).otherwise(F.col("computed")).alias("reported")).unionByName(
        computed.where("symbol % 29 = 0").select("user_id", (-F.col("symbol")).alias("symbol"), F.col("computed").alias("reported"))
    )
    both = computed.join(reported, ["user_id", "symbol"], "full_outer")
    status = F.when(F.col("reported").isNull(), "missing_in_report").when(F.col("computed").isNull(), "missing_in_ledger").when(F.abs(F.col("reported") - F.col("computed")) <= 0.000001, "match").otherwise("mismatch")
    return both.groupBy("user_id", status.alias("status")).agg(F.count("*").alias("n"), dbl(F.sum(F.coalesce("reported", F.lit(0).cast("decimal(18,2)")) - F.coalesce("computed", F.lit(0).cast("decimal(18,2)")))).alias("delta"))


def union_keys(spark: SparkSession, d: str) -> DataFrame:
    """Traded and watched keys: distinct union, intersection and difference in one list."""
    t = trades(spark, d)
    held = t.where("user_id in (0, 1)").select("symbol").distinct()
    watched = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("symbol"))
    parts = {"union": held.union(watched).distinct(), "both": held.intersect(watched), "held_only": held.subtract(watched)}
    out = [df.agg(F.count("*").alias("n"), F.sum("symbol").alias("checksum")).select(F.lit(k).alias("part"), "n", "checksum") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def tiered_search(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue search: exact code, code prefix, name prefix, name contains; the best forty."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    code, name, q = F.col("p_partkey").cast("string"), F.lower("p_name"), "1"
    tier = F.when(code == q, 0).when(code.startswith(q), 1).when(name.startswith(q), 2).when(name.contains(q), 3)
    return p.withColumn("tier", tier).where("tier is not null").orderBy("tier", "p_partkey").limit(40)


def latest_trade(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c).desc() for c in ("trade_date", "order_id", "line", "supplier", "qty", "gross", "disc", "tax")]
    return latest_per_key(trades(spark, d), ["user_id", "symbol"], order).select("user_id", "symbol", "side", dbl("gross").alias("gross"), F.col("trade_date").cast("string").alias("trade_date"))


def keep_n(spark: SparkSession, d: str) -> DataFrame:
    """The newest three rows of each (user, symbol) counted by side."""
    order = [F.col(c).desc() for c in ("trade_date", "order_id", "line", "supplier", "qty", "gross", "disc", "tax")]
    return latest_per_key(trades(spark, d), ["user_id", "symbol"], order, 3).groupBy("user_id", "side").agg(F.count("*").alias("n"), dbl(F.sum("gross")).alias("gross"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return closes(spark, d).groupBy("symbol").agg(F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), F.count("*").alias("n"), (F.datediff(F.max("d"), F.min("d")) + 1 - F.count("*")).cast("int").alias("gaps"))


def market_share(spark: SparkSession, d: str) -> DataFrame:
    """Subtotals by market and their share of all; the window runs over the few subtotals."""
    from pyspark.sql import Window

    t = trades(spark, d).groupBy("user_id").agg(F.countDistinct("symbol").alias("symbols"), F.sum("gross").alias("value"))
    share = F.col("value").cast("double") / F.sum("value").over(Window.partitionBy()).cast("double")
    return t.select("user_id", "symbols", dbl("value").alias("value"), F.round(share, 6).alias("share"))


def nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """Users by their converted value, those without a rate at the end."""
    t = with_rate(trades(spark, d), spark)
    g = t.groupBy("user_id").agg(F.sum(F.col("gross") * F.col("rate")).alias("v"))
    return g.orderBy(F.col("v").desc_nulls_last(), "user_id").select("user_id", dbl("v").alias("v"))


def asof_fx_backward(spark: SparkSession, d: str) -> DataFrame:
    """Backward as-of with the fall-back to the newest rate for dates before the series."""
    t = with_rate(trades(spark, d), spark)
    newest = fx(spark).groupBy("cur").agg(F.max_by("rate", "eff").alias("newest"))
    t = t.join(F.broadcast(newest), "cur", "left")  # a handful of currencies
    rate = F.coalesce("rate", "newest")
    return t.groupBy("cur").agg(F.count("*").alias("n"), F.count("rate").alias("in_series"), F.count(rate).alias("converted"), dbl(F.sum(F.col("gross") * rate)).alias("base"))


def asof_fx_strict(spark: SparkSession, d: str) -> DataFrame:
    return with_rate(trades(spark, d), spark).groupBy("cur").agg(F.count("*").alias("n"), F.count("rate").alias("matched"), dbl(F.sum(F.col("gross") * F.col("rate"))).alias("base"))


def asof_fx_cross(spark: SparkSession, d: str) -> DataFrame:
    """Triangulation: to C4 through the base currency."""
    t = with_rate(trades(spark, d), spark)
    target = fx(spark).where("cur = 'C4'").select(F.lit(1).alias("one"), "eff", F.col("rate").alias("target"))
    t = asof(t.withColumn("one_key", F.lit(1)), target, [("one_key", "one")], "trade_date", "eff", ["target"])
    return t.groupBy("cur").agg(F.count("*").alias("n"), F.round(F.sum(F.col("gross").cast("double") * F.col("rate").cast("double") / F.col("target").cast("double")), 2).alias("in_c4"))


def ffill_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate in force on the first of every month, null before the series starts."""
    months = spark.sql("SELECT explode(sequence(date'1995-01-01', date'2001-12-01', interval 1 month)) AS d")
    curs = fx(spark).select("cur").distinct()
    points = months.join(curs.hint("broadcast"), F.lit(True)).select("cur", "d", F.lit(None).cast("decimal(12,6)").alias("rate"), F.lit(1).alias("grid"))
    both = points.unionByName(fx(spark).select("cur", F.col("eff").alias("d"), "rate", F.lit(0).alias("grid")))
    merged = both.groupBy("cur", "d").agg(F.max("rate").alias("rate"), F.max("grid").alias("grid"))
    return merged.withColumn("in_force", forward_fill(merged, ["cur"], "d", "rate")).where("grid = 1").select("cur", F.col("d").cast("string").alias("d"), F.col("in_force").cast("double").alias("rate"))


def prior_year_match(spark: SparkSession, d: str) -> DataFrame:
    """Monthly gross beside that of the same month one year earlier."""
    m = trades(spark, d).groupBy("user_id", F.trunc("trade_date", "MM").alias("m")).agg(F.sum("gross").alias("gross"))
    prior = m.select("user_id", F.add_months("m", 12).alias("m"), F.col("gross").alias("prior"))
    both = m.join(prior, ["user_id", "m"], "left")
    growth = F.try_divide(F.col("gross").cast("double") - F.col("prior").cast("double"), F.abs(F.col("prior").cast("double")))
    return both.select("user_id", F.col("m").cast("string").alias("m"), dbl("gross").alias("gross"), dbl("prior").alias("prior"), F.round(growth, 6).alias("growth"))


def _dividends(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).where(F.col("disc") >= 0.09)
    return t.select("user_id", "symbol", "order_id", "line", "supplier", F.date_add("trade_date", 14).alias("pay"), F.round(F.col("gross") * F.lit(0.01).cast("decimal(4,2)"), 2).cast("decimal(18,2)").alias("div"))


def date_window_match(spark: SparkSession, d: str) -> DataFrame:
    """Dividend payments matched to the nearest buy of the key from 3 days before to 30 days after."""
    div = _dividends(spark, d).withColumn("did", F.concat_ws("-", "order_id", "line", "symbol", "supplier", "pay")).groupBy("user_id", "symbol", "did", "pay").agg(F.max("div").alias("div"))
    buys = trades(spark, d).where("side = 'BUY'").groupBy("user_id", "symbol", "trade_date").agg(F.sum("qty").alias("bought"))
    met = window_match(div, buys, ["user_id", "symbol"], "did", "pay", "trade_date", 3, 30)
    return met.select("user_id", "symbol", "did", "gap", dbl("bought").alias("bought"))


def unique_match(spark: SparkSession, d: str) -> DataFrame:
    """As above, kept only where exactly one candidate exists."""
    div = _dividends(spark, d).withColumn("did", F.concat_ws("-", "order_id", "line", "symbol", "supplier", "pay")).groupBy("user_id", "symbol", "did", "pay").agg(F.max("div").alias("div"))
    buys = trades(spark, d).where("side = 'BUY'").groupBy("user_id", "symbol", "trade_date").agg(F.sum("qty").alias("bought"))
    met = window_match(div, buys, ["user_id", "symbol"], "did", "pay", "trade_date", 60, 60, require_unique=True)
    return met.select("user_id", "symbol", "did", "gap", dbl("bought").alias("bought"))


_DIV = T + """, div AS (SELECT user_id, symbol, concat_ws('-', order_id, line, symbol, supplier, trade_date + 14) AS did, CAST(trade_date + 14 AS DATE) AS pay
  FROM trades WHERE disc >= 0.09 GROUP BY ALL),
 buys AS (SELECT user_id, symbol, trade_date, SUM(qty) AS bought FROM trades WHERE side = 'BUY' GROUP BY ALL)"""


def suspected_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Multiset match: new statement rows against booked ones of the same key, counted, not only tested."""
    t = trades(spark, d)
    key = ["user_id", "symbol", "side", "qty"]
    new = t.where("order_id % 3 = 0").select(*key, "order_id", "line", "supplier", "gross")
    booked = t.where("order_id % 3 = 1").select(*key, F.col("order_id").alias("b_order"), F.col("line").alias("b_line"), F.col("supplier").alias("b_supplier"), F.col("gross").alias("b_gross"))
    met = multiset_match(new, booked, key, ["order_id", "line", "supplier", "gross"], ["b_order", "b_line", "b_supplier", "b_gross"])
    return met.groupBy("user_id").agg(F.count("*").alias("new_rows"), F.count("b_order").alias("suspected"), F.sum("b_order").alias("checksum"))


QUERIES = {
    "trades_by_month": trades_by_month, "trades_by_year": trades_by_year, "ledger_trades": ledger_trades, "ledger_closes": ledger_closes, "txn_filter_page": txn_filter_page,
    "txn_counts": txn_counts, "topk_others": topk_others, "topk_abs": topk_abs, "semi_keys": semi_keys, "anti_new_rows": anti_new_rows, "full_outer_diff": full_outer_diff,
    "union_keys": union_keys, "tiered_search": tiered_search, "latest_trade": latest_trade, "keep_n": keep_n, "coverage": coverage, "market_share": market_share, "nulls_last": nulls_last,
    "asof_fx_backward": asof_fx_backward, "asof_fx_strict": asof_fx_strict, "asof_fx_cross": asof_fx_cross, "ffill_rates": ffill_rates, "prior_year_match": prior_year_match,
    "date_window_match": date_window_match, "unique_match": unique_match, "suspected_duplicates": suspected_duplicates,
}

_D = "CAST(ROUND({}, 4) AS DOUBLE)".format
_NEWEST = "trade_date DESC, order_id DESC, line DESC, supplier DESC, qty DESC, gross DESC, disc DESC, tax DESC"
ORACLE = {
    "trades_by_month": _PERIOD.format(p="%Y-%m"),
    "trades_by_year": _PERIOD.format(p="%Y"),
    "ledger_trades": T + f" SELECT user_id, cur, account_id, symbol, side, {_D('qty')} AS qty, {_D('gross')} AS gross, {_D('fee')} AS fee, CAST(trade_date AS VARCHAR) AS trade_date FROM trades",
    "ledger_closes": "WITH closes AS (SELECT user_id % 50 AS symbol, CAST(ts AS DATE) AS d, max_by(value, struct_pack(a := ts, b := event_id)) AS close FROM events WHERE event_type IN ('click','view') GROUP BY ALL) SELECT symbol, CAST(d AS VARCHAR) AS d, close FROM closes",
    "txn_filter_page": T + f" SELECT order_id, line, symbol, {_D('gross')} AS gross, CAST(trade_date AS VARCHAR) AS trade_date FROM trades WHERE user_id = 1 AND side = 'BUY' AND trade_date BETWEEN '1996-01-01' AND '1998-12-31' ORDER BY trades.trade_date DESC, order_id DESC, line DESC, symbol DESC, supplier DESC, qty DESC, trades.gross DESC, disc DESC, tax DESC LIMIT 50 OFFSET 100",
    "txn_counts": T + " SELECT user_id, nullif(supplier % 4, 3) AS account, count(*) AS n, count(nullif(supplier % 4, 3)) AS assigned FROM trades GROUP BY 1, 2",
    "topk_others": T + f", g AS (SELECT CAST(symbol AS VARCHAR) AS symbol, SUM(gross) AS gross FROM trades GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY gross DESC, symbol) AS rn FROM g) SELECT CASE WHEN rn <= 30 THEN symbol ELSE 'others' END AS symbol, {_D('SUM(gross)')} AS gross, count(*) AS members FROM r GROUP BY 1",
    "topk_abs": T + f", g AS (SELECT symbol, SUM(CASE WHEN side = 'SELL' THEN gross - fee ELSE -gross - fee END) AS net FROM trades GROUP BY 1) SELECT symbol, {_D('net')} AS net FROM (SELECT * FROM g ORDER BY abs(net) DESC, symbol LIMIT 20)",
    "semi_keys": T + f" SELECT user_id, count(*) AS n, {_D('SUM(qty)')} AS qty FROM trades t WHERE EXISTS (SELECT 1 FROM trades s WHERE s.user_id = t.user_id AND s.symbol = t.symbol AND s.side = 'SELL' AND s.qty >= 48) GROUP BY 1",
    "anti_new_rows": T + " SELECT user_id, count(DISTINCT symbol) AS symbols, count(*) AS n FROM trades t WHERE side = 'BUY' AND NOT EXISTS (SELECT 1 FROM trades s WHERE s.user_id = t.user_id AND s.symbol = t.symbol AND s.side = 'SELL') GROUP BY 1",
    "full_outer_diff": T + f", c AS (SELECT user_id, symbol, SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS computed FROM trades GROUP BY ALL), r AS (SELECT user_id, symbol, CASE WHEN symbol % 19 = 0 THEN computed + 1 ELSE computed END AS reported FROM c WHERE symbol % 23 <> 0 UNION ALL SELECT user_id, -symbol, computed FROM c WHERE symbol % 29 = 0), b AS (SELECT COALESCE(c.user_id, r.user_id) AS user_id, computed, reported FROM c FULL JOIN r ON c.user_id = r.user_id AND c.symbol = r.symbol) SELECT user_id, CASE WHEN reported IS NULL THEN 'missing_in_report' WHEN computed IS NULL THEN 'missing_in_ledger' WHEN abs(reported - computed) <= 0.000001 THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n, {_D('SUM(COALESCE(reported, 0) - COALESCE(computed, 0))')} AS delta FROM b GROUP BY 1, 2",
    "union_keys": T + ", h AS (SELECT DISTINCT symbol FROM trades WHERE user_id IN (0, 1)), w AS (SELECT p_partkey AS symbol FROM part WHERE p_size <= 25) SELECT 'union' AS part, count(*) AS n, CAST(SUM(symbol) AS BIGINT) AS checksum FROM (SELECT * FROM h UNION SELECT * FROM w) UNION ALL SELECT 'both', count(*), CAST(SUM(symbol) AS BIGINT) FROM (SELECT * FROM h INTERSECT SELECT * FROM w) UNION ALL SELECT 'held_only', count(*), CAST(SUM(symbol) AS BIGINT) FROM (SELECT * FROM h EXCEPT SELECT * FROM w)",
    "tiered_search": "SELECT * FROM (SELECT p_partkey, p_name, CASE WHEN CAST(p_partkey AS VARCHAR) = '1' THEN 0 WHEN starts_with(CAST(p_partkey AS VARCHAR), '1') THEN 1 WHEN starts_with(lower(p_name), '1') THEN 2 WHEN contains(lower(p_name), '1') THEN 3 END AS tier FROM part) WHERE tier IS NOT NULL ORDER BY tier, p_partkey LIMIT 40",
    "latest_trade": T + f" SELECT user_id, symbol, side, {_D('gross')} AS gross, CAST(trade_date AS VARCHAR) AS trade_date FROM (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY {_NEWEST}) AS rn FROM trades) WHERE rn = 1",
    "keep_n": T + f" SELECT user_id, side, count(*) AS n, {_D('SUM(gross)')} AS gross FROM (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY {_NEWEST}) AS rn FROM trades) WHERE rn <= 3 GROUP BY 1, 2",
    "coverage": "WITH closes AS (SELECT DISTINCT user_id % 50 AS symbol, CAST(ts AS DATE) AS d FROM events WHERE event_type IN ('click','view')) SELECT symbol, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last, count(*) AS n, CAST(max(d) - min(d) + 1 - count(*) AS INTEGER) AS gaps FROM closes GROUP BY 1",
    "market_share": T + f", g AS (SELECT user_id, count(DISTINCT symbol) AS symbols, SUM(gross) AS v FROM trades GROUP BY 1) SELECT user_id, symbols, {_D('v')} AS value, ROUND(CAST(v AS DOUBLE) / CAST(SUM(v) OVER () AS DOUBLE), 6) AS share FROM g",
    "nulls_last": TF + f", g AS (SELECT user_id, SUM(gross * rate) AS s {_ASOF} GROUP BY 1) SELECT user_id, {_D('s')} AS v FROM g",
    "asof_fx_backward": TF + ", n AS (SELECT cur, max_by(rate, eff) AS newest FROM fx GROUP BY 1), j AS (SELECT t.cur, gross, rate " + _ASOF + f") SELECT j.cur, count(*) AS n, count(rate) AS in_series, count(COALESCE(rate, newest)) AS converted, {_D('SUM(gross * COALESCE(rate, newest))')} AS base FROM j LEFT JOIN n ON j.cur = n.cur GROUP BY 1",
    "asof_fx_strict": TF + f" SELECT t.cur AS cur, count(*) AS n, count(rate) AS matched, {_D('SUM(gross * rate)')} AS base {_ASOF} GROUP BY 1",
    "asof_fx_cross": TF + ", j AS (SELECT t.cur, t.trade_date, gross, rate " + _ASOF + "), x AS (SELECT eff, rate AS target FROM fx WHERE cur = 'C4') SELECT cur, count(*) AS n, ROUND(SUM(CAST(gross AS DOUBLE) * CAST(rate AS DOUBLE) / CAST(target AS DOUBLE)), 2) AS in_c4 FROM j ASOF LEFT JOIN x ON j.trade_date >= x.eff GROUP BY 1",
    "ffill_rates": "WITH " + FX_SQL + ", m AS (SELECT cur, CAST(d AS DATE) AS d FROM (SELECT DISTINCT cur FROM fx), generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH) g(d)) SELECT m.cur, CAST(m.d AS VARCHAR) AS d, CAST(rate AS DOUBLE) AS rate FROM m ASOF LEFT JOIN fx ON m.cur = fx.cur AND m.d >= fx.eff",
    "prior_year_match": T + f", m AS (SELECT user_id, CAST(date_trunc('month', trade_date) AS DATE) AS m, SUM(gross) AS gross FROM trades GROUP BY ALL) SELECT a.user_id, CAST(a.m AS VARCHAR) AS m, {_D('a.gross')} AS gross, {_D('b.gross')} AS prior, ROUND((CAST(a.gross AS DOUBLE) - CAST(b.gross AS DOUBLE)) / abs(CAST(b.gross AS DOUBLE)), 6) AS growth FROM m a LEFT JOIN m b ON a.user_id = b.user_id AND a.m = b.m + INTERVAL 12 MONTH",
    "date_window_match": _DIV + f" SELECT div.user_id, div.symbol, did, CAST(trade_date - pay AS INTEGER) AS gap, {_D('bought')} AS bought FROM div JOIN buys ON div.user_id = buys.user_id AND div.symbol = buys.symbol AND trade_date - pay BETWEEN -3 AND 30 QUALIFY row_number() OVER (PARTITION BY div.user_id, did ORDER BY abs(trade_date - pay), trade_date) = 1",
    "unique_match": _DIV + f" SELECT div.user_id, div.symbol, did, CAST(trade_date - pay AS INTEGER) AS gap, {_D('bought')} AS bought FROM div JOIN buys ON div.user_id = buys.user_id AND div.symbol = buys.symbol AND trade_date - pay BETWEEN -60 AND 60 QUALIFY count(*) OVER (PARTITION BY div.user_id, did) = 1",
    "suspected_duplicates": T + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol, side, qty ORDER BY order_id, line, supplier, gross) AS k FROM trades WHERE order_id % 3 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol, side, qty ORDER BY order_id, line, supplier, gross) AS k FROM trades WHERE order_id % 3 = 1) SELECT n.user_id, count(*) AS new_rows, count(b.order_id) AS suspected, CAST(SUM(b.order_id) AS BIGINT) AS checksum FROM n LEFT JOIN b ON n.user_id = b.user_id AND n.symbol = b.symbol AND n.side = b.side AND n.qty = b.qty AND n.k = b.k GROUP BY 1",
}
