"""Replays, FIFO, cost and performance over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import forward_fill
from ..operators.curve import return_curve as sweep
from ..operators.ordered import clamped_position, running
from ..operators.replay import average_cost, fifo, xirr
from .star import CLOSES_SQL, KEY, ORDER, ORDER_SQL, QUOTES_SQL, TRADES_SQL, closes, dbl, fills, trades

T = "WITH " + TRADES_SQL
#: Ratio actions as of mid-1998: some symbols split 1:2, others get a bonus of 3 for 10.
_FACTOR = "CASE WHEN symbol % 7 = 0 THEN 2.0 WHEN symbol % 11 = 0 THEN 1.3 ELSE 1.0 END"
_SPLIT_DAY = "1998-06-30"
R2 = 2


def cents(col):
    """Two digits, rounded from six as a decimal: engines differ in how they round a double at half a cent."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("decimal(28,6)"), R2).cast("double")


def signed(t: DataFrame):
    return F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))


def positions_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Quantity only, negative allowed."""
    t = trades(spark, d)
    return t.groupBy("user_id", "symbol").agg(dbl(F.sum(signed(t))).alias("qty"), F.count("*").alias("events"))


def positions_clamped(spark: SparkSession, d: str) -> DataFrame:
    """Running position that never falls below zero; per key its end and highest value."""
    t = trades(spark, d)
    p = clamped_position(signed(t), KEY, ORDER, t)
    return p.groupBy("user_id", "symbol").agg(dbl(F.max_by("position", F.struct(*ORDER))).alias("final"), dbl(F.max("position")).alias("peak"), dbl(F.sum("position")).alias("total"))


def positions_split_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Clamped positions in units before the split, turned into shares by the factor in force."""
    t = trades(spark, d).withColumn("factor", F.when(F.col("trade_date") > _SPLIT_DAY, F.expr(_FACTOR)).otherwise(F.lit(1.0)).cast("double"))
    t = t.withColumn("units", signed(t).cast("double") / F.col("factor"))
    p = clamped_position(F.col("units"), KEY, ORDER, t)
    last = p.groupBy("user_id", "symbol").agg(F.max_by("position", F.struct(*ORDER)).alias("units"))
    return last.select("user_id", "symbol", F.round(F.col("units") * F.expr(_FACTOR).cast("double"), 4).alias("shares"))


def first_oversell(spark: SparkSession, d: str) -> DataFrame:
    """The first sell of each key that asks for more than the clamped position holds."""
    t = trades(spark, d)
    p = clamped_position(signed(t), KEY, ORDER, t).withColumn("before", F.coalesce(F.lag("position").over(Window.partitionBy(*KEY).orderBy(*ORDER)), F.lit(0).cast("decimal(28,2)")))
    bad = p.where((F.col("side") == "SELL") & (F.col("qty") > F.col("before")))
    g = bad.groupBy("user_id", "symbol").agg(F.min_by(F.struct("trade_date", "qty", "before"), F.struct(*ORDER)).alias("e"), F.count("*").alias("n"))
    return g.select("user_id", "symbol", F.col("e.trade_date").cast("string").alias("first_date"), dbl("e.qty").alias("needed"), dbl("e.before").alias("available"), "n")


def avg_cost_holdings(spark: SparkSession, d: str) -> DataFrame:
    a = average_cost(trades(spark, d), KEY, ORDER)
    return a.select("user_id", "symbol", cents("qty").alias("qty"), cents("avg_cost").alias("avg_cost"), cents("total_cost").alias("total_cost"))


def fifo_state(spark: SparkSession, d: str) -> DataFrame:
    return fifo(trades(spark, d), KEY, ORDER)


def fifo_summary(spark: SparkSession, d: str) -> DataFrame:
    f = fifo_state(spark, d)
    add = lambda a, g: F.aggregate(a, F.lit(0.0), lambda s, x: s + g(x))
    return f.select(
        "user_id", "symbol", F.size("closed").alias("closed"), "skipped", cents(add("closed", lambda c: c["proceeds"] - c["cost"])).alias("realised"),
        cents(add("closed", lambda c: c["cost"])).alias("sold_cost"), cents(add("lots", lambda x: x["cost"])).alias("open_cost"), cents(add("lots", lambda x: x["qty"])).alias("open_qty"),
    )


def closed_trades(spark: SparkSession, d: str) -> DataFrame:
    return fifo_state(spark, d).select("user_id", "symbol", F.explode("closed").alias("c")).select("user_id", "symbol", "c.*")


def fifo_closed_trades(spark: SparkSession, d: str) -> DataFrame:
    c = closed_trades(spark, d)
    return c.select("user_id", "symbol", F.col("date").cast("string").alias("date"), cents("qty").alias("qty"), cents("proceeds").alias("proceeds"), cents("cost").alias("cost"), F.datediff("date", "first_date").alias("holding_days"))


def fifo_open_lots(spark: SparkSession, d: str) -> DataFrame:
    o = fifo_state(spark, d).select("user_id", "symbol", F.posexplode("lots").alias("lot", "x"))
    return o.select("user_id", "symbol", "lot", cents("x.qty").alias("qty"), cents("x.cost").alias("cost"), F.col("x.date").cast("string").alias("date"))


def fifo_overlap(spark: SparkSession, d: str) -> DataFrame:
    """FIFO without a fold: sells and buys of a key overlap in their ranges of cumulative quantity.

    Holds for keys whose sells never exceed what is there.
    """
    t = trades(spark, d)
    run = t.withColumn("free", F.sum(signed(t)).over(running(KEY, ORDER)))
    fine = run.groupBy("user_id", "symbol").agg(F.min("free").alias("low")).where("low >= 0").select("user_id", "symbol")
    t = t.join(fine, KEY, "left_semi")
    w = running(KEY, ORDER)
    side = lambda s: t.where(F.col("side") == s).withColumn("hi", F.sum("qty").over(w)).withColumn("lo", F.col("hi") - F.col("qty"))
    b = side("BUY").select(*KEY, F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), (F.col("gross") + F.col("fee")).cast("double").alias("b_cost"), F.col("qty").cast("double").alias("b_qty"))
    s = side("SELL").select(*KEY, F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    m = s.join(b, KEY).where((F.col("b_lo") < F.col("s_hi")) & (F.col("b_hi") > F.col("s_lo")))
    part = (F.least("b_hi", "s_hi") - F.greatest("b_lo", "s_lo")).cast("double")
    return m.groupBy("user_id").agg(F.count("*").alias("pairs"), F.round(F.sum(part), R2).alias("qty"), F.round(F.sum(F.col("b_cost") * part / F.col("b_qty")), R2).alias("cost"))


def realized_pnl(spark: SparkSession, d: str) -> DataFrame:
    c = closed_trades(spark, d)
    return c.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("proceeds") - F.col("cost")), R2).alias("pnl"), F.round(F.sum("cost"), R2).alias("cost"), F.round(F.sum(F.col("proceeds") - F.col("cost")) / F.sum("cost"), 6).alias("rate"))


def trade_skill(spark: SparkSession, d: str) -> DataFrame:
    """Win rate, mean win and loss, profit factor, expectancy; trades without profit or loss count nowhere."""
    c = closed_trades(spark, d).withColumn("pnl", F.col("proceeds") - F.col("cost"))
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, -F.col("pnl"))
    g = c.groupBy("user_id").agg(F.count(win).alias("wins"), F.count(loss).alias("losses"), F.avg(win).alias("w"), F.avg(loss).alias("l"), F.sum(win).alias("sw"), F.sum(loss).alias("sl"))
    n = F.col("wins") + F.col("losses")
    return g.select("user_id", "wins", "losses", F.round(F.try_divide("wins", n), 6).alias("win_rate"), F.round("w", R2).alias("avg_win"), F.round("l", R2).alias("avg_loss"), F.round(F.try_divide("sw", "sl"), 6).alias("profit_factor"), F.round(F.try_divide(F.coalesce("sw", F.lit(0.0)) - F.coalesce("sl", F.lit(0.0)), n), R2).alias("expectancy"))


def cost_by_market(spark: SparkSession, d: str) -> DataFrame:
    a = average_cost(trades(spark, d), KEY, ORDER).where("qty > 0")
    return a.groupBy("user_id").agg(F.count("*").alias("holdings"), F.round(F.sum("total_cost"), R2).alias("cost"), F.round(F.sum("qty"), R2).alias("qty"))


def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d)
    money = lambda s, e: F.sum(F.when(F.col("side") == s, e))
    g = t.groupBy("user_id").agg(
        F.countDistinct("symbol").alias("symbols"), F.count(F.when(F.col("side") == "BUY", 1)).alias("buys"), F.count(F.when(F.col("side") == "SELL", 1)).alias("sells"),
        dbl(money("BUY", F.col("gross") + F.col("fee"))).alias("paid"), dbl(money("SELL", F.col("gross") - F.col("fee"))).alias("received"), F.min("trade_date").cast("string").alias("first"), F.max("trade_date").cast("string").alias("last"),
    )
    return g


def dividend_summary(spark: SparkSession, d: str) -> DataFrame:
    """Gross, tax and net of received dividends; line 7 is unverified and doesn't count."""
    t = trades(spark, d).where((F.col("disc") >= 0.09) & (F.col("line") != 7))
    gross = F.round(F.col("gross") * F.lit(0.01).cast("decimal(4,2)"), 2).cast("decimal(18,2)")
    tax = F.round(gross * F.lit(0.1).cast("decimal(4,2)"), 2).cast("decimal(18,2)")
    return t.groupBy("user_id", F.year(F.date_add("trade_date", 14)).alias("year")).agg(F.count("*").alias("n"), dbl(F.sum(gross)).alias("gross"), dbl(F.sum(tax)).alias("tax"), dbl(F.sum(gross - tax)).alias("net"))


def invested_peak(spark: SparkSession, d: str) -> DataFrame:
    """Running net invested money by day and its highest value."""
    t = trades(spark, d)
    flow = F.when(F.col("side") == "BUY", F.col("gross") + F.col("fee")).otherwise(F.col("fee") - F.col("gross"))
    day = t.groupBy("user_id", "trade_date").agg(F.sum(flow).alias("flow"))
    w = running(["user_id"], ["trade_date"])
    return day.withColumn("invested", F.sum("flow").over(w)).groupBy("user_id").agg(dbl(F.max("invested")).alias("peak"), dbl(F.max_by("invested", "trade_date")).alias("last"))


def curve(spark: SparkSession, d: str) -> DataFrame:
    """Daily value, flows and return of the event-driven ledger: clamped positions at the last known price."""
    none = lambda kind: F.lit(None).cast(kind)
    place = F.when(F.col("side") == "BUY", 1).otherwise(3)
    e = fills(spark, d).select(F.lit(0).alias("u"), "symbol", F.lit("C0").alias("cur"), "d", place.alias("place"), F.col("event_id").alias("id"), F.col("side").alias("kind"), F.col("qty").alias("q"), (F.col("qty") * F.col("price")).alias("c"), none("double").alias("num"), none("double").alias("den"), F.col("price").alias("p"))
    return sweep(e, closes(spark, d), users=["u"]).drop("u")


def return_curve(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d).select(F.col("d").cast("string").alias("d"), F.round("mv", R2).alias("mv"), F.round("inflow", R2).alias("inflow"), F.round("outflow", R2).alias("outflow"), F.round("r", 6).alias("r"), F.round(F.col("factor") - 1, 6).alias("cumulative"))


def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d).select(F.col("d").cast("string").alias("d"), F.round("drawdown", 6).alias("drawdown"))


def risk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Total and yearly return, volatility, Sharpe, Sortino, Calmar, worst drawdown; years of 365.25 days, no risk-free rate."""
    c = curve(spark, d)
    g = c.agg(F.count("r").alias("n"), F.max_by("factor", "d").alias("f"), F.datediff(F.max("d"), F.min("d")).alias("span"), F.stddev_samp("r").alias("sd"), F.avg("r").alias("m"), F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(0.0)).alias("down"), F.min("drawdown").alias("dd"))
    ppy = F.lit(365.25) * F.col("n") / F.col("span")
    ann = F.pow("f", F.lit(365.25) / F.col("span")) - 1
    return g.select(F.round(F.col("f") - 1, 6).alias("total"), F.round(ann, 5).alias("annual"), F.round(F.col("sd") * F.sqrt(ppy), 6).alias("volatility"), F.round(F.col("m") * ppy / (F.col("sd") * F.sqrt(ppy)), 6).alias("sharpe"), F.round(F.col("m") * ppy / (F.sqrt(F.col("down") / F.col("n")) * F.sqrt(ppy)), 6).alias("sortino"), F.round("dd", 6).alias("max_drawdown"), F.col("span").cast("int").alias("span"))


def benchmark_series(spark: SparkSession, d: str) -> DataFrame:
    """Symbol 0's closes relative to the first one, carried forward over the calendar."""
    c = closes(spark, d)
    g = c.select("d").distinct().join(c.where("symbol = 0").select("d", "close"), "d", "left").withColumn("one", F.lit(1))
    g = g.withColumn("level", forward_fill(g, ["one"], "d", "close"))
    first = F.first("level", ignorenulls=True).over(Window.partitionBy("one").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return g.select(F.col("d").cast("string").alias("d"), F.round(F.col("level") / first - 1, 6).alias("r"))


def month_end(spark: SparkSession, d: str) -> DataFrame:
    """The last day of each month of every user's invested money."""
    t = trades(spark, d)
    flow = F.when(F.col("side") == "BUY", F.col("gross") + F.col("fee")).otherwise(F.col("fee") - F.col("gross"))
    day = t.groupBy("user_id", "trade_date").agg(F.sum(flow).alias("flow")).withColumn("invested", F.sum("flow").over(running(["user_id"], ["trade_date"])))
    nxt = F.lead("trade_date").over(Window.partitionBy("user_id").orderBy("trade_date"))
    ends = day.withColumn("next", nxt).where(F.col("next").isNull() | (F.trunc("next", "MM") != F.trunc("trade_date", "MM")))
    return ends.select("user_id", F.col("trade_date").cast("string").alias("d"), dbl("invested").alias("invested"))


def period_pnl(spark: SparkSession, d: str) -> DataFrame:
    """Flows of each calendar year and their balance so far, by user; `curve_periods` adds the change of the book."""
    t = trades(spark, d)
    g = t.groupBy("user_id", F.year("trade_date").alias("year")).agg(F.sum(F.when(F.col("side") == "BUY", F.col("gross") + F.col("fee"))).alias("inflow"), F.sum(F.when(F.col("side") == "SELL", F.col("gross") - F.col("fee"))).alias("outflow"))
    w = running(["user_id"], ["year"])
    return g.select("user_id", "year", dbl("inflow").alias("inflow"), dbl("outflow").alias("outflow"), dbl(F.sum(F.coalesce("outflow", F.lit(0).cast("decimal(18,2)")) - F.coalesce("inflow", F.lit(0).cast("decimal(18,2)"))).over(w)).alias("cumulative"))


def money_weighted(spark: SparkSession, d: str) -> DataFrame:
    """XIRR of each user: yearly flows, and the paid money valued 10 % higher on the last day."""
    t = trades(spark, d)
    flow = F.when(F.col("side") == "BUY", -(F.col("gross") + F.col("fee"))).otherwise(F.col("gross") - F.col("fee")).cast("double")
    yearly = t.groupBy("user_id", F.trunc("trade_date", "YEAR").alias("d")).agg(F.sum(flow).alias("amount"))
    final = yearly.groupBy("user_id").agg(F.sum("amount").alias("amount")).select("user_id", F.lit("2002-01-01").cast("date").alias("d"), (-F.col("amount") * 1.1).alias("amount"))
    return xirr(yearly.unionByName(final), ["user_id"]).select("user_id", F.round("xirr", 6).alias("xirr"))


QUERIES = {
    "positions_lenient": positions_lenient, "positions_clamped": positions_clamped, "positions_split_adjusted": positions_split_adjusted, "first_oversell": first_oversell,
    "avg_cost_holdings": avg_cost_holdings, "fifo_summary": fifo_summary, "fifo_closed_trades": fifo_closed_trades, "fifo_open_lots": fifo_open_lots, "fifo_overlap": fifo_overlap,
    "realized_pnl": realized_pnl, "trade_skill": trade_skill, "cost_by_market": cost_by_market, "portfolio_summary": portfolio_summary,
    "dividend_summary": dividend_summary, "invested_peak": invested_peak, "return_curve": return_curve, "drawdown": drawdown, "risk_metrics": risk_metrics,
    "benchmark_series": benchmark_series, "month_end": month_end, "period_pnl": period_pnl, "xirr": money_weighted,
}

_D = "CAST(ROUND({}, 4) AS DOUBLE)".format
_W = f"OVER (PARTITION BY user_id, symbol ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)"
_SIGN = "CASE WHEN side = 'BUY' THEN qty ELSE -qty END"
_WALK = T + f", f AS (SELECT *, SUM({_SIGN}) {_W} AS free FROM trades), p AS (SELECT *, free - LEAST(0, MIN(free) {_W}) AS pos FROM f)"
_LAST = "struct_pack(" + ", ".join(f"{c} := {c}" for c in ORDER) + ")"
#: FIFO with whole over-sells skipped, one event after the other with lots as two lists.
_FIFO = "WITH RECURSIVE " + TRADES_SQL + f""",
 ev AS (SELECT user_id, symbol, side, CAST(qty AS DOUBLE) AS q, CAST(gross AS DOUBLE) AS g, CAST(fee AS DOUBLE) AS f, trade_date AS d, row_number() OVER (PARTITION BY user_id, symbol ORDER BY {ORDER_SQL}) AS rn FROM trades),
 st AS (
  SELECT DISTINCT user_id, symbol, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS lq, CAST([] AS DOUBLE[]) AS lc, CAST([] AS DATE[]) AS ld, 0 AS act, CAST(NULL AS DATE) AS d, CAST(0 AS DOUBLE) AS q, CAST(0 AS DOUBLE) AS proceeds, CAST(0 AS DOUBLE) AS cost, CAST(NULL AS DATE) AS first_date FROM ev
  UNION ALL
  SELECT user_id, symbol, rn,
   CASE act WHEN 1 THEN list_append(lq, q) WHEN 3 THEN lq ELSE list_transform(keep, lambda i: lq[i] - tk[i]) END,
   CASE act WHEN 1 THEN list_append(lc, g + f) WHEN 3 THEN lc ELSE list_transform(keep, lambda i: lc[i] * (1 - tk[i] / lq[i])) END,
   CASE act WHEN 1 THEN list_append(ld, d) WHEN 3 THEN ld ELSE list_transform(keep, lambda i: ld[i]) END,
   act, d, q, g - f, CASE WHEN act = 2 THEN list_sum(list_transform(range(1, len(lq) + 1), lambda i: lc[i] * (tk[i] / lq[i]))) ELSE 0 END, ld[1]
  FROM (SELECT *, list_filter(range(1, len(lq) + 1), lambda i: lq[i] - tk[i] > 1e-9) AS keep FROM (
    SELECT e.user_id, e.symbol, e.rn, e.q, e.g, e.f, e.d, s.lq, s.lc, s.ld,
     CASE WHEN e.side = 'BUY' THEN 1 WHEN e.q > COALESCE(list_sum(s.lq), 0) + 1e-9 THEN 3 ELSE 2 END AS act,
     list_transform(range(1, len(s.lq) + 1), lambda i: GREATEST(0, LEAST(s.lq[i], e.q - COALESCE(list_sum(s.lq[1:i-1]), 0)))) AS tk
    FROM st s JOIN ev e ON e.user_id = s.user_id AND e.symbol = s.symbol AND e.rn = s.rn + 1)))"""
_CLOSED = _FIFO + ", c AS (SELECT *, proceeds - cost AS pnl FROM st WHERE act = 2)"
_AVG = "WITH RECURSIVE " + TRADES_SQL + f""",
 ev AS (SELECT user_id, symbol, side, CAST(qty AS DOUBLE) AS q, CAST(gross AS DOUBLE) AS g, CAST(fee AS DOUBLE) AS f, row_number() OVER (PARTITION BY user_id, symbol ORDER BY {ORDER_SQL}) AS rn FROM trades),
 st AS (SELECT DISTINCT user_id, symbol, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS cost FROM ev
  UNION ALL SELECT e.user_id, e.symbol, e.rn, CASE WHEN side = 'BUY' THEN qty + q ELSE qty - LEAST(q, qty) END, CASE WHEN side = 'BUY' THEN cost + g + f WHEN qty > 0 THEN cost * ((qty - LEAST(q, qty)) / qty) ELSE 0 END
  FROM st s JOIN ev e ON e.user_id = s.user_id AND e.symbol = s.symbol AND e.rn = s.rn + 1),
 a AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY rn DESC) = 1)"""
_CURVE = "WITH " + CLOSES_SQL + ", " + QUOTES_SQL + """,
 s AS (SELECT *, SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) OVER w AS free FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY d, side, event_id ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, free - LEAST(0, MIN(free) OVER (PARTITION BY symbol ORDER BY d, side, event_id ROWS UNBOUNDED PRECEDING)) AS pos FROM s),
 m AS (SELECT *, COALESCE(LAG(pos) OVER (PARTITION BY symbol ORDER BY d, side, event_id), 0) AS prior FROM p),
 dy AS (SELECT symbol, d, max_by(pos, struct_pack(a := side, b := event_id)) AS pos, SUM(CASE WHEN side = 'BUY' THEN qty * price END) AS inflow, SUM(CASE WHEN side = 'SELL' THEN (prior - pos) * price END) AS outflow, max_by(price, struct_pack(a := side, b := event_id)) AS traded FROM m GROUP BY ALL),
 grid AS (SELECT d FROM closes UNION SELECT d FROM dy),
 pt AS (SELECT y.symbol, grid.d, dy.pos, inflow, outflow, COALESCE(closes.close, traded) AS price FROM (SELECT DISTINCT symbol FROM dy) y CROSS JOIN grid LEFT JOIN dy ON dy.symbol = y.symbol AND dy.d = grid.d LEFT JOIN closes ON closes.symbol = y.symbol AND closes.d = grid.d),
 h AS (SELECT *, last_value(pos IGNORE NULLS) OVER v AS position, last_value(price IGNORE NULLS) OVER v AS last_price FROM pt WINDOW v AS (PARTITION BY symbol ORDER BY d ROWS UNBOUNDED PRECEDING)),
 days AS (SELECT d, SUM(COALESCE(position * last_price, 0)) AS mv, SUM(COALESCE(inflow, 0)) AS inflow, SUM(COALESCE(outflow, 0)) AS outflow FROM h GROUP BY d),
 b AS (SELECT *, COALESCE(LAG(mv) OVER (ORDER BY d), 0) + inflow AS base FROM days),
 r AS (SELECT *, CASE WHEN base > 0 THEN (mv + outflow) / base - 1 END AS r FROM b),
 c AS (SELECT *, exp(SUM(ln(1 + COALESCE(r, 0))) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS factor FROM r),
 k AS (SELECT *, factor / GREATEST(1, MAX(factor) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM c)"""
_FLOW = "CASE WHEN side = 'BUY' THEN gross + fee ELSE fee - gross END"
ORACLE = {
    "positions_lenient": T + f" SELECT user_id, symbol, {_D('SUM(' + _SIGN + ')')} AS qty, count(*) AS events FROM trades GROUP BY 1, 2",
    "positions_clamped": _WALK + f" SELECT user_id, symbol, {_D('max_by(pos, ' + _LAST + ')')} AS final, {_D('MAX(pos)')} AS peak, {_D('SUM(pos)')} AS total FROM p GROUP BY 1, 2",
    "positions_split_adjusted": T + f", u AS (SELECT *, CAST({_SIGN} AS DOUBLE) / CAST(CASE WHEN trade_date > '{_SPLIT_DAY}' THEN {_FACTOR} ELSE 1.0 END AS DOUBLE) AS units FROM trades), f AS (SELECT *, SUM(units) {_W} AS free FROM u), p AS (SELECT *, free - LEAST(0, MIN(free) {_W}) AS pos FROM f) SELECT user_id, symbol, ROUND(max_by(pos, {_LAST}) * CAST({_FACTOR} AS DOUBLE), 4) AS shares FROM p GROUP BY 1, 2",
    "first_oversell": _WALK + f", l AS (SELECT *, COALESCE(LAG(pos) OVER (PARTITION BY user_id, symbol ORDER BY {ORDER_SQL}), 0) AS before FROM p) SELECT user_id, symbol, CAST(min_by(trade_date, {_LAST}) AS VARCHAR) AS first_date, {_D('min_by(qty, ' + _LAST + ')')} AS needed, {_D('min_by(before, ' + _LAST + ')')} AS available, count(*) AS n FROM l WHERE side = 'SELL' AND qty > before GROUP BY 1, 2",
    "avg_cost_holdings": _AVG + " SELECT user_id, symbol, CAST(ROUND(CAST(qty AS DECIMAL(28,6)), 2) AS DOUBLE) AS qty, CAST(ROUND(CAST(CASE WHEN qty > 0 THEN cost / qty END AS DECIMAL(28,6)), 2) AS DOUBLE) AS avg_cost, CAST(ROUND(CAST(cost AS DECIMAL(28,6)), 2) AS DOUBLE) AS total_cost FROM a",
    "cost_by_market": _AVG + " SELECT user_id, count(*) AS holdings, ROUND(SUM(cost), 2) AS cost, ROUND(SUM(qty), 2) AS qty FROM a WHERE qty > 0 GROUP BY 1",
    "fifo_summary": _FIFO + ", l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY rn DESC) = 1), g AS (SELECT user_id, symbol, CAST(count(*) FILTER (act = 2) AS INTEGER) AS closed, CAST(count(*) FILTER (act = 3) AS INTEGER) AS skipped, CAST(ROUND(CAST(COALESCE(SUM(proceeds - cost) FILTER (act = 2), 0) AS DECIMAL(28,6)), 2) AS DOUBLE) AS realised, CAST(ROUND(CAST(COALESCE(SUM(cost) FILTER (act = 2), 0) AS DECIMAL(28,6)), 2) AS DOUBLE) AS sold_cost FROM st GROUP BY 1, 2) SELECT g.*, CAST(ROUND(CAST(COALESCE(list_sum(lc), 0) AS DECIMAL(28,6)), 2) AS DOUBLE) AS open_cost, CAST(ROUND(CAST(COALESCE(list_sum(lq), 0) AS DECIMAL(28,6)), 2) AS DOUBLE) AS open_qty FROM g JOIN l ON g.user_id = l.user_id AND g.symbol = l.symbol",
    "fifo_closed_trades": _CLOSED + " SELECT user_id, symbol, CAST(d AS VARCHAR) AS date, CAST(ROUND(CAST(q AS DECIMAL(28,6)), 2) AS DOUBLE) AS qty, CAST(ROUND(CAST(proceeds AS DECIMAL(28,6)), 2) AS DOUBLE) AS proceeds, CAST(ROUND(CAST(cost AS DECIMAL(28,6)), 2) AS DOUBLE) AS cost, CAST(d - first_date AS INTEGER) AS holding_days FROM c",
    "fifo_open_lots": _FIFO + ", l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY rn DESC) = 1), x AS (SELECT *, unnest(range(1, len(lq) + 1)) AS i FROM l) SELECT user_id, symbol, CAST(i - 1 AS INTEGER) AS lot, CAST(ROUND(CAST(lq[i] AS DECIMAL(28,6)), 2) AS DOUBLE) AS qty, CAST(ROUND(CAST(lc[i] AS DECIMAL(28,6)), 2) AS DOUBLE) AS cost, CAST(ld[i] AS VARCHAR) AS date FROM x",
    "fifo_overlap": T + f", f AS (SELECT *, SUM({_SIGN}) {_W} AS free FROM trades), ok AS (SELECT user_id, symbol FROM f GROUP BY 1, 2 HAVING MIN(free) >= 0), t AS (SELECT trades.* FROM trades JOIN ok USING (user_id, symbol)), b AS (SELECT *, SUM(qty) {_W} AS hi FROM t WHERE side = 'BUY'), s AS (SELECT *, SUM(qty) {_W} AS hi FROM t WHERE side = 'SELL'), m AS (SELECT s.user_id, CAST(LEAST(b.hi, s.hi) - GREATEST(b.hi - b.qty, s.hi - s.qty) AS DOUBLE) AS part, CAST(b.gross + b.fee AS DOUBLE) AS cost, CAST(b.qty AS DOUBLE) AS bq FROM s JOIN b ON s.user_id = b.user_id AND s.symbol = b.symbol AND b.hi - b.qty < s.hi AND b.hi > s.hi - s.qty) SELECT user_id, count(*) AS pairs, ROUND(SUM(part), 2) AS qty, ROUND(SUM(cost * part / bq), 2) AS cost FROM m GROUP BY 1",
    "realized_pnl": _CLOSED + " SELECT user_id, count(*) AS n, ROUND(SUM(pnl), 2) AS pnl, ROUND(SUM(cost), 2) AS cost, ROUND(SUM(pnl) / SUM(cost), 6) AS rate FROM c GROUP BY 1",
    "trade_skill": _CLOSED + ", g AS (SELECT user_id, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, AVG(pnl) FILTER (pnl > 0) AS w, AVG(-pnl) FILTER (pnl < 0) AS l, SUM(pnl) FILTER (pnl > 0) AS sw, SUM(-pnl) FILTER (pnl < 0) AS sl FROM c GROUP BY 1) SELECT user_id, wins, losses, ROUND(wins / (wins + losses), 6) AS win_rate, ROUND(w, 2) AS avg_win, ROUND(l, 2) AS avg_loss, ROUND(sw / sl, 6) AS profit_factor, ROUND((COALESCE(sw, 0) - COALESCE(sl, 0)) / (wins + losses), 2) AS expectancy FROM g",
    "portfolio_summary": T + f" SELECT user_id, count(DISTINCT symbol) AS symbols, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, {_D('''SUM(gross + fee) FILTER (side = 'BUY')''')} AS paid, {_D('''SUM(gross - fee) FILTER (side = 'SELL')''')} AS received, CAST(MIN(trade_date) AS VARCHAR) AS first, CAST(MAX(trade_date) AS VARCHAR) AS last FROM trades GROUP BY 1",
    "dividend_summary": T + f", v AS (SELECT user_id, trade_date, CAST(ROUND(gross * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS g FROM trades WHERE disc >= 0.09 AND line <> 7), x AS (SELECT *, CAST(ROUND(g * CAST(0.1 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS x FROM v) SELECT user_id, CAST(year(trade_date + 14) AS INTEGER) AS year, count(*) AS n, {_D('SUM(g)')} AS gross, {_D('SUM(x)')} AS tax, {_D('SUM(g - x)')} AS net FROM x GROUP BY 1, 2",
    "invested_peak": T + f", y AS (SELECT user_id, trade_date, SUM({_FLOW}) AS flow FROM trades GROUP BY ALL), i AS (SELECT *, SUM(flow) OVER (PARTITION BY user_id ORDER BY trade_date) AS invested FROM y) SELECT user_id, {_D('MAX(invested)')} AS peak, {_D('max_by(invested, trade_date)')} AS last FROM i GROUP BY 1",
    "return_curve": _CURVE + " SELECT CAST(d AS VARCHAR) AS d, ROUND(mv, 2) AS mv, ROUND(inflow, 2) AS inflow, ROUND(outflow, 2) AS outflow, ROUND(r, 6) AS r, ROUND(factor - 1, 6) AS cumulative FROM k",
    "drawdown": _CURVE + " SELECT CAST(d AS VARCHAR) AS d, ROUND(drawdown, 6) AS drawdown FROM k",
    "risk_metrics": _CURVE + ", g AS (SELECT count(r) AS n, max_by(factor, d) AS f, MAX(d) - MIN(d) AS span, stddev_samp(r) AS sd, AVG(r) AS m, SUM(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS down, MIN(drawdown) AS dd FROM k), py AS (SELECT *, 365.25::DOUBLE * n / span AS ppy FROM g) SELECT ROUND(f - 1, 6) AS total, ROUND(pow(f, 365.25::DOUBLE / span) - 1, 5) AS annual, ROUND(sd * sqrt(ppy), 6) AS volatility, ROUND(m * ppy / (sd * sqrt(ppy)), 6) AS sharpe, ROUND(m * ppy / (sqrt(down / n) * sqrt(ppy)), 6) AS sortino, ROUND(dd, 6) AS max_drawdown, CAST(span AS INTEGER) AS span FROM py",
    "benchmark_series": "WITH " + CLOSES_SQL + ", g AS (SELECT y.d, close FROM (SELECT DISTINCT d FROM closes) y LEFT JOIN closes ON closes.d = y.d AND symbol = 0), l AS (SELECT d, last_value(close IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS level FROM g) SELECT CAST(d AS VARCHAR) AS d, ROUND(level / first_value(level IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 1, 6) AS r FROM l",
    "month_end": T + f", y AS (SELECT user_id, trade_date, SUM({_FLOW}) AS flow FROM trades GROUP BY ALL), i AS (SELECT *, SUM(flow) OVER (PARTITION BY user_id ORDER BY trade_date) AS invested, LEAD(trade_date) OVER (PARTITION BY user_id ORDER BY trade_date) AS nxt FROM y) SELECT user_id, CAST(trade_date AS VARCHAR) AS d, {_D('invested')} AS invested FROM i WHERE nxt IS NULL OR date_trunc('month', nxt) <> date_trunc('month', trade_date)",
    "period_pnl": T + f", g AS (SELECT user_id, CAST(year(trade_date) AS INTEGER) AS year, SUM(gross + fee) FILTER (side = 'BUY') AS i, SUM(gross - fee) FILTER (side = 'SELL') AS o FROM trades GROUP BY 1, 2) SELECT user_id, year, {_D('i')} AS inflow, {_D('o')} AS outflow, {_D('SUM(COALESCE(o, 0) - COALESCE(i, 0)) OVER (PARTITION BY user_id ORDER BY year)')} AS cumulative FROM g",
    "xirr": "WITH RECURSIVE " + TRADES_SQL + """, y AS (SELECT user_id, CAST(date_trunc('year', trade_date) AS DATE) AS d, SUM(CAST(CASE WHEN side = 'BUY' THEN -(gross + fee) ELSE gross - fee END AS DOUBLE)) AS a FROM trades GROUP BY 1, 2),
     fl AS (SELECT * FROM y UNION ALL SELECT user_id, DATE '2002-01-01', -SUM(a) * 1.1 FROM y GROUP BY 1),
     g AS (SELECT user_id, list(struct_pack(t := (d - s) / 365.25::DOUBLE, a := a)) AS fs FROM (SELECT *, MIN(d) OVER (PARTITION BY user_id) AS s FROM fl) GROUP BY 1),
     it AS (SELECT user_id, fs, 0 AS k, ln(1e-4::DOUBLE) AS lo, ln(1e6::DOUBLE) AS hi, sign(list_sum(list_transform(fs, lambda f: f.a * exp(-ln(1e-4::DOUBLE) * f.t)))) AS sg FROM g
      UNION ALL SELECT user_id, fs, k + 1, CASE WHEN down THEN (lo + hi) / 2 ELSE lo END, CASE WHEN down THEN hi ELSE (lo + hi) / 2 END, sg FROM (SELECT *, (list_sum(list_transform(fs, lambda f: f.a * exp(-(lo + hi) / 2 * f.t))) > 0) = (sg > 0) AS down FROM it WHERE k < 100))
     SELECT user_id, ROUND(CASE WHEN sg <> sign(list_sum(list_transform(fs, lambda f: f.a * exp(-ln(1e6::DOUBLE) * f.t)))) THEN exp((lo + hi) / 2) - 1 END, 6) AS xirr FROM it WHERE k = 100""",
}
