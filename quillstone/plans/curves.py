"""Return curves of portfolios in several currencies, with openings, actions and arrivals; and the SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curve as cv
from .star import CLOSES_SQL, closes, table

# The range, rates to the base currency and a yearly risk-free rate in percent.
START, END, BEFORE = "2024-01-11", "2024-01-30", "2024-01-10"
RATES = [("C0", "2023-01-01", 1.0), ("C1", "2023-06-01", 7.0), ("C1", "2024-01-12", 7.2), ("C1", "2024-01-22", 6.9), ("C4", "2023-01-01", 0.9), ("C4", "2024-01-18", 0.95)]
FREE = [("2024-01-13", 2.4), ("2024-01-20", 2.1), ("2024-01-26", 3.0)]

#: Events of the portfolios as expressions that Spark and SQL read alike; k tells the kind of an action.
_EVENT = {
    "u": "event_id % 5",
    "symbol": "user_id % 50",
    "cur": "CASE user_id % 50 % 3 WHEN 0 THEN 'C0' WHEN 1 THEN 'C1' ELSE 'C4' END",
    "d": "CAST(ts AS DATE)",
    "place": "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 3 ELSE 0 END",
    "id": "event_id",
    "kind": "CASE WHEN event_type = 'purchase' THEN 'BUY' WHEN event_type = 'error' THEN 'SELL' ELSE CASE event_id % 12 WHEN 0 THEN 'RATIO' WHEN 6 THEN 'RATIO' WHEN 1 THEN 'OPEN' WHEN 2 THEN 'OPEN' WHEN 7 THEN 'OPEN' WHEN 3 THEN 'RIGHTS' WHEN 5 THEN 'ADD' ELSE 'DIVIDEND' END END",
    "q": "CASE WHEN event_type IN ('purchase', 'error') THEN 1 + event_id % 10 WHEN event_id % 12 IN (1, 2, 7) THEN 3 WHEN event_id % 12 = 3 THEN 2 WHEN event_id % 12 = 5 THEN 4 END",
    "c": "CASE WHEN event_type = 'purchase' THEN (1 + event_id % 10) * value + 1 WHEN event_type = 'error' THEN (1 + event_id % 10) * value - 1 WHEN event_id % 12 = 1 THEN 3 * value WHEN event_id % 12 = 3 THEN 2 * value WHEN event_id % 12 IN (4, 8, 9, 10, 11) THEN (CASE event_id % 12 WHEN 4 THEN -1 ELSE 1 END) * value / 10 END",
    "num": "CASE WHEN event_type = 'signup' AND event_id % 12 = 0 THEN 2 WHEN event_type = 'signup' AND event_id % 12 = 6 THEN 1 END",
    "den": "CASE WHEN event_type = 'signup' AND event_id % 12 = 0 THEN 1 WHEN event_type = 'signup' AND event_id % 12 = 6 THEN 2 END",
    "p": "CASE WHEN event_type IN ('purchase', 'error') THEN value END",
}
_PLAIN = "event_type IN ('purchase', 'error', 'signup')"
_LATE = "symbol % 7 = 3 AND d < DATE '2024-01-20'"


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(_PLAIN).select(*[F.expr(e).alias(n) for n, e in _EVENT.items()])


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "cur string, eff string, rate double").withColumn("eff", F.to_date("eff"))


def portfolios(spark: SparkSession, d: str) -> DataFrame:
    prices = closes(spark, d).where(f"NOT ({_LATE})")
    return cv.return_curve(ledger(spark, d), prices, users=["u"], rates=rates(spark), start=START, end=END, opening_fx=BEFORE)


def portfolio_curve(spark: SparkSession, d: str) -> DataFrame:
    """Each portfolio's days: value, flows, return, and how many securities have no price yet."""
    c = portfolios(spark, d)
    r = lambda n, k: F.round(n, k).alias(n)
    return c.select("u", F.col("d").cast("string").alias("d"), r("opening", 1), r("mv", 1), r("inflow", 1), r("outflow", 1), r("dividends", 1), r("r", 6), r("cumulative", 6), r("drawdown", 6), "priced", "unpriced", "cut")


def portfolio_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk figures of each portfolio over a risk-free series."""
    series = spark.createDataFrame(FREE, "published string, rate double").withColumn("published", F.to_date("published"))
    g = cv.risk(portfolios(spark, d), ["u"], series)
    return g.select("u", *[F.round(c, 5).alias(c) for c in ("total", "volatility", "sharpe", "sortino", "max_drawdown", "risk_free")], "span", "n", "missing")


def portfolio_weeks(spark: SparkSession, d: str) -> DataFrame:
    """What each portfolio gained by week: the change of its value and what went out, less what came in."""
    c = portfolios(spark, d).groupBy("u", F.date_trunc("week", "d").cast("date").cast("string").alias("week"))
    g = c.agg(F.min_by("opening", "d").alias("opening"), F.max_by("mv", "d").alias("closing"), F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"), F.sum("pnl").alias("pnl"))
    return g.select("u", "week", *[F.round(c, 1).alias(c) for c in ("opening", "closing", "inflow", "outflow", "pnl")])


QUERIES = {"portfolio_curve": portfolio_curve, "portfolio_risk": portfolio_risk, "portfolio_weeks": portfolio_weeks}

_RATES = "rates AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', DATE '{e}', {r}::DOUBLE)" for c, e, r in RATES) + ") t(cur, eff, rate))"
_FREE = "free AS (SELECT * FROM (VALUES " + ", ".join(f"(DATE '{e}', {r}::DOUBLE)" for e, r in FREE) + ") t(published, yearly))"
# The grid of every security on every day, which the operator does without.
_SQL = "WITH RECURSIVE " + CLOSES_SQL + ", " + _RATES + ", " + _FREE + f""",
 ev AS (SELECT *, row_number() OVER (PARTITION BY u, symbol ORDER BY d, place, id) AS rn FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in _EVENT.items())} FROM events WHERE {_PLAIN}) WHERE d <= DATE '{END}'),
 walk AS (SELECT DISTINCT u, symbol, CAST(0 AS BIGINT) AS rn, 0::DOUBLE AS pos, 1::DOUBLE AS f, 0::DOUBLE AS matched FROM ev
  UNION ALL SELECT e.u, e.symbol, e.rn, CASE WHEN kind IN ('BUY', 'RIGHTS', 'OPEN') THEN pos + q WHEN kind = 'SELL' THEN pos - least(q, pos) WHEN kind = 'RATIO' THEN pos * num / den WHEN kind = 'ADD' AND pos > 0 THEN pos + q ELSE pos END,
   f * CASE WHEN kind = 'RATIO' THEN num / den WHEN kind = 'ADD' AND pos > 0 THEN (pos + q) / pos ELSE 1 END, least(q, pos)
  FROM walk w JOIN ev e ON e.u = w.u AND e.symbol = w.symbol AND e.rn = w.rn + 1),
 held AS (SELECT ev.*, walk.pos, walk.f, walk.matched FROM ev JOIN walk USING (u, symbol, rn)),
 own AS (SELECT u, symbol, max(cur) AS cur FROM ev GROUP BY ALL),
 px AS (SELECT u, symbol, d, close FROM closes JOIN own USING (symbol) WHERE NOT ({_LATE}) AND d <= DATE '{END}'),
 old AS (SELECT u, symbol, max_by(pos, rn) AS pos, max_by(f, rn) AS f, max(d) FILTER (place = 0 AND kind <> 'DIVIDEND') AS acted FROM held WHERE d < DATE '{START}' GROUP BY ALL),
 seen AS (SELECT u, symbol, max(d) AS day, max_by(p, struct_pack(d := d, k := k)) AS price FROM (SELECT u, symbol, d, 1 AS k, close AS p FROM px WHERE d < DATE '{START}' UNION ALL SELECT u, symbol, d, 0, min_by(p, rn) FROM held WHERE place > 0 AND d < DATE '{START}' GROUP BY u, symbol, d) GROUP BY u, symbol),
 opened AS (SELECT old.*, CASE WHEN acted > day THEN NULL ELSE price END AS price, (SELECT sum(h.q / h.f) FROM held h WHERE h.u = old.u AND h.symbol = old.symbol AND h.d < DATE '{START}' AND h.kind = 'OPEN' AND h.c IS NULL) * f AS unknown FROM old LEFT JOIN seen USING (u, symbol)),
 dy AS (SELECT u, symbol, d, max_by(pos, rn) AS pos, max_by(f, rn) AS f, max_by(p, rn) FILTER (place > 0) AS traded FROM held WHERE d >= DATE '{START}' GROUP BY ALL),
 days AS (SELECT u, d FROM px WHERE d >= DATE '{START}' UNION SELECT u, d FROM ev WHERE d >= DATE '{START}' UNION SELECT DISTINCT u, unnest([DATE '{START}', DATE '{END}']) FROM own),
 grid AS (SELECT own.u, own.symbol, own.cur, days.d, px.close, coalesce(px.close, dy.traded) AS price, dy.pos, dy.f FROM own JOIN days USING (u) LEFT JOIN dy ON dy.u = own.u AND dy.symbol = own.symbol AND dy.d = days.d LEFT JOIN px ON px.u = own.u AND px.symbol = own.symbol AND px.d = days.d),
 filled AS (SELECT g.u, g.symbol, g.cur, g.d, g.close, coalesce(last_value(g.pos IGNORE NULLS) OVER w, o.pos, 0) AS pos, coalesce(last_value(g.f IGNORE NULLS) OVER w, o.f, 1) AS f, coalesce(last_value(g.price IGNORE NULLS) OVER w, o.price) AS price,
   coalesce(last_value(g.price IGNORE NULLS) OVER (PARTITION BY g.u, g.symbol ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o.price) AS before
  FROM grid g LEFT JOIN opened o USING (u, symbol) WINDOW w AS (PARTITION BY g.u, g.symbol ORDER BY g.d ROWS UNBOUNDED PRECEDING)),
 rated AS (SELECT f.*, r.rate FROM filled f ASOF JOIN rates r ON f.cur = r.cur AND f.d >= r.eff),
 firsts AS (SELECT u, symbol, min(d) AS day, min_by(price * rate, d) AS worth, min_by(f, d) AS f FROM rated WHERE price IS NOT NULL GROUP BY ALL),
 come AS (SELECT h.u, CASE WHEN coalesce(r.close, r.before) IS NOT NULL THEN h.d ELSE x.day END AS d, CASE WHEN coalesce(r.close, r.before) IS NOT NULL THEN h.q * coalesce(r.close, r.before) * r.rate ELSE h.q * x.f / h.f * x.worth END AS amount
   FROM held h JOIN rated r ON r.u = h.u AND r.symbol = h.symbol AND r.d = h.d LEFT JOIN firsts x ON x.u = h.u AND x.symbol = h.symbol WHERE h.kind = 'OPEN' AND h.c IS NULL AND h.d >= DATE '{START}'
  UNION ALL SELECT o.u, x.day, least(o.unknown, o.pos) * x.f / o.f * x.worth FROM opened o JOIN firsts x USING (u, symbol) WHERE o.price IS NULL AND o.pos > 0 AND o.unknown > 0),
 flow AS (SELECT h.u, h.d, CASE WHEN kind IN ('BUY', 'RIGHTS', 'OPEN') THEN coalesce(c * rate, 0) ELSE 0 END AS inflow, CASE WHEN kind = 'SELL' THEN c * rate * matched / q WHEN kind = 'DIVIDEND' THEN c * rate ELSE 0 END AS outflow, CASE WHEN kind = 'DIVIDEND' THEN c * rate ELSE 0 END AS dividends, CAST(kind = 'SELL' AND matched < q AS INTEGER) AS cut
   FROM held h ASOF JOIN rates r ON h.cur = r.cur AND h.d >= r.eff WHERE h.d >= DATE '{START}' UNION ALL SELECT u, d, amount, 0, 0, 0 FROM come WHERE d IS NOT NULL),
 fs AS (SELECT u, d, sum(inflow) AS inflow, sum(outflow) AS outflow, sum(dividends) AS dividends, sum(cut) AS cut FROM flow GROUP BY ALL),
 mvs AS (SELECT u, d, sum(CASE WHEN pos > 0 THEN coalesce(pos * price * rate, 0) ELSE 0 END) AS mv, count(*) FILTER (pos > 0 AND price IS NOT NULL) AS priced, count(*) FILTER (pos > 0 AND price IS NULL) AS unpriced FROM rated GROUP BY ALL),
 first_mv AS (SELECT o.u, sum(o.pos * o.price * r.rate) AS mv FROM (SELECT opened.*, own.cur, DATE '{BEFORE}' AS at FROM opened JOIN own USING (u, symbol)) o ASOF JOIN rates r ON o.cur = r.cur AND o.at >= r.eff WHERE o.pos > 0 GROUP BY o.u),
 b AS (SELECT m.u, m.d, m.mv, priced, unpriced, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(dividends, 0) AS dividends, coalesce(cut, 0) AS cut, coalesce(lag(m.mv) OVER (PARTITION BY m.u ORDER BY m.d), x.mv, 0) AS opening FROM mvs m LEFT JOIN fs ON fs.u = m.u AND fs.d = m.d LEFT JOIN first_mv x ON x.u = m.u),
 r AS (SELECT *, mv + outflow - opening - inflow AS pnl, CASE WHEN opening + inflow > 0 THEN (mv + outflow) / (opening + inflow) - 1 END AS r FROM b),
 c AS (SELECT *, product(1 + coalesce(r, 0)) OVER (PARTITION BY u ORDER BY d ROWS UNBOUNDED PRECEDING) AS factor FROM r),
 k AS (SELECT *, factor / greatest(1, max(factor) OVER (PARTITION BY u ORDER BY d ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM c)"""
_RISK = """, g AS (SELECT u, d, r, date_diff('day', lag(d) OVER (PARTITION BY u ORDER BY d), d) AS gap FROM k),
 whole AS (SELECT u, date_diff('day', min(d), max(d)) AS span, count(r) AS n, max_by(factor, d) AS f, min(drawdown) AS dd FROM k GROUP BY u),
 x AS (SELECT g.*, y.yearly, r - coalesce(yearly, 0) / 100 * coalesce(gap, span / n) / 365.25 AS x, w.span, w.n, w.f, w.dd FROM g ASOF LEFT JOIN free y ON g.d >= y.published JOIN whole w ON w.u = g.u)
SELECT u, ROUND(any_value(f) - 1, 5) AS total, ROUND(stddev_samp(r) * sqrt(365.25 * any_value(n) / any_value(span)), 5) AS volatility, ROUND(avg(x) / stddev_samp(x) * sqrt(365.25 * any_value(n) / any_value(span)), 5) AS sharpe,
 ROUND(avg(x) / sqrt(sum(CASE WHEN x < 0 THEN x * x ELSE 0 END) / any_value(n)) * sqrt(365.25 * any_value(n) / any_value(span)), 5) AS sortino, ROUND(any_value(dd), 5) AS max_drawdown, ROUND(avg(yearly) FILTER (r IS NOT NULL), 5) AS risk_free,
 CAST(any_value(span) AS INTEGER) AS span, any_value(n) AS n, count(*) FILTER (r IS NOT NULL AND yearly IS NULL) AS missing FROM x GROUP BY u"""
ORACLE = {
    "portfolio_curve": _SQL + " SELECT u, CAST(d AS VARCHAR) AS d, ROUND(opening, 1) AS opening, ROUND(mv, 1) AS mv, ROUND(inflow, 1) AS inflow, ROUND(outflow, 1) AS outflow, ROUND(dividends, 1) AS dividends, ROUND(r, 6) AS r, ROUND(factor - 1, 6) AS cumulative, ROUND(drawdown, 6) AS drawdown, CAST(priced AS INTEGER) AS priced, CAST(unpriced AS INTEGER) AS unpriced, CAST(cut AS INTEGER) AS cut FROM k",
    "portfolio_risk": _SQL + _RISK,
    "portfolio_weeks": _SQL + " SELECT u, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS week, ROUND(min_by(opening, d), 1) AS opening, ROUND(max_by(mv, d), 1) AS closing, ROUND(sum(inflow), 1) AS inflow, ROUND(sum(outflow), 1) AS outflow, ROUND(sum(pnl), 1) AS pnl FROM k GROUP BY 1, 2",
}
