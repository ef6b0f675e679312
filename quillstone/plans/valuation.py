"""Entitlements, price choices, ranges, dividend notices and filed facts over the ledger and the tables, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions as ac
from ..operators import valuation as va
from .fundamentals import _FACTS_SQL, _r, _rs, facts
from .performance import _CURVE, curve, signed
from .star import CLOSES_SQL, FX_SQL, KEY, ORDER, ORDER_SQL, QUOTES_SQL, TRADES_SQL, closes, dbl, fills, fx, table, trades

_RECORD = "DATE '1997-01-01' + CAST(symbol % 365 AS INTEGER)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol has a record date of its own; trades of that day count."""
    t = trades(spark, d).where(F.col("trade_date") <= F.date_add(F.lit("1997-01-01").cast("date"), (F.col("symbol") % 365).cast("int")))
    return va.held_by_account(t, KEY, "account_id", signed(t), ORDER)


def entitlements(spark: SparkSession, d: str) -> DataFrame:
    """Shares held on the record date, by account or, where accounts oversell, merged."""
    return _held(spark, d).select(*KEY, "account_id", dbl("quantity").alias("quantity"), "basis")


def sole_holders(spark: SparkSession, d: str) -> DataFrame:
    """Keys that one account alone holds on the record date, by account."""
    return va.sole_holders(_held(spark, d), KEY, "account_id").groupBy("account_id").agg(F.count("*").alias("n"), F.sum("symbol").alias("symbols"))


def valuation_prices(spark: SparkSession, d: str) -> DataFrame:
    """The newest of quote and close of each symbol, where it's from, and whether it's over a week older than the newest day."""
    quote = fills(spark, d).groupBy("symbol").agg(F.max("d").alias("quote_day"), F.max_by("price", F.struct("d", "ts", "event_id")).alias("quote")).withColumn("source", F.when(F.col("symbol") % 3 == 0, "manual").otherwise("feed"))
    close = closes(spark, d).where((F.col("symbol") % 4 > 0) | (F.col("d") < "2024-01-05")).groupBy("symbol").agg(F.max("d").alias("close_day"), F.max_by("close", "d").alias("close"))
    wins = ac.close_wins(F.col("close_day"), F.when(F.col("symbol") % 5 > 0, F.col("quote_day")), F.col("source"))
    both = quote.join(close, "symbol", "full").select("symbol", F.when(wins, F.col("close")).otherwise(F.col("quote")).alias("price"), F.when(wins, "latest_history").when(F.col("quote").isNotNull(), "holding").otherwise("missing").alias("origin"), F.when(wins, F.col("close_day")).otherwise(F.col("quote_day")).alias("day"))
    newest = table(spark, d, "events").agg(F.to_date(F.max("ts")).alias("today"))
    return both.crossJoin(F.broadcast(newest)).select("symbol", F.round("price", 4).alias("price"), "origin", F.col("day").cast("string").alias("day"), (F.datediff("today", "day") > 7).alias("stale"))  # one row


def benchmark_excess(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol as a benchmark of the portfolio's return; the difference only where its range begins no later."""
    start, end = F.lit("2024-01-08").cast("date"), F.lit("2024-01-20").cast("date")
    r = va.span_return(closes(spark, d).where("symbol % 3 > 0 or d > DATE '2024-01-10'"), ["symbol"], "d", "close", start, end)
    own = va.span_return(curve(spark, d).select(F.lit(0).alias("portfolio"), "d", "factor"), ["portfolio"], "d", "factor", start, end).select(F.col("rate").alias("own"))
    r = r.join(F.broadcast(own))  # one row
    return r.select("symbol", "alignment", _r("rate").alias("rate"), F.when(F.col("alignment") == "on_or_before_start", _r(F.col("own") - F.col("rate"))).alias("excess"))


def range_clamps(spark: SparkSession, d: str) -> DataFrame:
    """Requested ranges within each user's history, and those that had to be moved."""
    span = trades(spark, d).groupBy("user_id").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    day = F.to_date("o_orderdate")
    asked = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("user_id"), F.when(F.col("o_orderkey") % 5 > 0, F.add_months(day, ((F.col("o_orderkey") % 9 - 4) * 36).cast("int"))).alias("start"), F.when(F.col("o_orderkey") % 7 > 0, F.add_months(day, ((F.col("o_orderkey") % 9 - 4) * 36 + 12).cast("int"))).alias("end"))
    c = asked.join(span, "user_id").select("user_id", va.clamp(F.col("first"), F.col("last"), F.col("start"), F.col("end")).alias("c"))  # at most as many spans as users
    return c.groupBy("user_id", "c.clamped").agg(F.count("*").alias("n"), F.sum(F.unix_date("c.start")).alias("starts"), F.sum(F.unix_date("c.end")).alias("ends"))


def rate_checks(spark: SparkSession, d: str) -> DataFrame:
    """Third-party rates against the newest official one: the difference in percent, and whether it's over two."""
    latest = fx(spark).groupBy("cur").agg(F.max_by("rate", "eff").alias("rate"), F.max("eff").alias("eff"))
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("cur"), (1 + (F.col("n_nationkey") - 12).cast("decimal(8,4)") / 400).cast("decimal(12,6)").alias("factor"))
    c = n.join(F.broadcast(latest), "cur").select("n_nationkey", "cur", "eff", F.round(F.try_divide((F.col("rate") * F.col("factor")).cast("decimal(18,12)"), F.col("rate")) * 100 - 100, 4).alias("diff"))  # one rate a currency
    return c.select("n_nationkey", "cur", F.col("eff").cast("string").alias("eff"), F.col("diff").cast("double").alias("diff"), (F.abs("diff") > 2).alias("warn"))


def price_moves(spark: SparkSession, d: str) -> DataFrame:
    """Closes of held symbols that moved by a fifth or more from the one before."""
    from pyspark.sql import Window

    c = closes(spark, d).withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("d")))
    f = fills(spark, d)
    held = f.groupBy("symbol").agg(F.sum(signed(f)).alias("qty")).where("qty > 0").select("symbol")
    moved = c.withColumn("pct", F.try_divide(F.col("close") - F.col("before"), F.col("before")) * 100).where(F.abs("pct") >= 20)
    return moved.join(held, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("pct") > 0).alias("up"), F.max("d").cast("string").alias("last"))


def added_prices(spark: SparkSession, d: str) -> DataFrame:
    """Price that each watched symbol starts from on the day it was added."""
    added = table(spark, d, "events").where("event_type = 'signup'").select((F.col("user_id") % 50).alias("symbol"), F.to_date("ts").alias("d"))
    gaps = closes(spark, d).where("symbol % 4 > 0 or dayofmonth(d) between 10 and 11")
    r = va.base_prices(added, gaps, "symbol", "d", "close", 7)
    return r.select("symbol", F.col("d").cast("string").alias("d"), F.col("at").cast("string").alias("at"), F.round("close", 4).alias("close"), "basis")


def opening_basis(spark: SparkSession, d: str) -> DataFrame:
    """How far the opening values of a range can be trusted, by status."""
    start = F.lit("2024-01-16").cast("date")
    t = fills(spark, d).where(F.col("d") < start).groupBy("symbol").agg(F.max("d").alias("trade_day"), F.max_by(F.when(F.col("symbol") % 10 != 3, F.col("price")), F.struct("d", "ts", "event_id")).alias("trade_price"))
    c = closes(spark, d).where((F.col("d") < start) & (F.col("symbol") % 10 > 3) & ((F.col("symbol") % 2 == 0) | (F.col("d") < "2024-01-04"))).groupBy("symbol").agg(F.max("d").alias("close_day"), F.max_by("close", "d").alias("close"))
    return va.opening_basis(t.join(c, "symbol", "left"), start, 10).groupBy("status").agg(F.count("*").alias("n"), F.sum("symbol").alias("symbols"))


def dividends_by_ex_date(spark: SparkSession, d: str) -> DataFrame:
    """Dividends of one company and ex-date in one, in conflict where their currencies differ."""
    k = F.col("o_orderkey")
    forms = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("company"), F.trunc(F.to_date("o_orderdate"), "MM").alias("ex"), F.when(k % 50 == 0, "USD").otherwise("HKD").alias("currency"), (k % 97).cast("decimal(18,4)").alias("amount"))
    g = va.sum_by_day(forms, ["company"], "ex", "amount", "currency")
    return g.select("company", F.col("ex").cast("string").alias("ex"), "forms", "currency", dbl("amount").alias("amount"), "conflict")


def implemented_dividends(spark: SparkSession, d: str) -> DataFrame:
    """Distributions by company, each once in spite of revisions and of period ends that share one."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select(
        (F.col("o_custkey") % 60).alias("company"), F.when(k % 2 == 0, F.trunc(day, "YEAR")).otherwise(F.trunc(day, "QUARTER")).alias("end"), F.when(k % 11 > 0, F.trunc(day, "QUARTER")).alias("ex"),
        F.when(k % 13 > 0, F.trunc(day, "QUARTER")).alias("announced"), day.alias("noticed"), F.when(k % 40 > 0, F.lit(1).cast("decimal(18,4)")).alias("amount"), F.when(k % 4 == 0, F.lit(0).cast("decimal(18,4)")).alias("stock"),
    )
    return va.implemented(rows, ["company"]).groupBy("company").agg(F.count("*").alias("n"), F.count_if("conflict").alias("conflicts"), F.count_if(F.col("ends") > 1).alias("merged"), F.sum(F.year("end")).alias("years"))


_CHAINS = {"revenue": ["Revenues", "SalesRevenueNet"], "income": ["NetIncomeLoss", "ProfitLoss"]}


def _filed(spark: SparkSession, d: str) -> DataFrame:
    """Filed facts, one a line item: length, unit and concept vary, and later filings restate earlier ones."""
    t = trades(spark, d)
    k = F.col("order_id") % 4
    end = F.last_day("trade_date")
    names = F.array(*[F.lit(c) for chain in _CHAINS.values() for c in chain], F.lit("Other"))
    return t.select(
        (F.col("symbol") % 30).alias("company"), end.alias("end"), F.when(k == 0, "FY").otherwise("Q").alias("fp"), F.when(k == 0, F.date_sub(end, 364)).when(k == 1, F.date_sub(end, 90)).when(k == 2, F.date_sub(end, 181)).alias("start"),
        F.get(names, (F.col("symbol") % 5).cast("int")).alias("concept"), F.when(F.col("supplier") % 3 == 0, "USD").when(F.col("supplier") % 3 == 1, "EUR").otherwise("CNY").alias("unit"), F.date_add("trade_date", (F.col("line") * 30).cast("int")).alias("filed"), F.when(F.col("line") < 7, F.col("gross")).alias("value"),
    )


def concept_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Revenue and income of each company and period from chains of concepts, of facts whose length fits their period."""
    f = _filed(spark, d).where(va.fits_period(F.col("start"), F.col("end"), F.col("fp")))
    p = va.concept_pivot(f, ["company", "end", "fp"], _CHAINS)
    return p.select("company", F.col("end").cast("string").alias("end"), "fp", dbl("revenue").alias("revenue"), dbl("income").alias("income"))


def reporting_units(spark: SparkSession, d: str) -> DataFrame:
    """The unit in which each company reports most full years."""
    return va.reporting_unit(_filed(spark, d).where("(company + month(end)) % 3 > 0"), ["company"])


def statement_identities(spark: SparkSession, d: str) -> DataFrame:
    """Totals of statements against their parts, some of them missing or wrong."""
    c = F.col
    f = facts(spark, d).withColumn("wrong", F.when((c("company") + c("year")) % 7 == 0, 1.5).when((c("company") + c("year")) % 11 == 0, 0.5).otherwise(1.0))
    rest = c("assets") - c("liabilities")
    checks = {"gross_profit": va.identity_status((c("revenue") - c("costs")) * c("wrong"), [c("revenue"), -c("costs")]), "balance": va.identity_status(c("assets") * c("wrong"), [c("liabilities"), rest]), "equity": va.identity_status(rest * c("wrong"), [rest], excess=True), "assets_positive": F.when(c("assets").isNull(), "skipped").when(c("assets") > 0, "ok").otherwise("suspect"), "current_within_total": F.when(c("cur_assets").isNull() | c("assets").isNull(), "skipped").when(c("cur_assets") <= c("assets") * 1.01, "ok").otherwise("suspect")}
    each = f.select(F.explode(F.create_map(*[x for n, s in checks.items() for x in (F.lit(n), s)])).alias("check", "status"))
    return each.groupBy("check", "status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (entitlements, sole_holders, valuation_prices, benchmark_excess, range_clamps, rate_checks, price_moves, added_prices, opening_basis, dividends_by_ex_date, implemented_dividends, concept_pivot, reporting_units, statement_identities)}

_HELD_SQL = "WITH " + TRADES_SQL + f""", e AS (SELECT *, CASE WHEN side = 'BUY' THEN qty ELSE -qty END AS s FROM trades WHERE trade_date <= {_RECORD}),
  w AS (SELECT *, SUM(s) OVER (PARTITION BY user_id, symbol ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS total, SUM(s) OVER (PARTITION BY user_id, symbol, account_id ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS own FROM e),
  k AS (SELECT user_id, symbol, min(own) < 0 AS torn, SUM(s) - least(min(total), 0) AS quantity FROM w GROUP BY ALL),
  held AS (SELECT user_id, symbol, CAST(NULL AS BIGINT) AS account_id, quantity, 'merged' AS basis FROM k WHERE torn AND quantity > 0
    UNION ALL SELECT user_id, symbol, account_id, SUM(s) AS quantity, 'per_account' AS basis FROM e SEMI JOIN (SELECT * FROM k WHERE NOT torn) USING (user_id, symbol) GROUP BY user_id, symbol, account_id HAVING SUM(s) > 0)"""
_FILED_SQL = "WITH " + TRADES_SQL + """, f AS (SELECT symbol % 30 AS company, last_day(trade_date) AS "end", CASE WHEN order_id % 4 = 0 THEN 'FY' ELSE 'Q' END AS fp, order_id % 4 AS length, symbol % 5 AS place,
  CASE supplier % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'CNY' END AS unit, trade_date + CAST(line * 30 AS INTEGER) AS filed, CASE WHEN line < 7 THEN gross END AS value FROM trades)"""
_CHECK = "CASE WHEN {0} IS NULL THEN 'skipped' WHEN {1} THEN 'ok' ELSE 'suspect' END"
ORACLE = {
    "entitlements": _HELD_SQL + " SELECT user_id, symbol, account_id, CAST(quantity AS DOUBLE) AS quantity, basis FROM held",
    "sole_holders": _HELD_SQL + ", o AS (SELECT user_id, symbol, max(account_id) AS account_id FROM held WHERE basis = 'per_account' GROUP BY ALL HAVING count(*) = 1) SELECT account_id, count(*) AS n, CAST(SUM(symbol) AS BIGINT) AS symbols FROM o GROUP BY 1",
    "valuation_prices": f"""WITH {CLOSES_SQL}, {QUOTES_SQL},
        q AS (SELECT symbol, max(d) AS qd, max_by(price, struct_pack(a := d, b := ts, c := event_id)) AS q FROM fills GROUP BY 1), c AS (SELECT symbol, max(d) AS cd, max_by(close, d) AS c FROM closes WHERE symbol % 4 > 0 OR d < DATE '2024-01-05' GROUP BY 1),
        j AS (SELECT *, CASE WHEN cd IS NULL THEN false WHEN symbol % 5 = 0 OR qd IS NULL THEN true WHEN cd = qd THEN symbol % 3 <> 0 ELSE cd > qd END AS wins FROM q FULL JOIN c USING (symbol))
        SELECT symbol, round(CASE WHEN wins THEN c ELSE q END, 4) AS price, CASE WHEN wins THEN 'latest_history' ELSE 'holding' END AS origin, CAST(CASE WHEN wins THEN cd ELSE qd END AS VARCHAR) AS day,
        date_diff('day', CASE WHEN wins THEN cd ELSE qd END, (SELECT CAST(max(ts) AS DATE) FROM events)) > 7 AS stale FROM j""",
    "benchmark_excess": _CURVE + f""", bc AS (SELECT * FROM closes WHERE d <= DATE '2024-01-20' AND (symbol % 3 > 0 OR d > DATE '2024-01-10')),
        bg AS (SELECT symbol, arg_max(close, d) FILTER (d <= DATE '2024-01-08') AS a, arg_min(close, d) FILTER (d > DATE '2024-01-08') AS f, arg_max(close, d) AS l FROM bc GROUP BY 1), br AS (SELECT symbol, CASE WHEN a IS NULL THEN 'first_available' ELSE 'on_or_before_start' END AS alignment, l / nullif(ifnull(a, f), 0) - 1 AS rate FROM bg),
        own AS (SELECT (SELECT max_by(factor, d) FROM k WHERE d <= DATE '2024-01-20') / (SELECT max_by(factor, d) FROM k WHERE d <= DATE '2024-01-08') - 1 AS own)
        SELECT symbol, alignment, {_rs("rate")} AS rate, CASE WHEN alignment = 'on_or_before_start' THEN {_rs("own - rate")} END AS excess FROM br, own""",
    "range_clamps": "WITH " + TRADES_SQL + """, h AS (SELECT user_id, min(trade_date) AS a, max(trade_date) AS b FROM trades GROUP BY 1),
        q AS (SELECT o_custkey % 5 AS user_id, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + to_months(CAST((o_orderkey % 9 - 4) * 36 AS INTEGER)) AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + to_months(CAST((o_orderkey % 9 - 4) * 36 + 12 AS INTEGER)) AS DATE) AS e FROM orders),
        x AS (SELECT user_id, a, b, CASE WHEN k % 5 > 0 THEN s END AS s, CASE WHEN k % 7 > 0 THEN e END AS e FROM q JOIN h USING (user_id)), y AS (SELECT *, CASE WHEN s > a THEN s ELSE a END AS lo, CASE WHEN e < b THEN e ELSE b END AS hi FROM x),
        z AS (SELECT user_id, s, e, CASE WHEN hi >= lo THEN lo WHEN e < a THEN a ELSE b END AS lo, CASE WHEN hi >= lo THEN hi WHEN e < a THEN a ELSE b END AS hi FROM y)
        SELECT user_id, ifnull(s <> lo, false) OR ifnull(e <> hi, false) AS clamped, count(*) AS n, CAST(SUM(lo - DATE '1970-01-01') AS BIGINT) AS starts, CAST(SUM(hi - DATE '1970-01-01') AS BIGINT) AS ends FROM z GROUP BY ALL""",
    "rate_checks": f"""WITH {FX_SQL}, l AS (SELECT cur, arg_max(rate, eff) AS rate, max(eff) AS eff FROM fx GROUP BY 1), x AS (SELECT n_nationkey, cur, eff, (n_nationkey - 12) / 4.0 AS diff FROM nation JOIN l ON cur = 'C' || n_regionkey)
        SELECT n_nationkey, cur, CAST(eff AS VARCHAR) AS eff, CAST(diff AS DOUBLE) AS diff, abs(diff) > 2 AS warn FROM x""",
    "price_moves": f"""WITH {CLOSES_SQL}, {QUOTES_SQL}, l AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY d) AS before FROM closes), m AS (SELECT *, (close - before) / nullif(before, 0) * 100 AS pct FROM l)
        SELECT symbol, count(*) AS n, count(*) FILTER (pct > 0) AS up, CAST(max(d) AS VARCHAR) AS last FROM m WHERE abs(pct) >= 20 AND symbol IN (SELECT symbol FROM fills GROUP BY 1 HAVING SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) > 0) GROUP BY 1""",
    "added_prices": f"""WITH {CLOSES_SQL}, c AS (SELECT * FROM closes WHERE symbol % 4 > 0 OR day(d) IN (10, 11)), a AS (SELECT DISTINCT user_id % 50 AS symbol, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup'),
        j AS (SELECT a.symbol, a.d, max(c.d) FILTER (c.d <= a.d AND c.d >= a.d - 7) AS b, min(c.d) FILTER (c.d >= a.d) AS f FROM a LEFT JOIN c ON a.symbol = c.symbol GROUP BY ALL)
        SELECT j.symbol, CAST(j.d AS VARCHAR) AS d, CAST(c.d AS VARCHAR) AS "at", round(c.close, 4) AS close, CASE WHEN b IS NOT NULL THEN 'before' WHEN f IS NOT NULL THEN 'after' ELSE 'pending' END AS basis FROM j LEFT JOIN c ON c.symbol = j.symbol AND c.d = ifnull(b, f)""",
    "opening_basis": f"""WITH {CLOSES_SQL}, {QUOTES_SQL}, t AS (SELECT DISTINCT symbol FROM fills WHERE d < DATE '2024-01-16'), c AS (SELECT symbol, max(d) AS cd FROM closes WHERE d < CASE WHEN symbol % 2 = 0 THEN DATE '2024-01-16' ELSE DATE '2024-01-04' END AND symbol % 10 > 3 GROUP BY 1)
        SELECT CASE WHEN cd IS NULL AND symbol % 10 = 3 THEN 'unavailable' WHEN cd IS NULL OR cd < DATE '2024-01-06' THEN 'estimated' ELSE 'exact' END AS status, count(*) AS n, CAST(SUM(symbol) AS BIGINT) AS symbols FROM t LEFT JOIN c USING (symbol) GROUP BY 1""",
    "dividends_by_ex_date": """WITH x AS (SELECT o_custkey % 40 AS company, date_trunc('month', CAST(o_orderdate AS DATE)) AS ex, CASE WHEN o_orderkey % 50 = 0 THEN 'USD' ELSE 'HKD' END AS cur, o_orderkey % 97 AS a FROM orders)
        SELECT company, CAST(CAST(ex AS DATE) AS VARCHAR) AS ex, count(*) AS forms, CASE WHEN count(DISTINCT cur) = 1 THEN min(cur) END AS currency, CAST(CASE WHEN count(DISTINCT cur) = 1 THEN SUM(a) END AS DOUBLE) AS amount, count(DISTINCT cur) > 1 AS conflict FROM x GROUP BY 1, 2""",
    "implemented_dividends": """WITH o AS (SELECT o_orderkey AS k, o_custkey % 60 AS company, CAST(o_orderdate AS DATE) AS day FROM orders),
        r AS (SELECT company, CAST(date_trunc(CASE WHEN k % 2 = 0 THEN 'year' ELSE 'quarter' END, day) AS DATE) AS fin, CASE WHEN k % 11 > 0 THEN CAST(date_trunc('quarter', day) AS DATE) END AS ex, CASE WHEN k % 13 > 0 THEN CAST(date_trunc('quarter', day) AS DATE) END AS ann, day, CASE WHEN k % 40 > 0 THEN 1 END AS a, CASE WHEN k % 4 = 0 THEN 0 END AS st FROM o),
        l AS (SELECT company, fin, ex, count(DISTINCT ifnull(a, 0)) > 1 AS conflict, first(struct_pack(ann := ann, a := a, st := st) ORDER BY ann DESC NULLS LAST, day DESC, a DESC NULLS LAST, st DESC NULLS LAST) AS x FROM r GROUP BY ALL),
        c AS (SELECT *, NOT conflict AND ex IS NOT NULL AND x.ann IS NOT NULL AND ifnull(x.a > 0, false) AS clear FROM l),
        d AS (SELECT company, max(fin) AS fin, bool_or(conflict) AS conflict, count(*) AS ends FROM c GROUP BY company, ex, x.ann, x.a, ifnull(x.st, 0), clear, CASE WHEN NOT clear THEN fin END)
        SELECT company, count(*) AS n, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (ends > 1) AS merged, CAST(SUM(year(fin)) AS BIGINT) AS years FROM d GROUP BY 1""",
    "concept_pivot": _FILED_SQL + """, b AS (SELECT company, "end", fp, place // 2 AS field, first(value ORDER BY place, filed DESC, value DESC) AS v FROM f WHERE place < 4 AND value IS NOT NULL AND length <> 2 GROUP BY ALL)
        SELECT company, CAST("end" AS VARCHAR) AS "end", fp, CAST(max(v) FILTER (field = 0) AS DOUBLE) AS revenue, CAST(max(v) FILTER (field = 1) AS DOUBLE) AS income FROM b GROUP BY company, "end", fp""",
    "reporting_units": _FILED_SQL + """, y AS (SELECT company, unit, count(DISTINCT "end") AS years FROM f WHERE fp = 'FY' AND (company + month("end")) % 3 > 0 GROUP BY ALL)
        SELECT company, unit, years FROM y QUALIFY row_number() OVER (PARTITION BY company ORDER BY years DESC, unit = 'USD' DESC, unit) = 1""",
    "statement_identities": _FACTS_SQL + f""", w AS (SELECT *, CASE WHEN (company + year) % 7 = 0 THEN 1.5 WHEN (company + year) % 11 = 0 THEN 0.5 ELSE 1 END AS m FROM facts),
        s AS (SELECT unnest(['gross_profit', 'balance', 'equity', 'assets_positive', 'current_within_total']) AS "check", unnest([{_CHECK.format("revenue - costs", "m = 1 OR revenue = costs")}, {_CHECK.format("assets - liabilities", "m = 1")}, {_CHECK.format("assets - liabilities", "m = 1 OR (assets - liabilities) * m >= assets - liabilities")}, {_CHECK.format("assets", "assets > 0")}, {_CHECK.format("cur_assets + assets", "cur_assets <= assets * 1.01")}]) AS status FROM w)
        SELECT "check", status, count(*) AS n FROM s GROUP BY ALL""",
}
