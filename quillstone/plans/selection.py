"""Choosing, grouping and matching over the tables and the ledger, and the SQL for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import selection as sel
from .fundamentals import _FACTS_SQL, _r, _rs, facts
from .star import CLOSES_SQL, FX_SQL, TRADES_SQL, closes, dbl, fx, table, trades

T = "WITH " + TRADES_SQL


def disjunctive_match(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions joined to the action that they made or that they were matched with, each pair once."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("action"), F.col("o_custkey").alias("owner"))
    s = o.select(F.col("action").alias("suggestion"), F.when(F.col("action") % 3 == 0, F.col("action")).alias("created"), F.when(F.col("action") % 4 == 0, F.col("action") + F.when(F.col("action") % 8 == 0, 0).otherwise(1)).alias("matched"))
    return sel.match_either(s, o, [("created", "action"), ("matched", "action")]).groupBy((F.col("owner") % 10).alias("owner")).agg(F.count("*").alias("n"), F.sum("suggestion").alias("suggestions"))


def prices_with_seed(spark: SparkSession, d: str) -> DataFrame:
    c = closes(spark, d)
    r = sel.range_with_seed(c, ["symbol"], "d", "close", F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))
    return r.select("symbol", F.col("d").cast("string").alias("d"), F.round("close", 4).alias("close"))


def settlement_owners(spark: SparkSession, d: str) -> DataFrame:
    """Purchases whose receipt falls within an hour behind exactly one signup of the user, the ambiguous and the others."""
    e = table(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    ups = e.where("event_type = 'signup'").select(F.col("event_id").alias("owner_id"), F.col("user_id").alias("u"), F.col("ts").alias("up"), F.date_trunc("hour", "ts").alias("hour"))
    # Each purchase meets the signups of its hour and of the one before.
    spread = buys.withColumn("h", F.explode(F.array(F.date_trunc("hour", "ts"), F.date_trunc("hour", "ts") - F.expr("INTERVAL 1 HOUR"))))
    met = spread.join(ups, (F.col("user_id") == F.col("u")) & (F.col("h") == F.col("hour"))).where((F.col("up") <= F.col("ts")) & (F.col("up") > F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    return sel.owners(buys, met, "event_id", "owner_id").groupBy("status").agg(F.count("*").alias("n"), F.sum("owner").alias("owners"))


def transfer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing lines with the incoming ones they are linked to: same order, the next line, equal or unequal quantity."""
    t = trades(spark, d).where("side = 'SELL'").select("order_id", "line", "supplier", "qty", "account_id")
    into = trades(spark, d).where("side = 'BUY'").select(F.col("order_id").alias("o"), (F.col("line") - 1).alias("l"), F.col("qty").alias("into_qty"), F.col("account_id").alias("into_account"))
    p = t.join(into, (F.col("order_id") == F.col("o")) & (F.col("line") == F.col("l")))
    return p.groupBy("account_id", "into_account").agg(F.count("*").alias("n"), F.sum((F.col("qty") == F.col("into_qty")).cast("long")).alias("equal"), dbl(F.sum("qty")).alias("qty"))


def source_priority(spark: SparkSession, d: str) -> DataFrame:
    """Each part's label from its rule, else the official list, else a third party."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_type", "p_brand", "p_name")
    rows = p.where("k % 11 = 0").select("k", F.lit("rule").alias("source"), F.col("p_brand").alias("label")).unionByName(p.where("k % 3 = 0").select("k", F.lit("official").alias("source"), F.when(F.col("k") % 2 == 0, F.col("p_type")).alias("label"))).unionByName(p.where("k % 5 <> 0").select("k", F.lit("other").alias("source"), F.col("p_name").alias("label")))
    rank = F.when(F.col("source") == "rule", 1).when(F.col("source") == "official", 2).otherwise(3)
    found = sel.by_priority(rows, ["k"], rank, "label")
    return p.select("k").join(found, "k", "left").select("k", "label")


def name_chain(spark: SparkSession, d: str) -> DataFrame:
    """A name from overrides, else from the catalog, else from the ledger."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("catalog")).where("k % 4 <> 0")
    over = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("override"))
    held = trades(spark, d).groupBy(F.col("symbol").alias("k")).agg(F.max("trade_date").alias("last"))
    return held.join(over, "k", "left").join(p, "k", "left").select("k", F.coalesce("override", "catalog", F.concat(F.lit("symbol "), "k")).alias("name"))


def token_matches(spark: SparkSession, d: str) -> DataFrame:
    """Texts that mention wanted words, through their words and a broadcast list of a fixed few."""
    wanted = spark.createDataFrame([("the", 1), ("der", 2), ("los", 3), ("les", 4)], "token string, mark int")
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0)))).alias("token"))
    return words.join(F.broadcast(wanted), "token").groupBy("doc_id").agg(F.count("*").alias("n"), F.bit_or("mark").alias("marks"))


def last_currency(spark: SparkSession, d: str) -> DataFrame:
    """The newest currency that a key's trades name; some name none."""
    t = trades(spark, d).withColumn("named", F.when(F.col("order_id") % 3 != 0, F.col("cur")))
    return t.where("named is not null").groupBy("user_id", "account_id").agg(F.max_by(F.struct("named", "order_id"), F.struct("trade_date", "order_id", "line", "supplier")).alias("x")).select("user_id", "account_id", "x.named", "x.order_id")


def cash_balance(spark: SparkSession, d: str) -> DataFrame:
    """Signed flows of trades and dividends up to a day, by account and currency; balances of nothing left out."""
    t = trades(spark, d).where("trade_date <= '1998-06-30'")
    flow = F.when(F.col("side") == "BUY", -(F.col("gross") + F.col("fee"))).otherwise(F.col("gross") - F.col("fee"))
    paid = t.where("line = 1").select("user_id", "account_id", "cur", F.round(F.col("qty") / 10, 2).alias("flow"))
    both = t.select("user_id", "account_id", "cur", flow.alias("flow")).unionByName(paid)
    return both.groupBy("user_id", "account_id", "cur").agg(F.sum("flow").alias("b")).where("b <> 0").select("user_id", "account_id", "cur", dbl("b", 2).alias("balance"))


def announcement_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer and month as one notice: the most important leads, all are listed in order."""
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), "o_orderkey")
    g = o.groupBy("o_custkey", "month").agg(F.min("level").alias("level"), F.min(F.struct("level", "o_orderkey"))["o_orderkey"].alias("lead"), F.sort_array(F.collect_list("o_orderkey")).alias("all"))
    return g.select("o_custkey", "month", "level", "lead", F.array_join(F.col("all").cast("array<string>"), ",").alias("listed"))


def dividend_streaks(spark: SparkSession, d: str) -> DataFrame:
    paid = trades(spark, d).where("line = 1").select("symbol", F.year("trade_date").alias("year"))
    return sel.streak(paid, ["symbol"], "year").select("symbol", "newest", "years")


def adjustment_factors(spark: SparkSession, d: str) -> DataFrame:
    """Backward factors of closes: every seventh day cuts by a tenth or a fifth; one symbol's ratio isn't known."""
    c = closes(spark, d)
    cuts = c.where("day(d) % 7 = 0").select("symbol", "d", F.when((F.col("symbol") == 3) & (F.dayofmonth("d") == 14), F.lit(None).cast("double")).when(F.col("symbol") % 2 == 0, F.lit(0.9)).otherwise(F.lit(0.8)).alias("ratio"))
    return sel.backward_factors(c, cuts, ["symbol"], "d", "ratio").select("symbol", F.col("d").cast("string").alias("d"), F.round("factor", 6).alias("factor"))


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return sel.take_turns(s, "s_nationkey", ["s_suppkey"]).select("s_suppkey", "s_nationkey", "turn")


def author_feed(spark: SparkSession, d: str) -> DataFrame:
    """Per author the three newest of its utterances that differ, how many there are, and the newest author's rank."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("k")).where("k is not null").dropDuplicates(["conv_id", "turn", "k"])
    own = c.groupBy("conv_id", "k").agg(F.max("turn").alias("turn"))
    return sel.top_of_each(own, ["conv_id"], [F.col("turn").desc(), F.col("k")], 3).select("conv_id", "k", "turn", "total", "place")


def new_since_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Events behind each user's last summary (its newest signup); without one all are new."""
    e = table(spark, d, "events")
    anchor = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("anchor"))
    fresh = F.col("anchor").isNull() | (F.col("ts") > F.col("anchor"))
    return e.join(anchor, "user_id", "left").groupBy("user_id").agg(F.sum(fresh.cast("long")).alias("fresh"), F.count("*").alias("n"))


def whole_day_page(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    return sel.whole_days(e, "day", 500).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def newest_per_kind(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "ts")
    return sel.top_of_each(e, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 4).select("event_type", "event_id", "place", "total")


def component_sums(spark: SparkSession, d: str) -> DataFrame:
    """Totals of three parts a company and year, only where all of them were reported."""
    f = trades(spark, d).select((F.col("symbol") % 997).alias("company"), F.year("trade_date").alias("year"), F.concat(F.lit("p"), F.col("line").cast("string")).alias("part"), "gross")
    return sel.complete_sums(f, ["company", "year"], "part", "gross", ["p1", "p2", "p3"]).select("company", "year", dbl("total", 2).alias("total"))


def fingerprint_news(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a batch whose hash no booked line explains."""
    t = trades(spark, d).withColumn("h", F.sha2(F.concat_ws("|", "symbol", "qty", F.col("trade_date").cast("string")), 256))
    booked = t.where("order_id % 3 <> 0").select("h").distinct()
    return t.where("order_id % 3 = 0").join(booked, "h", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("h").alias("hashes"))


def cumulative_cash_cover(spark: SparkSession, d: str) -> DataFrame:
    """Five years' cash flow on income over each company's newest unbroken run."""
    r = sel.run_totals(facts(spark, d).select("company", "year", F.col("cash_flow").cast("decimal(18,4)").alias("cash_flow"), F.col("income").cast("decimal(18,4)").alias("income")), ["company"], "year", ["cash_flow", "income"], 5)
    return r.select("company", "newest", _r(F.try_divide(F.col("cash_flow").cast("double"), F.col("income").cast("double"))).alias("cover"))


def return_on_equity(spark: SparkSession, d: str) -> DataFrame:
    """Income on the mean of this and the prior year's equity; on this year's alone if the prior isn't there, never on none."""
    f = facts(spark, d).select("company", "year", "income", (F.col("assets") - F.col("liabilities")).alias("equity"))
    w = Window.partitionBy("company").orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("equity").over(w))
    mean = F.when(before > 0, (F.col("equity") + before) / 2).otherwise(F.col("equity"))
    return f.withColumn("mean", mean).select("company", "year", _r(F.when(F.col("mean") > 0, F.col("income") / F.col("mean") * 100), 2).alias("roe"))


def second_half(spark: SparkSession, d: str) -> DataFrame:
    """Full year less the first half, where both were reported."""
    t = trades(spark, d).select((F.col("symbol") % 97).alias("company"), F.year("trade_date").alias("year"), (F.month("trade_date") <= 6).alias("first"), "gross")
    g = t.groupBy("company", "year").agg(F.sum("gross").alias("full"), F.sum(F.when(F.col("first"), F.col("gross"))).alias("half"))
    return g.where("half is not null").select("company", "year", dbl(F.col("full") - F.col("half"), 2).alias("second"))


def dividends_per_share(spark: SparkSession, d: str) -> DataFrame:
    """The newest revision of each dividend (company and ex-date), summed by year."""
    t = trades(spark, d).where("line <= 2").select((F.col("symbol") % 997).alias("company"), "trade_date", "order_id", "line", "supplier", "fee")
    newest = t.groupBy("company", "trade_date").agg(F.max_by("fee", F.struct("order_id", "line", "supplier", "fee")).alias("dps"), F.count("*").alias("revisions"))
    return newest.groupBy("company", F.year("trade_date").alias("year")).agg(dbl(F.sum("dps"), 2).alias("dps"), F.count("*").alias("n"), F.max("revisions").alias("revisions"))


def tail_plan(spark: SparkSession, d: str) -> DataFrame:
    """What of January is missing of each symbol's closes, before, behind or in all."""
    cover = closes(spark, d).where("symbol % 7 <> 0 and day(d) between 3 and 20 + symbol % 9").groupBy("symbol").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    targets = spark.range(50).select(F.col("id").alias("symbol"), F.lit("2024-01-01").cast("date").alias("low"), F.lit("2024-01-25").cast("date").alias("high"))
    return sel.missing_ranges(targets, cover, ["symbol"]).select("symbol", "part", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


def open_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events inside two markets' hours."""
    e = table(spark, d, "events")
    home = sel.session_open(F.col("ts"), "Asia/Shanghai", [("09:30", "11:30"), ("13:00", "15:00")])
    away = sel.session_open(F.col("ts"), "America/New_York", [("09:30", "16:00")])
    return e.groupBy("event_type").agg(F.sum(home.cast("long")).alias("home"), F.sum(away.cast("long")).alias("away"))


def tax_allocations(spark: SparkSession, d: str) -> DataFrame:
    """Tax events against what was allocated of them to actions of the same account: fits, exceeds or strays."""
    t = trades(spark, d)
    event = t.groupBy("user_id", "symbol").agg(F.sum("fee").alias("amount"), F.min("account_id").alias("account"))
    part = t.where("line <= 3").groupBy("user_id", "symbol").agg((F.sum("fee") * 2).alias("allocated"), F.count_distinct("account_id").alias("accounts"))
    j = event.join(part, ["user_id", "symbol"], "left")
    state = F.when(F.col("allocated").isNull(), "none").when(F.col("accounts") > 1, "strays").when(F.col("allocated") > F.col("amount"), "exceeds").otherwise("fits")
    return j.groupBy("user_id", state.alias("state")).agg(F.count("*").alias("n"))


def fx_latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest rate of each currency with what a user holds in it; the freshest row counts."""
    newest = fx(spark).groupBy("cur").agg(F.max_by("rate", "eff").alias("rate"), F.max("eff").cast("string").alias("eff"))
    held = trades(spark, d).groupBy("cur").agg(F.sum("gross").alias("gross"))
    return held.join(newest, "cur", "left").select("cur", dbl("rate").alias("rate"), "eff", dbl(F.col("gross") * F.col("rate"), 2).alias("base"))


QUERIES = {
    f.__name__: f
    for f in (
        disjunctive_match, prices_with_seed, settlement_owners, transfer_pairs, source_priority, name_chain, token_matches, last_currency, cash_balance, announcement_groups, dividend_streaks, adjustment_factors, round_robin,
        author_feed, new_since_anchor, whole_day_page, newest_per_kind, component_sums, fingerprint_news, cumulative_cash_cover, return_on_equity, second_half, dividends_per_share, tail_plan, open_sessions, tax_allocations, fx_latest,
    )
}

_D2 = "CAST(ROUND({}, 2) AS DOUBLE)".format
_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE '{}')".format
ORACLE = {
    "disjunctive_match": "WITH s AS (SELECT o_orderkey AS suggestion, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS created, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS matched FROM orders) SELECT o_custkey % 10 AS owner, count(*) AS n, CAST(SUM(suggestion) AS BIGINT) AS suggestions FROM s JOIN orders ON created = o_orderkey OR matched = o_orderkey GROUP BY 1",
    "prices_with_seed": "WITH " + CLOSES_SQL + ", p AS (SELECT * FROM closes WHERE d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' UNION ALL SELECT symbol, max(d), max_by(close, d) FROM closes WHERE d < DATE '2024-01-10' GROUP BY symbol) SELECT symbol, CAST(d AS VARCHAR) AS d, ROUND(close, 4) AS close FROM p",
    "settlement_owners": "WITH b AS (SELECT e.event_id, count(DISTINCT s.event_id) AS n, min(s.event_id) AS o FROM events e LEFT JOIN events s ON s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts AND s.ts > e.ts - INTERVAL 1 HOUR WHERE e.event_type = 'purchase' GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, count(*) AS n, CAST(SUM(CASE WHEN n = 1 THEN o END) AS BIGINT) AS owners FROM b GROUP BY 1",
    "transfer_pairs": T + " SELECT a.account_id, b.account_id AS into_account, count(*) AS n, CAST(SUM(CASE WHEN a.qty = b.qty THEN 1 ELSE 0 END) AS BIGINT) AS equal, CAST(ROUND(SUM(a.qty), 4) AS DOUBLE) AS qty FROM trades a JOIN trades b ON a.side = 'SELL' AND b.side = 'BUY' AND a.order_id = b.order_id AND b.line = a.line + 1 GROUP BY 1, 2",
    "source_priority": "SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN p_brand WHEN p_partkey % 6 = 0 THEN p_type WHEN p_partkey % 5 <> 0 THEN p_name END AS label FROM part",
    "name_chain": T + " SELECT k, COALESCE(s_name, CASE WHEN k % 4 <> 0 THEN p_name END, 'symbol ' || k) AS name FROM (SELECT DISTINCT symbol AS k FROM trades) LEFT JOIN supplier ON s_suppkey = k LEFT JOIN part ON p_partkey = k",
    "token_matches": "WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS token FROM documents), v(token, mark) AS (VALUES ('the', 1), ('der', 2), ('los', 3), ('les', 4)) SELECT doc_id, count(*) AS n, bit_or(mark) AS marks FROM w JOIN v USING (token) GROUP BY 1",
    "last_currency": T + " SELECT user_id, account_id, max_by(cur, (trade_date, order_id, line, supplier)) AS named, max_by(order_id, (trade_date, order_id, line, supplier)) AS order_id FROM trades WHERE order_id % 3 <> 0 GROUP BY 1, 2",
    "cash_balance": T + f", f AS (SELECT user_id, account_id, cur, CASE WHEN side = 'BUY' THEN -(gross + fee) ELSE gross - fee END AS flow FROM trades WHERE trade_date <= DATE '1998-06-30' UNION ALL SELECT user_id, account_id, cur, ROUND(qty / CAST(10 AS DECIMAL(4,0)), 2) FROM trades WHERE trade_date <= DATE '1998-06-30' AND line = 1) SELECT user_id, account_id, cur, {_D2('SUM(flow)')} AS balance FROM f GROUP BY 1, 2, 3 HAVING SUM(flow) <> 0",
    "announcement_groups": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(min(CAST(o_orderpriority[1] AS INTEGER)) AS INTEGER) AS level, min_by(o_orderkey, (CAST(o_orderpriority[1] AS INTEGER), o_orderkey)) AS lead, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS listed FROM orders GROUP BY 1, 2",
    "dividend_streaks": T + ", y AS (SELECT DISTINCT symbol, CAST(year(trade_date) AS INTEGER) AS year FROM trades WHERE line = 1), i AS (SELECT *, year + row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS island, max(year) OVER (PARTITION BY symbol) AS newest FROM y) SELECT symbol, newest, count(*) AS years FROM i WHERE island = newest + 1 GROUP BY 1, 2",
    "adjustment_factors": "WITH " + CLOSES_SQL + ", c AS (SELECT symbol, d, CASE WHEN symbol = 3 AND day(d) = 14 THEN NULL WHEN symbol % 2 = 0 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS ratio FROM closes WHERE day(d) % 7 = 0) SELECT p.symbol, CAST(p.d AS VARCHAR) AS d, ROUND(CASE WHEN count(c.d) = count(c.ratio) THEN COALESCE(product(1 / c.ratio), 1) END, 6) AS factor FROM closes p LEFT JOIN c ON c.symbol = p.symbol AND c.d <= p.d GROUP BY p.symbol, p.d",
    "round_robin": "SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS turn FROM supplier",
    "author_feed": "WITH o AS (SELECT conv_id, md5(text) AS k, max(turn) AS turn FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, k) AS INTEGER) AS place FROM o) SELECT conv_id, k, turn, total, place FROM r WHERE place <= 3",
    "new_since_anchor": "WITH a AS (SELECT user_id, max(ts) AS anchor FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, count(*) FILTER (anchor IS NULL OR ts > anchor) AS fresh, count(*) AS n FROM events LEFT JOIN a USING (user_id) GROUP BY 1",
    "whole_day_page": "WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1), b AS (SELECT *, COALESCE(SUM(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT CAST(day AS VARCHAR) AS day, n, last FROM b WHERE before < 500",
    "newest_per_kind": "SELECT * FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE place <= 4",
    "component_sums": T + f" SELECT symbol % 997 AS company, CAST(year(trade_date) AS INTEGER) AS year, {_D2('SUM(gross)')} AS total FROM trades WHERE line IN (1, 2, 3) GROUP BY 1, 2 HAVING count(DISTINCT line) = 3",
    "fingerprint_news": T + ", h AS (SELECT *, (symbol, qty, trade_date) AS h FROM trades) SELECT user_id, count(*) AS n, count(DISTINCT h) AS hashes FROM h WHERE order_id % 3 = 0 AND h NOT IN (SELECT h FROM h WHERE order_id % 3 <> 0) GROUP BY 1",
    "cumulative_cash_cover": _FACTS_SQL + f", r AS (SELECT company, year, CAST(cash_flow AS DECIMAL(18,4)) AS c, CAST(income AS DECIMAL(18,4)) AS i, row_number() OVER (PARTITION BY company ORDER BY year DESC) AS k, max(year) OVER (PARTITION BY company) AS newest FROM facts) SELECT company, newest, {_rs('CAST(SUM(c) AS DOUBLE) / NULLIF(CAST(SUM(i) AS DOUBLE), 0)')} AS cover FROM r WHERE year + k = newest + 1 AND k <= 5 GROUP BY 1, 2 HAVING count(*) = 5",
    "return_on_equity": _FACTS_SQL + f", e AS (SELECT company, year, income, assets - liabilities AS equity FROM facts), b AS (SELECT e.*, p.equity AS before FROM e LEFT JOIN e p ON p.company = e.company AND p.year = e.year - 1), m AS (SELECT *, CASE WHEN before > 0 THEN (equity + before) / 2 ELSE equity END AS mean FROM b) SELECT company, year, {_rs('CASE WHEN mean > 0 THEN income / mean * 100 END', 2)} AS roe FROM m",
    "second_half": T + f" SELECT symbol % 97 AS company, CAST(year(trade_date) AS INTEGER) AS year, {_D2('SUM(gross) - SUM(gross) FILTER (month(trade_date) <= 6)')} AS second FROM trades GROUP BY 1, 2 HAVING count(*) FILTER (month(trade_date) <= 6) > 0",
    "dividends_per_share": T + f", n AS (SELECT symbol % 997 AS company, trade_date, max_by(fee, (order_id, line, supplier, fee)) AS dps, count(*) AS revisions FROM trades WHERE line <= 2 GROUP BY 1, 2) SELECT company, CAST(year(trade_date) AS INTEGER) AS year, {_D2('SUM(dps)')} AS dps, count(*) AS n, max(revisions) AS revisions FROM n GROUP BY 1, 2",
    "tail_plan": "WITH " + CLOSES_SQL + ", c AS (SELECT symbol, min(d) AS first, max(d) AS last FROM closes WHERE symbol % 7 <> 0 AND day(d) BETWEEN 3 AND 20 + symbol % 9 GROUP BY 1), t AS (SELECT range AS symbol, DATE '2024-01-01' AS low, DATE '2024-01-25' AS high FROM range(50)), j AS (SELECT * FROM t LEFT JOIN c USING (symbol)), g AS (SELECT symbol, CASE WHEN first IS NULL THEN 'all' ELSE 'head' END AS part, low AS s, CASE WHEN first IS NULL THEN high ELSE LEAST(first - 1, high) END AS e FROM j WHERE first IS NULL OR low < first UNION ALL SELECT symbol, 'tail', GREATEST(last + 1, low), high FROM j WHERE high > last) SELECT symbol, part, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS \"end\" FROM g",
    "open_sessions": f"WITH x AS (SELECT event_type, {_LOCAL('Asia/Shanghai')} AS h, {_LOCAL('America/New_York')} AS a FROM events) SELECT event_type, count(*) FILTER (isodow(h) < 6 AND (strftime(h, '%H:%M') >= '09:30' AND strftime(h, '%H:%M') < '11:30' OR strftime(h, '%H:%M') >= '13:00' AND strftime(h, '%H:%M') < '15:00')) AS home, count(*) FILTER (isodow(a) < 6 AND strftime(a, '%H:%M') >= '09:30' AND strftime(a, '%H:%M') < '16:00') AS away FROM x GROUP BY 1",
    "tax_allocations": T + ", g AS (SELECT user_id, symbol, SUM(fee) AS amount, SUM(fee) FILTER (line <= 3) * 2 AS allocated, count(DISTINCT account_id) FILTER (line <= 3) AS accounts FROM trades GROUP BY 1, 2) SELECT user_id, CASE WHEN accounts = 0 THEN 'none' WHEN accounts > 1 THEN 'strays' WHEN allocated > amount THEN 'exceeds' ELSE 'fits' END AS state, count(*) AS n FROM g GROUP BY 1, 2",
    "fx_latest": T + ", " + FX_SQL + f", n AS (SELECT cur, max_by(rate, eff) AS rate, CAST(max(eff) AS VARCHAR) AS eff FROM fx GROUP BY 1), h AS (SELECT cur, SUM(gross) AS gross FROM trades GROUP BY 1) SELECT h.cur AS cur, CAST(ROUND(rate, 4) AS DOUBLE) AS rate, eff, {_D2('gross * rate')} AS base FROM h LEFT JOIN n USING (cur)",
}
