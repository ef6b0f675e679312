"""Incremental, windowed and import queries: event windows, first-wins dedup, policy merges, reconciliation, coverage gaps, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .star import TRADES_SQL, dbl, table, trades

T = "WITH " + TRADES_SQL


def win_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows; the same expression serves a stream with a watermark (see quillstone.streaming)."""
    from ..streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", dbl("total").alias("total"))


def win_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    g = e.groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def win_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user that a gap of two hours ends."""
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def dedup_events(spark: SparkSession, d: str) -> DataFrame:
    """The first event of a user, type and day wins."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).withColumn("day", F.col("day").cast("string"))


def latest_quote(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each key, older arrivals never win."""
    e = table(spark, d, "events")
    g = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("q"), F.count("*").alias("seen"))
    return g.select("user_id", "q.event_id", dbl("q.value").alias("value"), "seen")


def alert_states(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's error events in time order: an alert fires at the second of a run, repeats are suppressed."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = e.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w)).where("bad").groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.count(F.when(F.col("n") >= 2, 1)).alias("fired"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("suppressed"))


def row_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Rows with one normalised text are told apart by their occurrence; the hash goes over both."""
    t = trades(spark, d)
    text = F.concat_ws("|", "user_id", "symbol", "side", F.col("qty").cast("string"), F.col("trade_date").cast("string"))
    n = F.row_number().over(Window.partitionBy("text").orderBy("order_id", "line", "supplier", "gross", "disc", "tax"))
    hashed = t.withColumn("text", text).withColumn("occurrence", n).withColumn("hash", F.md5(F.concat_ws("#", "text", F.col("occurrence").cast("string"))))
    return hashed.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("hash").alias("hashes"), F.max("hash").alias("last_hash"), F.max("occurrence").cast("long").alias("most"))


def merge_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by policy: the new name wins where there is one, the old balance stays, counts add up."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("old_name"), F.col("c_acctbal").alias("old_bal"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("new "), "c_name")).alias("new_name"), (F.col("c_acctbal") + 1).alias("new_bal"))
    m = old.join(new, "c_custkey", "full_outer")
    return m.select("c_custkey", F.coalesce("new_name", "old_name").alias("name"), dbl(F.coalesce("old_bal", "new_bal")).alias("balance"), (F.when(F.col("old_bal").isNotNull(), 1).otherwise(0) + F.when(F.col("new_bal").isNotNull(), 1).otherwise(0)).alias("sources"))


def reconciliation_diff(spark: SparkSession, d: str) -> DataFrame:
    """Computed positions against a snapshot, with a tolerance and a status each."""
    c = trades(spark, d).groupBy("user_id", "symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))).alias("computed"))
    snap = c.where("symbol % 23 <> 0").select("user_id", "symbol", (F.col("computed") + F.when(F.col("symbol") % 19 == 0, 1).otherwise(0)).alias("stated"))
    m = c.where("symbol % 29 <> 0").join(snap, ["user_id", "symbol"], "full_outer")
    status = F.when(F.col("stated").isNull(), "missing_in_snapshot").when(F.col("computed").isNull(), "missing_in_ledger").when(F.abs(F.col("computed") - F.col("stated")) > 0.01, "differs").otherwise("ok")
    return m.groupBy("user_id", status.alias("status")).agg(F.count("*").alias("n"), dbl(F.sum(F.coalesce("computed", F.lit(0)) - F.coalesce("stated", F.lit(0)))).alias("gap"))


def edge_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of more than a day between a user's events, and how far the ends lie from the whole range's."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    whole = e.agg(F.min("day").alias("low"), F.max("day").alias("high"))  # one row
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day")))
    per = e.withColumn("gap", gap).groupBy("user_id").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.when(F.col("gap") > 1, 1)).alias("gaps"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest"))
    return per.join(F.broadcast(whole)).select("user_id", "gaps", "widest", F.datediff("first", "low").alias("head"), F.datediff("high", "last").alias("tail"))


def rule_classify(spark: SparkSession, d: str) -> DataFrame:
    """The first of an ordered list of patterns that a page's title meets names its class."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    kind = F.when(title.rlike("[0-9]"), "numbered").when(F.length(title) > 20, "long").when(title == "", "none").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def conversation_pack(spark: SparkSession, d: str) -> DataFrame:
    """Turns packed in order into windows of at most four."""
    c = table(spark, d, "conversations")
    pack = F.floor((F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1) / 4).cast("long")
    return c.withColumn("pack", pack).groupBy("conv_id", "pack").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (win_tumbling, win_sliding, win_session, dedup_events, latest_quote, alert_states, row_hash_dedup, merge_coalesce, reconciliation_diff, edge_gaps, rule_classify, conversation_pack)}

_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
ORACLE = {
    "win_tumbling": f"SELECT {_STAMP('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS start, event_type, count(*) AS n, CAST(ROUND(SUM(CAST(value AS DECIMAL(28,6))), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "win_sliding": f"SELECT {_STAMP('s')} AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * k AS s FROM events, range(4) r(k)) GROUP BY 1, 2",
    "win_session": f"SELECT user_id, {_STAMP('MIN(ts)')} AS start, count(*) AS n FROM (SELECT *, SUM(CASE WHEN ts < before + INTERVAL 2 HOURS THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, run",
    "dedup_events": "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1, 2, 3",
    "latest_quote": "SELECT user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id, ROUND(max_by(value, struct_pack(a := ts, b := event_id)), 4) AS value, count(*) AS seen FROM events GROUP BY 1",
    "alert_states": "SELECT user_id, count(*) AS runs, count(*) FILTER (n >= 2) AS fired, CAST(SUM(GREATEST(n - 2, 0)) AS BIGINT) AS suppressed FROM (SELECT user_id, run, count(*) AS n FROM (SELECT *, SUM(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY 1",
    "row_hash_dedup": T + ", x AS (SELECT *, concat_ws('|', user_id, symbol, side, CAST(qty AS VARCHAR), CAST(trade_date AS VARCHAR)) AS text FROM trades), o AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY order_id, line, supplier, gross, disc, tax) AS occurrence FROM x), h AS (SELECT *, md5(text || '#' || occurrence) AS hash FROM o) SELECT user_id, count(*) AS n, count(DISTINCT hash) AS hashes, max(hash) AS last_hash, max(occurrence) AS most FROM h GROUP BY 1",
    "merge_coalesce": "WITH o AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new ' || c_name END AS new_name, c_acctbal + 1 AS new_bal FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, COALESCE(new_name, c_name) AS name, ROUND(COALESCE(c_acctbal, new_bal), 4) AS balance, CAST((c_acctbal IS NOT NULL)::INT + (new_bal IS NOT NULL)::INT AS INTEGER) AS sources FROM o FULL JOIN n USING (c_custkey)",
    "reconciliation_diff": T + ", c AS (SELECT user_id, symbol, SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS computed FROM trades GROUP BY ALL), s AS (SELECT user_id, symbol, computed + CASE WHEN symbol % 19 = 0 THEN 1 ELSE 0 END AS stated FROM c WHERE symbol % 23 <> 0), m AS (SELECT * FROM (SELECT * FROM c WHERE symbol % 29 <> 0) FULL JOIN s USING (user_id, symbol)) SELECT user_id, CASE WHEN stated IS NULL THEN 'missing_in_snapshot' WHEN computed IS NULL THEN 'missing_in_ledger' WHEN abs(computed - stated) > 0.01 THEN 'differs' ELSE 'ok' END AS status, count(*) AS n, CAST(ROUND(SUM(COALESCE(computed, 0) - COALESCE(stated, 0)), 4) AS DOUBLE) AS gap FROM m GROUP BY 1, 2",
    "edge_gaps": "WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), w AS (SELECT MIN(day) AS low, MAX(day) AS high FROM e), g AS (SELECT *, day - LAG(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM e) SELECT user_id, count(*) FILTER (gap > 1) AS gaps, CAST(COALESCE(MAX(gap), 0) AS INTEGER) AS widest, CAST(MIN(day) - ANY_VALUE(low) AS INTEGER) AS head, CAST(ANY_VALUE(high) - MAX(day) AS INTEGER) AS tail FROM g, w GROUP BY user_id",
    "rule_classify": "WITH p AS (SELECT regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS t FROM pages) SELECT CASE WHEN regexp_matches(t, '[0-9]') THEN 'numbered' WHEN length(t) > 20 THEN 'long' WHEN t = '' THEN 'none' ELSE 'other' END AS class, count(*) AS n FROM p GROUP BY 1",
    "conversation_pack": "SELECT conv_id, pack, count(*) AS turns, CAST(SUM(length(text)) AS BIGINT) AS chars FROM (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 4 AS BIGINT) AS pack FROM conversations) GROUP BY 1, 2",
}
