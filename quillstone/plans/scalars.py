"""Queries over the scalar functions, each on cells written from the tables' rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .star import table


def market_inference(spark: SparkSession, d: str) -> DataFrame:
    """Orders counted by the market that a code, a currency and a holder's code speak for."""
    o = table(spark, d, "orders").select(F.lpad((F.col("o_orderkey") * 7919 % 1000000).cast("string"), 6, "0").alias("code"), F.col("o_custkey").alias("k"))
    o = o.withColumn("code", F.when(F.col("k") % 5 == 0, F.substring("code", 2, 5)).otherwise(F.col("code")))
    cur = F.when(F.col("k") % 7 == 0, "HKD").when(F.col("k") % 7 == 1, "USD").otherwise("CNY")
    return o.select(sc.market_of(F.col("code"), cur, F.when(F.col("k") % 11 == 0, "H123")).alias("market"), sc.counter_currency(F.col("code")).alias("counter")).groupBy("market", "counter").agg(F.count("*").alias("n"))


def cell_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the shapes of names, and codes shown by their head alone."""
    p = table(spark, d, "part")
    shown = sc.mask_code(F.col("p_partkey").cast("string"))
    return p.select(sc.value_class(F.concat("p_brand", F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).alias("shape"), F.substring(shown, 1, 1).alias("head"), F.length(shown).alias("size")).groupBy("shape", "head", "size").agg(F.count("*").alias("n"))


def share_factors(spark: SparkSession, d: str) -> DataFrame:
    """Bonus and split factors from ratios, or from shares where a ratio is missing or unreadable."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("k"))
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("10："), F.col("k"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("0:"), F.col("k")))
    ratio, held = sc.ratio_text(text), F.lit(100).cast("decimal(18,2)")
    more = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey").cast("decimal(18,2)"))
    r = lambda c: F.round(c.cast("decimal(28,8)"), 4).cast("double")
    return s.select("s_suppkey", r(sc.bonus_factor(ratio, more, held)).alias("bonus"), r(sc.split_factor(ratio, more, held)).alias("split"))


def restated_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of totals to balances: those about a whole number or one over it, and those about a power of ten."""
    c = table(spark, d, "customer").select((F.lit(1.0) * F.col("c_custkey") / (F.col("c_custkey") % 37 + 1)).alias("ratio"))
    return c.select(sc.clean_factor(F.col("ratio")).alias("factor"), sc.magnitude_off(F.col("ratio")).alias("power")).groupBy(F.round("factor", 6).alias("factor"), "power").agg(F.count("*").alias("n"))


def accounting_cells(spark: SparkSession, d: str) -> DataFrame:
    """Figures written with brackets, dashes and separators, read back and summed."""
    v = F.col("l_extendedprice").cast("decimal(12,2)")
    k = F.col("l_orderkey") % 8
    cell = F.when(k == 0, F.concat(F.lit("("), F.format_number(v.cast("double"), 2), F.lit(")"))).when(k == 1, F.lit("—")).when(k == 2, F.concat(F.lit("("), v.cast("string"))).when(k == 3, F.lit("n/a")).otherwise(F.format_number(v.cast("double"), 2))
    read = table(spark, d, "lineitem").select(k.alias("kind"), sc.number_cell(cell).alias("value"))
    return read.groupBy("kind").agg(F.count("value").alias("n"), F.sum("value").cast("decimal(28,2)").cast("double").alias("total"))


def fiscal_years(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the fiscal year of a period end in either spelling; only annual rows have one."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"))
    text = F.when(F.col("k") % 2 == 0, F.date_format("d", "yyyyMMdd")).otherwise(F.date_format("d", "yyyy-MM-dd"))
    return o.select(sc.fiscal_year(text, F.when(F.col("k") % 3 == 0, "FY").when(F.col("k") % 3 == 1, "Q1")).alias("year"), sc.period_end(text).isNotNull().alias("read")).groupBy("year", "read").agg(F.count("*").alias("n"))


def local_days(spark: SparkSession, d: str) -> DataFrame:
    """Events by the market's calendar day, the source's own day first, and the starts of its periods."""
    e = table(spark, d, "events").select("ts", "user_id", F.when(F.col("user_id") % 4 == 0, F.to_date("ts")).alias("own"), F.when(F.col("user_id") % 3 == 0, "America/New_York").otherwise("Asia/Shanghai").alias("zone"))
    e = e.select(sc.quote_day(F.col("own"), F.col("ts"), F.col("zone")).alias("day"), F.when(F.col("user_id") % 3 == 1, "mtd").when(F.col("user_id") % 3 == 2, "ytd").otherwise("daily").alias("period"))
    return e.select(F.col("day").cast("string").alias("day"), sc.period_start(F.col("period"), F.col("day")).cast("string").alias("start")).groupBy("day", "start").agg(F.count("*").alias("n"))


def growth_directions(spark: SparkSession, d: str) -> DataFrame:
    """Balances against those of the customer before: signs, growth and where it goes."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("now"))
    before = c.select((F.col("k") + 1).alias("k"), F.col("now").alias("before"))
    r = c.join(before, "k", "left").select(sc.direction(F.col("now"), F.col("before")).alias("way"), sc.growth(F.col("now"), F.col("before")).alias("g"))
    return r.groupBy("way").agg(F.count("*").alias("n"), F.count("g").alias("grown"), F.sum((F.col("g") > 0).cast("int")).cast("long").alias("up"))


def fees_in_price_currency(spark: SparkSession, d: str) -> DataFrame:
    """Costs booked in the base currency, in that of the price, by currency."""
    line = table(spark, d, "lineitem")
    q, gross, fee = (F.col(c).cast("decimal(18,4)") for c in ("l_quantity", "l_extendedprice", "l_tax"))
    price = (F.col("l_partkey") % 90 + 1).cast("decimal(18,4)")
    k = F.col("l_suppkey") % 4
    net = F.when(k != 3, gross + fee)
    cost = sc.fee_in_price_currency(q, price, gross, net, fee, k == 0)
    return line.select(k.alias("kind"), F.round(cost.cast("double"), 8).cast("decimal(28,8)").alias("fee"), (sc.lot_multiplier(F.when(k == 1, "上海").otherwise("深圳"), F.col("l_partkey").cast("string")) * q).alias("units"), sc.tax_of(gross, fee).alias("tax")).groupBy("kind").agg(F.round(F.sum("fee"), 2).cast("double").alias("fee"), F.sum("units").cast("double").alias("units"), F.round(F.sum("tax").cast("decimal(28,8)"), 2).cast("double").alias("tax"))


def text_features(spark: SparkSession, d: str) -> DataFrame:
    """Codes named in posts, ideograph shares and squashed spacing, over texts made from customers."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    post = F.concat(F.lit("看好 $名 称("), "k", F.lit(")$ 与 $b(sh60"), F.col("k"), F.lit(")$"))
    link = F.concat(F.lit("https://x/S/"), F.when(F.col("k").cast("int") % 2 == 0, F.col("k")).otherwise(F.lit("aapl")), F.lit("/123"))
    return c.select(F.col("k").cast("long").alias("c_custkey"), F.array_join(sc.symbol_refs(post, link), ",").alias("refs"), F.round(sc.ideograph_share(post), 6).alias("share"), sc.squash_spaced(F.concat(F.lit("净 利 润 "), "k", F.lit(" 合 计"))).alias("squashed"))


def price_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Prices under any of three keys, non-positive ones passed over, and details merged with the newer map ahead."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("code"), F.col("s_nationkey").cast("string").alias("market"))
    entry = lambda key, v: F.struct(key.alias("key"), v.cast("double").alias("value"))
    prices = F.map_from_entries(F.array(entry(F.concat_ws(":", "code", "market"), F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(F.lit(0))), entry(F.concat_ws(":", F.lit("m"), "market", "code"), F.col("k")), entry(F.col("code"), F.when(F.col("k") % 3 == 0, -F.col("k")).otherwise(F.col("k") * 2))))
    details = sc.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.when(F.col("k") % 5 != 0, F.create_map(F.lit("b"), F.col("k").cast("int"))))
    return s.select("k", sc.current_price(prices, F.col("code"), F.col("market")).alias("price"), details["a"].alias("a"), details["b"].alias("b"))


def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of supplier rows; amounts without trailing zeros."""
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", sc.row_hash(F.col("s_name"), sc.plain_decimal(F.col("s_acctbal").cast("decimal(18,2)")), F.when(F.col("s_suppkey") % 2 == 0, F.lit("2026-01-01").cast("date"))).alias("hash"))


QUERIES = {f.__name__: f for f in (market_inference, cell_shapes, share_factors, restated_ratios, accounting_cells, fiscal_years, local_days, growth_directions, fees_in_price_currency, text_features, price_lookup, row_hashes)}

_R = "CAST(ROUND(CAST({} AS DECIMAL(28,8)), 4) AS DOUBLE)".format
ORACLE = {
    "market_inference": """WITH c AS (SELECT lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code, o_custkey AS k FROM orders),
        x AS (SELECT CASE WHEN k % 5 = 0 THEN substr(code, 2, 5) ELSE code END AS code, CASE k % 7 WHEN 0 THEN 'HKD' WHEN 1 THEN 'USD' ELSE 'CNY' END AS cur, k FROM c)
        SELECT CASE WHEN code LIKE '200%' OR code LIKE '900%' THEN 'B股' WHEN cur = 'HKD' OR k % 11 = 0 OR length(code) = 5 THEN '港股' WHEN cur = 'USD' THEN '美股' WHEN code[1] IN ('0', '1', '2', '3', '5', '6', '9') THEN 'A股' ELSE '其他' END AS market,
        CASE WHEN CAST(code AS INTEGER) BETWEEN 80000 AND 89999 THEN 'CNY' END AS counter, count(*) AS n FROM x GROUP BY 1, 2""",
    "cell_shapes": """WITH c AS (SELECT trim(p_brand || ' ' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)) AS t, CAST(p_partkey AS VARCHAR) AS k FROM part)
        SELECT array_to_string(list_transform(regexp_extract_all(t, '[0-9]|[.,+-]|[^0-9.,+-]+'), lambda r: CASE WHEN regexp_full_match(r, '[0-9]') THEN 'd' WHEN regexp_full_match(r, '[.,+-]') THEN r ELSE '<X:' || length(r) || '>' END), '') AS shape,
        CASE WHEN length(k) = 1 THEN '*' ELSE k[1] END AS head, CAST(length(k) AS INTEGER) AS size, count(*) AS n FROM c GROUP BY 1, 2, 3""",
    "share_factors": f"""WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS more, s_suppkey % 3 = 0 AS given FROM supplier)
        SELECT s_suppkey, {_R("CASE WHEN given THEN 1 + s_suppkey / 10.0 ELSE (100 + more) / 100.0 END")} AS bonus, {_R("CASE WHEN given THEN s_suppkey / 10.0 ELSE more / 100.0 END")} AS split FROM x""",
    "restated_ratios": """WITH x AS (SELECT 1.0::DOUBLE * c_custkey / (c_custkey % 37 + 1) AS r FROM customer),
        f AS (SELECT r, round_even(r, 0) AS whole, CASE WHEN r > 0 AND r < 1 THEN 1.0::DOUBLE / round_even(1.0::DOUBLE / r, 0) END AS part, round_even(log10(r), 0) AS k FROM x)
        SELECT round(CASE WHEN whole <> 0 AND abs(r / whole - 1) <= 0.01 THEN whole WHEN abs(r / part - 1) <= 0.01 THEN part END, 6) AS factor,
        CAST(CASE WHEN k <> 0 AND abs(r / pow(10.0::DOUBLE, k) - 1) <= 0.15 THEN k END AS INTEGER) AS power, count(*) AS n FROM f GROUP BY 1, 2""",
    "accounting_cells": """SELECT l_orderkey % 8 AS kind, count(*) FILTER (l_orderkey % 8 NOT IN (1, 2, 3)) AS n,
        CAST(SUM(CASE l_orderkey % 8 WHEN 0 THEN -1 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 1 END * CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1""",
    "fiscal_years": """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders)
        SELECT CASE WHEN k % 3 = 0 OR (month(d) = 12 AND day(d) = 31) THEN CAST(year(d - 14) AS VARCHAR) END AS year, true AS read, count(*) AS n FROM x GROUP BY 1""",
    "local_days": """WITH x AS (SELECT user_id % 3 AS p, CASE WHEN user_id % 4 = 0 THEN CAST(ts AS DATE) ELSE CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN user_id % 3 = 0 THEN 'America/New_York' ELSE 'Asia/Shanghai' END AS DATE) END AS d FROM events)
        SELECT CAST(d AS VARCHAR) AS day, CAST(CASE p WHEN 0 THEN d WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) ELSE CAST(date_trunc('year', d) AS DATE) END AS VARCHAR) AS start, count(*) AS n FROM x GROUP BY 1, 2""",
    "growth_directions": """WITH x AS (SELECT a.c_acctbal AS now, b.c_acctbal AS before FROM customer a LEFT JOIN customer b ON b.c_custkey + 1 = a.c_custkey),
        g AS (SELECT CASE WHEN now > before THEN '上升' WHEN now < before THEN '下降' WHEN now = before THEN '持平' END AS way, CASE WHEN before <> 0 AND (now < 0) = (before < 0) THEN round((now - before) / abs(before) * 100, 1) END AS g FROM x)
        SELECT way, count(*) AS n, count(g) AS grown, CAST(SUM(CASE WHEN g > 0 THEN 1 WHEN g <= 0 THEN 0 END) AS BIGINT) AS up FROM g GROUP BY 1""",
    "fees_in_price_currency": """WITH x AS (SELECT l_suppkey % 4 AS kind, CAST(l_quantity AS DECIMAL(18,4)) AS q, CAST(l_extendedprice AS DECIMAL(18,4)) AS gross, CAST(l_tax AS DECIMAL(18,4)) AS fee, CAST(l_partkey % 90 + 1 AS DECIMAL(18,4)) AS price, CAST(l_partkey AS VARCHAR) AS code FROM lineitem)
        SELECT kind, CAST(ROUND(SUM(CAST(ROUND(CASE WHEN kind = 0 OR fee = 0 THEN CAST(fee AS DOUBLE) ELSE CAST(fee AS DOUBLE) * CAST(q * price AS DOUBLE) / CAST(gross AS DOUBLE) END, 8) AS DECIMAL(28,8))), 2) AS DOUBLE) AS fee,
        CAST(SUM(q * CASE WHEN kind = 1 AND code LIKE '11%' THEN 10 ELSE 1 END) AS DOUBLE) AS units, CAST(ROUND(CAST(SUM(gross * fee) AS DECIMAL(28,8)), 2) AS DOUBLE) AS tax FROM x GROUP BY 1""",
    "text_features": """WITH x AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer)
        SELECT c_custkey, array_to_string(list_sort(list_distinct([k, 'SH60' || k, CASE WHEN c_custkey % 2 = 0 THEN k ELSE 'AAPL' END])), ',') AS refs,
        round(5.0::DOUBLE / (5 + 13 + 2 * length(k)), 6) AS share, '净利润 ' || k || ' 合 计' AS squashed FROM x""",
    "price_lookup": """SELECT s_suppkey AS k, CAST(CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN s_suppkey WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 2 END AS DOUBLE) AS price, CAST(1 AS INTEGER) AS a, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey ELSE 2 END AS INTEGER) AS b FROM supplier""",
    "row_hashes": """SELECT s_suppkey, sha256(s_name || '|' || regexp_replace(CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') || '|' || CASE WHEN s_suppkey % 2 = 0 THEN '2026-01-01' ELSE '' END) AS hash FROM supplier""",
}
