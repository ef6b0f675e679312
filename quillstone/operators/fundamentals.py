"""Statement analysis: period joins, runs of years, trailing sums, earnings quality and the eight-factor score.

A statement row has a company, a year (or quarter) and amounts.  Years are joined by their number, never by
position, so a gap makes the comparison null instead of wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import growth_percent, ratio

# Intercept, weights and threshold of the eight-factor score.
M_SCORE = {"dsri": 0.92, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}
M_INTERCEPT, M_FLAG = -4.84, -1.78


def with_prior(rows: DataFrame, keys: list[str], year: str, columns: list[str], gap: int = 1) -> DataFrame:
    """Adds ``p_<column>`` of the same key ``gap`` years earlier; null where that year is missing."""
    prior = rows.select(*keys, (F.col(year) + gap).alias(year), *[F.col(c).alias(f"p_{c}") for c in columns])
    return rows.join(prior, [*keys, year], "left")


def soft_assets(prefix: str = "") -> Column:
    """Share of the assets that's neither current nor tangible."""
    return F.lit(1.0) - ratio(F.col(f"{prefix}cur_assets") + F.col(f"{prefix}ppe"), F.col(f"{prefix}assets"))


def m_score(rows: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """keys, year, the eight factors, score and flag; without all factors no row."""
    used = ["revenue", "receivable", "margin", "cur_assets", "ppe", "assets", "depreciation", "sga", "liabilities"]
    j = with_prior(rows, keys, year, used)
    c, p = F.col, lambda n: F.col(f"p_{n}")
    wear = lambda x, y: ratio(x, x + y)
    factors = {
        "dsri": ratio(ratio(c("receivable"), c("revenue")), ratio(p("receivable"), p("revenue"))),
        "gmi": ratio(p("margin"), c("margin")),
        "aqi": ratio(soft_assets(), soft_assets("p_")),
        "sgi": ratio(c("revenue"), p("revenue")),
        "depi": ratio(wear(p("depreciation"), p("ppe")), wear(c("depreciation"), c("ppe"))),
        "sgai": ratio(ratio(c("sga"), c("revenue")), ratio(p("sga"), p("revenue"))),
        "tata": ratio(c("income") - c("cash_flow"), c("assets")),
        "lvgi": ratio(ratio(c("liabilities"), c("assets")), ratio(p("liabilities"), p("assets"))),
    }
    out = j.select(*keys, year, *[f.alias(n) for n, f in factors.items()]).dropna(subset=list(factors))
    total = F.lit(M_INTERCEPT)
    for n, w in M_SCORE.items():
        total = total + F.lit(w) * F.col(n)
    return out.withColumn("score", total).withColumn("flag", F.col("score") > M_FLAG)


def earnings_quality(rows: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """Cash cover (only of a positive income), accruals over assets, growth of receivables and stock ahead of revenue."""
    j = with_prior(rows, keys, year, ["revenue", "receivable", "inventory"])
    grow = lambda n: growth_percent(F.col(n), F.col(f"p_{n}"))
    return j.select(
        *keys, year, F.when(F.col("income") > 0, ratio(F.col("cash_flow"), F.col("income"))).alias("cash_cover"), ratio(F.col("income") - F.col("cash_flow"), F.col("assets")).alias("accruals"),
        (grow("receivable") - grow("revenue")).alias("receivable_gap"), (grow("inventory") - grow("revenue")).alias("inventory_gap"),
    )


def newest_run(rows: DataFrame, keys: list[str], order: str, holds: Column) -> DataFrame:
    """keys, length of the run of consecutive periods from the newest back in which ``holds`` is true, and what ended it.

    ``stop`` is ``gap`` (a missing period), ``unknown`` (a null), ``value`` (false) or null (all rows hold).
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    gap = F.coalesce(F.lag(order).over(w) - F.col(order) > 1, F.lit(False))
    stop = F.when(gap, "gap").when(holds.isNull(), "unknown").when(~holds, "value")
    marked = rows.select(*keys, order, stop.alias("__stop"))
    first = marked.groupBy(*keys).agg(F.max(F.when(F.col("__stop").isNotNull(), F.struct(order, "__stop"))).alias("__end"))
    counted = marked.join(first, keys).where(F.col("__end").isNull() | (F.col(order) > F.col(f"__end.{order}")) | (F.col(order) == F.col(f"__end.{order}")))
    return counted.groupBy(*keys).agg(F.count(F.when(F.col("__stop").isNull(), 1)).alias("run"), F.first("__end.__stop", ignorenulls=True).alias("stop"))


def single_quarters(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``single``: the quarter's own value from the year-to-date one; null if the quarter before is missing."""
    w = Window.partitionBy(*keys, "year").orderBy("quarter")
    before = F.when(F.lag("quarter").over(w) == F.col("quarter") - 1, F.lag(value).over(w))
    return rows.withColumn("single", F.when(F.col("quarter") == 1, F.col(value)).otherwise(F.col(value) - before))


def trailing_year(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, year, quarter and ``trailing``: last full year + this year to date - last year to the same date."""
    full = rows.where("quarter = 4").select(*keys, (F.col("year") + 1).alias("year"), F.col(value).alias("__full"))
    same = rows.select(*keys, (F.col("year") + 1).alias("year"), "quarter", F.col(value).alias("__same"))
    j = rows.join(full, [*keys, "year"], "left").join(same, [*keys, "year", "quarter"], "left")
    return j.select(*keys, "year", "quarter", F.when(F.col("quarter") == 4, F.col(value)).otherwise(F.col("__full") + F.col(value) - F.col("__same")).alias("trailing"))


def missing_years(rows: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """keys, first, last and the years between them without a row."""
    g = rows.groupBy(*keys).agg(F.min(year).alias("first"), F.max(year).alias("last"), F.collect_set(year).alias("__have"))
    return g.select(*keys, "first", "last", F.array_sort(F.array_except(F.sequence("first", "last"), "__have")).alias("missing"))


def defensive_screen(rows: DataFrame, keys: list[str], *, years: int = 5, year: str = "year") -> DataFrame:
    """pass, fail or indeterminate on each criterion at a company's newest year: liquidity, debt, steady earnings, growth."""
    newest = rows.groupBy(*keys).agg(F.max(year).alias("anchor"), F.max_by(F.struct("cur_assets", "cur_liabilities", "debt", "income"), year).alias("n"))
    run = newest_run(rows, keys, year, F.col("income") > 0)
    first = rows.select(*keys, (F.col(year) + years - 1).alias("anchor"), F.col("income").alias("then"))
    verdict = lambda test: F.when(test.isNull(), "indeterminate").when(test, "pass").otherwise("fail")
    j = newest.join(run, keys).join(first, [*keys, "anchor"], "left")
    steady = F.when(F.col("run") >= years, "pass").when(F.col("stop") == "value", "fail").otherwise("indeterminate")
    return j.select(
        *keys, "anchor", verdict(ratio(F.col("n.cur_assets"), F.col("n.cur_liabilities")) >= 2).alias("liquidity"), verdict(F.col("n.debt") <= F.col("n.cur_assets") - F.col("n.cur_liabilities")).alias("debt"),
        steady.alias("steady"), verdict(F.when(F.col("then") > 0, ratio(F.col("n.income"), F.col("then")) >= 1.33)).alias("growth"),
    )
