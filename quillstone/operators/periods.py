"""Changes from one period to another, and walks over a key's rows that decide on each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_change(days: DataFrame, period: Column) -> DataFrame:
    """Profit of each period of a daily (d, mv, inflow, outflow): change of the book plus what went out less what came in.

    Grouped to a row a period first, so the window without partitions runs over periods only.
    """
    g = days.groupBy(period.alias("period")).agg(F.max_by("mv", "d").alias("closing"), F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    g = g.withColumn("opening", F.coalesce(F.lag("closing").over(Window.orderBy("period")), F.lit(0.0)))
    return g.withColumn("pnl", F.col("closing") - F.col("opening") + F.col("outflow") - F.col("inflow"))


def long_only(rows: DataFrame, keys: list[str], order: list[str], buy: Column, quantity: Column, forced: Column) -> DataFrame:
    """Per key what's left and how many forced sells were dropped because they would go short; other sells stop at zero.

    A fold over a key's rows: each step depends on which rows before it were dropped, so no window expresses it.
    """
    step = F.struct(*order, buy.alias("__buy"), quantity.cast("double").alias("__q"), forced.alias("__forced"))
    start = F.struct(F.lit(0.0).alias("held"), F.lit(0).alias("dropped"))

    def walk(s: Column, r: Column) -> Column:
        held = F.when(r["__buy"], s["held"] + r["__q"]).when(r["__forced"] & (r["__q"] > s["held"]), s["held"]).otherwise(F.greatest(s["held"] - r["__q"], F.lit(0.0)))
        return F.struct(held.alias("held"), (s["dropped"] + F.when(~r["__buy"] & r["__forced"] & (r["__q"] > s["held"]), 1).otherwise(0)).alias("dropped"))

    return rows.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(step)), start, walk).alias("s")).select(*keys, "s.*")


def share_mismatch(rows: DataFrame, keys: list[str], income: str, per_share: str, times: float = 2.0) -> DataFrame:
    """Rows whose implied number of shares lies beyond so many times that of the newest year that has one."""
    shares = F.try_divide(F.col(income), F.col(per_share))
    w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = rows.withColumn("shares", F.when(shares > 0, shares)).withColumn("__ref", F.last("shares", ignorenulls=True).over(w))
    ratio = F.try_divide("shares", "__ref")
    return r.withColumn("mismatch", F.when(ratio.isNull(), False).otherwise(~ratio.between(1 / times, times))).drop("__ref")


def newest_against(rows: DataFrame, keys: list[str], end: str, value: str, days: int = 400) -> DataFrame:
    """The newest value of each key beside the one before, if it's no more than so many days older, and that of a year ago."""
    w = Window.partitionBy(*keys).orderBy(F.col(end).desc())
    newest = F.max(end).over(Window.partitionBy(*keys))
    year_ago = F.add_months(newest, -12)
    r = rows.withColumn("__n", newest).withColumn("__k", F.row_number().over(w)).withColumn("__year", F.col(end) == F.last_day(year_ago))
    g = r.groupBy(*keys).agg(F.max(F.when(F.col("__k") == 1, F.col(end))).alias(end), F.max(F.when(F.col("__k") == 1, F.col(value))).alias("now"), F.max(F.when((F.col("__k") == 2) & (F.datediff("__n", end) <= days), F.col(value))).alias("previous"), F.max(F.when(F.col("__year"), F.col(value))).alias("year_ago"))
    return g


def merged_accounts(held: DataFrame, keys: list[str]) -> DataFrame:
    """Holdings of (account, qty, cost) across accounts: quantity, cost, average and number of accounts."""
    g = held.groupBy(*keys).agg(F.sum("qty").alias("qty"), F.sum("cost").alias("cost"), F.count("*").alias("accounts"))
    return g.withColumn("avg", F.try_divide(F.col("cost").cast("double"), F.col("qty").cast("double")))


def archive_only(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Marks rows whose code a rule excludes; they are kept, but not booked."""
    return rows.join(rules.select(key).distinct().withColumn("excluded", F.lit(True)), key, "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
