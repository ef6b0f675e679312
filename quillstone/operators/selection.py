"""Choosing rows and values: by source, by recency, by completeness, by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_either(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that agree on any of the column pairs, each pair of rows once: an equi-join for each, never a nested loop."""
    return reduce(DataFrame.unionByName, [left.join(right, F.col(a) == F.col(b)) for a, b in pairs]).distinct()


def by_priority(rows: DataFrame, keys: list[str], priority: Column, value: str) -> DataFrame:
    """The value of each key's foremost source that has one."""
    return rows.where(F.col(value).isNotNull()).withColumn("__p", priority).groupBy(*keys).agg(F.min_by(value, F.struct("__p", value)).alias(value))


def range_with_seed(series: DataFrame, keys: list[str], date: str, value: str, start: Column, end: Column) -> DataFrame:
    """A series inside a range, and of each key the last value before it."""
    before = series.where(F.col(date) < start).groupBy(*keys).agg(F.max_by(F.struct(date, value), F.col(date)).alias("__s"))
    return series.where(F.col(date).between(start, end)).select(*keys, date, value).unionByName(before.select(*keys, f"__s.{date}", f"__s.{value}"))


def owners(left: DataFrame, met: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Each left row's only match, or why it has none: (left_id, owner, status)."""
    found = met.groupBy(left_id).agg(F.count_distinct(right_id).alias("__n"), F.min(right_id).alias("owner"))
    out = left.select(left_id).join(found, left_id, "left")
    status = F.when(F.col("__n") == 1, "matched").when(F.col("__n") > 1, "ambiguous").otherwise("none")
    return out.select(left_id, F.when(F.col("__n") == 1, F.col("owner")).alias("owner"), status.alias("status"))


def streak(rows: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Years in a row that end with each key's newest."""
    years = rows.select(*keys, year).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(year).desc()))
    islands = years.withColumn("__i", F.col(year) + place)
    newest = islands.groupBy(*keys).agg(F.max(year).alias("newest"))
    return islands.join(newest, keys).where(F.col("__i") == F.col("newest") + 1).groupBy(*keys).agg(F.max("newest").alias("newest"), F.count("*").alias("years"))


def backward_factors(prices: DataFrame, cuts: DataFrame, keys: list[str], date: str, ratio: str) -> DataFrame:
    """Each price row's product of 1 / ratio over the cuts at or before its date; null from a cut without ratio on.

    Cuts join the prices as rows of their own, so the running product is one window over a key.
    """
    log = F.when(F.col(ratio) > 0, -F.ln(ratio))
    marks = cuts.select(*keys, date, log.alias("__log"), log.isNull().cast("int").alias("__bad"), F.lit(False).alias("__price"))
    both = prices.select(*keys, date, F.lit(0.0).alias("__log"), F.lit(0).alias("__bad"), F.lit(True).alias("__price")).unionByName(marks)
    w = Window.partitionBy(*keys).orderBy(F.col(date), F.col("__price")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factor = F.when(F.max("__bad").over(w) == 0, F.exp(F.sum("__log").over(w)))
    return both.withColumn("factor", factor).where("__price").select(*keys, date, "factor")


def take_turns(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``turn``: the first of every group come before the second of any."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def top_of_each(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, with how many it has in all."""
    w = Window.partitionBy(*group)
    return rows.withColumn("total", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= most)


def whole_days(rows: DataFrame, day: str, least: int) -> DataFrame:
    """The newest days that together hold at least so many rows; the last one is finished."""
    counts = rows.groupBy(day).agg(F.count("*").alias("__n"))  # as many rows as days
    before = F.coalesce(F.sum("__n").over(Window.orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = counts.withColumn("__before", before).where(F.col("__before") < least).select(day)
    return rows.join(kept, day, "left_semi")


def complete_sums(rows: DataFrame, keys: list[str], name: str, value: str, parts: list[str]) -> DataFrame:
    """The sum over named parts where all of them are there."""
    return rows.where(F.col(name).isin(parts) & F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(name).alias("__n"), F.sum(value).alias("total")).where(F.col("__n") == len(parts)).drop("__n")


def run_totals(rows: DataFrame, keys: list[str], year: str, columns: list[str], years: int) -> DataFrame:
    """Of each key the sums over the newest unbroken run, if it has so many years: of its last ones."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(year).desc()))
    newest = F.max(year).over(Window.partitionBy(*keys))
    run = rows.withColumn("__k", place).withColumn("__new", newest).where((F.col(year) + F.col("__k") == F.col("__new") + 1) & (F.col("__k") <= years))
    return run.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(year).alias("newest"), *[F.sum(c).alias(c) for c in columns]).where(F.col("__n") == years).drop("__n")


def missing_ranges(targets: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """What of each target (low, high) isn't covered (first, last): a head before, a tail behind, or all of it."""
    t = targets.join(coverage, keys, "left")
    head = F.when(F.col("first").isNull(), F.struct(F.lit("all").alias("part"), F.col("low").alias("start"), F.col("high").alias("end"))).when(F.col("low") < F.col("first"), F.struct(F.lit("head").alias("part"), F.col("low").alias("start"), F.least(F.date_sub("first", 1), F.col("high")).alias("end")))
    tail = F.when(F.col("high") > F.col("last"), F.struct(F.lit("tail").alias("part"), F.greatest(F.date_add("last", 1), F.col("low")).alias("start"), F.col("high").alias("end")))
    return t.select(*keys, F.explode(F.array_compact(F.array(head, tail))).alias("gap")).select(*keys, "gap.*")


def session_open(at: Column, zone: str, windows: list[tuple[str, str]]) -> Column:
    """Whether an instant lies on a weekday inside a market's local hours (from inclusive, to exclusive)."""
    local = F.from_utc_timestamp(at, zone)
    clock = F.date_format(local, "HH:mm")
    inside = reduce(Column.__or__, [(clock >= a) & (clock < b) for a, b in windows])
    return (F.weekday(local) < 5) & inside
