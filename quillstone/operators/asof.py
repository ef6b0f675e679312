"""As-of, nearest and window matches.

All of them turn a series into intervals or use a bounded range beside equality keys, so that Spark plans
an equi-join (hash partitioned by the key) with the range as a residual condition, never a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(series: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Adds valid_from and valid_to (exclusive, null for the newest): what was in force when."""
    w = Window.partitionBy(*keys).orderBy(date)
    return series.withColumn("valid_from", F.col(date)).withColumn("valid_to", F.lead(date).over(w))


#: Days of a bucket of an as-of join.
BUCKET_DAYS = 32


def asof(left: DataFrame, series: DataFrame, on: list[tuple[str, str]], left_date: str, series_date: str, values: list[str], how: str = "left") -> DataFrame:
    """Each left row with the newest series row at or before its date; ``on`` pairs left with series columns.

    A series row that another follows stands in every bucket of days that its interval touches, and a left row meets
    those of its own bucket alone: a daily series of decades costs it a month of rows, and a frequent key is spread
    over its buckets.  The newest row of each key is joined by the key, one row each.
    """
    own = [s for _, s in on]
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS).cast("long")
    spans = intervals(series.select(*own, series_date, *values), own, series_date)
    part = lambda p: [*[F.col(s).alias(f"{p}_{s}") for s in own], F.col("valid_from").alias(f"{p}_from"), F.col("valid_to").alias(f"{p}_to"), *[F.col(v).alias(f"{p}_{v}") for v in values]]
    closed = spans.where("valid_to is not null").select(*part("__c"), F.explode(F.sequence(bucket("valid_from"), bucket("valid_to"))).alias("__c_bucket"))
    newest = spans.where("valid_to is null").select(*part("__n"))
    same = lambda p: [F.col(mine) == F.col(f"{p}_{theirs}") for mine, theirs in on]
    met = left.join(closed, reduce(Column.__and__, [*same("__c"), bucket(left_date) == F.col("__c_bucket"), F.col(left_date) >= F.col("__c_from"), F.col(left_date) < F.col("__c_to")]), "left")
    met = met.join(newest, reduce(Column.__and__, [*same("__n"), F.col(left_date) >= F.col("__n_from")]), "left")
    if how == "inner":
        met = met.where("__c_from is not null or __n_from is not null")
    return met.select(*left.columns, *[F.when(F.col("__c_from").isNotNull(), F.col(f"__c_{v}")).otherwise(F.col(f"__n_{v}")).alias(v) for v in values])


def forward_fill(grid: DataFrame, keys: list[str], date: str, value: str) -> Column:
    """The last non-null value at or before the row, as a window expression over a grid that holds the series' rows."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(value, ignorenulls=True).over(w)


def window_match(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_date: str, right_date: str, before: int, after: int, *, require_unique: bool = False) -> DataFrame:
    """For each left row the right row of the same key nearest in date, among those from ``before`` days before to ``after`` days after.

    Days are cut into buckets as wide as the window, so each left row meets three buckets of its key.
    With ``require_unique`` a left row with several candidates is left out.
    """
    width = before + after + 1
    bucket = lambda d: F.floor(F.datediff(F.col(d), F.lit("1970-01-01").cast("date")) / width).cast("long")
    spread = left.withColumn("__b", F.explode(F.array(bucket(left_date) - 1, bucket(left_date), bucket(left_date) + 1)))
    gap = F.datediff(F.col(right_date), F.col(left_date))
    met = spread.join(right.withColumn("__b", bucket(right_date)), [*keys, "__b"]).withColumn("gap", gap).where(F.col("gap").between(-before, after)).drop("__b")
    if require_unique:
        return met.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(left_id))).where("__n = 1").drop("__n")
    order = Window.partitionBy(left_id).orderBy(F.abs("gap"), F.col(right_date), *[c for c in right.columns if c not in (*keys, right_date)])
    return met.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def multiset_match(new: DataFrame, booked: DataFrame, keys: list[str], new_order: list[str], booked_order: list[str]) -> DataFrame:
    """The k-th new row of a key paired with the k-th booked row of it; unpaired new rows keep nulls."""
    a = new.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*new_order)))
    b = booked.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*booked_order)))
    return a.join(b, [*keys, "__k"], "left").drop("__k")
