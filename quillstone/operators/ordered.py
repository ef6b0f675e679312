"""Ordered operators as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(keys: list[str], order: list[Column | str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clamped_position(signed: Column, keys: list[str], order: list[Column | str], df: DataFrame, name: str = "position") -> DataFrame:
    """Running sum that never falls below zero: what a step takes beyond the rest is cut off.

    A walk reflected at zero equals the free walk minus its smallest value so far, if that is negative.
    """
    w = running(keys, order)
    free = df.withColumn("__free", F.sum(signed).over(w))
    low = F.least(F.min("__free").over(w), F.lit(0).cast(free.schema["__free"].dataType))
    return free.withColumn(name, F.col("__free") - low).drop("__free")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def islands(df: DataFrame, keys: list[str], order: str, name: str = "island") -> DataFrame:
    """Numbers the runs of consecutive integers of ``order`` within a key (rows must be distinct there)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.col(order) - F.row_number().over(w))


def top_with_others(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k keys of largest value and one row for the sum of the rest.

    Only the ranking of the k largest is global (a bounded top-k); the rest is summed by key membership.
    """
    total = df.groupBy(key).agg(F.sum(value).alias(value))
    top = total.orderBy(F.col(value).desc(), key).limit(k)
    marked = total.join(F.broadcast(top.select(key, F.lit(True).alias("__top"))), key, "left")  # k rows
    label = F.when(F.col("__top"), F.col(key).cast("string")).otherwise(F.lit("others"))
    return marked.groupBy(label.alias(key)).agg(F.sum(value).alias(value), F.count("*").alias("members"))


def running_product(factor: Column, w) -> Column:
    """Product of positive factors so far; a zero makes it zero from there on, a negative one is not allowed."""
    zero = F.max(F.when(factor == 0, 1).otherwise(0)).over(w)
    return F.when(zero == 1, 0.0).otherwise(F.exp(F.sum(F.when(factor > 0, F.ln(factor))).over(w)))
