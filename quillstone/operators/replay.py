"""Ledger replays: per-key folds inside the JVM.

A key's events are gathered in one sorted array and folded by ``aggregate``; a key is one security of one
user, whose events stay few while the number of keys grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOT = "array<struct<qty:double,cost:double,date:date>>"
CLOSED = "array<struct<date:date,qty:double,proceeds:double,cost:double,first_date:date>>"


def events_of(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the sorted array ``events`` of (order, side, qty, gross, fee, trade_date)."""
    row = F.struct(F.struct(*order).alias("o"), "side", F.col("qty").cast("double").alias("q"), F.col("gross").cast("double").alias("g"), F.col("fee").cast("double").alias("f"), F.col("trade_date").alias("d"))
    return trades.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("events"))


def fifo(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, open lots, closed trades, number of skipped over-sells.

    A buy opens a lot at cost gross + fee.  A sell takes the oldest lots; one that asks for more than there
    is gets skipped whole and counted.  Proceeds are gross - fee.
    """

    def take(state: Column, e: Column) -> Column:
        lots = state["lots"]
        before = lambda i: F.aggregate(F.slice(lots, F.lit(1), i), F.lit(0.0), lambda s, x: s + x["qty"])
        # Of each lot: how much is taken, given what the lots before it held.
        cut = F.transform(lots, lambda x, i: F.struct(x["qty"].alias("qty"), x["cost"].alias("cost"), x["date"].alias("date"), F.greatest(F.lit(0.0), F.least(x["qty"], e["q"] - before(i))).alias("taken")))
        rest = F.transform(F.filter(cut, lambda x: x["qty"] - x["taken"] > 1e-9), lambda x: F.struct((x["qty"] - x["taken"]).alias("qty"), (x["cost"] * (F.lit(1.0) - x["taken"] / x["qty"])).alias("cost"), x["date"].alias("date")))
        cost = F.aggregate(cut, F.lit(0.0), lambda s, x: s + x["cost"] * (x["taken"] / x["qty"]))
        closed = F.struct(e["d"].alias("date"), e["q"].alias("qty"), (e["g"] - e["f"]).alias("proceeds"), cost.alias("cost"), F.get(lots, F.lit(0))["date"].alias("first_date"))
        return F.struct(rest.alias("lots"), F.concat(state["closed"], F.array(closed)).alias("closed"), state["skipped"].alias("skipped"))

    def step(state: Column, e: Column) -> Column:
        held = F.aggregate(state["lots"], F.lit(0.0), lambda s, x: s + x["qty"])
        lot = F.struct(e["q"].alias("qty"), (e["g"] + e["f"]).alias("cost"), e["d"].alias("date"))
        bought = F.struct(F.concat(state["lots"], F.array(lot)).alias("lots"), state["closed"].alias("closed"), state["skipped"].alias("skipped"))
        skipped = F.struct(state["lots"].alias("lots"), state["closed"].alias("closed"), (state["skipped"] + 1).alias("skipped"))
        return F.when(e["side"] == "BUY", bought).when(e["q"] > held + 1e-9, skipped).otherwise(take(state, e))

    kind = f"struct<lots:{LOT},closed:{CLOSED},skipped:int>"
    start = F.struct(F.array().cast(LOT).alias("lots"), F.array().cast(CLOSED).alias("closed"), F.lit(0).alias("skipped"))
    folded = events_of(trades, keys, order).withColumn("s", F.aggregate("events", start.cast(kind), lambda s, e: step(s, e).cast(kind)))
    return folded.select(*keys, "s.lots", "s.closed", "s.skipped")


def average_cost(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, qty, avg_cost, total_cost by the moving average; a sell is cut at what is held."""

    def step(s: Column, e: Column) -> Column:
        buy = F.struct((s["qty"] + e["q"]).alias("qty"), (s["cost"] + e["g"] + e["f"]).alias("cost"))
        sold = F.least(e["q"], s["qty"])
        left = s["qty"] - sold
        sell = F.struct(left.alias("qty"), F.when(s["qty"] > 0, s["cost"] * (left / s["qty"])).otherwise(0.0).alias("cost"))
        return F.when(e["side"] == "BUY", buy).otherwise(sell)

    kind = "struct<qty:double,cost:double>"
    start = F.struct(F.lit(0.0).alias("qty"), F.lit(0.0).alias("cost")).cast(kind)
    out = events_of(trades, keys, order).withColumn("s", F.aggregate("events", start, lambda s, e: step(s, e).cast(kind)))
    return out.select(*keys, F.col("s.qty").alias("qty"), F.try_divide("s.cost", "s.qty").alias("avg_cost"), F.col("s.cost").alias("total_cost"))


def xirr(flows: DataFrame, keys: list[str], date: str = "d", amount: str = "amount", steps: int = 100) -> DataFrame:
    """keys and the yearly rate that makes the discounted flows sum to zero; null if all have one sign.

    Bisection over log(1 + rate) in [log 1e-4, log 1e6], years of 365.25 days from the first flow, folded in the JVM.
    """
    row = F.struct(F.col(date).alias("d"), F.col(amount).cast("double").alias("a"))
    g = flows.groupBy(*keys).agg(F.collect_list(row).alias("flows"), F.min(date).alias("start"), F.min(amount).alias("low"), F.max(amount).alias("high"))

    def value(x: Column) -> Column:
        return F.aggregate("flows", F.lit(0.0), lambda s, f: s + f["a"] * F.exp(-x * F.datediff(f["d"], F.col("start")) / 365.25))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        down = (value(mid) > 0) == (s["sign"] > 0)
        return F.struct(F.when(down, mid).otherwise(s["lo"]).alias("lo"), F.when(down, s["hi"]).otherwise(mid).alias("hi"), s["sign"].alias("sign"))

    lo, hi = math.log(1e-4), math.log(1e6)
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.signum(value(F.lit(lo))).alias("sign"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.exp((s["lo"] + s["hi"]) / 2) - 1)
    crosses = F.signum(value(F.lit(lo))) != F.signum(value(F.lit(hi)))
    return g.select(*keys, F.when((F.col("low") < 0) & (F.col("high") > 0) & crosses, found).alias("xirr"))
