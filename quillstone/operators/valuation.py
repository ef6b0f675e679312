"""Entitlements, price choices, ranges and notices, as windows and groups over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import latest_per_key, running


def held_by_account(events: DataFrame, keys: list[str], account: str, signed: Column, order: list[str]) -> DataFrame:
    """What each account holds after all events: (keys, account, quantity, basis).

    If an account sells more than it has, accounts can't be told apart: the key gets one row, without account and
    with basis "merged", whose quantity never falls below zero on the way.  Only positive quantities are returned.
    Both windows lie in the partitioning of the keys, so the events are shuffled once.
    """
    e = events.withColumn("__s", signed)
    e = e.withColumn("__all", F.sum("__s").over(running(keys, order))).withColumn("__own", F.sum("__s").over(running([*keys, account], order)))
    parts = e.groupBy(*keys, account).agg(F.sum("__s").alias("quantity"), F.min("__own").alias("__low"), F.min("__all").alias("__least"))
    key = parts.groupBy(*keys).agg(F.min("__low").alias("__low"), F.min("__least").alias("__least"), F.sum("quantity").alias("__total"), F.collect_list(F.struct(account, "quantity")).alias("__parts"))
    kind = dict(parts.dtypes)
    merged = F.array(F.struct(F.lit(None).cast(kind[account]).alias(account), (F.col("__total") - F.least(F.col("__least"), F.lit(0))).cast(kind["quantity"]).alias("quantity")))
    torn = F.col("__low") < 0
    rows = key.select(*keys, F.when(torn, "merged").otherwise("per_account").alias("basis"), F.explode(F.when(torn, merged).otherwise(F.col("__parts"))).alias("__p"))
    return rows.select(*keys, f"__p.{account}", "__p.quantity", "basis").where("quantity > 0")


def sole_holders(held: DataFrame, keys: list[str], account: str) -> DataFrame:
    """The keys that exactly one account holds."""
    return held.where("basis = 'per_account'").groupBy(*keys).agg(F.count("*").alias("__n"), F.max(account).alias(account)).where("__n = 1").drop("__n")


def sum_by_day(forms: DataFrame, keys: list[str], day: str, amount: str, currency: str) -> DataFrame:
    """Dividends of one ex-date in one: their sum, or none and a conflict where their currencies differ."""
    g = forms.groupBy(*keys, day).agg(F.count("*").alias("forms"), F.min(currency).alias("low"), F.max(currency).alias("high"), F.sum(amount).alias("total"))
    alone = F.col("low") == F.col("high")
    return g.select(*keys, day, "forms", F.when(alone, F.col("low")).alias("currency"), F.when(alone, F.col("total")).alias("amount"), (~alone).alias("conflict"))


def implemented(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distributions of (end, ex, announced, noticed, amount, stock), each once.

    Revisions of one (end, ex) give way to the last announced; differing amounts are a conflict.  One distribution
    under several period ends is merged into the newest if ex-date, announcement and a positive amount agree.
    """
    cash, stock = F.coalesce("amount", F.lit(0)), F.coalesce("stock", F.lit(0))
    w = Window.partitionBy(*keys, "end", "ex")
    marked = rows.withColumn("conflict", F.min(cash).over(w) != F.max(cash).over(w))
    last = latest_per_key(marked, [*keys, "end", "ex"], [F.col("announced").desc_nulls_last(), F.col("noticed").desc_nulls_last(), F.col("amount").desc_nulls_last(), F.col("stock").desc_nulls_last()])
    clear = ~F.col("conflict") & F.col("ex").isNotNull() & F.col("announced").isNotNull() & F.coalesce(F.col("amount") > 0, F.lit(False))
    one = Window.partitionBy(*keys, "ex", "announced", "amount", stock, clear, F.when(~clear, F.col("end")))
    return last.withColumn("ends", F.count("*").over(one)).withColumn("__newest", F.row_number().over(one.orderBy(F.col("end").desc()))).where(F.col("__newest") == 1).drop("__newest")


def base_prices(added: DataFrame, prices: DataFrame, key: str, day: str, value: str, within: int) -> DataFrame:
    """The price that each added (key, day) starts from: the last one so many days back at most, else the first one behind, else none."""
    p = prices.select(key, day, F.struct(F.col(day).alias("at"), F.col(value).alias("v")).alias("__p"), F.lit(False).alias("__add"))
    both = p.unionByName(added.select(key, day).distinct().withColumn("__p", F.lit(None).cast(p.schema["__p"].dataType)).withColumn("__add", F.lit(True)))
    w = Window.partitionBy(key).orderBy(day)
    both = both.withColumn("__b", F.last("__p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__a", F.first("__p", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    near = F.datediff(F.col(day), F.col("__b.at")) <= within
    chosen = F.when(near, F.col("__b")).otherwise(F.col("__a"))
    return both.where("__add").select(key, day, chosen["at"].alias("at"), chosen["v"].alias(value), F.when(near, "before").when(F.col("__a").isNotNull(), "after").otherwise("pending").alias("basis"))


def span_return(prices: DataFrame, keys: list[str], day: str, value: str, start: Column, end: Column) -> DataFrame:
    """Return of each key over a range from its last price at or before the start (aligned), else from its first one in it."""
    d = F.col(day)
    g = prices.where(d <= end).groupBy(*keys).agg(
        F.max_by(F.when(d <= start, F.col(value)), F.when(d <= start, d)).alias("__anchor"), F.min_by(F.when(d > start, F.col(value)), F.when(d > start, d)).alias("__first"), F.max_by(value, day).alias("__last"), F.max(day).alias("__d")
    )
    base = F.coalesce("__anchor", "__first")
    return g.select(*keys, F.when(F.col("__anchor").isNotNull(), "on_or_before_start").otherwise("first_available").alias("alignment"), (F.try_divide("__last", base) - 1).alias("rate"))


def clamp(first: Column, last: Column, start: Column, end: Column) -> Column:
    """struct<start, end, clamped>: a requested range within the history; one that misses it becomes the nearest day of it."""
    low, high = F.greatest(F.coalesce(start, first), first), F.least(F.coalesce(end, last), last)
    edge = F.when(end < first, first).otherwise(last)
    low, high = F.when(high < low, edge).otherwise(low), F.when(high < low, edge).otherwise(high)
    return F.struct(low.alias("start"), high.alias("end"), F.coalesce((start != low), F.lit(False)).__or__(F.coalesce(end != high, F.lit(False))).alias("clamped"))


def opening_basis(opened: DataFrame, start: Column, days: int) -> DataFrame:
    """How far each opening value can be trusted: unavailable without a price, estimated from trades or old prices, else exact.

    Takes (close_day, close, trade_day, trade_price) of what is held when the range starts.
    """
    old = F.col("close_day") < F.date_sub(start, days)
    return opened.withColumn("status", F.when(F.col("close").isNull() & F.col("trade_price").isNull(), "unavailable").when(F.col("close").isNull() | old, "estimated").otherwise("exact"))


def concept_pivot(facts: DataFrame, keys: list[str], chains: dict[str, list[str]]) -> DataFrame:
    """One row a key: each field takes the first concept of its chain that has a value, and of that the one filed last."""
    rank = {c: (field, i) for field, chain in chains.items() for i, c in enumerate(chain)}
    place = F.coalesce(*[F.when(F.col("concept") == c, i) for c, (_, i) in rank.items()])

    def best(field: str) -> Column:
        own = F.col("concept").isin(chains[field])
        return F.min_by(F.when(own, F.col("value")), F.when(own, F.struct(place, -F.unix_date("filed"), -F.col("value"))))

    return facts.where(F.col("concept").isin(list(rank)) & F.col("value").isNotNull()).groupBy(*keys).agg(*[best(field).alias(field) for field in chains])


def fits_period(start: Column, end: Column, period: Column) -> Column:
    """Whether a fact's length is that of its period: a year or a quarter; what has no start is an instant and fits all."""
    days = F.datediff(end, start)
    return start.isNull() | F.when(period == "FY", days.between(330, 400)).otherwise(days.between(60, 115))


def reporting_unit(facts: DataFrame, keys: list[str], preferred: str = "USD") -> DataFrame:
    """The unit in which most full years are reported; ties go to the preferred one, then by name."""
    years = facts.where("fp = 'FY'").groupBy(*keys, "unit").agg(F.count_distinct("end").alias("years"))
    return latest_per_key(years, keys, [F.col("years").desc(), (F.col("unit") == preferred).desc(), F.col("unit")])


def identity_status(whole: Column, parts: list[Column], tolerance: float = 0.01, excess: bool = False) -> Column:
    """ok, suspect or skipped: whether a total equals its parts within a share; with excess it may be more."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    apart = F.coalesce(F.try_divide(F.abs(whole - total), F.greatest(F.abs(whole), F.abs(total))), F.lit(0.0))
    fine = (apart <= tolerance) | (whole > total) if excess else apart <= tolerance
    return F.when(whole.isNull() | total.isNull(), "skipped").when(fine, "ok").otherwise("suspect")
