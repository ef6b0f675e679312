"""Write policies as DataFrames: what a table holds after an upsert, and what a sink must change.

Plain Parquet has no row updates, so each function returns the new content (or the rows to append); the
full outer join is on the table's key and co-partitions both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in the given order."""
    rest = [c for c in incoming.columns if c not in keys]
    return incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def _policy(kind: str, old: Column, new: Column) -> Column:
    match kind:
        case "new":
            return new
        case "fill":  # the old value stays
            return F.coalesce(old, new)
        case "known":  # a null never overwrites
            return F.coalesce(new, old)
        case "text":  # an empty text never overwrites
            return F.coalesce(F.nullif(new, F.lit("")), old)
        case "greatest":
            return F.greatest(old, new)
    raise ValueError(kind)


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], policies: dict[str, str]) -> DataFrame:
    """The table after the upsert, with ``change``: inserted, updated or kept.  Both have one row a key; columns without a policy keep the table's value."""
    columns = [c for c in table.columns if c not in keys]
    a = table.select(*keys, F.struct(*columns).alias("__old"))
    b = incoming.select(*keys, F.struct(*[F.col(c) if c in incoming.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns]).alias("__new"))
    both = a.join(b, keys, "full_outer")
    old, new = F.col("__old"), F.col("__new")
    after = [F.when(new.isNull(), old[c]).when(old.isNull(), new[c]).otherwise(_policy(policies[c], old[c], new[c]) if c in policies else old[c]).alias(c) for c in columns]
    out = both.select(*keys, *after, "__old", "__new")
    change = F.when(old.isNull(), "inserted").when(new.isNull() | F.struct(*columns).eqNullSafe(old), "kept").otherwise("updated")
    return out.withColumn("change", change).drop("__old", "__new")


def to_insert(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: keys that the table lacks, one row of each."""
    return incoming.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def keep_newest(table: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key, by a total order."""
    return table.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def prune_stale(table: DataFrame, produced: DataFrame, keys: list[str], row_keys: list[str], date: str) -> DataFrame:
    """Rows of the table that stay: those of keys that weren't produced, those from before a key's produced window, and those produced again."""
    window = produced.groupBy(*keys).agg(F.min(date).alias("__from"))
    again = produced.select(*keys, *row_keys).distinct().withColumn("__again", F.lit(True))
    marked = table.join(window, keys, "left").join(again, [*keys, *row_keys], "left")
    return marked.where(F.col("__from").isNull() | (F.col(date) < F.col("__from")) | F.col("__again")).select(*table.columns)


def deactivate_third_party(table: DataFrame, keys: list[str], official: Column, low: str, high: str, date: str, stale_days: int) -> DataFrame:
    """Inside the window, third-party rows on dates without an official row become inactive.

    Keys without official rows in the window keep theirs.  Third-party rows after the newest official one go
    only while that is at most ``stale_days`` older than the window's end; beyond, they stand in for it.
    """
    inside = table.where(official & F.col(date).between(low, high))
    dates = inside.select(*keys, date).distinct().withColumn("__official", F.lit(True))
    latest = inside.groupBy(*keys).agg(F.max(date).alias("__latest"))
    end = F.lit(high).cast("date")
    cutoff = F.when(F.col("__latest") >= F.date_sub(end, stale_days), end).otherwise(F.col("__latest"))
    off = F.coalesce(~official & F.col(date).between(F.lit(low).cast("date"), cutoff) & F.col("__official").isNull(), F.lit(False))
    return table.join(dates, [*keys, date], "left").join(latest, keys, "left").withColumn("active", F.col("active") & ~off).select(*table.columns)
