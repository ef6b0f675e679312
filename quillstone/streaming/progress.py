"""How far each key has been read, and day reports that are taken once.

Marks are a table of (key, last_ok).  A key with a mark asks for a few days before it again, and for no more than
``longest`` days; one without asks for the whole backfill, of which a run may take only the first few by key.  A run
writes the keys that it read; a key that failed keeps its mark and asks for the same days, and more, the next time.

``DayReports`` is a foreachBatch sink: a day's rows are taken from the first micro-batch that brings it whole, and
later ones leave it alone, also after a restart.  A micro-batch that runs again replaces what it wrote itself.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Days asked for again, at most, and by a key without a mark.
LOOKBACK, LONGEST, BACKFILL = 2, 30, 365


def sync_windows(keys: DataFrame, marks: DataFrame, today: Column, *, backfill: int = BACKFILL, most_new: int | None = None) -> DataFrame:
    """key, start, end, and mode (incremental, backfill, deferred: without dates) of each distinct key.

    keys: key; marks: key, last_ok.  Repeated marks of a key count by the newest, null ones as none; null keys ask for
    nothing.  With ``most_new``, that many keys without a mark are read now, the smallest first, and the others deferred.
    """
    newest = marks.groupBy("key").agg(F.max("last_ok").alias("last_ok"))
    rows = keys.select("key").dropna().distinct().join(newest, "key", "left")
    known = F.col("last_ok").isNotNull()
    mode = F.when(known, "incremental").otherwise("backfill")
    if most_new is not None:
        # The first few alone are ranked: Spark keeps so many a task, and the others are told by their absence.
        first = rows.where(~known).select("key").orderBy("key").limit(most_new).withColumn("now", F.lit(True))
        rows = rows.join(first, "key", "left")
        mode = F.when(known, "incremental").when(F.col("now"), "backfill").otherwise("deferred")
    start = F.when(mode == "incremental", F.greatest(F.date_sub("last_ok", LOOKBACK), F.date_sub(today, LONGEST))).when(mode == "backfill", F.date_sub(today, backfill))
    return rows.select("key", start.alias("start"), F.when(mode != "deferred", today).alias("end"), mode.alias("mode"))


def advanced(marks: DataFrame, read: DataFrame, today: Column) -> DataFrame:
    """The marks after a run: key, last_ok.  read: key, ok; keys that failed keep theirs."""
    done = read.where(F.col("ok") & F.col("key").isNotNull()).select("key", today.alias("last_ok"))
    return marks.select("key", "last_ok").unionByName(done).groupBy("key").agg(F.max("last_ok").alias("last_ok"))


class DayReports:
    """Rows of day reports in ``folder`` (day folders), each day once; folder must be shared by driver and executors."""

    def __init__(self, spark: SparkSession, folder: str, day: str = "day") -> None:
        self.data, self.marks, self.day = f"{folder}/data", f"{folder}/marks", day
        self.marker = f"{day} date, batch_id long"
        spark.createDataFrame([], self.marker).write.mode("ignore").parquet(self.marks)

    def taken(self, spark: SparkSession) -> DataFrame:
        """day and the micro-batch that brought it."""
        return spark.read.schema(self.marker).parquet(self.marks).distinct()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Rows without a day are left out.  The rows are written before the mark, so a run cut off between takes them again."""
        spark = batch.sparkSession
        before = self.taken(spark).where(F.col("batch_id") != batch_id).select(self.day)
        rows = batch.where(F.col(self.day).isNotNull()).join(before, self.day, "left_anti")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.day).parquet(self.data)
        marked = self.taken(spark).where(F.col("batch_id") == batch_id).select(self.day)
        new = rows.select(self.day).distinct().join(marked, self.day, "left_anti")
        new.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1).write.mode("append").parquet(self.marks)


def missing_days(taken: DataFrame, today: datetime.date, lookback: int, most: int) -> DataFrame:
    """The newest ``most`` weekdays of the last ``lookback`` days without a report: day, place (from 1)."""
    spark = taken.sparkSession
    days = spark.range(lookback).select(F.date_sub(F.lit(today), F.col("id").cast("int")).alias("day")).where(F.weekday("day") < 5)
    rest = days.join(taken.select("day").distinct(), "day", "left_anti")
    return rest.withColumn("place", F.row_number().over(Window.orderBy(F.col("day").desc()))).where(F.col("place") <= most)  # lookback rows
