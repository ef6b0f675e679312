"""Windows, dedup and late data over event streams; every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark, which only a timestamp with time zone can carry."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, width: str, *, late: str = "1 day", time: str = "ts") -> DataFrame:
    """start, event_type, n and total (exact decimal sum) of each window; on a stream, windows older than ``late`` are closed."""
    marked = _marked(events, time, late) if events.isStreaming else events
    g = marked.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def dedup(events: DataFrame, keys: list[str], *, late: str = "1 day", time: str = "ts") -> DataFrame:
    """One event of each key; on a stream, the first that arrives within the watermark."""
    return _marked(events, time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
