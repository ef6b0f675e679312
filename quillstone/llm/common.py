"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts that are Python strings in a task at once.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(col: Column, divisor: int) -> Column:
    """crc32 of the id written as decimal text, modulo divisor (null id: of the empty text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8")), F.lit(divisor))


def scaled_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def add_columns(rows: DataFrame, fields: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """rows without their last column, a text, and with ``fields`` instead, which ``start()(texts)`` returns as lists.

    All other columns pass as Arrow, so that a null beside a large integer changes no value.
    """
    new = StructType.fromDDL(fields)
    out = StructType([*rows.schema.fields[:-1], *new.fields])
    kinds, names = [to_arrow_type(f.dataType) for f in new.fields], out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = make(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names)

    return rows.mapInArrow(run, out)


def set_aside(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[Column]]:
    """All columns of docs under names that clash with nothing, and the text once more as the last; and what brings them back."""
    names = [f"_kept{i}" for i in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col(f"`{text_col}`").alias("_text")), [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]
