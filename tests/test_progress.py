"""Marks by key and day reports taken once, by hand."""

from datetime import date

from pyspark.sql import functions as F

from quillstone.streaming import progress as pg

TODAY = date(2024, 6, 30)


def test_windows_and_marks(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), ("e",), (None,)], "key string")
    marks = spark.createDataFrame([("a", date(2024, 6, 28)), ("a", date(2024, 6, 20)), ("b", date(2024, 1, 1)), ("c", None), ("z", date(2024, 6, 1))], "key string, last_ok date")
    got = {r["key"]: (r["mode"], r["start"]) for r in pg.sync_windows(keys, marks, F.lit(TODAY), most_new=2).collect()}
    whole = ("backfill", date(2023, 7, 1))
    assert got == {"a": ("incremental", date(2024, 6, 26)), "b": ("incremental", date(2024, 5, 31)), "c": whole, "d": whole, "e": ("deferred", None)}
    assert {r["mode"] for r in pg.sync_windows(keys, marks.limit(0), F.lit(TODAY)).collect()} == {"backfill"}
    assert pg.sync_windows(keys.limit(0), marks, F.lit(TODAY), most_new=1).isEmpty()
    # One key failed and keeps its mark; a new one gets its first.
    read = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "key string, ok boolean")
    after = {r["key"]: r["last_ok"] for r in pg.advanced(marks, read, F.lit(TODAY)).collect()}
    assert after == {"a": date(2024, 6, 30), "b": date(2024, 1, 1), "c": date(2024, 6, 30), "z": date(2024, 6, 1)}


def test_days_are_taken_once_over_a_restart(spark, tmp_path):
    schema = "day date, symbol string, price int"
    folder, store = str(tmp_path / "in"), f"file://{tmp_path}/store"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = stream.writeStream.foreachBatch(pg.DayReports(spark, store)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    put([(date(2024, 6, 3), "A", 1), (date(2024, 6, 3), "B", 2), (None, "A", 9)])
    run()
    put([(date(2024, 6, 3), "A", 7), (date(2024, 6, 4), "A", 3)])
    put([(date(2024, 6, 4), "A", 8)])
    run()
    got = sorted((r["day"], r["symbol"], r["price"]) for r in spark.read.schema("symbol string, price int, day date").parquet(f"{store}/data").collect())
    assert got[:2] == [(date(2024, 6, 3), "A", 1), (date(2024, 6, 3), "B", 2)] and len(got) == 3 and got[2][2] in (3, 8)
    taken = pg.DayReports(spark, store).taken(spark)
    assert sorted(r["day"] for r in taken.collect()) == [date(2024, 6, 3), date(2024, 6, 4)]
    open_days = pg.missing_days(taken, date(2024, 6, 5), 6, 2).orderBy("place").collect()
    assert [r["day"] for r in open_days] == [date(2024, 6, 5), date(2024, 5, 31)]


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    sink = pg.DayReports(spark, f"file://{tmp_path}/store")
    first = spark.createDataFrame([(date(2024, 6, 3), "A")], "day date, symbol string")
    for batch_id in (0, 0, 1):
        sink(first if batch_id == 0 else first.withColumn("symbol", F.lit("late")), batch_id)
    assert [r["symbol"] for r in spark.read.parquet(sink.data).collect()] == ["A"]
    assert [r["batch_id"] for r in sink.taken(spark).collect()] == [0]
    # Cut off between the rows and the mark: the next run of the batch replaces them.
    sink(first.withColumn("day", F.lit(date(2024, 6, 4))), 2)
    cut = pg.DayReports(spark, f"file://{tmp_path}/cut")
    first.write.partitionBy("day").parquet(cut.data)
    cut(first, 0)
    assert spark.read.parquet(cut.data).count() == 1
