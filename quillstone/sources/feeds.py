"""Market feeds as rows.

Each function takes raw payloads (one a row, column ``payload``) and returns rows; a payload that isn't of
the expected kind gives none and shows in ``rejected``.  All of it is parsing inside the JVM, so a landing
zone of any size is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import amount, day, or_none

PARITY = "head struct<rep_code:string>, data struct<searchlist:array<string>>, records array<struct<date:string, values:array<string>>>"
INTERBANK = "head struct<rep_code:string>, records array<map<string,string>>"
BARS = "array<struct<date:string, open:string, high:string, low:string, close:string, adjClose:string, volume:string>>"
FILINGS = "cik string, filings struct<recent:struct<accessionNumber:array<string>, filingDate:array<string>, reportDate:array<string>, form:array<string>, items:array<string>, primaryDocument:array<string>>>"
NOTICES = "array<struct<NEWS_ID:string, DATE_TIME:string, TITLE:string, LONG_TEXT:string, FILE_LINK:string, STOCK_CODE:string>>"


def landed(spark, path: str) -> DataFrame:
    """Whole text files of a landing zone as (file, payload)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def rejected(raw: DataFrame, schema: str) -> DataFrame:
    """Payloads that aren't JSON of the schema, hold none of its fields or say that they failed."""
    parsed = F.from_json("payload", schema)
    if schema.startswith("array"):
        return raw.where(parsed.isNull())
    unread = F.coalesce(*[parsed[f].cast("string") for f in StructType.fromDDL(schema).names]).isNull()
    failed = parsed["head"]["rep_code"] != "200" if "rep_code" in schema else F.lit(False)
    return raw.where(unread | F.coalesce(failed, F.lit(False)))


def central_parity(raw: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """currency, d, rate of the wanted pairs (pair -> currency); a pair stands where the payload's own list says."""
    names = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    p = raw.select(F.from_json("payload", PARITY).alias("p")).where(F.coalesce(F.col("p.head.rep_code"), F.lit("200")) == "200")
    rows = p.select(F.col("p.data.searchlist").alias("pairs"), F.explode("p.records").alias("r"))
    cells = rows.select(day(F.col("r.date")).alias("d"), F.explode(F.arrays_zip("pairs", F.col("r.values").alias("values"))).alias("c"))
    return cells.select(names[F.col("c.pairs")].alias("currency"), "d", amount(F.col("c.values")).alias("rate")).where("currency is not null and d is not null and rate > 0")


def interbank_rates(raw: DataFrame, term: str = "3M") -> DataFrame:
    """d, rate of one term; days without a value are left out."""
    p = raw.select(F.from_json("payload", INTERBANK).alias("p")).where(F.coalesce(F.col("p.head.rep_code"), F.lit("200")) == "200")
    return p.select(F.explode("p.records").alias("r")).select(day(F.col("r")["showDateCN"]).alias("d"), amount(F.col("r")[term]).alias("rate")).where("d is not null and rate > 0")


def bill_rates(raw: DataFrame, field: str) -> DataFrame:
    """d, rate of one field of an Atom feed of daily rates."""
    entry = raw.select(F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<m:properties>.*?</m:properties>"), F.lit(0))).alias("e"))
    value = lambda name: F.regexp_extract("e", rf"<d:{name}\b[^>/]*>([^<]*)<", 1)
    return entry.select(day(value("INDEX_DATE")).alias("d"), amount(value(field)).alias("rate")).where("d is not null and rate is not null")


def daily_bars(raw: DataFrame, key: str = "symbol") -> DataFrame:
    """key, d, open, high, low, close, adj_close, volume; without a positive close no bar, of one day's bars the last."""
    items = raw.select(key, F.posexplode(F.from_json("payload", BARS)).alias("at", "b"))
    cells = items.select(key, "at", day(F.col("b.date")).alias("d"), *[amount(F.col(f"b.{c}")).alias(n) for c, n in (("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"), ("adjClose", "adj_close"), ("volume", "volume"))])
    good = cells.where("d is not null and close > 0")
    last = good.groupBy(key, "d").agg(F.max_by(F.struct("open", "high", "low", "close", "adj_close", "volume"), "at").alias("b"))
    return last.select(key, "d", "b.*")


def filings(raw: DataFrame) -> DataFrame:
    """cik, accession, filed, period, form, items, document: one row of each place in the parallel arrays."""
    r = raw.select(F.from_json("payload", FILINGS).alias("p")).select(F.col("p.cik").alias("cik"), "p.filings.recent.*")
    z = r.select("cik", F.explode(F.arrays_zip("accessionNumber", "filingDate", "reportDate", "form", "items", "primaryDocument")).alias("f"))
    return z.select("cik", F.col("f.accessionNumber").alias("accession"), day(F.col("f.filingDate")).alias("filed"), day(F.col("f.reportDate")).alias("period"), F.col("f.form").alias("form"), or_none(F.col("f.items")).alias("items"), F.col("f.primaryDocument").alias("document"))


def notices(raw: DataFrame) -> DataFrame:
    """id, at, title, category (what the long text has in brackets), link, code (the first one listed)."""
    r = raw.select(F.explode(F.from_json("payload", NOTICES)).alias("n"))
    plain = F.replace(F.col("n.LONG_TEXT"), F.lit("&#x2f;"), F.lit("/"))
    return r.select(
        F.col("n.NEWS_ID").alias("id"), F.try_to_timestamp(F.col("n.DATE_TIME"), F.lit("dd/MM/yyyy HH:mm")).alias("at"), F.col("n.TITLE").alias("title"),
        or_none(F.regexp_extract(plain, r"\[([^\]]*)\]", 1)).alias("category"), F.col("n.FILE_LINK").alias("link"), F.split("n.STOCK_CODE", "<br/>")[0].alias("code"),
    )


def quote_fields(raw: DataFrame, price_at: int = 3, previous_at: int = 4, time_at: int = 30) -> DataFrame:
    """Fields of a quote line whose values a tilde parts: name, code, price, previous close, time text."""
    f = F.split(F.regexp_extract("payload", '"([^"]*)"', 1), "~")
    return raw.select(F.get(f, F.lit(1)).alias("name"), F.get(f, F.lit(2)).alias("code"), amount(F.get(f, F.lit(price_at))).alias("price"), amount(F.get(f, F.lit(previous_at))).alias("previous"), F.get(f, F.lit(time_at)).alias("time")).where("price > 0")


def date_windows(ranges: DataFrame, start: str, end: str, most_days: int) -> DataFrame:
    """Each range cut into closed windows of at most so many days; an empty range gives none."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.datediff(end, start) / most_days).cast("int")))
    cut = ranges.where(F.col(start) <= F.col(end)).withColumn("__k", at)
    low = F.date_add(start, F.col("__k") * most_days)
    return cut.withColumn("window_start", low).withColumn("window_end", F.least(F.date_add(low, most_days - 1), F.col(end))).drop("__k")
