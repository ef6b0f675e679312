"""Ledger files of the standard layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import amount, day, or_none, symbol_cell

# Required and optional columns with their defaults.
TRADE_REQUIRED = ["symbol", "market", "transaction_type", "quantity", "price", "transaction_date"]
TRADE_DEFAULTS = {"name": None, "fee": "0", "currency": "CNY", "notes": None}
ACTION_REQUIRED = ["symbol", "market", "action_type", "ex_date"]
ACTION_DEFAULTS = {
    "receipt_confirmed": "False",
    "amount_basis": "GROSS_NET",
    "name": None,
    "record_date": None,
    "payment_date": None,
    "dividend_per_share": None,
    "total_dividend": None,
    "tax_withheld": None,
    "tax_rate": None,
    "net_dividend": None,
    "shares_received": None,
    "distribution_ratio": None,
    "subscription_price": None,
    "subscription_quantity": None,
    "subscription_amount": None,
    "split_ratio": None,
    "new_shares": None,
    "cost_basis_adjustment": None,
    "adjusted_quantity": None,
    "adjusted_cost_per_share": None,
    "currency": "CNY",
    "notes": None,
}
ACTION_TEXT = {"receipt_confirmed", "amount_basis", "currency", "name", "notes"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text: a code's leading zeros stay."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def _complete(df: DataFrame, required: list[str], defaults: dict[str, str | None]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    fill = {c: F.coalesce(or_none(F.col(c)), F.lit(v)) if c in df.columns else F.lit(v).cast("string") for c, v in defaults.items()}
    return df.withColumns(fill)


def _checked(df: DataFrame, tests: list[tuple[Column, str]]) -> DataFrame:
    """Adds ``errors``, what is wrong with a row; rows with errors stay for a report."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in tests])))


def trades(df: DataFrame) -> DataFrame:
    """Typed transactions with an array of errors."""
    full = _complete(df, TRADE_REQUIRED, TRADE_DEFAULTS)
    typed = full.select(
        symbol_cell(F.col("symbol")).alias("symbol"), "name", or_none(F.col("market")).alias("market"), F.upper(or_none(F.col("transaction_type"))).alias("transaction_type"),
        amount(F.col("quantity")).alias("quantity"), amount(F.col("price")).alias("price"), amount(F.col("fee")).alias("fee"), day(F.col("transaction_date")).alias("transaction_date"), "currency", "notes",
    )
    tests = [
        (F.col("symbol") != "", "no symbol"), (F.col("market").isNotNull(), "no market"), (F.col("transaction_type").isin("BUY", "SELL"), "unknown type"),
        (F.col("quantity") > 0, "quantity isn't positive"), (F.col("price") >= 0, "no price"), (F.col("fee") >= 0, "fee is negative"), (F.col("transaction_date").isNotNull(), "no date"),
    ]
    return _checked(typed, tests)


def actions(df: DataFrame) -> DataFrame:
    """Typed corporate actions with an array of errors."""
    full = _complete(df, ACTION_REQUIRED, ACTION_DEFAULTS)
    dates = {c: day(F.col(c)) for c in ("ex_date", "record_date", "payment_date")}
    numbers = {c: amount(F.col(c)) for c in ACTION_DEFAULTS if c not in ACTION_TEXT and c not in dates}
    typed = full.withColumns(dates | numbers | {"symbol": symbol_cell(F.col("symbol")), "action_type": F.upper(or_none(F.col("action_type"))), "receipt_confirmed": F.lower("receipt_confirmed").isin("true", "1", "yes")})
    tests = [(F.col("symbol") != "", "no symbol"), (or_none(F.col("market")).isNotNull(), "no market"), (F.col("action_type").isNotNull(), "no type"), (F.col("ex_date").isNotNull(), "no ex-date")]
    return _checked(typed.select(*ACTION_REQUIRED, *ACTION_DEFAULTS), tests)


def sections(raw: DataFrame, section: str) -> DataFrame:
    """Rows of one section of a multi-section activity file: (file, line, header, cells, values) from (file, line, value) text lines.

    A line starts with its section and its kind (Header or Data); a data line belongs to the newest header
    of its section above it.  Cells stand where they stand in the line, empty ones as null, up to the header's
    last; ``values`` maps the header's names (from the third on) to them, of a repeated name the first.  The window
    runs inside a file's section.
    """
    from pyspark.sql import Window

    mine = raw.where(F.trim(F.split_part("value", F.lit(","), F.lit(1))).isin(section, f'"{section}"'))
    # No line has more cells than commas and one.
    width = mine.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","))) + 1).alias("n")).first().n or 1
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(max(width, 2)))))
    rows = mine.select("file", "line", cells.alias("c")).select("file", "line", F.array(*[or_none(F.col(f"c.c{i}")) for i in range(max(width, 2))]).alias("cells"))
    filled = lambda c: F.array_max(F.transform(c, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)))
    head = F.when(F.get("cells", F.lit(1)) == "Header", F.slice("cells", F.lit(1), filled(F.col("cells"))))
    header = F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("line"))
    data = rows.withColumn("header", header).where(F.get("cells", F.lit(1)) == "Data").withColumn("cells", F.slice("cells", F.lit(1), F.coalesce(F.size("header"), F.size("cells"))))
    named = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("key"), F.get("cells", i).alias("value"), i.alias("i"))), lambda e: (e["i"] >= 2) & e["key"].isNotNull())
    first = F.filter(named, lambda e: F.array_position(F.slice("header", F.lit(3), F.size("header")), e["key"]) == e["i"] - 1)
    values = F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))
    return data.withColumn("values", values)
