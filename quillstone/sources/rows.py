"""Rows of cash-flow statements from their lines of text.

A statement is read from top to bottom and what was said last holds: the account, the period, the title of a section,
the header of a table.  A table line whose date cell is a date starts a row; table lines without one continue it, cell
by cell, where a cell was wrapped.  Lines are carried by windows over each file, so files are read apart from each
other, a long one within one task but without being gathered.

Rows are then checked against what a row of their kind must fulfil.  A row that doesn't has its ``error`` beside it,
and nothing is dropped: rows that aren't booked say why in ``skip``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.actions import CONNECT_FEE, TRADE_BUSINESS, skip_reason

# Titles, labels, names of columns and of businesses, amounts that may differ.
ROWS_TITLE, OTHER_TITLES = "流水明细", ["未回业务流水明细", "配号信息"]
ACCOUNT_LABEL, PERIOD_LABEL = "资金账号", "查询区间"
DATE, BUSINESS, CODE, NAME, QUANTITY, PRICE, AMOUNT, RATE, BALANCE = "发生日期", "买卖类别", "证券代码", "证券名称", "成交数量", "成交价格", "总发生金额", "结算汇率", "资金余额"
FEES = ["手续费", "印花税"]
STOCK_FEES, CONNECT_FEES = ["过户费"], ["交易征费", "交易费", "系统费用", "交收费", "其他费用"]
DIVIDEND, DIVIDEND_TAX = "红利入账", "股息红利差异扣税"
AMOUNT_SLACK = "0.02"
MONEY = "decimal(28,8)"


def statement_rows(lines: DataFrame) -> DataFrame:
    """file, row (its first line), account, first_day, last_day, columns, cells and warning of each row.

    lines: file, n, text; cells stand between bars.  Only tables below the title of the rows count, and none below a
    title that ends them.  Lines before a header, and table lines that no row is open for, are no rows.
    """
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    text = F.col("text")
    x = lines.select("file", "n", strip_text(text).alias("text")).withColumn("table", text.contains("|"))
    label = lambda name: F.when(~F.col("table") & text.startswith(name), strip_text(F.regexp_replace(F.substring("text", len(name) + 1, 1000), "^[：:]", "")))
    title = F.when(~F.col("table") & text.isin([ROWS_TITLE, *OTHER_TITLES]), F.struct("n", (text == ROWS_TITLE).alias("of_rows")))
    # Lines are carried as text; only headers are cut into cells here, and rows once they are whole.
    place = F.when(F.col("table") & text.contains(DATE), F.array_position(cells_of(text), DATE))
    x = x.withColumns({"label": label(ACCOUNT_LABEL), "range": label(PERIOD_LABEL), "title": title, "place": place})
    x = x.withColumns({"account": last("label"), "period": last("range"), "section": last("title"), "head": last(F.when(F.col("place") > 0, F.struct("n", "text", "place")))})
    x = x.where(F.col("section.of_rows") & (F.col("head.n") > F.col("section.n")) & F.col("table") & (F.col("n") > F.col("head.n")))
    dated = day_of(F.get(F.split("text", r"\|"), F.col("head.place") - 1)).isNotNull()
    x = x.select("file", "n", "text", "account", "period", "head", last(F.when(dated, F.col("n"))).alias("row")).where("row > head.n")
    whole = Window.partitionBy("file", "row").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = x.withColumn("parts", F.collect_list("text").over(whole)).where("n = row")
    rows = rows.select("file", "row", "account", "period", cells_of(F.col("head.text")).alias("columns"), F.transform("parts", cells_of).alias("parts"))
    joined = F.transform("columns", lambda _, i: F.array_join(F.filter(F.transform("parts", lambda p: F.get(p, i)), lambda c: c != ""), ""))
    wide = F.exists("parts", lambda p: F.size(p) > F.size("columns"))
    day = lambda i: day_of(F.get(F.split("period", "-"), F.lit(i)))
    return rows.select("file", "row", "account", day(0).alias("first_day"), day(1).alias("last_day"), "columns", joined.alias("cells"), F.when(wide, "more cells than columns").alias("warning"))


def strip_text(text: Column) -> Column:
    """Without byte order marks and outer white space, null as empty: each cell passes here, so without patterns."""
    return F.btrim(F.replace(F.coalesce(text, F.lit("")), F.lit("\ufeff"), F.lit("")), F.lit(" \t\n\x0b\f\r"))


def cells_of(line: Column) -> Column:
    """The cells of a line between its bars, without outer white space."""
    return F.transform(F.split(line, r"\|"), strip_text)


def day_of(text: Column) -> Column:
    """The date of 20250131, 2025-01-31 or 2025/01/31."""
    digits = F.regexp_replace(strip_text(text), "[-/]", "")
    return F.when(F.length(digits) == 8, F.to_date(F.concat_ws("-", F.left(digits, F.lit(4)), F.substring(digits, 5, 2), F.right(digits, F.lit(2))).try_cast("date")))


def strict_number(text: Column) -> Column:
    """A number with or without commas between its thousands; null of anything else, an empty cell too."""
    bare = F.replace(strip_text(text), F.lit(","))
    return F.when(bare.rlike(r"^[0-9.+-]+\z"), bare.try_cast(MONEY))


def flow_rows(rows: DataFrame) -> DataFrame:
    """file, row, account, statement (stock, hk_connect), day, business, code, name, quantity, price, amount, fees, kind, skip and error.

    Of several faults the first counts: business, date, numbers, balance, negative fees, then what the kind asks for.
    A trade's amount must be quantity times price and fees, as far as the shown digits of the price tell.
    """
    cell = lambda name: F.get("cells", F.array_position("columns", name) - 1)
    of_all = lambda names, read: F.transform(F.array(*map(F.lit, names)), lambda name: read(cell(name)))
    named = {"business": BUSINESS, "code": CODE, "name": NAME, "price_text": PRICE, "balance": BALANCE}
    names = [QUANTITY, PRICE, AMOUNT, RATE, *FEES, *STOCK_FEES, *CONNECT_FEES]
    # Cells are read once: what follows can't be pushed below the generator.  One function reads all cells of a kind,
    # as code written out for each of them grows too long for the JVM to compile.
    read = F.struct(day_of(cell(DATE)).alias("day"), of_all(named.values(), strip_text).alias("texts"), of_all(names, strict_number).alias("numbers"))
    r = rows.select("file", "row", "account", "columns", F.inline(F.array(read)))
    r = r.select("file", "row", "account", "columns", "day", *[F.get("texts", F.lit(i)).alias(a) for i, a in enumerate(named)], *[F.get("numbers", F.lit(i)).alias(c) for i, c in enumerate(names)])
    connect = F.array_contains("columns", RATE)
    needed = lambda cols: [F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in cols]
    missing = F.when(connect, F.array_compact(F.array(*needed([QUANTITY, PRICE, AMOUNT, *FEES, RATE, *CONNECT_FEES])))).otherwise(F.array_compact(F.array(*needed([QUANTITY, PRICE, AMOUNT, *FEES, *STOCK_FEES]))))
    zero = F.lit(0).cast(MONEY)
    each = [F.coalesce(F.col(f"`{c}`"), zero) for c in [*FEES, *STOCK_FEES, *CONNECT_FEES]]
    fees = each[0]
    for f in each[1:]:
        fees = fees + f
    r = r.withColumns({"statement": F.when(connect, "hk_connect").otherwise("stock"), "missing": missing, "fees": fees.cast(MONEY), "negative": F.least(*each) < 0})
    quantity, price, amount = (F.col(f"`{c}`") for c in (QUANTITY, PRICE, AMOUNT))
    digits = F.when(F.col("price_text").contains("."), F.length(F.substring_index("price_text", ".", -1))).otherwise(0)
    half = (F.lit(0.5) * F.pow(F.lit(10.0), -digits)).cast(MONEY)
    trade, buys = F.col("business").isin(TRADE_BUSINESS), F.col("business").isin("证券买入", "港股通买入", "开放基金申购")
    money = lambda c: c.cast(MONEY)
    gross = money(quantity * price)
    expected = F.when(buys, -(gross + F.col("fees"))).otherwise(gross - F.col("fees"))
    off_stock = F.abs(amount - expected) > money(quantity * F.col("half")) + F.lit(AMOUNT_SLACK).cast(MONEY)
    off_unit = F.abs(F.try_divide(F.abs(amount), quantity) - price) > F.col("half")
    # What several conditions ask for is a column, and not written out in each of them.
    r = r.withColumn("reason", skip_reason(F.col("statement"), F.col("business"), F.col("code")))
    r = r.withColumns({"booked": trade & F.col("reason").isNull(), "half": half}).withColumns({"off_stock": off_stock, "off_unit": off_unit})
    reason, stock, booked, off_stock, off_unit = F.col("reason"), F.col("statement") == "stock", F.col("booked"), F.col("off_stock"), F.col("off_unit")
    bad_balance = stock & ~F.coalesce("balance", F.lit("")).isin("", "--") & strict_number(F.col("balance")).isNull()
    early = (
        F.when(F.col("business") == "", "no business").when(F.col("day").isNull(), "no date").when(F.size("missing") > 0, F.concat(F.lit("no number: "), F.array_join("missing", ", ")))
        .when(bad_balance, "no balance").when(F.col("negative"), "negative fees")
    )
    invalid = (
        F.when(booked & ((quantity <= 0) | (price <= 0)), "quantity or price")
        .when((F.col("business") == DIVIDEND) & (amount <= 0), "dividend not above zero").when((F.col("business") == DIVIDEND_TAX) & (amount >= 0), "tax not below zero").when((F.col("business") == CONNECT_FEE) & (amount <= 0), "fee not above zero")
    )
    apart = F.when(booked & stock & off_stock, "amount apart").when(booked & ~stock & (F.col(RATE) <= 0), "rate").when(booked & ~stock & off_unit, "unit price apart")
    late = F.coalesce(invalid, apart, F.when(reason == "conflict", "conflict"))
    kind = F.when(trade & buys, "BUY").when(trade, "SELL").when(F.col("business") == DIVIDEND, "DIVIDEND").when(F.col("business") == DIVIDEND_TAX, "TAX").when(F.col("business") == CONNECT_FEE, "FEE")
    return r.select(
        "file", "row", "account", "statement", "day", "business", "code", "name", quantity.alias("quantity"), price.alias("price"), amount.alias("amount"), "fees", kind.alias("kind"),
        F.when(early.isNull(), F.when(invalid.isNotNull(), "invalid").otherwise(reason)).alias("skip"), F.coalesce(early, late).alias("error"),
    )
