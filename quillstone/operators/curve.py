"""Time-weighted return curves of portfolios by a sweep over changes, and risk figures over them.

A security's worth to its owner changes only where its position, its price or its currency's rate does.  Each such
day becomes one row of the security; its difference from the row before is added up by owner and day, and the
running sum of a day's differences is the market value.  Days on which nothing of a security changes cost nothing,
and no days x securities grid is made.  What is global to an owner is a row a day, bounded by the calendar.

Values are in the base currency.  A position walks through its events: buys, rights and openings add, sells take at
most what is there (their proceeds are cut alike), ratios multiply, absolute actions add to or replace what is held.
A day's price is its close, else the last trade of the day, else the newest before.  An opening position of unknown
cost flows in at the price it has when it comes; where there is none yet, its shares wait, multiplied by what
happens meanwhile, and flow in on the first day with a price, so that their arrival is no gain.
Values and flows are added up as decimals of ten places, of any size: a day's figures don't depend on the order of its
rows, and the running sum keeps nothing of what has gone.  Amounts that are not finite end the job.

Events are dealt by security, sorted inside their partitions and walked in Arrow batches, one row a day comes out; the
changes of an owner are walked alike.  No key is gathered, however long, but one security's events pass through one
task, and so do one owner's changes.  Positions have fifty digits, as ratios may take them to any size.

With ``start`` the days before are replayed: shares held then are valued at the newest close or trade before ``start``
(a close wins within a day, else its first trade), unless an action came after it; shares of unknown cost that still have no price wait.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .asof import asof
from .ordered import running_product
from .rounds import settled

#: Columns of events besides the owner's and the security's: currency, day, place in the day, id, kind, quantity, money, ratio, price.
EVENT = ["cur", "d", "place", "id", "kind", "q", "c", "num", "den", "p"]
YEAR = 365.25
#: For positions; for amounts of ten places, all of a double's digits before them.
SHARES, MONEY, PLACES = Context(prec=50), Context(prec=400, rounding=ROUND_HALF_UP), Decimal("1e-10")
ZERO, SLICE_ROWS = Decimal(0), 4096
#: A security's day: what is held at its end, the product of the factors so far, trades' prices, whether an action came,
#: shares of unknown cost that came (``units``: over the factors), money in the base currency, sells that were cut.
_DAY = "d date, pos double, f double, traded double, first_traded double, acted boolean, came double, units double, inflow string, outflow string, dividends string, cut long"
_LEVEL = "d date, opening double, mv double, inflow double, outflow double, dividends double, priced int, unpriced int, cut int"


def amount(value: float | str) -> Decimal:
    return MONEY.quantize(Decimal(str(value)), PLACES)


def by_key(rows: DataFrame, keys: list[str], order: list[str], out: str, walk: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """What ``walk`` makes of each key's rows, without the key, in their order; the key stands before it."""
    fields = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(out).fields)
    kinds, names, n = [to_arrow_type(f.dataType) for f in fields], fields.names, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        made = ((*key, *m) for key, own in groupby(read, itemgetter(slice(n))) for m in walk(r[n:] for r in own))
        for part in batched(made, SLICE_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    # The other columns only fix the order of repeated rows.
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.select(*keys, *order, *rest).repartition(*keys).sortWithinPartitions(*keys, *order, *rest).mapInArrow(run, fields)


def _days(events: Iterator[tuple]) -> Iterator[tuple]:
    pos, f = ZERO, 1.0
    for day, today in groupby(events, itemgetter(0)):
        traded, acted, came, units, sums, cut = [], False, None, None, [ZERO, ZERO, ZERO], 0
        for _, place, _, kind, q, c, num, den, p, rate in today:
            before = pos
            money = None if c is None or rate is None else c * rate
            if kind in ("BUY", "RIGHTS", "OPEN"):
                pos = SHARES.add(pos, q)
                if money is not None:
                    sums[0] = MONEY.add(sums[0], amount(money))
            elif kind == "SELL":
                took = min(q, pos)
                pos, cut = SHARES.subtract(pos, took), cut + (took < q)
                if money is not None and q > 0:
                    sums[1] = MONEY.add(sums[1], amount(money * (float(took) / float(q))))
            elif kind == "RATIO":
                pos, f = SHARES.divide(SHARES.multiply(pos, num), den), f * (float(num) / float(den))
            elif kind in ("ADD", "TOTAL") and pos > 0:
                pos = SHARES.add(pos, q) if kind == "ADD" else q
                f *= float(SHARES.divide(pos, before))
            elif kind == "DIVIDEND" and money is not None:
                sums[1:] = [MONEY.add(x, amount(money)) for x in sums[1:]]
            if kind == "OPEN" and c is None:
                came, units = SHARES.add(came or ZERO, q), (units or 0.0) + float(q) / f
            if place > 0:
                traded = [*traded[:1], p]
            elif kind != "DIVIDEND":
                acted = True
        yield (day, float(pos), f, *((traded[-1], traded[0]) if traded else (None, None)), acted, None if came is None else float(came), units, *map(str, sums), cut)


def walked(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``_DAY`` of each day with events; events have their ``rate``."""
    typed = {"d": "date", "place": "int", "id": "bigint", "kind": "string", "q": "decimal(20,8)", "c": "double", "num": "decimal(20,8)", "den": "decimal(20,8)", "p": "double", "rate": "double"}
    return by_key(events.select(*keys, *[F.col(c).cast(t).alias(c) for c, t in typed.items()]), keys, ["d", "place", "id", "kind", "q", "c", "num", "den", "p", "rate"], _DAY, _days)


def _levels(before: object) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """The walk through an owner's changes: a row for each day that is shown; ``before``: the day of the opening."""

    def walk(changes: Iterator[tuple]) -> Iterator[tuple]:
        mv, opening, held = ZERO, 0.0, [0, 0]
        for day, today in groupby(changes, itemgetter(0)):
            sums, cuts, seen = [ZERO, ZERO, ZERO], 0, False
            for _, now, was, priced, unpriced, *flows, cut, shown in today:
                mv = MONEY.subtract(MONEY.add(mv, amount(now or 0)), amount(was or 0))
                held = [held[0] + priced, held[1] + unpriced]
                sums = [MONEY.add(x, amount(y)) if y else x for x, y in zip(sums, flows, strict=True)]
                cuts, seen = cuts + cut, seen or shown
            if seen:
                yield (day, opening, float(mv), *map(float, sums), *held, cuts)
            if seen or day == before:
                opening = float(mv)

    return walk


def return_curve(events: DataFrame, closes: DataFrame, *, users: list[str], symbol: str = "symbol", rates: DataFrame | None = None, start: str | None = None, end: str | None = None, opening_fx: str | None = None) -> DataFrame:
    """users, d, mv, opening, inflow, outflow, dividends, pnl, r, factor, cumulative, drawdown, priced, unpriced and cut sells of each day.

    events: users, symbol and ``EVENT`` (kinds BUY, SELL, RIGHTS, OPEN, RATIO, ADD, TOTAL, and DIVIDEND, whose c is the
    net amount or, below zero, a tax).  closes: symbol, d, close.  rates: cur, eff, rate into the base; none: all are 1.
    Days: those with a price of the owner's securities, those with events, and the ends of the range.  The opening's
    rates are those of ``opening_fx``, else of ``start``.
    """
    keys = [*users, symbol]
    date = lambda s: F.lit(s).cast("date")
    inside = lambda c: (c >= date(start) if start else F.lit(True)) & (c <= date(end) if end else F.lit(True))
    events = events.where(F.col("d") <= date(end)) if end else events
    own = events.groupBy(*keys).agg(F.max("cur").alias("cur"), F.min("d").alias("first_day"))
    events = asof(events, rates, [("cur", "cur")], "d", "eff", ["rate"]) if rates is not None else events.withColumn("rate", F.lit(1.0))
    # Both are met several times below, and the walk isn't taken again for each.
    daily = settled(walked(events, keys))
    priced = closes.select(symbol, F.col("d"), F.col("close").cast("double").alias("close")).join(own, symbol)
    priced = settled(priced.where(F.col("d") <= date(end)) if end else priced)

    columns = ["pos", "f", "close", "traded", "rate", "unknown", "old_price"]
    kinds = dict.fromkeys(columns, "double")
    row = lambda df, **values: df.select(*keys, F.col("d"), *[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
    changes = [row(daily.where(inside(F.col("d"))), pos=F.col("pos"), f=F.col("f"), traded=F.col("traded")), row(priced.where(inside(F.col("d")) & (F.col("d") >= F.col("first_day"))), close=F.col("close"))]
    ahead = priced.where(inside(F.col("d")) & (F.col("d") < F.col("first_day"))).groupBy(*keys).agg(F.max_by("close", "d").alias("close"), F.max("d").alias("d"))
    changes.append(row(ahead, close=F.col("close")))
    before = date(start) - 1 if start else None
    if start:
        old = daily.where(F.col("d") < date(start))
        seen = old.where("traded is not null").select(*keys, "d", F.lit(0).alias("rank"), F.col("first_traded").alias("price")).unionByName(priced.where(F.col("d") < date(start)).select(*keys, "d", F.lit(1).alias("rank"), F.col("close").alias("price")))
        newest = seen.groupBy(*keys).agg(F.max("d").alias("seen_day"), F.max_by("price", F.struct("d", "rank")).alias("seen"))
        opened = old.groupBy(*keys).agg(F.max_by("pos", "d").alias("pos"), F.max_by("f", "d").alias("f"), F.max(F.when(F.col("acted"), F.col("d"))).alias("acted_day"), F.sum("units").alias("units")).join(newest, keys, "left")
        stale = F.coalesce(F.col("acted_day") > F.col("seen_day"), F.lit(False))
        opened = opened.withColumn("d", before).withColumn("price", F.when(~stale, F.col("seen")))
        still = F.when(F.col("price").isNull() & (F.col("pos") > 0) & F.col("units").isNotNull(), F.least(F.col("units") * F.col("f"), F.col("pos")))
        changes.append(row(opened, pos=F.col("pos"), f=F.col("f"), unknown=still, old_price=F.col("price")))
    if rates is not None:
        dated = own.withColumn("d", date(start) if start else F.col("first_day"))
        first = [dated, own.withColumn("d", before).withColumn("of", date(opening_fx or start))] if start else [dated]
        for o in first:
            o = o if "of" in o.columns else o.withColumn("of", F.col("d"))
            changes.append(row(asof(o, rates, [("cur", "cur")], "of", "eff", ["rate"]), rate=F.col("rate")))
        later = rates.join(own, "cur").where((F.col("eff") > (date(start) if start else F.col("first_day"))) & (F.col("eff") <= date(end) if end else F.lit(True)))
        changes.append(row(later.withColumn("d", F.col("eff")), rate=F.col("rate")))
    union = changes[0]
    for c in changes[1:]:
        union = union.unionByName(c)
    merged = union.groupBy(*keys, "d").agg(*[F.max(c).alias(c) for c in columns])
    w = Window.partitionBy(*keys).orderBy("d")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    price = F.coalesce("close", "traded", "old_price")
    swept = merged.select(*keys, "d", "close", "unknown", F.coalesce(F.last("pos", True).over(upto), F.lit(0.0)).alias("pos"), F.coalesce(F.last("f", True).over(upto), F.lit(1.0)).alias("f"), F.last(price, True).over(upto).alias("price"), (F.last("rate", True).over(upto) if rates is not None else F.lit(1.0)).alias("rate"))
    value = F.when(F.col("pos") > 0, F.col("pos") * F.col("price") * F.col("rate"))
    swept = swept.withColumns({"value": F.coalesce(value, F.lit(0.0)).cast("string"), "priced": value.isNotNull().cast("int"), "unpriced": (value.isNull() & (F.col("pos") > 0)).cast("int"), "price_before": F.lag("price").over(w)})
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))

    # Shares of unknown cost: those that find a price when they come, and those that wait for the first one.
    first_priced = swept.where("price is not null").groupBy(*keys).agg(F.min("d").alias("priced_day"), F.min_by(F.struct("f", "price", "rate"), "d").alias("at"))
    coming = daily.where(inside(F.col("d")) & F.col("came").isNotNull()).select(*keys, "d", "came", "units")
    met = coming.join(swept.select(*keys, "d", F.coalesce("close", "price_before").alias("now"), "rate"), [*keys, "d"]).join(first_priced, keys, "left")
    arrivals = met.select(*users, F.when(F.col("now").isNotNull(), F.col("d")).otherwise(F.col("priced_day")).alias("d"), F.when(F.col("now").isNotNull(), F.col("came") * F.col("now") * F.col("rate")).otherwise(F.col("units") * F.col("at.f") * F.col("at.price") * F.col("at.rate")).alias("inflow"))
    if start:
        waited = swept.where("unknown > 0").select(*keys, "unknown", F.col("f").alias("own_f")).join(first_priced, keys)
        arrivals = arrivals.unionByName(waited.select(*users, F.col("priced_day").alias("d"), (F.col("unknown") * F.col("at.f") / F.col("own_f") * F.col("at.price") * F.col("at.rate")).alias("inflow")))

    flows = daily.where(inside(F.col("d"))).select(*users, "d", "inflow", "outflow", "dividends", "cut", F.lit(True).alias("shown"))
    deltas = swept.select(*users, "d", F.col("value").alias("now"), F.lag("value").over(w).alias("was"), step("priced").alias("priced"), step("unpriced").alias("unpriced"))
    marks = priced.where(inside(F.col("d"))).select(*users, "d").distinct().withColumn("shown", F.lit(True))
    ends = own.select(*users).distinct().select(*users, F.explode(F.array(*[date(x) for x in (start, end) if x])).alias("d"), F.lit(True).alias("shown")) if start or end else None
    # Rates may change on a day that isn't shown: the change then shows on the next one.
    parts = {"now": ("string", None), "was": ("string", None), "priced": ("bigint", 0), "unpriced": ("bigint", 0), "inflow": ("string", None), "outflow": ("string", None), "dividends": ("string", None), "cut": ("bigint", 0), "shown": ("boolean", False)}
    part = lambda df: df.select(*users, "d", *[(F.col(c) if c in df.columns else F.lit(none)).cast(t).alias(c) for c, (t, none) in parts.items()])
    pieces = [part(x) for x in (deltas, arrivals.where("d IS NOT NULL"), flows, marks, ends) if x is not None]
    total = pieces[0]
    for p in pieces[1:]:
        total = total.unionByName(p)
    by_day = Window.partitionBy(*users).orderBy("d")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nothing = F.lit(0.0)
    levels = by_key(total, users, ["d"], _LEVEL, _levels(dt.date.fromisoformat(start) - dt.timedelta(1) if start else None))
    base = F.col("opening") + F.col("inflow")
    r = levels.withColumn("pnl", F.col("mv") + F.col("outflow") - base).withColumn("r", F.when(base > 0, (F.col("mv") + F.col("outflow")) / base - 1))
    r = r.withColumn("factor", running_product(1 + F.coalesce("r", nothing), so_far)).withColumn("cumulative", F.col("factor") - 1)
    return r.withColumn("drawdown", F.col("factor") / F.greatest(F.lit(1.0), F.max("factor").over(so_far)) - 1)


def risk(curve: DataFrame, users: list[str], risk_free: float | DataFrame = 0.0) -> DataFrame:
    """users, total, annual, volatility, sharpe, sortino, calmar, max_drawdown, span, n, risk_free and missing.

    Returns are annualised by the calendar, years of 365.25 days.  ``risk_free``: a yearly rate in percent, spread
    evenly over the returns, or a series (published, rate): each return then bears the newest rate for the days since
    the curve's day before; returns ahead of the series bear none and are counted in ``missing``.
    """
    w = Window.partitionBy(*users).orderBy("d")
    points = curve.select(*users, "d", "r", "factor", "drawdown", F.datediff("d", F.lag("d").over(w)).alias("gap"))
    whole = points.groupBy(*users).agg(F.datediff(F.max("d"), F.min("d")).alias("span"), F.count("r").alias("n"), F.max_by("factor", "d").alias("f"), F.min("drawdown").alias("dd"))
    if isinstance(risk_free, DataFrame):
        series = risk_free.select(F.lit(1).alias("one"), "published", F.col("rate").cast("double").alias("rate"))
        points = asof(points.withColumn("one", F.lit(1)), series, [("one", "one")], "d", "published", ["rate"]).drop("one")
        free = F.coalesce("rate", F.lit(0.0)) / 100 * F.coalesce("gap", F.col("span") / F.col("n")) / YEAR
        shown, missing = F.avg(F.when(F.col("r").isNotNull(), F.col("rate"))), F.count_if(F.col("r").isNotNull() & F.col("rate").isNull())
    else:
        free = F.lit(risk_free) / 100 / (F.lit(YEAR) * F.col("n") / F.col("span"))
        shown, missing = F.lit(float(risk_free)), F.lit(0).cast("long")
    joined = points.join(whole, users)
    excess = F.col("r") - free
    g = joined.withColumn("x", excess).groupBy(*users, "span", "n", "f", "dd").agg(F.stddev_samp("r").alias("sd"), F.avg("x").alias("m"), F.stddev_samp("x").alias("xd"), F.sum(F.when(F.col("x") < 0, F.col("x") * F.col("x")).otherwise(0.0)).alias("down"), shown.alias("risk_free"), missing.alias("missing"))
    fine = (F.col("n") >= 2) & (F.col("span") > 0)
    factor = F.sqrt(F.lit(YEAR) * F.col("n") / F.col("span"))
    annual = F.when(F.col("f") > 0, F.pow("f", F.lit(YEAR) / F.col("span")) - 1)
    low = F.sqrt(F.col("down") / F.col("n"))
    ratio = lambda up, down: F.when(fine & (down > 0), up / down * factor)
    return g.select(
        *users, (F.col("f") - 1).alias("total"), F.when(fine, annual).alias("annual"), F.when(fine, F.col("sd") * factor).alias("volatility"), ratio(F.col("m"), F.col("xd")).alias("sharpe"), ratio(F.col("m"), low).alias("sortino"),
        F.when(fine & (F.col("dd") < 0), annual / -F.col("dd")).alias("calmar"), F.col("dd").alias("max_drawdown"), "span", "n", "risk_free", "missing",
    )


def money_events(amounts: DataFrame, users: list[str], symbol: str, amount: Column) -> DataFrame:
    """DIVIDEND events of amounts that come on a day (``d``, ``cur``, ``id``); a tax is an amount below zero."""
    none = lambda kind: F.lit(None).cast(kind)
    return amounts.select(*users, symbol, "cur", "d", F.lit(0).alias("place"), F.col("id").cast("bigint").alias("id"), F.lit("DIVIDEND").alias("kind"), none("decimal(20,8)").alias("q"), amount.cast("double").alias("c"), none("decimal(20,8)").alias("num"), none("decimal(20,8)").alias("den"), none("double").alias("p"))
