"""Which expected or booked dividend a cash receipt of a statement belongs to.

A receipt of an account may complete a booking made by hand (same security, cash date and currency; its net or its
gross is equal), or a notice whose window (``BEFORE`` days before the ex-date to ``AFTER`` days after the payment date,
else after the ex-date) holds the payment date.  A notice may have been booked in advance (a legacy booking), which the
receipt then replaces.  Doubtful cash is never linked by nearness: with several open notices, or one that names no
account, the receipt is booked and stays unlinked; where an advance booking is among them, cash would count twice, so
the receipt is blocked with a reason, and with it its batch.

No pairs of receipts and notices are made, so a security with any number of both is no burden: windows are summed up as
changes by day (how many are open, how many of them are booked in advance, the sum of their ids, which is the id where
one is open), and a receipt reads the sums of its day.  A window partition holds one row for a day at most.  Bookings
are counted by their amounts before they are joined, one row for each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days of a notice's window.
BEFORE, AFTER = 3, 30

_ID = "decimal(38,0)"
_OPEN = ["open", "open_legacy", "open_id", "legacy_id"]


def _manual(receipts: DataFrame, bookings: DataFrame) -> DataFrame:
    """receipts with ``n_manual`` and, where that is 1, ``manual_id`` and ``manual_notice``: n(net) + n(gross) - n(both)."""
    net = F.coalesce(F.col("net"), F.coalesce(F.col("gross"), F.lit(0)) - F.coalesce(F.col("tax"), F.lit(0)))
    made = bookings.where((F.col("status") == "RECEIVED") & (F.col("basis") != "LEGACY") & ~F.col("sourced"))
    made = made.select("booking_id", "notice_id", "account_id", "symbol", "currency", F.coalesce("payment_date", "ex_date").alias("payment_date"), net.alias("amount"), "gross")
    key = ["account_id", "symbol", "payment_date", "currency"]
    out = receipts
    for tag, more in (("net", ["amount"]), ("gross", ["gross"]), ("both", ["amount", "gross"])):
        known = made.dropna(subset=more).groupBy(*key, *more).agg(F.count("*").alias(f"n_{tag}"), F.min_by(F.struct("booking_id", "notice_id"), "booking_id").alias(f"m_{tag}"))
        out = out.join(known, [*key, *more], "left")
    n = F.coalesce("n_net", F.lit(0)) + F.coalesce("n_gross", F.lit(0)) - F.coalesce("n_both", F.lit(0))
    one = F.when(n == 1, F.coalesce("m_net", "m_gross"))
    out = out.withColumns({"n_manual": n, "manual_id": one["booking_id"], "manual_notice": one["notice_id"]})
    return out.drop(*[f"{p}_{tag}" for p in "nm" for tag in ("net", "gross", "both")])


def _open_on(days: DataFrame, windows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """days (keys, payment_date) with what is open on them; windows: keys, low, high, notice_id, legacy."""
    zero = {c: F.lit(0).cast(_ID) for c in _OPEN}
    values = {"open": F.lit(1), "open_legacy": F.when(F.col("legacy").isNotNull(), 1).otherwise(0), "open_id": F.col("notice_id"), "legacy_id": F.coalesce("legacy", F.lit(0))}
    change = lambda day, sign: windows.select(*keys, day.alias("payment_date"), *[(F.lit(sign) * v).cast(_ID).alias(c) for c, v in values.items()])
    changes = change(F.col("low"), 1).unionByName(change(F.date_add("high", 1), -1)).unionByName(days.select(*keys, "payment_date").distinct().withColumns(zero))
    daily = changes.groupBy(*keys, "payment_date").agg(*[F.sum(c).cast(_ID).alias(c) for c in _OPEN])
    so_far = Window.partitionBy(*keys).orderBy("payment_date")
    swept = daily.select(*keys, "payment_date", *[F.sum(c).over(so_far).alias(prefix + c) for c in _OPEN])
    return days.join(swept, [*keys, "payment_date"], "left").fillna(0, [prefix + c for c in _OPEN])


def plan(receipts: DataFrame, bookings: DataFrame, notices: DataFrame) -> DataFrame:
    """receipts with ``booking_id``, ``notice_id``, ``state``, ``reason`` and ``batch_blocked``.

    receipts: receipt_id, batch, account_id, symbol, payment_date, currency, amount, gross, tax (null: unknown).
    bookings: booking_id, account_id, symbol, status, basis (LEGACY, NET_ONLY, GROSS_NET), ex_date, payment_date,
    currency, gross, tax, net, notice_id, sourced (a statement's row proves it already).
    notices: notice_id, account_id (null: none named), symbol, ex_date, pay_date, booking_id (made in advance), ignored,
    complete, superseded.  Ids are whole numbers, unique in their table, and notices' are positive.

    state: booking (with or without a notice), notice, unlinked, new, blocked.  Receipts with a null account, security
    or date meet nothing and are new; so are all if both other tables are empty.
    """
    legacy = bookings.where((F.col("status") == "RECEIVED") & (F.col("basis") == "LEGACY") & ~F.col("sourced")).select(F.col("booking_id").alias("legacy"), F.col("account_id").alias("legacy_account"))
    live = notices.where(~F.col("ignored") & ~F.col("complete") & ~F.col("superseded") & F.col("ex_date").isNotNull())
    named = live.join(legacy, live["booking_id"] == legacy["legacy"], "left")
    account = F.when(F.col("legacy").isNotNull(), F.col("legacy_account")).otherwise(F.col("account_id"))
    spans = named.select("symbol", account.alias("account_id"), F.date_sub("ex_date", BEFORE).alias("low"), F.date_add(F.coalesce("pay_date", "ex_date"), AFTER).alias("high"), "notice_id", "legacy").where("low <= high")

    days = receipts.select("symbol", "account_id", "payment_date").dropna().distinct()
    days = _open_on(days, spans.where("account_id IS NOT NULL"), ["symbol", "account_id"], "own_")
    days = _open_on(days, spans.where("account_id IS NULL").drop("account_id"), ["symbol"], "any_")
    rows = _manual(receipts, bookings).join(days, ["symbol", "account_id", "payment_date"], "left").fillna(0, [p + c for p in ("own_", "any_") for c in _OPEN])

    known = notices.select(F.col("notice_id").alias("manual_notice"), F.lit(True).alias("known"))
    rows = rows.join(known, "manual_notice", "left")
    many = F.col("own_open") + F.col("any_open")
    linked = F.col("manual_notice").isNotNull()
    single = ~linked & (many == 1) & (F.col("own_open") == 1)
    advance = F.when(single & (F.col("own_open_legacy") == 1), F.col("own_legacy_id").cast("long"))
    doubt = ~linked & ((F.col("own_open_legacy") + F.col("any_open_legacy")) > 0) & ((many > 1) | (F.col("own_open") == 0))
    reason = (
        F.when(F.col("n_manual") > 1, "several bookings").when(linked & F.col("known").isNull(), "its notice is gone")
        .when(doubt, "an advance booking among several notices or without an account").when(advance.isNotNull() & (F.col("manual_id") != advance), "booked by hand and in advance")
    )
    rows = rows.withColumn("booking_id", F.when(reason.isNull(), F.coalesce("manual_id", advance)))
    rows = rows.withColumn("notice_id", F.when(reason.isNull(), F.coalesce("manual_notice", F.when(single, F.col("own_open_id").cast("long")))))
    rows = rows.withColumns({"reason": reason, "__advance": F.col("manual_id").isNull() & F.col("booking_id").isNotNull(), "__many": many})
    return _shared(rows).select(*receipts.columns, "booking_id", "notice_id", "state", "reason", "batch_blocked")


def _shared(rows: DataFrame) -> DataFrame:
    """What several receipts of one booking may be, and the states; sums by booking and by batch come before the joins."""
    by_booking = rows.where("booking_id IS NOT NULL").groupBy("booking_id").agg(F.count("*").alias("__n"), F.max(~F.col("__advance")).alias("__proved"), F.max(F.col("gross").isNotNull()).alias("__gross"), (F.min("payment_date") != F.max("payment_date")).alias("__dates"), (F.min("currency") != F.max("currency")).alias("__money"))
    rows = rows.join(by_booking, "booking_id", "left")
    late = F.when((F.col("__n") > 1) & (F.col("__proved") | F.col("__gross")), "several receipts of one booking").when(F.col("__dates") | F.col("__money"), "an advance booking received in parts")
    rows = rows.withColumn("reason", F.coalesce(F.col("reason"), late))
    blocked = F.col("reason").isNotNull()
    state = F.when(blocked, "blocked").when(F.col("booking_id").isNotNull(), "booking").when(F.col("notice_id").isNotNull(), "notice").when(F.col("__many") > 0, "unlinked").otherwise("new")
    rows = rows.withColumns({"state": state, "booking_id": F.when(~blocked, F.col("booking_id")), "notice_id": F.when(~blocked, F.col("notice_id"))})
    batches = rows.where("state = 'blocked'").select("batch").distinct().withColumn("batch_blocked", F.lit(True))
    return rows.join(batches, "batch", "left").fillna(False, ["batch_blocked"])


def settled_amounts(planned: DataFrame, bookings: DataFrame) -> DataFrame:
    """One row for each booking that the receipts of unblocked batches make or complete: ``net``, ``gross``, ``tax``, ``basis``.

    Receipts of one booking or notice, day and currency are one booking; one that states its gross stays alone, and so
    does one without either.  Gross and tax are known where every receipt states them, or where a booking by hand in the
    receipt's currency had them; an announcement never proves a tax.
    """
    free = planned.where("NOT batch_blocked")
    alone = F.when(F.col("gross").isNotNull() | (F.col("booking_id").isNull() & F.col("notice_id").isNull()), F.col("receipt_id"))
    keys = ["account_id", "symbol", "booking_id", "notice_id", "payment_date", "currency", "alone"]
    stated = F.min(F.col("gross").isNotNull() & F.col("tax").isNotNull())
    sums = free.withColumn("alone", alone).groupBy(*keys).agg(F.count("*").alias("receipts"), F.sum("amount").alias("net"), stated.alias("__stated"), F.sum("gross").alias("__gross"), F.sum("tax").alias("__tax"))
    old = bookings.where("basis = 'GROSS_NET'").select("booking_id", F.col("currency").alias("__currency"), F.col("gross").alias("__old_gross"), F.col("tax").alias("__old_tax"))
    out = sums.join(old, "booking_id", "left")
    kept = F.coalesce(F.col("__currency") == F.col("currency"), F.lit(False))
    pick = lambda new, before: F.when(F.col("__stated"), F.col(new)).when(kept, F.col(before))
    basis: Column = F.when(F.col("__stated") | kept, "GROSS_NET").otherwise("NET_ONLY")
    return out.select(*keys, "receipts", "net", pick("__gross", "__old_gross").alias("gross"), pick("__tax", "__old_tax").alias("tax"), basis.alias("basis")).drop("alone")
