"""Text and number columns; every function is null where its inputs don't suffice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_text(text: Column) -> Column:
    """Without byte order marks and outer white space; null counts as empty."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("﻿"), F.lit("")), r"^\s+|\s+$", "")


def or_none(text: Column) -> Column:
    return F.nullif(strip_text(text), F.lit(""))


def symbol_cell(text: Column) -> Column:
    """A code as read from a sheet: digits that were taken for a float lose the added ".0"."""
    return F.regexp_replace(strip_text(text), r"^([0-9]+)\.0$", "$1")


def manual_symbol(symbol: Column, zero_padded: Column) -> Column:
    """Upper case; digits of markets with five-digit codes padded with zeros."""
    plain = F.upper(strip_text(symbol))
    return F.when(zero_padded & plain.rlike("^[0-9]{1,5}$"), F.lpad(plain, 5, "0")).otherwise(plain)


def amount(text: Column, kind: str = "decimal(28,8)") -> Column:
    """A number written with or without thousands separators; null where it's none."""
    return F.replace(strip_text(text), F.lit(","), F.lit("")).try_cast(kind)


def day(text: Column) -> Column:
    """A date written 2025-01-31, 2025/1/31, 2025.1.31 or 20250131, with or without a time behind it."""
    plain = F.regexp_replace(strip_text(text), "[/.]", "-")
    packed = F.when(plain.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2)))
    return F.coalesce(packed, F.regexp_extract(plain, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:$|[ T])", 1)).try_cast("date")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def growth_percent(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, F.abs(before)) * 100.0


# Names of markets, marks for missing numbers, days by which a fiscal year's end is moved back.
B_SHARES, HONG_KONG, US, A_SHARES, OTHER = "B股", "港股", "美股", "A股", "其他"
NULL_MARKS = ["–", "—", "-", "－", "―", "−"]
FISCAL_YEAR_SHIFT_DAYS = 14
MAGNITUDE_BAND = 0.15
CLEAN_BAND = 0.01


def market_of(symbol: Column, currency: Column, holder: Column) -> Column:
    """The market of a booked code, from its digits, the currency and the shareholder's code."""
    code = F.trim(symbol)
    starts = lambda *p: code.rlike("^(?:" + "|".join(p) + ")")
    abroad = (currency == "HKD") | F.coalesce(holder, F.lit("")).startswith("H") | code.rlike("^[0-9]{5}$")
    return F.when(starts("200", "900"), B_SHARES).when(F.coalesce(abroad, F.lit(False)), HONG_KONG).when(currency == "USD", US).when(starts("[0123569]"), A_SHARES).otherwise(OTHER)


def counter_currency(symbol: Column) -> Column:
    """CNY for the five-digit codes of the second-currency counter, else unknown."""
    code = strip_text(symbol)
    return F.when(code.rlike("^[0-9]+$") & code.try_cast("int").between(80000, 89999), "CNY")


def mask_code(text: Column, keep: int = 2) -> Column:
    """The first characters of a code, stars for the rest: at least one is hidden."""
    plain = strip_text(text)
    shown = F.greatest(F.least(F.lit(keep), F.length(plain) - 1), F.lit(0))
    return F.concat(F.substring(plain, F.lit(1), shown), F.repeat(F.lit("*"), F.length(plain) - shown))


def value_class(text: Column) -> Column:
    """The shape of a cell: d for digits (D for those of other scripts), signs as they are, other runs by their length."""
    runs = F.regexp_extract_all(strip_text(text), F.lit(r"\p{Nd}|[.,+-]|[^\p{Nd}.,+-]+"), F.lit(0))
    shape = lambda r: F.when(r.rlike("^[0-9]$"), "d").when(r.rlike(r"^\p{Nd}$"), "D").when(r.rlike("^[.,+-]$"), r).otherwise(F.concat(F.lit("<X:"), F.length(r), F.lit(">")))
    return F.array_join(F.transform(runs, shape), "")


def ratio_text(text: Column) -> Column:
    """A ratio with a half-width colon and no blanks; null if nothing is left."""
    return F.nullif(F.trim(F.replace(F.replace(text, F.lit("："), F.lit(":")), F.lit(" "))), F.lit(""))


def ratio_parts(text: Column, kind: str = "decimal(18,8)") -> Column:
    """struct<first, second> of "a:b"; null unless both are numbers and the first is positive."""
    parts = F.split(text, ":")
    first, second = F.get(parts, F.lit(0)).try_cast(kind), F.get(parts, F.lit(1)).try_cast(kind)
    return F.when((F.size(parts) == 2) & (first > 0) & second.isNotNull(), F.struct(first.alias("first"), second.alias("second")))


def bonus_factor(ratio: Column, received: Column, held: Column) -> Column:
    """By how much a bonus issue multiplies a holding: "base:bonus" if it is given, else the shares received on those held."""
    parts = ratio_parts(ratio)
    return F.coalesce(1 + parts["second"] / parts["first"], F.when((received != 0) & (held > 0), (held + received) / held))


def split_factor(ratio: Column, new_total: Column, held: Column) -> Column:
    """By how much a split multiplies a holding: "old:new" if it is given, else the new total on the shares held."""
    parts = ratio_parts(ratio)
    return F.coalesce(parts["second"] / parts["first"], F.when(held > 0, new_total / held))


def clean_factor(ratio: Column) -> Column:
    """The whole number, or one over it, that a ratio lies within a hundredth of."""
    near = lambda c: F.when(F.abs(F.try_divide(ratio, c) - 1) <= CLEAN_BAND, c)
    whole = F.nullif(F.rint(ratio), F.lit(0.0))
    return F.coalesce(near(whole), near(F.when((ratio > 0) & (ratio < 1), F.try_divide(F.lit(1.0), F.rint(F.try_divide(F.lit(1.0), ratio))))))


def magnitude_off(ratio: Column) -> Column:
    """k if a ratio is about ten to the k, k not 0: a figure in the wrong unit."""
    k = F.rint(F.log10(F.when(ratio > 0, ratio)))
    return F.when((k != 0) & (F.abs(ratio / F.pow(F.lit(10.0), k) - 1) <= MAGNITUDE_BAND), k.cast("int"))


def number_cell(text: Column, kind: str = "decimal(28,8)") -> Column:
    """An accounting figure: brackets mean minus, dashes nothing; brackets that don't pair make it unreadable."""
    plain = F.trim(text)
    count = lambda c: F.length(plain) - F.length(F.replace(plain, F.lit(c)))
    bare = F.replace(F.regexp_replace(plain, r"^[()]+|[()]+$", ""), F.lit(","))
    value = bare.try_cast(kind)
    usable = (plain != "") & ~plain.isin(NULL_MARKS) & (count("(") == count(")"))
    return F.when(usable, F.when(plain.startswith("(") & plain.endswith(")"), -value).otherwise(value))


def squash_spaced(text: Column) -> Column:
    """Without the blanks in runs of three or more ideographs that stand apart."""
    runs = r"[\u4e00-\u9fff](?:[ \u3000][\u4e00-\u9fff]){2,}"
    inside = r"(?<=[\u4e00-\u9fff])[ \u3000](?=[\u4e00-\u9fff])"
    found = F.regexp_extract_all(text, F.lit(runs), F.lit(0))
    return F.aggregate(found, text, lambda t, r: F.replace(t, r, F.regexp_replace(r, inside, "")))


def ideograph_share(text: Column) -> Column:
    """Share of ideographs among the characters that aren't blank."""
    compact = F.regexp_replace(text, r"\s", "")
    return F.coalesce(F.try_divide((F.length(compact) - F.length(F.regexp_replace(compact, r"[\u4e00-\u9fff]", ""))).cast("double"), F.length(compact)), F.lit(0.0))


def period_end(text: Column) -> Column:
    """The date of 20251231 or 2025-12-31, whatever follows; null if it is none."""
    digits = F.substring(F.replace(text, F.lit("-")), 1, 8)
    return F.when(digits.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date"))


def fiscal_year(end: Column, period: Column) -> Column:
    """The year that an annual row belongs to; null of other rows.  Without a period, ends on the last day of a year are annual."""
    annual = F.coalesce(period == "FY", F.lit(False)) | F.replace(end, F.lit("-")).endswith("1231")
    return F.when(annual, F.year(F.date_sub(period_end(end), FISCAL_YEAR_SHIFT_DAYS)).cast("string"))


def local_day(at: Column, zone: Column | str = "Asia/Shanghai") -> Column:
    """The calendar day of an instant of the session's zone UTC elsewhere."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def quote_day(as_of: Column, written: Column, zone: Column | str) -> Column:
    """The market's day of a price: the source's own, else that of the time it was written."""
    return F.coalesce(as_of, local_day(written, zone))


def period_start(period: Column, today: Column) -> Column:
    return F.when(period == "daily", today).when(period == "mtd", F.trunc(today, "MM")).when(period == "ytd", F.trunc(today, "YEAR"))


def growth(now: Column, before: Column) -> Column:
    """Percent on the absolute prior value; null where that is 0 or the signs differ."""
    return F.when((before != 0) & ((now < 0) == (before < 0)), F.round((now - before) / F.abs(before) * 100, 1))


def direction(now: Column, before: Column) -> Column:
    return F.when(now > before, "上升").when(now < before, "下降").when(now == before, "持平")


def lot_multiplier(market: Column, code: Column) -> Column:
    """Ten for convertible bonds that Shanghai quotes by the lot."""
    return F.when((strip_text(market) == "上海") & strip_text(code).startswith("11"), 10).otherwise(1)


def fee_in_price_currency(quantity: Column, price: Column, gross: Column, net: Column, commission: Column, same_currency: Column) -> Column:
    """A trade's costs, booked in the base currency, in that of its price."""
    cost = F.when(gross.isNotNull() & net.isNotNull(), F.abs(net - gross)).otherwise(F.coalesce(F.abs(commission), F.lit(0)))
    value = F.abs(quantity * price)
    return F.when(cost == 0, cost).when(same_currency, cost).when((value != 0) & (gross != 0), cost * value / F.abs(gross)).otherwise(F.coalesce(F.abs(commission), F.lit(0)))


def tax_of(total: Column, rate: Column) -> Column:
    return total * rate


def _is_code(text: Column) -> Column:
    """Up to twelve letters, digits, points and dashes."""
    return F.length(text).between(1, 12) & (F.translate(F.upper(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-", "") == "")


def symbol_refs(*texts: Column) -> Column:
    """All codes that cashtags (a name and a code in brackets between dollar signs) and permalinks (the code after /S/, then a number) name, upper case, each once."""

    def tagged(piece: Column) -> Column:
        name, code = F.get(F.split(piece, r"\("), F.lit(0)), F.get(F.split(piece, r"\("), F.lit(1))
        fits = (F.size(F.split(piece, r"\(")) == 2) & F.length(name).between(1, 60) & code.endswith(")") & ~name.contains(")")
        return F.when(fits, F.left(code, F.length(code) - 1))

    def linked(piece: Column) -> Column:
        steps = F.split(piece, "/")
        return F.when(F.left(F.get(steps, F.lit(1)), F.lit(1)).between("0", "9"), F.get(steps, F.lit(0)))

    found = []
    for t in texts:
        text = F.coalesce(t, F.lit(""))
        between = F.split(text, r"\$")
        found += [F.transform(F.slice(between, F.lit(2), F.greatest(F.size(between) - 2, F.lit(0))), tagged), F.transform(F.slice(F.split(text, "/S/"), F.lit(2), F.size(F.split(text, "/S/"))), linked)]
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.flatten(F.array(*found)), _is_code), F.upper)))


def current_price(prices: Column, symbol: Column, market: Column) -> Column:
    """The first positive price under symbol:market, market:symbol and symbol."""
    keys = (F.concat_ws(":", symbol, market), F.concat_ws(":", market, symbol), symbol)
    return F.coalesce(*[F.when(F.try_element_at(prices, k) > 0, F.try_element_at(prices, k)) for k in keys])


def merged(old: Column, new: Column) -> Column:
    """Two maps in one; where both have a key, the new value counts."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.coalesce(F.map_concat(kept, new), old, new)


def row_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, joined by bars; decimals without trailing zeros, dates in ISO form, null as empty."""
    return F.sha2(F.encode(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), "UTF-8"), 256)


def plain_decimal(value: Column) -> Column:
    """A decimal as text, without trailing zeros and exponent."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
