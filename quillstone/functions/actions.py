"""Columns over corporate actions, statement rows and dividend notices; null where the inputs don't suffice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bonus_factor, ratio_parts, ratio_text, split_factor, strip_text

# Kinds of actions, statement wordings, months of option contracts, currency codes in notices.
BONUS = ["STOCK_DIVIDEND", "BONUS_ISSUE"]
SPLIT = ["STOCK_SPLIT", "REVERSE_SPLIT"]
TRADE_BUSINESS = ["证券买入", "证券卖出", "港股通买入", "港股通卖出", "开放基金申购"]
DIVIDEND_BUSINESS = ["红利入账", "股息红利差异扣税"]
CONNECT_FEE = "港股通组合费"
OPTION_MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
CURRENCY_ALIASES = {"RMB": "CNY"}


def cash_day(paid: Column, ex: Column) -> Column:
    return F.coalesce(paid, ex)


def scope_day(kind: Column, paid: Column, ex: Column) -> Column:
    """The day that a date filter looks at: when cash came for dividends, else the ex-date."""
    return F.when(kind == "CASH_DIVIDEND", cash_day(paid, ex)).otherwise(ex)


def received(kind: Column, status: Column, paid: Column, ex: Column, as_of: Column) -> Column:
    """Whether a dividend's cash has come by a day; a receipt that nobody verified hasn't."""
    return F.coalesce((kind == "CASH_DIVIDEND") & ~status.eqNullSafe(F.lit("UNVERIFIED")) & (cash_day(paid, ex) <= as_of), F.lit(False))


def amounts_complete(basis: Column) -> Column:
    return ~basis.eqNullSafe(F.lit("NET_ONLY"))


def opening_lot(kind: Column, quantity: Column, total: Column, unit: Column) -> Column:
    """struct<quantity, cost> of an opening position; its cost is null if neither a total nor a unit cost is known."""
    return F.when((kind == "OPENING_POSITION") & (quantity > 0), F.struct(quantity.alias("quantity"), F.coalesce(total, unit * quantity).alias("cost")))


def rights_lot(kind: Column, quantity: Column, price: Column, paid: Column) -> Column:
    """struct<quantity, cost> of subscribed rights; both quantity and price are needed, the amount paid is the better cost."""
    there = (kind == "RIGHTS_ISSUE") & (quantity != 0) & (price != 0)
    return F.when(there, F.struct(quantity.alias("quantity"), F.coalesce(F.nullif(paid, F.lit(0)), quantity * price).alias("cost")))


def by_ratio(kind: Column, distribution: Column, split: Column) -> Column:
    """Whether an action works per share, so on all buckets, and not on one with an absolute number."""
    return F.coalesce((kind.isin(BONUS) & ratio_parts(ratio_text(distribution)).isNotNull()) | (kind.isin(SPLIT) & ratio_parts(ratio_text(split)).isNotNull()), F.lit(False))


def quantity_after(kind: Column, held: Column, distribution: Column, shares: Column, split: Column, new_total: Column, rights: Column, opening: Column) -> Column:
    """What a bucket holds after one action; one that says nothing readable leaves it as it is."""
    bonus, parted = bonus_factor(ratio_text(distribution), shares, held), split_factor(ratio_text(split), new_total, held)
    return F.coalesce(F.when(kind.isin(BONUS), held * bonus).when(kind.isin(SPLIT), held * parted).when(kind == "RIGHTS_ISSUE", held + rights["quantity"]).when(kind == "OPENING_POSITION", held + opening["quantity"]), held)


def action_defect(kind: Column, distribution: Column, shares: Column, split: Column, new_total: Column, sub_quantity: Column, sub_price: Column, quantity: Column, unit: Column, total: Column) -> Column:
    """Why an action can't change a quantity: ratio, missing, subscription, opening or cost; null if it can."""

    def ratio_defect(text: Column, absent: Column) -> Column:
        given = F.coalesce(text != "", F.lit(False))
        positive = F.coalesce(ratio_parts(ratio_text(text))["second"] > 0, F.lit(False))
        return F.when(given & ~positive, "ratio").when(~given & absent, "missing")

    none = lambda c: F.coalesce(c == 0, F.lit(True))
    apart = F.abs(unit * quantity - total) > F.greatest(quantity * F.lit("0.01").cast("decimal(4,2)"), F.lit("0.01").cast("decimal(4,2)"))
    opening = F.when(F.coalesce(quantity <= 0, F.lit(True)), "opening").when(apart, "cost")
    return F.when(kind.isin(BONUS), ratio_defect(distribution, none(shares))).when(kind.isin(SPLIT), ratio_defect(split, new_total.isNull())).when((kind == "RIGHTS_ISSUE") & (none(sub_quantity) | none(sub_price)), "subscription").when(kind == "OPENING_POSITION", opening)


def _digits(text: Column) -> Column:
    return F.coalesce((F.length(text) > 0) & (F.translate(text, "0123456789", "") == ""), F.lit(False))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(",")).try_cast("decimal(28,10)")


def _expiry(word: Column, days: bool) -> Column:
    """Whether a word is a month and a year of two digits, with the day ahead of it or without."""
    month = F.substring(word, 3 if days else 1, 3).isin(OPTION_MONTHS.split("|"))
    return (F.length(word) == (7 if days else 5)) & month & _digits(F.right(word, F.lit(2))) & (_digits(F.left(word, F.lit(2))) if days else F.lit(True))


def is_option(symbol: Column, description: Column) -> Column:
    """Whether a symbol or its description names an option contract.

    Packed: a root, then six digits of expiry, C or P, and eight of strike.  Written: four words in a row, underlying,
    expiry, strike and side; an underlying of letters and digits needs the day of the expiry.
    """
    code = F.coalesce(F.upper(strip_text(symbol)), F.lit(""))
    packed = F.replace(code, F.lit(" "))
    tail, root = F.right(packed, F.lit(15)), F.left(packed, F.greatest(F.length(packed) - 15, F.lit(0)))
    is_packed = (F.length(packed) > 15) & _digits(F.concat(F.left(tail, F.lit(6)), F.right(tail, F.lit(8)))) & F.substring(tail, 7, 1).isin("C", "P") & F.right(root, F.lit(1)).between("A", "Z")
    words = F.split(F.concat_ws(" ", code, F.upper(strip_text(description))), r"\s+")

    def written(i: Column) -> Column:
        under, expiry, strike, side = (F.get(words, i + k) for k in range(4))
        plain = F.translate(under, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
        dated = _expiry(expiry, True) & (F.length(under) <= 6) & ((plain == "") | _digits(plain))
        monthly = _expiry(expiry, False) & (F.length(under) <= 5) & (plain == "")
        return side.isin("C", "P") & strike.try_cast("double").isNotNull() & _digits(F.left(strike, F.lit(1))) & (dated | monthly)

    starts = F.when(F.size(words) >= 4, F.sequence(F.lit(0), F.greatest(F.size(words) - 4, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return is_packed | F.coalesce(F.exists(starts, written), F.lit(False))


def skip_reason(statement: Column, business: Column, code: Column) -> Column:
    """Why a statement's row isn't booked: unsupported, or in conflict with the kind of the statement; null if it is."""
    here, abroad = code.rlike("^[0-9]{6}$"), code.rlike("^[0-9]{5}$")
    wrong = ((statement == "stock") & ~here) | ((statement == "hk_connect") & ~abroad)
    security = F.when(~(here | abroad), "unsupported").when(wrong, "conflict")
    return F.when(business.isin(TRADE_BUSINESS + DIVIDEND_BUSINESS), security).when(business == CONNECT_FEE, F.when(statement != "hk_connect", "conflict")).otherwise("unsupported")


def currency_code(text: Column) -> Column:
    code = F.nullif(F.upper(F.trim(text)), F.lit(""))
    return F.coalesce(*[F.when(code == k, v) for k, v in CURRENCY_ALIASES.items()], code)


def _tokens(text: Column) -> Column:
    """Numbers and codes of three capitals, in order."""
    return F.regexp_extract_all(text, F.lit("[A-Z]{3}|[0-9][0-9,.]*"), F.lit(0))


def _split_once(text: Column, mark: str) -> tuple[Column, Column]:
    parts = F.split(text, mark, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def per_share(text: Column) -> Column:
    """struct<amount, currency> a share, of "每 10 股 3HKD"; the currency stands before or behind, two that differ say nothing."""
    count, rest = _split_once(_split_once(text, "每")[1], "股")
    shares = F.when(F.trim(count) == "", F.lit(1)).otherwise(F.trim(count).try_cast("int"))
    token = lambda i: F.get(_tokens(rest), F.lit(i))
    ahead = _number(token(0)).isNull()  # the currency comes first
    amount = F.try_divide(_number(F.when(ahead, token(1)).otherwise(token(0))), shares.cast("decimal(10,0)")).cast("decimal(28,10)")
    behind = F.when(ahead, token(2)).otherwise(token(1))
    code = F.when(ahead, F.when(F.coalesce(_number(behind).isNotNull() | (behind == token(0)), F.lit(True)), token(0))).otherwise(F.when(_number(behind).isNull(), behind))
    currency = currency_code(code)
    return F.when(currency.isNotNull() & amount.isNotNull() & (shares > 0), F.struct(amount.alias("amount"), currency.alias("currency")))


def rate_phrase(text: Column) -> Column:
    """struct<base, quote, rate> of "1 RMB : 1.14HKD", for one unit of the base: a number and a code on each side of the colon."""
    left, right = map(_tokens, _split_once(F.replace(text, F.lit("："), F.lit(":")), ":"))
    units, base = F.try_element_at(left, F.lit(-2)), F.try_element_at(left, F.lit(-1))
    price, quote = F.get(right, F.lit(0)), F.get(right, F.lit(1))
    rate = F.try_divide(_number(price), _number(units)).cast("decimal(28,10)")
    codes = _number(base).isNull() & _number(quote).isNull() & base.isNotNull() & quote.isNotNull()
    return F.when(codes & rate.isNotNull(), F.struct(currency_code(base).alias("base"), currency_code(quote).alias("quote"), rate.alias("rate")))


def close_wins(close_day: Column, quote_day: Column, source: Column) -> Column:
    """Whether the last close replaces the quote: the newer day does; on the same day the close, but for a price set by hand."""
    same = F.coalesce(source != "manual", F.lit(True))
    return F.when(close_day.isNull(), False).when(quote_day.isNull(), True).otherwise(F.when(close_day != quote_day, close_day > quote_day).otherwise(same))


def exchange_legs(pair: Column, quantity: Column, price: Column, currency: Column) -> Column:
    """array<struct<currency, amount>>: the two cash legs of an exchange "EUR.USD"; null where the pair or its currency is in doubt."""
    code = F.upper(strip_text(pair))
    base, quote = F.substring(code, 1, 3), F.substring(code, 5, 3)
    sure = code.rlike(r"^[A-Z]{3}\.[A-Z]{3}$") & (quantity != 0) & (price > 0) & F.coalesce(F.upper(F.nullif(currency, F.lit(""))) == quote, F.lit(True))
    kind = "decimal(38,8)"
    return F.when(sure, F.array(F.struct(base.alias("currency"), quantity.cast(kind).alias("amount")), F.struct(quote.alias("currency"), (-quantity * price).cast(kind).alias("amount"))))


def mentions(text: Column, url: Column) -> Column:
    """Whether a post may name a security: a cheap test that a scan can push down."""
    return F.coalesce(text.contains("$"), F.lit(False)) | F.coalesce(url.contains("/S/"), F.lit(False))


def versions_current(payload: Column, **expected: int) -> Column:
    """Whether a JSON payload carries just the expected versions; one that isn't readable is out of date."""
    read = F.from_json(payload, ", ".join(f"{name} bigint" for name in expected))
    fits = F.lit(True)
    for name, version in expected.items():
        fits = fits & read[name].eqNullSafe(F.lit(version))
    return fits
