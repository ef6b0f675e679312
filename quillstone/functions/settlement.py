"""Columns over settled trades and days on which markets were open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled_price(connect: Column, price: Column, amount: Column, quantity: Column, rate: Column) -> Column:
    """A trade's price in its own currency: as shown, or through the settled amount and the settlement rate; null without a rate or shares."""
    through = F.when((quantity > 0) & (rate > 0), F.abs(amount) / quantity / rate)
    return F.when(F.coalesce(connect, F.lit(False)), through).otherwise(price)


def settlement_flow(basis: Column, amount: Column, fees: Column, buys: Column) -> Column:
    """Cash that a trade moves in the settlement currency.

    ``basis``: net (the amount has its sign and its fees), gross (an amount without either; fees come on top or off by
    the side of the trade); of any other basis nothing is said.
    """
    gross = F.abs(amount)
    cost = F.coalesce(fees, F.lit(0))
    return F.when(basis == "net", amount).when(basis == "gross", F.when(buys, -(gross + cost)).otherwise(gross - cost))


def weekday_before(day: Column) -> Column:
    """The last day from Monday to Friday ahead of a day."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def last_trading_day(day: Column, opened: Column) -> Column:
    """The last completed trading day ahead of a day: what the market's calendar says, else the last weekday."""
    return F.coalesce(F.when(opened < day, opened), weekday_before(day))


def hours_open(at: Column, zone: str, first: int, end: int) -> Column:
    """Whether an instant lies within local hours (from inclusive, to exclusive) of any day."""
    return F.hour(F.from_utc_timestamp(at, zone)).between(first, end - 1)
