"""Cash receipts against booked and expected dividends, by hand."""

from datetime import date
from decimal import Decimal

import pytest

from quillstone.operators import receipts as rc

RECEIPT = "receipt_id long, batch string, account_id long, symbol string, payment_date date, currency string, amount decimal(18,2), gross decimal(18,2), tax decimal(18,2)"
BOOKING = "booking_id long, account_id long, symbol string, status string, basis string, ex_date date, payment_date date, currency string, gross decimal(18,2), tax decimal(18,2), net decimal(18,2), notice_id long, sourced boolean"
NOTICE = "notice_id long, account_id long, symbol string, ex_date date, pay_date date, booking_id long, ignored boolean, complete boolean, superseded boolean"
EX, PAID = date(2024, 6, 3), date(2024, 6, 20)


def dec(x):
    return None if x is None else Decimal(str(x))


def receipt(i, day=PAID, amount=90, gross=None, tax=None, account=1, symbol="A", currency="HKD", batch="b"):
    return (i, batch, account, symbol, day, currency, dec(amount), dec(gross), dec(tax))


def booking(i, basis="LEGACY", paid=None, gross=100, tax=10, net=None, account=1, symbol="A", currency="HKD", notice=None, sourced=False, status="RECEIVED"):
    return (i, account, symbol, status, basis, EX, paid, currency, dec(gross), dec(tax), dec(net), notice, sourced)


def notice(i, account=1, symbol="A", ex=EX, pay=None, made=None, ignored=False, complete=False, superseded=False):
    return (i, account, symbol, ex, pay, made, ignored, complete, superseded)


@pytest.fixture
def planned(spark):
    def run(receipts, bookings=(), notices=()):
        p = rc.plan(spark.createDataFrame(list(receipts), RECEIPT), spark.createDataFrame(list(bookings), BOOKING), spark.createDataFrame(list(notices), NOTICE))
        return {r["receipt_id"]: (r["state"], r["booking_id"], r["notice_id"], r["reason"]) for r in p.collect()}

    return run


def test_one_notice_is_linked_and_its_advance_booking_replaced(planned):
    assert planned([receipt(1)], [], [notice(7)]) == {1: ("notice", None, 7, None)}
    assert planned([receipt(1)], [booking(3)], [notice(7, account=None, made=3)]) == {1: ("booking", 3, 7, None)}
    # A proved or unverified advance booking is none; then the notice's own account counts.
    assert planned([receipt(1)], [booking(3, sourced=True)], [notice(7, made=3)]) == {1: ("notice", None, 7, None)}
    assert planned([receipt(1)], [booking(3, status="UNVERIFIED")], [notice(7, account=None, made=3)]) == {1: ("unlinked", None, None, None)}


def test_doubt_is_not_resolved_by_nearness(planned):
    assert planned([receipt(1)], [], [notice(7), notice(8, ex=date(2024, 6, 19))]) == {1: ("unlinked", None, None, None)}
    assert planned([receipt(1)], [], [notice(7, account=None)]) == {1: ("unlinked", None, None, None)}
    state, _, _, reason = planned([receipt(1)], [booking(3)], [notice(7, made=3), notice(8)])[1]
    assert state == "blocked" and reason.startswith("an advance booking among")


def test_the_window_ends_are_inside(planned):
    days = [date(2024, 5, 30), date(2024, 5, 31), date(2024, 7, 10), date(2024, 7, 11)]
    p = planned([receipt(i, day=d) for i, d in enumerate(days)], [], [notice(7, pay=date(2024, 6, 10))])
    assert [p[i][0] for i in range(4)] == ["new", "notice", "notice", "new"]


def test_closed_notices_and_other_accounts_meet_nothing(planned):
    closed = [notice(7, ignored=True), notice(8, complete=True), notice(9, superseded=True), notice(10, account=2), notice(11, symbol="B"), notice(12, ex=None)]
    assert planned([receipt(1)], [booking(3, account=2)], closed) == {1: ("new", None, None, None)}


def test_bookings_by_hand_match_by_net_or_gross(planned):
    assert planned([receipt(1)], [booking(3, "GROSS_NET", PAID)])[1] == ("booking", 3, None, None)
    assert planned([receipt(1, amount=80, gross=100, tax=20)], [booking(3, "GROSS_NET", PAID)])[1] == ("booking", 3, None, None)
    assert planned([receipt(1, gross=100, tax=10)], [booking(3, "GROSS_NET", PAID)])[1] == ("booking", 3, None, None)
    assert planned([receipt(1, amount=0)], [booking(3, "NET_ONLY", PAID, net=0)])[1] == ("booking", 3, None, None)
    for other in (booking(3, "GROSS_NET", PAID, currency="USD"), booking(3, "GROSS_NET", EX), booking(3, "GROSS_NET", PAID, account=2), booking(3, "GROSS_NET", PAID, sourced=True), booking(3, "GROSS_NET", PAID, tax=11)):
        assert planned([receipt(1)], [other])[1] == ("new", None, None, None)
    # One matches by its net, another by its gross.
    two = [booking(3, "GROSS_NET", PAID, gross=95, tax=5), booking(4, "GROSS_NET", PAID, gross=100, tax=20)]
    assert planned([receipt(1, gross=100, tax=10)], two)[1] == ("blocked", None, None, "several bookings")


def test_a_bookings_own_notice_outranks_windows(planned):
    linked = booking(3, "GROSS_NET", PAID, notice=9)
    assert planned([receipt(1)], [linked], [notice(7), notice(8), notice(9, complete=True)])[1] == ("booking", 3, 9, None)
    assert planned([receipt(1)], [linked], [notice(7)])[1] == ("blocked", None, None, "its notice is gone")
    assert planned([receipt(1)], [booking(3, "GROSS_NET", PAID), booking(4)], [notice(7, made=4)])[1] == ("blocked", None, None, "booked by hand and in advance")


def test_receipts_of_one_booking(planned):
    old, expected = [booking(3)], [notice(7, made=3)]
    assert {s[0] for s in planned([receipt(1), receipt(2, amount=5)], old, expected).values()} == {"booking"}
    assert {s[3] for s in planned([receipt(1), receipt(2, day=date(2024, 6, 21))], old, expected).values()} == {"an advance booking received in parts"}
    assert {s[3] for s in planned([receipt(1), receipt(2, currency="USD")], old, expected).values()} == {"an advance booking received in parts"}
    assert {s[3] for s in planned([receipt(1), receipt(2, gross=10, tax=1)], old, expected).values()} == {"several receipts of one booking"}
    assert {s[3] for s in planned([receipt(1), receipt(2)], [booking(3, "GROSS_NET", PAID)]).values()} == {"several receipts of one booking"}


def test_nulls_and_empty_tables(planned):
    assert planned([]) == {}
    odd = [receipt(1, account=None), receipt(2, symbol=None), receipt(3, day=None), receipt(4, amount=None), receipt(5, currency=None)]
    p = planned(odd, [booking(3, "GROSS_NET", PAID)], [notice(7)])
    assert [p[i][0] for i in range(1, 6)] == ["new", "new", "new", "booking" if p[4][1] else "notice", "notice"]


def test_amounts_and_blocked_batches(spark):
    receipts = [receipt(1, batch="x"), receipt(2, amount=5, batch="x"), receipt(3, symbol="B", gross=100, tax=10, batch="x"), receipt(4, symbol="C", amount=80, batch="x"), receipt(5, symbol="D", batch="y"), receipt(6, symbol="E", batch="y")]
    bookings = [booking(3), booking(4, "GROSS_NET", PAID, symbol="C", gross=100, tax=20), booking(5, "GROSS_NET", PAID, symbol="D", notice=99)]
    b = spark.createDataFrame(bookings, BOOKING)
    p = rc.plan(spark.createDataFrame(receipts, RECEIPT), b, spark.createDataFrame([notice(7, made=3)], NOTICE))
    got = {(r["symbol"], r["booking_id"], r["receipts"], r["net"], r["gross"], r["tax"], r["basis"]) for r in rc.settled_amounts(p, b).collect()}
    # The advance booking's tax was the notice's and proves nothing; that by hand does; batch y is blocked whole.
    assert got == {("A", 3, 2, Decimal(95), None, None, "NET_ONLY"), ("B", None, 1, Decimal(90), Decimal(100), Decimal(10), "GROSS_NET"), ("C", 4, 1, Decimal(80), Decimal(100), Decimal(20), "GROSS_NET")}


def test_a_hot_security_makes_no_pairs(spark):
    """20,000 receipts and 20,000 notices of one security and account: no frame on the way is larger than both."""
    n = 20_000
    r = spark.range(n).selectExpr("id AS receipt_id", "'b' AS batch", "1L AS account_id", "'A' AS symbol", "date_add(date'2024-01-01', CAST(id % 300 AS INT)) AS payment_date", "'HKD' AS currency", "CAST(id AS decimal(18,2)) AS amount", "CAST(NULL AS decimal(18,2)) AS gross", "CAST(NULL AS decimal(18,2)) AS tax")
    m = spark.range(n).selectExpr("id AS notice_id", "1L AS account_id", "'A' AS symbol", "date_add(date'2024-01-01', CAST(id % 200 AS INT)) AS ex_date", "CAST(NULL AS date) AS pay_date", "CAST(NULL AS long) AS booking_id", "false AS ignored", "false AS complete", "false AS superseded")
    got = {x["state"]: x["count"] for x in rc.plan(r, spark.createDataFrame([], BOOKING), m).groupBy("state").count().collect()}
    assert sum(got.values()) == n and set(got) == {"unlinked", "new"}
    assert got["new"] == sum(1 for i in range(n) if i % 300 > 199 + rc.AFTER)
