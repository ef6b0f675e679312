"""Replays by account with transfers and actions: cases by hand, and random ledgers against a plain replay in Python's decimals."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quillstone.operators import buckets

KEYS = ["sym"]
TRADE = "sym string, id bigint, a bigint, side string, link bigint, qty decimal(18,8), price decimal(18,8), fee decimal(18,8), trade_date date"
ACTION = "sym string, id bigint, a bigint, kind string, ex_date date, distribution string, shares decimal(18,8), split string, new_total decimal(18,8), sub_quantity decimal(18,8), sub_price decimal(18,8), sub_amount decimal(18,8), quantity decimal(18,8), unit_cost decimal(18,8), total_cost decimal(18,8)"
FIELDS = [f.split()[0] for f in ACTION.split(", ")[1:]]


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(n)


def trade(id, side, qty, price=0, on=1, a=1, fee=0, link=None, sym="X"):
    return (sym, id, a, side, link, D(str(qty)), D(str(price)), D(str(fee)), day(on))


def action(id, kind, on, sym="X", **fields):
    return (sym, *[{"id": id, "kind": kind, "ex_date": day(on)}.get(f, fields.get(f) if isinstance(fields.get(f), (str, int, type(None))) and f in ("a", "distribution", "split") else fields.get(f) and D(str(fields[f]))) for f in FIELDS])


def events(spark, trades, actions=()):
    return buckets.trade_events(spark.createDataFrame(trades, TRADE), KEYS).unionByName(buckets.action_events(spark.createDataFrame(list(actions), ACTION), KEYS))


def fifo(spark, trades, actions=()):
    rows = buckets.fifo_by_account(events(spark, trades, actions), KEYS).withColumn("costs", F.transform("lots", buckets.lot_cost)).collect()
    assert len(rows) == 1
    return rows[0]


def average(spark, trades, actions=()):
    row = buckets.average_by_account(events(spark, trades, actions), KEYS).first()
    return row, {b.a: (b.q, b.c, b.unknown) for b in row.buckets if b.q}


def lots(row):
    return [(x.a, x.q, c, x.d) for x, c in zip(row.lots, row.costs, strict=True)]


def test_one_and_two_accounts_agree_to_the_last_digit(spark):
    one, two = D("8931992295.31575055"), D("1641890924.22944734")
    for accounts, branch in (((1, 1), "single"), ((1, 2), "account")):
        r = fifo(spark, [trade(1, "BUY", 1, one, 2, accounts[0]), trade(2, "BUY", 1, two, 3, accounts[1]), trade(3, "SELL", 1, one, 10, accounts[0]), trade(4, "SELL", 1, two, 11, accounts[1])])
        assert r.branch == branch and sum(c.cost for c in r.closed) == one + two and sum(c.proceeds - c.cost for c in r.closed) == 0 and not r.lots


def test_pieces_of_a_lot_cost_what_it_cost(spark):
    r = fifo(spark, [trade(1, "BUY", 3, 1, 1, fee="0.01"), *[trade(k, "SELL", 1, 2, k) for k in (2, 3, 4)]])
    assert abs(sum(c.cost for c in r.closed) - D("3.01")) < D("1e-11") and [c.first for c in r.closed] == [day(1)] * 3


def test_transfers_carry_dates_and_costs(spark):
    ledger = [trade(1, "BUY", 10, 5, 1, 1), trade(2, "BUY", 10, 7, 5, 2), trade(3, "OUT", 4, 0, 8, 1), trade(4, "IN", 4, 0, 8, 2, link=3), trade(5, "SELL", 6, 9, 9, 2, fee=1)]
    r = fifo(spark, ledger)
    assert r.branch == "account"
    # The moved lot is the older one in its new account, so it is sold first.
    assert [(c.a, c.cost, c.proceeds, c.first) for c in r.closed] == [(2, D(34), D(53), day(1))]
    assert sorted(lots(r)) == [(1, D(6), D(30), day(1)), (2, D(8), D(56), day(5))]
    row, held = average(spark, ledger)
    assert row.branch == "account" and held[1] == (D(6), D(30), D(0))
    assert held[2][0] == D(8) and abs(held[2][1] - (20 + 70) * D(8) / D(14)) < D("1e-9")


def test_chained_transfers_of_one_day(spark):
    r = fifo(spark, [trade(1, "BUY", 5, 2, 1, 1), trade(2, "OUT", 5, 0, 3, 1), trade(3, "IN", 5, 0, 3, 2, link=2), trade(4, "OUT", 5, 0, 3, 2), trade(5, "IN", 5, 0, 3, 3, link=4)])
    assert r.branch == "account" and lots(r) == [(3, D(5), D(10), day(1))]


@pytest.mark.parametrize(
    "more,reason",
    [
        ([trade(3, "SELL", 12, 6, 9, 1)], "sells more than the account has"),
        ([trade(3, "OUT", 11, 0, 9, 1), trade(4, "IN", 11, 0, 9, 2, link=3)], "moves more than the account has"),
        ([trade(3, "OUT", 1, 0, 9, 1)], "leaves without arriving"),
        ([trade(3, "IN", 1, 0, 9, 1, link=77)], "arrives without having left"),
    ],
)
def test_contradictions_fall_back_to_one_bucket(spark, more, reason):
    base = [trade(1, "BUY", 10, 5, 1, 1), trade(2, "BUY", 10, 7, 2, 2)]
    r = fifo(spark, base + more)
    assert (r.branch, r.reason) == ("merged", reason)
    sold = more[0][3] == "SELL"
    assert sum(x[1] for x in lots(r)) == (8 if sold else 20) and sum(x[2] for x in lots(r)) == (56 if sold else 120) and r.skipped == 0
    row, held = average(spark, base + more)
    assert (row.branch, row.reason, row.error) == ("merged", reason, None) and held[None][0] == (8 if sold else 20)


def test_oversell_in_one_bucket_is_skipped_whole(spark):
    r = fifo(spark, [trade(1, "BUY", 10, 5, 1), trade(2, "SELL", 11, 6, 2), trade(3, "SELL", 10, 6, 3)])
    assert r.branch == "single" and r.skipped == 1 and len(r.closed) == 1 and not r.lots
    row, _ = average(spark, [trade(1, "BUY", 10, 5, 1), trade(2, "SELL", 11, 6, 2)])
    assert row.branch == "merged" and row.error == "sells more than the account has"


def test_rounded_lots_are_sold_whole(spark):
    """Seven lots of 143 shares become 40, each rounded at eight digits, and add up to 39.99999999."""
    bought = [trade(k, "BUY", q, 5, k) for k, q in enumerate((20, 20, 5, 28, 30, 26, 14), 1)]
    r = fifo(spark, [*bought, trade(9, "SELL", 40, 6, 21)], [action(8, "REVERSE_SPLIT", 20, new_total=40)])
    assert r.skipped == 0 and not r.lots and [(c.q, c.first) for c in r.closed] == [(D(40), day(1))] and abs(r.closed[0].cost - 715) < D("1e-6")
    moved = [trade(9, "OUT", 40, 0, 21, 1), trade(10, "IN", 40, 0, 21, 2, link=9), trade(11, "SELL", 40, 6, 22, 2)]
    r = fifo(spark, [*bought, *moved], [action(8, "REVERSE_SPLIT", 20, new_total=40)])
    assert (r.branch, r.reason) == ("account", None) and not r.lots and len(r.closed) == 1
    # What rounding leaves holds nothing: 5 of 3 * 1.66666667 are sold, and the next number is told to the other account.
    three = [trade(k, "BUY", 1, 5, k, 1) for k in (1, 2, 3)]
    r = fifo(spark, [*three, trade(4, "BUY", 9, 5, 4, 2), trade(6, "SELL", 5, 6, 7, 1)], [action(5, "REVERSE_SPLIT", 6, a=1, new_total=5), action(7, "BONUS_ISSUE", 8, shares=1)])
    assert (r.branch, r.reason) == ("account", None) and [x[:2] for x in lots(r) if x[1] > D("1e-7")] == [(2, D(10))]


def test_ratios_work_in_all_accounts_and_absolute_numbers_in_one(spark):
    two = [trade(1, "BUY", 10, 5, 1, 1), trade(2, "BUY", 20, 7, 2, 2)]
    r = fifo(spark, two, [action(1, "STOCK_SPLIT", 5, split="1:2"), action(2, "BONUS_ISSUE", 6, distribution="10：3")])
    assert sorted(lots(r)) == [(1, D(26), D(50), day(1)), (2, D(52), D(140), day(2))]
    # Two holders and no account: nobody knows whose; in one bucket the shares are spread.
    r = fifo(spark, two, [action(1, "BONUS_ISSUE", 5, shares=3)])
    assert (r.branch, r.reason) == ("merged", "is told to no account") and [x[1] for x in lots(r)] == [D(11), D(22)]
    r = fifo(spark, two, [action(1, "BONUS_ISSUE", 5, shares=3, a=2)])
    assert r.branch == "account" and sorted(x[:2] for x in lots(r)) == [(1, D(10)), (2, D(23))]
    # One holder is the account that is meant.
    sold = [*two, trade(3, "SELL", 10, 5, 4, 1)]
    r = fifo(spark, sold, [action(1, "REVERSE_SPLIT", 5, new_total=8), action(2, "RIGHTS_ISSUE", 6, sub_quantity=2, sub_price=3)])
    assert r.branch == "account" and lots(r) == [(2, D(8), D(140), day(2)), (2, D(2), D(6), day(6))]
    _, held = average(spark, sold, [action(1, "REVERSE_SPLIT", 5, new_total=8), action(2, "RIGHTS_ISSUE", 6, sub_quantity=2, sub_price=3, sub_amount=7)])
    assert held == {2: (D(10), D(147), D(0))}


def test_openings(spark):
    ledger = [trade(1, "BUY", 5, 4, 10, 1), trade(2, "BUY", 1, 1, 11, 2), trade(3, "SELL", 8, 6, 20, 1)]
    opened = [action(1, "OPENING_POSITION", 2, a=1, quantity=6)]
    r = fifo(spark, ledger, opened)
    # The opening is the older lot; its cost is unknown, so the trade's result is an estimate.
    assert r.branch == "account" and [(c.cost, c.estimated, c.first) for c in r.closed] == [(D(8), True, day(2))]
    row, held = average(spark, ledger, opened)
    assert row.branch == "account" and held[1][0] == D(3) and held[1][2] == D(3) and abs(held[1][1] - D(60) / 11) < D("1e-9")
    r = fifo(spark, ledger, [action(1, "OPENING_POSITION", 2, a=2, quantity=6, unit_cost=2)])
    assert r.reason == "sells more than the account has"  # another account's opening doesn't cover this one
    r = fifo(spark, ledger[:1], [action(1, "OPENING_POSITION", 2, a=1, quantity=6, unit_cost=2, total_cost=13)])
    assert [x[1:] for x in lots(r)] == [(D(6), D(13), day(2)), (D(5), D(20), day(10))]


def test_actions_of_a_day_come_before_its_trades(spark):
    r = fifo(spark, [trade(1, "BUY", 10, 5, 1), trade(2, "SELL", 20, 3, 4), trade(3, "BUY", 1, 9, 4)], [action(9, "STOCK_SPLIT", 4, split="1:2"), action(10, "STOCK_SPLIT", 4, split="bad"), action(11, "CASH_DIVIDEND", 4)])
    assert r.skipped == 0 and [x[1:] for x in lots(r)] == [(D(1), D(9), day(4))]  # buys before sells: the older lot goes


def test_positions_asof(spark):
    e = events(spark, [trade(1, "BUY", 10, 5, 1, 1), trade(2, "BUY", 4, 5, 3, 2), trade(3, "SELL", 4, 5, 6, 2)], [action(1, "STOCK_SPLIT", 5, split="1:3")])
    at = lambda n, **k: {(r.account, r.quantity) for r in buckets.positions_asof(e, KEYS, F.lit(day(n)), **k).collect()}
    assert at(0) == set() and at(4) == {(1, D(10)), (2, D(4))} and at(5) == {(1, D(30)), (2, D(12))} and at(5, before=True) == at(4) and at(6) == {(1, D(30)), (2, D(8))}


# --- random ledgers against a plain replay ---


class Contradiction(Exception):
    pass


def order(e):
    kind = e[1]
    return (e[0], {"BUY": 1, "OUT": 2, "IN": 2, "SELL": 3}.get(kind, 0), e[4] if kind == "IN" else e[2], kind == "IN")


def plain(rows, by_account):
    """rows: (day, kind, id, account, link, q, c, num, den) -> (lots by account, closed, skipped)."""
    queues, moving, closed, skipped = {}, {}, [], 0
    total = lambda a: sum((x[0] for x in queues.get(a, [])), D(0))

    def pop(a, q):
        out, queue = [], queues[a]
        while q > 0:
            x = queue[0]
            part = min(q, x[0])
            out.append([part, x[1], x[2], x[3]])
            x[0] -= part
            if not x[0]:
                queue.pop(0)
            q -= part
        return out

    q8 = lambda x: x.quantize(D("1e-8"), "ROUND_HALF_UP")
    for d, kind, id, a, link, q, c, num, den in sorted(rows, key=order):
        if not by_account:
            a = None
            if kind in ("OUT", "IN"):
                continue
        if kind == "BUY":
            queues.setdefault(a, []).append([q, q, c, d])
        elif kind in ("SELL", "OUT"):
            if q > total(a):
                if by_account:
                    raise Contradiction
                skipped += 1
            elif kind == "OUT":
                moving[id] = pop(a, q)
            else:
                got = pop(a, q)
                closed.append((a, d, q, sum(x[2] * x[0] / x[1] for x in got), got[0][3]))
        elif kind == "IN":
            if link not in moving:
                raise Contradiction
            queues[a] = sorted(queues.get(a, []) + moving.pop(link), key=lambda x: x[3])
        elif kind == "OPEN":
            queues.setdefault(a, []).append([q, q, c, d])
            if by_account:
                queues[a].sort(key=lambda x: x[3])
        else:
            holders = [k for k in queues if total(k) > 0]
            targets = holders
            if kind != "RATIO":
                if a is None and len(holders) > 1:
                    raise Contradiction
                targets = [a if a is not None else holders[0] if holders else None]
            if kind == "RIGHTS":
                queues.setdefault(targets[0], []).append([q, q, c, d])
                continue
            for t in targets:
                n = total(t)
                if n > 0:
                    up, down = (num, den) if kind == "RATIO" else (n + q, n) if kind == "ADD" else (q, n)
                    for x in queues[t]:
                        x[0], x[1] = q8(x[0] * up / down), q8(x[1] * up / down)
    if moving:
        raise Contradiction
    return queues, closed, skipped


def random_ledger(rng):
    rows, id = [], 0
    for _ in range(rng.randrange(3, 22)):
        id += 1
        d, a, q = rng.randrange(12), rng.choice([1, 2, 2, None]), D(rng.randrange(1, 40)) / 4
        kind = rng.choice(["BUY", "BUY", "BUY", "SELL", "SELL", "MOVE", "RATIO", "ADD", "TOTAL", "RIGHTS", "OPEN"])
        if kind == "MOVE":
            rows += [(d, "OUT", id, a, None, q, None, None, None)] + [(d, "IN", id + 1, rng.choice([1, 2, 3]), id, q, None, None, None)] * (rng.random() < 0.9)
            id += 1
        else:
            ratio = rng.choice([(D(2), D(1)), (D(13), D(10)), (D(1), D(2)), (D(4), D(3))]) if kind == "RATIO" else (None, None)
            rows.append((d, kind, id, a, None, None if kind == "RATIO" else q, q * 3 + 1 if kind in ("BUY", "SELL", "RIGHTS", "OPEN") else None, *ratio))
    return rows


def test_random_ledgers_equal_a_plain_replay(spark):
    rng = random.Random(11)
    ledgers = {f"k{i}": random_ledger(rng) for i in range(400)}
    flat = [(k, day(d), {"BUY": 1, "OUT": 2, "IN": 2, "SELL": 3}.get(kind, 0), link if kind == "IN" else id, int(kind == "IN"), kind, a, link, q, c, num, den) for k, rows in ledgers.items() for d, kind, id, a, link, q, c, num, den in rows]
    rng.shuffle(flat)
    kinds = f"sym string, d date, place int, id bigint, leg int, kind string, a bigint, link bigint, q {buckets.Q}, c {buckets.C}, num {buckets.Q}, den {buckets.Q}"
    got = {r.sym: r for r in buckets.fifo_by_account(spark.createDataFrame(flat, kinds), KEYS).withColumn("costs", F.transform("lots", buckets.lot_cost)).collect()}
    branches = Counter()
    for k, rows in ledgers.items():
        r = got[k]
        trades = [x for x in rows if x[1] in ("BUY", "SELL", "OUT", "IN")]
        one = len({x[3] for x in trades}) <= 1 and not any(x[1] in ("OUT", "IN") for x in trades)
        try:
            queues, closed, skipped = plain(rows, not one)
            branch = "single" if one else "account"
        except Contradiction:
            queues, closed, skipped = plain(rows, False)
            branch = "merged"
        branches[branch] += 1
        assert (r.branch, r.skipped) == (branch, skipped), k
        want = sorted(((a or 0), day(x[3]), x[0], x[2] * x[0] / x[1]) for a, queue in queues.items() for x in queue if x[0])
        have = sorted((x.a or 0, x.d, x.q, c) for x, c in zip(r.lots, r.costs, strict=True) if x.q)
        assert [x[:3] for x in have] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < D("1e-6") for x, y in zip(have, want, strict=True)), k
        assert [(c.a, c.d, c.q, c.first) for c in r.closed] == [(a, day(d), q, day(f)) for a, d, q, _, f in closed], k
        assert all(abs(c.cost - x[3]) < D("1e-6") for c, x in zip(r.closed, closed, strict=True)), k
    assert min(branches.values()) > 20 and len(branches) == 3
