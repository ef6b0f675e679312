"""Return curves: figures by hand, and random portfolios against a plain replay day by day."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from compare import difference
from quillstone.operators import curve
from quillstone.plans import curves

EVENT = "u string, symbol string, cur string, d date, place int, id bigint, kind string, q double, c double, num double, den double, p double"
PLACE = {"BUY": 1, "SELL": 3}


def event(symbol, cur, day, kind, q=None, c=None, num=None, den=None, p=None, id=1, u="u"):
    f = lambda x: None if x is None else float(x)
    return (u, symbol, cur, dt.date.fromisoformat(day) if isinstance(day, str) else day, PLACE.get(kind, 0), id, kind, f(q), f(c), f(num), f(den), f(p))


def buy(symbol, cur, day, q, p, fee=0.0, **k):
    return event(symbol, cur, day, "BUY", q, q * p + fee, p=p, **k)


def sell(symbol, cur, day, q, p, fee=0.0, **k):
    return event(symbol, cur, day, "SELL", q, q * p - fee, p=p, **k)


def frames(spark, events, closes, rates=None):
    date = dt.date.fromisoformat
    day = lambda x: date(x) if isinstance(x, str) else x
    return (
        spark.createDataFrame(events, EVENT), spark.createDataFrame([(s, day(d), float(c)) for s, d, c in closes], "symbol string, d date, close double"),
        None if rates is None else spark.createDataFrame([(c, day(d), float(r)) for c, d, r in rates], "cur string, eff date, rate double"),
    )


def run(spark, events, closes, rates=None, **k):
    e, c, r = frames(spark, events, closes, rates)
    return curve.return_curve(e, c, users=["u"], rates=r, **k)


# A year of three securities in three currencies, and what it must come to.
USD, HKD, CNY = "USD", "HKD", "CNY"
LEDGER = [
    buy("AAPL", USD, "2025-01-10", 100, 10, 1), buy("AAPL", USD, "2025-03-01", 50, 12, 1, id=2), sell("AAPL", USD, "2025-06-10", 80, 15, 2, id=3),
    buy("0700", HKD, "2025-02-01", 200, 300, 10), buy("600519", CNY, "2025-04-01", 10, 1500, 5), sell("600519", CNY, "2025-08-01", 5, 1600, 5, id=2),
    event("AAPL", USD, "2025-04-15", "RATIO", num=2, den=1), event("AAPL", USD, "2025-05-20", "DIVIDEND", c=45), event("0700", HKD, "2025-03-10", "RIGHTS", 20, 5000), event("600519", CNY, "2025-05-01", "RATIO", num=12, den=10),
]
RATES = [(USD, "2025-01-01", 7.0), (USD, "2025-06-01", 7.2), (HKD, "2025-01-01", 0.9), (CNY, "2020-01-01", 1.0)]
CLOSES = [
    *[("AAPL", f"2025-{d}", c) for d, c in zip("01-31 02-28 03-31 04-30 05-30 06-30 09-30 12-31".split(), (11, 11.5, 12.5, 6.5, 7, 7.5, 8, 8.2))],
    *[("0700", f"2025-{d}", c) for d, c in zip("01-31 02-28 03-31 06-30 09-30 12-31".split(), (290, 305, 310, 315, 318, 322))],
    *[("600519", f"2025-{d}", c) for d, c in zip("04-30 05-30 06-30 09-30 12-31".split(), (1520, 1280, 1300, 1450, 1560))],
]


def test_a_year_of_three_currencies(spark):
    c = run(spark, LEDGER, CLOSES, RATES, start="2025-01-10", end="2025-12-31").cache()
    assert c.count() == 18
    r = curve.risk(c, ["u"]).first()
    assert (round(100 * r.total, 6), round(100 * r.annual, 6), round(100 * r.volatility, 6), round(100 * r.max_drawdown, 6)) == (36.048508, 37.263148, 31.729362, -12.082237)
    assert (round(r.sharpe, 5), round(r.sortino, 6), round(r.calmar, 6), r.span) == (1.15187, 2.225459, 3.084127, 355)


def test_by_hand(spark):
    days = ["2025-01-01", "2025-01-02", "2025-01-03", "2025-01-04"]
    rows = run(spark, [buy("A", "C", days[0], 100, 10), buy("A", "C", days[2], 100, 11, id=2), sell("A", "C", days[3], 100, 12, id=3)], [("A", d, p) for d, p in zip(days, (10, 11, 12, 12))]).orderBy("d").collect()
    assert [round(r.r, 6) for r in rows] == [0, 0.1, 0.090909, 0] and round(rows[-1].cumulative, 9) == 0.2
    assert [(r.mv, r.opening, r.inflow, r.outflow) for r in rows] == [(1000, 0, 1000, 0), (1100, 1000, 0, 0), (2400, 1100, 1100, 0), (1200, 2400, 0, 1200)]


def test_arrivals_of_unknown_cost_are_no_gain(spark):
    wait = [event("A", "C", "2025-01-01", "OPEN", 10), event("A", "C", "2025-01-02", "RATIO", num=2, den=1), buy("B", "C", "2025-01-01", 1, 100)]
    rows = {str(r.d)[8:]: r for r in run(spark, wait, [("B", "2025-01-01", 100), ("B", "2025-01-03", 100), ("A", "2025-01-03", 7), ("A", "2025-01-04", 14)]).collect()}
    assert rows["01"].unpriced == 1 and rows["02"].inflow == 0 and rows["03"].inflow == 140 and rows["03"].r == 0
    assert rows["04"].pnl == 140 and rows["04"].unpriced == 0
    # A price is there when they come: at once, before the day's own ratio.
    rows = run(spark, [buy("A", "C", "2025-01-01", 1, 5), event("A", "C", "2025-01-02", "OPEN", 10, id=2)], [("A", "2025-01-02", 6)]).orderBy("d").collect()
    assert [(r.inflow, r.mv) for r in rows] == [(5, 5), (60, 66)] and rows[1].pnl == 1


def test_sums_are_exact_in_any_order(spark):
    """Ten tenths make one, and what was sold leaves nothing in the value."""
    events = [buy("A", USD, "2025-01-10", 1, 0.1), buy("B", USD, "2025-01-11", 1, 0.2, id=2), sell("B", USD, "2025-01-12", 1, 0.2, id=3)]
    events += [event("A", USD, "2025-01-13", "DIVIDEND", c=0.1, id=i) for i in range(10, 20)]
    days = {str(r.d): r for r in run(spark, events, [], start="2025-01-10", end="2025-01-13").collect()}
    assert days["2025-01-12"].mv == days["2025-01-13"].mv == 0.1
    assert days["2025-01-13"].outflow == days["2025-01-13"].dividends == 1.0


def test_curve_equals_its_sql_on_ties(spark, sf_dir):
    """On sf0.01 a day's outflow is 6027.05, which a sum of doubles misses by a hair and rounds down."""
    d = sf_dir.rsplit("/", 1)[0] + "/sf0.01"
    assert difference(curves.portfolio_curve(spark, d), curves.ORACLE["portfolio_curve"], d) == ""


@pytest.mark.parametrize("query", ["portfolio_curve", "portfolio_risk", "portfolio_weeks"])
def test_positions_beyond_twelve_digits(spark, tmp_path, query):
    """Fifty ratios of two take six shares to 6 * 2 ** 50, fifty of a half take them back."""
    at = lambda day, second: dt.datetime(2024, 1, day, 9, 0, second)
    events = [(5, at(9, 0), 0, "purchase", 3.0), (10, at(9, 1), 0, "view", 4.0), (65, at(12, 0), 3, "purchase", 5.0)]
    events += [(60 * k, at(14, k), 0, "signup", 1.0) for k in range(1, 51)] + [(60 * k + 30, at(18, k), 0, "signup", 1.0) for k in range(1, 51)]
    events += [(9000 + 5 * day, at(day, 50), 0, "view", (4.0 + day % 3) * (2.0**-50 if 14 <= day < 18 else 1)) for day in range(10, 30)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    d = str(tmp_path)
    sql = curves.ORACLE[query].replace("FROM events", f"FROM '{d}/events.parquet/*.parquet'")
    assert difference(getattr(curves, query)(spark, d), sql, d) == ""
    if query == "portfolio_curve":
        mv = {r.d[8:]: r.mv for r in curves.portfolio_curve(spark, d).where("u = 0").collect()}
        assert mv["13"] == 6 * 5 + 6 * 5 and mv["14"] == mv["20"] == 6 * 6 + 6 * 5


def test_value_keeps_nothing_of_large_positions_that_have_gone(spark):
    ledger = [buy("A", "C", "2025-01-01", 4, 10), buy("B", "C", "2025-01-01", 1, 5, id=2)]
    ledger += [event("A", "C", "2025-01-02", "RATIO", num=2, den=1, id=k) for k in range(3, 403)] + [event("A", "C", "2025-01-03", "RATIO", num=1, den=2, id=k) for k in range(500, 900)]
    rows = run(spark, ledger, [("A", f"2025-01-0{n}", 1) for n in (1, 2, 3)]).orderBy("d").collect()
    assert [r.mv for r in rows] == [9, 4 * 2.0**400, 9] and [r.opening for r in rows] == [0, 9, 4 * 2.0**400]


def test_no_key_is_gathered(spark):
    """A fold over a gathered key copied what it had put out so far at each event: time grew with the square of a key's events."""
    e, _, _ = frames(spark, LEDGER, CLOSES)
    plan = curve.walked(e.withColumn("rate", F.lit(1.0)), ["u", "symbol"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_openings(spark):
    ledger = [buy("A", "C", "2024-12-01", 10, 5), event("A", "C", "2024-12-20", "RATIO", num=2, den=1), buy("B", "C", "2024-12-05", 2, 50), event("Z", "C", "2024-12-06", "OPEN", 3)]
    rows = run(spark, ledger, [("A", "2024-12-10", 6), ("B", "2024-12-05", 60), ("A", "2025-01-02", 3), ("Z", "2025-01-03", 9)], start="2025-01-01", end="2025-01-04").orderBy("d").collect()
    # A's price is older than its split, so it isn't worth anything before the next one; Z waits for its first price.
    assert [str(r.d)[8:] for r in rows] == ["01", "02", "03", "04"] and rows[0].opening == 120 and rows[0].unpriced == 2
    assert rows[1].mv == 180 and rows[2].inflow == 27 and rows[2].r == 0
    # What moved between the opening's rate and that of the first day is a gain.
    rows = run(spark, ledger[2:3], [("B", "2024-12-05", 60)], [("C", "2024-01-01", 1.0), ("C", "2025-01-01", 2.0)], start="2025-01-01", end="2025-01-02", opening_fx="2024-12-31").orderBy("d").collect()
    assert [(r.opening, r.mv) for r in rows] == [(120, 240), (240, 240)]


def test_sells_beyond_what_is_there_are_cut(spark):
    row = run(spark, [buy("A", "C", "2025-01-01", 4, 10), sell("A", "C", "2025-01-01", 16, 10, 4, id=2)], [("A", "2025-01-01", 10)]).first()
    assert (row.outflow, row.mv, row.cut) == (39, 0, 1)


def test_risk_free_series(spark):
    days = ["2025-01-01", "2025-01-02", "2025-01-03", "2025-01-06", "2025-01-09"]
    c = spark.createDataFrame([("u", dt.date.fromisoformat(d), r, f, 0.0) for d, r, f in zip(days, (None, 0.01, -0.02, 0.03, 0.0), (1.0, 1.01, 0.9898, 1.019494, 1.019494))], "u string, d date, r double, factor double, drawdown double")
    series = spark.createDataFrame([(dt.date(2025, 1, 3), 2.0), (dt.date(2025, 1, 8), 4.0)], "published date, rate double")
    got = curve.risk(c, ["u"], series).first()
    x = [0.01, -0.02 - 0.02 * 1 / 365.25, 0.03 - 0.02 * 3 / 365.25, 0.0 - 0.04 * 3 / 365.25]
    m = sum(x) / 4
    sd = math.sqrt(sum((v - m) ** 2 for v in x) / 3)
    up = math.sqrt(365.25 * 4 / 8)
    assert got.missing == 1 and got.risk_free == pytest.approx(8 / 3) and got.sharpe == pytest.approx(m / sd * up)
    assert got.sortino == pytest.approx(m / math.sqrt(sum(min(v, 0) ** 2 for v in x) / 4) * up) and got.calmar is None
    even = curve.risk(c, ["u"], 3.0).first()
    x = [v - 0.03 / (365.25 * 4 / 8) for v in (0.01, -0.02, 0.03, 0.0)]
    assert even.sharpe == pytest.approx(sum(x) / 4 / math.sqrt(sum((v - sum(x) / 4) ** 2 for v in x) / 3) * up)


# --- random portfolios against a plain replay ---


def plain(events, closes, rates, start, end):
    """Day by day, security by security."""
    rate = lambda cur, d: max(((e, r) for c, e, r in rates if c == cur and e <= d), default=(None, None))[1]
    mine = {e[1] for e in events}
    cur = {e[1]: e[2] for e in events}
    price_of = {(s, d): c for s, d, c in closes if s in mine and d <= end}
    by_day = defaultdict(list)
    for e in events:
        by_day[e[3]].append(e)
    pos, last, seen, unknown = defaultdict(float), {}, {}, defaultdict(float)
    for (s, d), c in sorted(price_of.items(), key=lambda x: x[0][1]):
        if d < start:
            last[s], seen[s] = c, d

    def act(e, waits):
        _, s, _, d, _, _, kind, q, _, num, den, _ = e
        f = num / den if kind == "RATIO" else (pos[s] + q) / pos[s] if kind == "ADD" and pos[s] > 0 else q / pos[s] if kind == "TOTAL" and pos[s] > 0 else 1
        pos[s] *= f
        for w in waits:
            w[s] *= f
        if kind in ("RIGHTS", "OPEN"):
            pos[s] += q

    for d in sorted(x for x in by_day if x < start):
        for e in sorted(by_day[d], key=lambda e: (e[4], e[5])):
            s, kind, q = e[1], e[6], e[7]
            if kind in ("BUY", "SELL"):
                if seen.get(s, dt.date.min) < d:
                    last[s], seen[s] = e[11], d
                pos[s] += q if kind == "BUY" else -min(q, pos[s])
            elif kind != "DIVIDEND":
                act(e, [unknown])
                if kind == "OPEN" and e[8] is None:
                    unknown[s] += q
                if seen.get(s, dt.date.min) < d:
                    last.pop(s, None)
                    seen.pop(s, None)
    waiting = defaultdict(float, {s: min(q, pos[s]) for s, q in unknown.items() if pos[s] > 1e-9 and s not in last})
    mv = sum(pos[s] * last[s] * rate(cur[s], start) for s in pos if pos[s] > 0 and s in last)
    days = sorted({d for _, d in price_of if start <= d} | {d for d in by_day if start <= d} | {start, end})
    out = []
    for d in days:
        today = {s: c for (s, x), c in price_of.items() if x == d}
        last.update(today)
        before, cash_in, cash_out = mv, 0.0, 0.0
        for e in sorted(by_day[d], key=lambda e: (e[4], e[5])):
            s, kind, q, c, p = e[1], e[6], e[7], e[8], e[11]
            now = rate(e[2], d)
            if kind == "DIVIDEND":
                cash_out += c * now
            elif kind == "BUY":
                pos[s] += q
                cash_in += c * now
            elif kind == "SELL":
                took = min(q, pos[s])
                pos[s] -= took
                cash_out += c * now * took / q
            else:
                act(e, [waiting])
                if kind == "RIGHTS" or kind == "OPEN" and c is not None:
                    cash_in += c * now
                elif kind == "OPEN":
                    if s in last:
                        cash_in += q * last[s] * now
                    else:
                        waiting[s] += q
            if kind in ("BUY", "SELL") and s not in today:
                last[s] = p
        for s in [s for s in waiting if s in last]:
            cash_in += waiting.pop(s) * last[s] * rate(cur[s], d)
        mv = sum(pos[s] * last[s] * rate(cur[s], d) for s in pos if pos[s] > 0 and s in last)
        base = before + cash_in
        out.append((d, mv, cash_in, cash_out, (mv + cash_out) / base - 1 if base > 1e-9 else None, sum(pos[s] > 1e-9 and s not in last for s in pos)))
    return out


def test_random_portfolios_equal_a_plain_replay(spark):
    rng = random.Random(21)
    first = dt.date(2025, 1, 1)
    day = lambda n: first + dt.timedelta(n)
    closes = [(f"S{s}", day(n), float(rng.randrange(5, 40))) for s in range(5) for n in range(-10, 25) if rng.random() < (0.5 if s else 0.05)]
    rates = [("C0", day(-40), 1.0), ("C1", day(-40), 7.0), ("C1", day(-3), 7.5), ("C1", day(6), 6.5), ("C1", day(13), 8.0)]
    events = []
    for u in range(12):
        for id in range(rng.randrange(8, 30)):
            s, n = rng.randrange(5), rng.randrange(-10, 22)
            cur, kind = f"C{s % 2}", rng.choice(["BUY", "BUY", "BUY", "SELL", "SELL", "RATIO", "ADD", "TOTAL", "RIGHTS", "OPEN", "OPEN", "DIVIDEND"])
            q, p = float(rng.randrange(1, 30)), float(rng.randrange(5, 40))
            money = {"BUY": q * p + 1, "SELL": q * p - 1, "RIGHTS": q * 2, "OPEN": rng.choice([None, q * 3]), "DIVIDEND": rng.choice([5.0, -2.0])}.get(kind)
            num, den = rng.choice([(2.0, 1.0), (1.0, 2.0), (13.0, 10.0)]) if kind == "RATIO" else (None, None)
            events.append(event(f"S{s}", cur, day(n), kind, None if kind in ("RATIO", "DIVIDEND") else q, money, num, den, p if kind in ("BUY", "SELL") else None, id=id, u=f"u{u}"))
    # Two arrivals beside an action of the same day would need the place of each among the others.
    busy = {(e[0], e[1], e[3]) for e in events if e[6] in ("RATIO", "ADD", "TOTAL")}
    events = [e for e in events if not (e[6] == "OPEN" and (e[0], e[1], e[3]) in busy)]
    got = defaultdict(list)
    for r in run(spark, events, closes, rates, start="2025-01-01", end="2025-01-20").collect():
        got[r.u].append((r.d, r.mv, r.inflow, r.outflow, r.r, r.unpriced))
    waits = 0
    for u in sorted(got):
        want = plain([e for e in events if e[0] == u and e[3] <= dt.date(2025, 1, 20)], closes, rates, dt.date(2025, 1, 1), dt.date(2025, 1, 20))
        have = sorted(got[u])
        assert [x[0] for x in have] == [x[0] for x in want], u
        for h, x in zip(have, want, strict=True):
            assert h[1:4] == pytest.approx(x[1:4], abs=1e-4) and h[5] == x[5], (u, h, x)
            assert (h[4] is None) == (x[4] is None) or abs(x[1]) < 1e-4
            assert h[4] is None or x[4] is None or h[4] == pytest.approx(x[4], abs=1e-5)
        waits += sum(x[5] > 0 for x in want)
    assert len(got) == 12 and waits > 0


def test_no_grid_in_the_plan(spark):
    e, c, r = frames(spark, LEDGER, CLOSES, RATES)
    plan = curve.return_curve(e, c, users=["u"], rates=r, start="2025-01-10", end="2025-12-31")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert curve.return_curve(e.limit(0), c, users=["u"], rates=r, start="2025-01-10").select(F.count("*")).first()[0] == 0
