"""One-to-one matching, notices in force and splits told from restatements: cases by hand and plain replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import matching as mt
from quillstone.operators import restatements as rs
from quillstone.operators import supersession as sp


def day(text):
    return dt.date.fromisoformat(text)


# --- matching ---


def greedy(pairs):
    left, right, out = set(), set(), set()
    for gap, diff, a, b in sorted({(g, d, a, b) for a, b, g, d in pairs}):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b))
    return out


def test_one_to_one_equals_the_greedy_walk(spark):
    rng = random.Random(2)
    # A chain in which every pair waits for the one before it, ties, and dense groups.
    pairs = [(i, i, 0, 1.0 + 2 * i) for i in range(12)] + [(i + 1, i, 0, 2.0 + 2 * i) for i in range(12)]
    pairs += [(100 + rng.randrange(15), 100 + rng.randrange(15), rng.randrange(2), rng.randrange(3) / 4) for _ in range(150)]
    pairs += [pairs[-1], (500, 500, 1, 0.0)]
    df = spark.createDataFrame(pairs, "left_id int, right_id int, gap int, difference double").repartition(3)
    got = mt.one_to_one(df).collect()
    assert {(r.left_id, r.right_id) for r in got} == greedy(pairs) and len(got) == len(greedy(pairs))
    assert mt.one_to_one(df.limit(0)).isEmpty()


def test_near_pairs(spark):
    kinds = "id int, sym string, q int, d date, price double, market string"
    left = spark.createDataFrame([(1, "A", 5, day("2025-01-10"), 10.0, "US"), (2, "A", 5, day("2025-01-10"), 10.0, "CN"), (3, None, 5, day("2025-01-10"), 10.0, "US")], kinds)
    right = spark.createDataFrame([(1, "A", 5, day("2025-01-11"), 10.05, ""), (2, "A", 5, day("2025-01-10"), 10.1, ""), (3, "A", 5, day("2025-01-09"), 11.0, ""), (4, "A", 6, day("2025-01-10"), 10.0, ""), (5, "A", 5, day("2025-01-12"), 10.0, ""), (6, None, 5, day("2025-01-10"), 10.0, ""), (7, "A", 5, None, 10.0, "")], kinds)
    apart = F.abs(F.col("l.price") - F.col("r.price")) / F.col("r.price")
    got = mt.near_pairs(left, right, ["sym", "q"], "d", 1, apart, 0.01, allowed=F.when(F.col("l.market") == "US", 1).otherwise(0))
    assert {(r.left_id, r.right_id, r.gap) for r in got.collect()} == {(1, 1, 1), (1, 2, 0), (2, 2, 0)}
    # Same day first: the second row keeps the nearer one, so the first takes the neighbour.
    assert {(r.left_id, r.right_id) for r in mt.one_to_one(got.where("NOT (left_id = 1 AND right_id = 2)")).collect()} == {(1, 1), (2, 2)}


# --- notices ---

NOTICE = "issuer int, sort_key int, readable boolean, anchor string, basis string, type string, nature string, kind string, year_end date, ex_date date, pending boolean"


def notice(key, kind="new", anchor="2025-06-30", basis="period_end", year_end="2025-12-31", ex="2025-09-01", type="interim", nature="ordinary", pending=False, readable=True, issuer=1):
    return (issuer, key, readable, anchor, basis, type, nature, kind, year_end and day(year_end), ex and day(ex), pending)


def states(spark, *rows):
    return [(r.state, r.reason) for r in sp.resolve(spark.createDataFrame(list(rows), NOTICE)).orderBy("issuer", "sort_key").collect()]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([notice(1), notice(2, "update", ex="2025-09-02")], ["superseded", "current"]),
        ([notice(1), notice(2, "withdrawal")], ["superseded", "withdrawn"]),
        ([notice(1), notice(2, "update", pending=True)], ["superseded", "pending"]),
        ([notice(1), notice(2, readable=False, kind=None, ex=None)], ["superseded", "blocked"]),
        # Final and special dividends of one period are two.
        ([notice(1), notice(2, nature="special")], ["current", "current"]),
        # The period's end isn't given in the update: it may mean the older one.
        ([notice(1), notice(2, "update", anchor="2025-12-31", basis="financial_year")], ["current", "unscoped"]),
        ([notice(1, anchor="2025-12-31", basis="financial_year"), notice(2, "update")], ["current", "unscoped"]),
        ([notice(1, anchor="2025-12-31", basis="financial_year"), notice(2, "update", anchor="2025-12-31", basis="financial_year")], ["superseded", "current"]),
        # Another financial year, or another type, is no conflict.
        ([notice(1, year_end="2024-12-31"), notice(2, "update", anchor="2025-12-31", basis="financial_year")], ["current", "current"]),
        ([notice(1, type="final"), notice(2, "update", anchor="2025-12-31", basis="financial_year")], ["current", "current"]),
        ([notice(1, year_end=None), notice(2, "update", anchor="2025-12-31", basis="financial_year")], ["current", "unscoped"]),
        # Two new ones of one loose name: the same ex-date is a correction, another one may be another dividend.
        ([notice(1, anchor="2025-12-31", basis="financial_year"), notice(2, anchor="2025-12-31", basis="financial_year")], ["superseded", "current"]),
        ([notice(1, anchor="2025-12-31", basis="financial_year"), notice(2, anchor="2025-12-31", basis="financial_year", ex="2025-10-01")], ["current", "unscoped"]),
        ([notice(1), notice(2, ex="2025-10-01")], ["superseded", "current"]),
        ([notice(1), notice(2, "update", anchor=None)], ["current", "unscoped"]),
        ([notice(1), notice(2, readable=False, anchor=None, type=None, nature="")], ["current", "unscoped"]),
        # Issuers don't meddle with each other.
        ([notice(1), notice(2, "withdrawal", issuer=2)], ["current", "withdrawn"]),
    ],
)
def test_notices(spark, rows, want):
    assert [s for s, _ in states(spark, *rows)] == want


def test_blocked_notices_keep_the_days_that_were_seen(spark):
    rows = spark.createDataFrame([notice(1), notice(2, "update", ex="2025-09-03"), notice(3, None, readable=False, ex="2025-09-09")], NOTICE)
    got = sp.resolve(rows).where("state = 'blocked'").first()
    assert got.ex_dates == [day("2025-09-01"), day("2025-09-03")] and sp.resolve(rows.limit(0)).isEmpty()


# --- splits ---


def splits(spark, facts, ratios=()):
    f = spark.createDataFrame([("X", "eps", p, day(filed), float(v)) for p, filed, v in facts], "company string, concept string, period string, filed date, value double")
    r = spark.createDataFrame([("X", day(d), float(x)) for d, x in ratios], "company string, day date, ratio double")
    events = rs.split_events(rs.restated_pairs(f), rs.disclosed(r))
    got = sorted((e.basis, str(e.day or ""), round(e.factor, 4)) for e in events.collect())
    return got, {(x.period, str(x.filed)): round(x.adjusted, 4) for x in rs.adjusted(f, events).collect()}


def test_a_disclosed_split_needs_a_restatement(spark):
    facts = [("2017", "2018-02-01", 10), ("2017", "2019-02-01", 5), ("2018", "2019-02-01", 6)]
    got, adjusted = splits(spark, facts, [("2018-06-30", 2)])
    assert got == [("disclosed", "2018-06-30", 2)] and adjusted == {("2017", "2018-02-01"): 5, ("2017", "2019-02-01"): 5, ("2018", "2019-02-01"): 6}
    assert splits(spark, facts[::2], [("2018-06-30", 2)])[0] == [("unconfirmed", "2018-06-30", 2)]
    # Within a fiftieth, as values are rounded to cents; beyond it, something else happened.
    assert splits(spark, [("2017", "2018-02-01", 12.25), ("2017", "2019-02-01", 1.22)], [("2018-06-30", 10)])[0][0][0] == "disclosed"
    assert splits(spark, [("2017", "2018-02-01", 12.25), ("2017", "2019-02-01", 1.1)], [("2018-06-30", 10)])[0][0][0] == "unconfirmed"


def test_one_split_disclosed_on_several_days(spark):
    got, _ = splits(spark, [("2014", "2015-02-01", 7), ("2014", "2016-02-01", 1)], [("2015-06-23", 7), ("2015-06-30", 7), ("2015-07-14", 7)])
    assert got == [("disclosed", "2015-06-23", 7)]


def test_two_splits_between_two_filings(spark):
    both = [("2016", "2017-02-01", 12), ("2016", "2018-02-01", 2)]
    ratios = [("2017-06-30", 2), ("2017-09-30", 3)]
    # Their product alone tells neither.
    assert [b for b, _, _ in splits(spark, both, ratios)[0]] == ["unconfirmed"] * 2
    # Another filing between them bears the first out, and then the product the second.
    got, adjusted = splits(spark, [*both, ("2015", "2017-02-01", 8), ("2015", "2017-08-01", 4)], ratios)
    assert got == [("disclosed", "2017-06-30", 2), ("disclosed", "2017-09-30", 3)]
    assert adjusted[("2015", "2017-02-01")] == pytest.approx(8 / 6, abs=1e-4) and adjusted[("2015", "2017-08-01")] == pytest.approx(4 / 3, abs=1e-4) and adjusted[("2016", "2018-02-01")] == 2


def test_undisclosed_splits_need_two_periods(spark):
    one = [("2016", "2017-02-01", 20), ("2016", "2018-02-01", 2)]
    two = [*one, ("2015", "2017-02-01", 10), ("2015", "2018-02-01", 1)]
    assert splits(spark, one)[0] == [] and splits(spark, two)[0] == [("restated", "", 10)]
    # Quotients that are no clean factor, corrections and changes of sign tell nothing.
    assert splits(spark, [(p, d, v * (1 if d < "2018" else 0.87)) for p, d, v in two])[0] == []
    assert splits(spark, [("2016", "2017-02-01", 2), ("2016", "2018-02-01", -1), ("2015", "2017-02-01", 3), ("2015", "2018-02-01", 2.5)])[0] == []
    # A filing before the split that is younger than one after it: the two are mixed up.
    assert splits(spark, [*one, ("2015", "2018-03-01", 10), ("2015", "2019-02-01", 1)])[0] == []


def test_a_product_of_known_splits_is_no_third_one(spark):
    facts = [("2014", "2015-02-01", 60), ("2014", "2016-02-01", 30), ("2015", "2016-02-01", 30), ("2015", "2017-02-01", 10), ("2013", "2016-02-01", 18), ("2013", "2017-02-01", 6), ("2012", "2015-02-01", 6), ("2012", "2017-02-01", 1), ("2011", "2015-02-01", 12), ("2011", "2017-02-01", 2), ("2010", "2015-02-01", 4), ("2010", "2016-02-01", 2)]
    got, adjusted = splits(spark, facts)
    assert got == [("restated", "", 2), ("restated", "", 3)] and adjusted[("2012", "2015-02-01")] == 1 == adjusted[("2012", "2017-02-01")]
    got, _ = splits(spark, facts, [("2015-06-30", 2)])
    assert got == [("disclosed", "2015-06-30", 2), ("restated", "", 3)]


def test_reverse_splits_and_nothing(spark):
    got, adjusted = splits(spark, [("2016", "2017-02-01", 1), ("2016", "2018-02-01", 10), ("2015", "2017-02-01", 2), ("2015", "2018-02-01", 20)])
    assert got == [("restated", "", 0.1)] and adjusted[("2016", "2017-02-01")] == 10
    assert splits(spark, [("2016", "2017-02-01", 1)])[0] == []
