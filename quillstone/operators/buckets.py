"""Replays of trades, transfers and corporate actions by account: FIFO lots and average cost, in decimals.

Events of a key (one security of one user) are folded inside the JVM, in the order of ``ordered``.  The state is the
open lots, or the balances, of all accounts in one array, each with its account; shares on their way from one account
to another stand there under their transfer's id.  A contradiction (an account gives more than it has, an absolute
action that can't be told to one account, half a transfer) sets ``error`` and ends that replay; the key is then
replayed as one bucket, in which transfers change nothing and a sell of more than there is gets skipped whole.

Quantities, costs and shares of costs stay decimals from the first event to the last.  A lot keeps the quantity and
the cost that it began with, and what is left of it; parts of its cost come from these alone, so a lot that is sold in
pieces doesn't drift.  An absolute action rounds each lot at eight digits, so lots may add up to a hair less or more than
it says: FIFO lets a sell or transfer be ``SLACK`` more than the lots hold, and an account whose lots are no larger than
``DUST`` holds nothing that an absolute action could be told to.  A key's events are one array in one task: as long as one security of one user has few enough.

Kinds of events: BUY (q, c paid), SELL (q, c received), OUT and IN (q, ``link`` of IN: the id of its OUT), and from
actions RATIO (every account's shares times num / den), ADD (q shares on those held), TOTAL (q shares in place of
those held), RIGHTS (q, c) and OPEN (q, c null: unknown).  Transfers of nothing are no events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import BONUS, SPLIT, opening_lot, rights_lot
from ..functions.scalars import ratio_parts, ratio_text

# Types of quantities, costs, shares of a lot (up to 1) and results.
Q, C, R, RESULT = "DECIMAL(20,8)", "DECIMAL(24,8)", "DECIMAL(19,18)", "DECIMAL(30,12)"
LOT = f"STRUCT<a: BIGINT, d: DATE, q: {Q}, q0: {Q}, c0: {C}, known: BOOLEAN, moving: BIGINT>"
CLOSED = f"STRUCT<a: BIGINT, d: DATE, q: {Q}, proceeds: {C}, cost: {RESULT}, first: DATE, estimated: BOOLEAN>"
FIFO = f"STRUCT<lots: ARRAY<{LOT}>, closed: ARRAY<{CLOSED}>, skipped: INT, error: STRING>"
BALANCE = f"STRUCT<a: BIGINT, q: {Q}, c: {RESULT}, unknown: {Q}, moving: BIGINT>"
AVERAGE = f"STRUCT<buckets: ARRAY<{BALANCE}>, error: STRING>"
EVENT = ["d", "place", "id", "leg", "kind", "a", "link", "q", "c", "num", "den"]
# Shares that rounding may take from lots, or leave in them.
SLACK, DUST = "0.000001BD", "0.0000001BD"


def trade_events(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Events of trades: keys, id, a (account), side (BUY, SELL, OUT, IN), link, qty, price, fee, trade_date; ``amount`` in place of price times quantity if it is there."""
    price = F.col("amount") if "amount" in trades.columns else F.col("qty").cast(Q) * F.col("price").cast("decimal(18,8)")
    fee = F.coalesce(F.col("fee"), F.lit(0))
    cost = F.when(F.col("side") == "BUY", price + fee).when(F.col("side") == "SELL", price - fee)
    moves = F.col("side").isin("OUT", "IN")
    pair = F.when(F.col("side") == "IN", F.coalesce("link", "id")).otherwise(F.col("id"))
    place = F.when(F.col("side") == "BUY", 1).when(moves, 2).otherwise(3)
    return trades.where(~(moves & (F.col("qty") == 0))).select(
        *keys, F.col("trade_date").alias("d"), place.alias("place"), pair.cast("bigint").alias("id"), (F.col("side") == "IN").cast("int").alias("leg"), F.col("side").alias("kind"),
        F.col("a").cast("bigint").alias("a"), F.col("link").cast("bigint").alias("link"), F.col("qty").cast(Q).alias("q"), cost.cast(C).alias("c"), F.lit(None).cast(Q).alias("num"), F.lit(None).cast(Q).alias("den"),
    )


def action_events(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Events of actions: keys, id, a (account or null), kind, ex_date, distribution, shares, split, new_total, sub_quantity, sub_price, sub_amount, quantity, unit_cost, total_cost.

    A ratio that can be read comes before an absolute number; actions that say nothing readable are no events.
    """
    kind = F.col("kind")
    bonus, parted = ratio_parts(ratio_text(F.col("distribution"))), ratio_parts(ratio_text(F.col("split")))
    ratio = F.when(kind.isin(BONUS), F.struct((bonus["first"] + bonus["second"]).cast(Q).alias("num"), bonus["first"].cast(Q).alias("den"))).when(kind.isin(SPLIT), F.struct(parted["second"].cast(Q).alias("num"), parted["first"].cast(Q).alias("den")))
    by_ratio = ratio["den"].isNotNull()
    added = kind.isin(BONUS) & (F.col("shares") != 0)
    total = kind.isin(SPLIT) & F.col("new_total").isNotNull()
    opening, rights = opening_lot(kind, F.col("quantity"), F.col("total_cost"), F.col("unit_cost")), rights_lot(kind, F.col("sub_quantity"), F.col("sub_price"), F.col("sub_amount"))
    what = F.when(by_ratio, "RATIO").when(added, "ADD").when(total, "TOTAL").when(opening["quantity"].isNotNull(), "OPEN").when(rights["quantity"].isNotNull(), "RIGHTS")
    q = F.when(what == "ADD", F.col("shares")).when(what == "TOTAL", F.col("new_total")).when(what == "OPEN", opening["quantity"]).when(what == "RIGHTS", rights["quantity"])
    c = F.when(what == "OPEN", opening["cost"]).when(what == "RIGHTS", rights["cost"])
    return actions.select(
        *keys, F.col("ex_date").alias("d"), F.lit(0).alias("place"), F.col("id").cast("bigint").alias("id"), F.lit(0).alias("leg"), what.alias("kind"), F.col("a").cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("link"),
        q.cast(Q).alias("q"), c.cast(C).alias("c"), ratio["num"].alias("num"), ratio["den"].alias("den"),
    ).where("kind IS NOT NULL")


def ordered(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ``events`` (actions first of a day, then buys, transfers pair by pair, sells), ``one``: whether all trades are of one account and none is a transfer."""
    trade = F.col("place") > 0
    spread = (F.min(F.when(trade, F.col("a"))) != F.max(F.when(trade, F.col("a")))) | (F.count_if(trade & F.col("a").isNull()).between(1, F.count_if(trade) - 1))
    return events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*EVENT))).alias("events"), (~F.coalesce(spread, F.lit(False)) & (F.count_if(F.col("place") == 2) == 0)).alias("one"))


def struct(kind: str, **values: str) -> str:
    return f"CAST(named_struct({', '.join(f'{k!r}, {v}' for k, v in values.items())}) AS {kind})"


def changed(row: str, kind: str, fields: str, **values: str) -> str:
    """The struct with other values in some fields."""
    return struct(kind, **{f: values.get(f, f"{row}.{f}") for f in fields.split()})


LOT_FIELDS, CLOSED_FIELDS, FIFO_FIELDS = "a d q q0 c0 known moving", "a d q proceeds cost first estimated", "lots closed skipped error"
BALANCE_FIELDS, AVERAGE_FIELDS = "a q c unknown moving", "buckets error"


def let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def held(rows: str, account: str) -> str:
    return f"aggregate({rows}, CAST(0 AS {Q}), (n, h) -> IF(h.moving IS NULL AND h.a <=> {account}, CAST(n + h.q AS {Q}), n))"


def holders(rows: str) -> str:
    return f"array_distinct(transform(filter({rows}, h -> h.moving IS NULL AND h.q > {DUST}), h -> h.a))"


def times(value: str, num: str, den: str, kind: str = Q) -> str:
    return f"CAST(CAST({value} * {num} AS DECIMAL(28,10)) / {den} AS {kind})"


#: The account of an absolute action: its own, else the only holder, else none; more holders contradict.
TARGET = "coalesce(e.a, IF(size(w) = 1, w[0], NULL))"
UNTOLD = "(e.a IS NULL AND size(w) > 1)"


def fifo_step(strict: bool) -> str:
    lot = lambda account, known="true", cost="e.c": struct(LOT, a=account, d="e.d", q="e.q", q0="e.q", c0=cost, known=known, moving="NULL")
    state = lambda **v: changed("s", FIFO, FIFO_FIELDS, **v)
    error = lambda text: state(error=f"'{text}'")
    cost = lambda lots: f"aggregate({lots}, CAST(0 AS {RESULT}), (n, x) -> CAST(n + CAST(x.c0 * CAST(IF(x.q0 = 0, 1, x.q / x.q0) AS {R}) AS {RESULT}) AS {RESULT}))"
    # Lots of the account are cut from the front until the quantity is there.
    left, rest = "CAST(t.left - least(x.q, t.left) AS DECIMAL(20,8))", f"IF(x.q > t.left, concat(t.kept, array({changed('x', LOT, LOT_FIELDS, q='x.q - t.left')})), t.kept)"
    kind = f"STRUCT<left: {Q}, kept: ARRAY<{LOT}>, out: ARRAY<{LOT}>>"
    start = struct(kind, left="e.q", kept="array()", out="array()")
    piece = struct(kind, left=left, kept=rest, out=f"concat(t.out, array({changed('x', LOT, LOT_FIELDS, q='least(x.q, t.left)')}))")
    passed = struct(kind, left="t.left", kept="concat(t.kept, array(x))", out="t.out")
    cut = f"aggregate(s.lots, {start}, (t, x) -> IF(x.moving IS NULL AND x.a <=> e.a AND t.left > 0, {piece}, {passed}))"
    by_date = lambda lots: f"concat(filter({lots}, x -> NOT (x.moving IS NULL AND x.a <=> e.a)), array_sort(filter({lots}, x -> x.moving IS NULL AND x.a <=> e.a), (l, r) -> CASE WHEN l.d < r.d THEN -1 WHEN l.d > r.d THEN 1 ELSE 0 END))"
    closed = struct(CLOSED, a="e.a", d="e.d", q="e.q", proceeds="e.c", cost=cost("k.out"), first="IF(size(k.out) > 0, k.out[0].d, NULL)", estimated="exists(k.out, x -> NOT x.known)")
    sold = let(cut, "k", state(lots="k.kept", closed=f"concat(s.closed, array({closed}))"))
    gone = let(cut, "k", state(lots=f"concat(k.kept, transform(k.out, x -> {changed('x', LOT, LOT_FIELDS, moving='e.id')}))"))
    come = state(lots=by_date(f"concat(filter(s.lots, x -> NOT (x.moving <=> e.link)), transform(filter(s.lots, x -> x.moving <=> e.link), x -> {changed('x', LOT, LOT_FIELDS, a='e.a', moving='NULL')}))"))
    scaled = lambda test, num, den: state(lots=f"transform(s.lots, x -> IF(x.moving IS NULL AND {test}, {changed('x', LOT, LOT_FIELDS, q=times('x.q', num, den), q0=times('x.q0', num, den))}, x))")
    opened = f"concat(s.lots, array({lot('e.a', 'e.c IS NOT NULL', 'coalesce(e.c, 0)')}))"
    changed_total = scaled("x.a <=> y.a", "IF(e.kind = 'ADD', n + e.q, e.q)", "n")
    absolute = let(held("s.lots", "y.a"), "n", f"IF(n > {DUST}, {changed_total}, s)")
    rights = state(lots=f"concat(s.lots, array({lot('y.a')}))")
    told = let(f"named_struct('a', {TARGET})", "y", f"IF(e.kind = 'RIGHTS', {rights}, {absolute})")
    short = error("sells more than the account has") if strict else state(skipped="s.skipped + 1")
    over = f"e.q > {held('s.lots', 'e.a')} + {SLACK}"
    return f"""CASE WHEN s.error IS NOT NULL THEN s
        WHEN e.kind = 'BUY' THEN {state(lots=f"concat(s.lots, array({lot('e.a')}))")}
        WHEN e.kind = 'SELL' THEN IF({over}, {short}, {sold})
        WHEN e.kind = 'OUT' THEN IF({over}, {error("moves more than the account has")}, {gone})
        WHEN e.kind = 'IN' THEN IF(exists(s.lots, x -> x.moving <=> e.link AND e.link IS NOT NULL), {come}, {error("arrives without having left")})
        WHEN e.kind = 'RATIO' THEN {scaled("true", "e.num", "e.den")}
        WHEN e.kind = 'OPEN' THEN {state(lots=by_date(opened) if strict else opened)}
        ELSE {let(holders("s.lots"), "w", f"IF({UNTOLD}, {error('is told to no account')}, {told})")} END"""


def average_step() -> str:
    state = lambda buckets: changed("s", AVERAGE, AVERAGE_FIELDS, buckets=buckets)
    error = lambda text: changed("s", AVERAGE, AVERAGE_FIELDS, error=f"'{text}'")
    new = lambda account: struct(BALANCE, a=account, q="0", c="0", unknown="0", moving="NULL")
    there = lambda account: f"IF(exists(s.buckets, x -> x.moving IS NULL AND x.a <=> {account}), s.buckets, concat(s.buckets, array({new(account)})))"
    each = lambda account, **v: f"transform({there(account)}, x -> IF(x.moving IS NULL AND x.a <=> {account}, {changed('x', BALANCE, BALANCE_FIELDS, **v)}, x))"
    grown = lambda account, cost="e.c", **v: state(each(account, q="x.q + e.q", c=f"x.c + {cost}", **v))
    rest = "x.q - e.q"
    part = f"CAST((x.q - e.q) / x.q AS {R})"
    kept = f"IF(x.q > e.q, CAST(x.c * {part} AS {RESULT}), 0)"
    sold = state(each("e.a", q=rest, c=kept, unknown="least(x.unknown, x.q - e.q)"))
    # What leaves takes its share of cost and of unknown cost with it.
    share = f"CAST(e.q / b.q AS {R})"
    moved = let("filter(s.buckets, x -> x.moving IS NULL AND x.a <=> e.a)[0]", "b", struct(BALANCE, a="e.a", q="e.q", c=f"CAST(b.c * {share} AS {RESULT})", unknown=f"CAST(b.unknown * {share} AS {Q})", moving="e.id"))
    gone = let(moved, "m", state(f"concat({each('e.a', q=rest, c='IF(x.q > e.q, x.c - m.c, 0)', unknown='IF(x.q > e.q, x.unknown - m.unknown, 0)')}, array(m))"))
    come = let("filter(s.buckets, x -> x.moving <=> e.link)[0]", "m", state(f"filter({each('e.a', q='x.q + m.q', c='x.c + m.c', unknown='x.unknown + m.unknown')}, x -> NOT (x.moving <=> e.link))"))
    scaled = lambda test, num, den: state(f"transform(s.buckets, x -> IF(x.moving IS NULL AND x.q > 0 AND {test}, {changed('x', BALANCE, BALANCE_FIELDS, q=times('x.q', num, den), unknown=times('x.unknown', num, den))}, x))")
    absolute = scaled("x.a <=> y.a", "IF(e.kind = 'ADD', x.q + e.q, e.q)", "x.q")
    short = lambda text: f"e.q > {held('s.buckets', 'e.a')}, {error(text)}"
    named = f"named_struct('a', {TARGET})"
    told = let(named, "y", f"IF(e.kind = 'RIGHTS', {grown('y.a')}, {absolute})")
    return f"""CASE WHEN s.error IS NOT NULL THEN s
        WHEN e.kind = 'BUY' THEN {grown("e.a")}
        WHEN e.kind = 'SELL' THEN IF({short("sells more than the account has")}, {sold})
        WHEN e.kind = 'OUT' THEN IF({short("moves more than the account has")}, {gone})
        WHEN e.kind = 'IN' THEN IF(exists(s.buckets, x -> x.moving <=> e.link AND e.link IS NOT NULL), {come}, {error("arrives without having left")})
        WHEN e.kind = 'RATIO' THEN {scaled("true", "e.num", "e.den")}
        WHEN e.kind = 'OPEN' THEN {grown("e.a", "coalesce(e.c, 0)", unknown="IF(e.c IS NULL, x.unknown + e.q, x.unknown)")}
        ELSE {let(holders("s.buckets"), "w", f"IF({UNTOLD}, {error('is told to no account')}, {told})")} END"""


#: The events as one bucket's: without accounts and transfers.
TOGETHER = "transform(filter(events, e -> e.place <> 2), e -> named_struct({}))".format(", ".join(f"'{f}', {'CAST(NULL AS BIGINT)' if f == 'a' else 'e.' + f}" for f in EVENT))


def fold(events: str, start: str, step: str, rows: str) -> Column:
    left = f"IF(s.error IS NULL AND exists(s.{rows}, x -> x.moving IS NOT NULL), 'leaves without arriving', s.error)"
    fields = FIFO_FIELDS if rows == "lots" else AVERAGE_FIELDS
    return F.expr(f"aggregate({events}, {start}, (s, e) -> {step}, s -> {changed('s', FIFO if rows == 'lots' else AVERAGE, fields, error=left)})")


def chosen(folded: DataFrame, keys: list[str], fields: str) -> DataFrame:
    """The account branch where it holds, else the merged one; ``reason`` says what contradicted."""
    apart = ~F.col("one") & F.col("apart.error").isNull()
    branch = F.when(F.col("one"), "single").when(apart, "account").otherwise("merged")
    return folded.select(*keys, branch.alias("branch"), F.when(~F.col("one"), F.col("apart.error")).alias("reason"), *[F.when(apart, F.col(f"apart.{f}")).otherwise(F.col(f"merged.{f}")).alias(f) for f in fields.split()])


def fifo_by_account(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, branch (single, account, merged), reason, open ``lots``, ``closed`` trades and ``skipped`` sells.

    One account without transfers is replayed as one bucket; else by account, and as one bucket if that contradicts.
    An opening position takes its place among its account's lots by date; others stand in the order of events.
    """
    start = struct(FIFO, lots="array()", closed="array()", skipped="0", error="NULL")
    rows = ordered(events, keys).withColumn("apart", F.when(~F.col("one"), fold("events", start, fifo_step(True), "lots")))
    rows = rows.withColumn("merged", F.when(F.col("one") | F.col("apart.error").isNotNull(), fold(TOGETHER, start, fifo_step(False), "lots")))
    return chosen(rows, keys, "lots closed skipped")


def average_by_account(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, branch (account, merged), reason, ``buckets`` (account, quantity, cost, quantity of unknown cost) and ``error``.

    Always by account first.  ``error`` is what contradicts even in one bucket: records are missing there.
    """
    start = struct(AVERAGE, buckets="array()", error="NULL")
    rows = ordered(events, keys).withColumn("one", F.lit(False)).withColumn("apart", fold("events", start, average_step(), "buckets"))
    rows = rows.withColumn("merged", F.when(F.col("apart.error").isNotNull(), fold(TOGETHER, start, average_step(), "buckets")))
    return chosen(rows, keys, "buckets error")


def lot_cost(lot: Column) -> Column:
    """What is left of a lot's cost."""
    share = F.when(lot["q0"] == 0, 1).otherwise(lot["q"] / lot["q0"]).cast(R)
    return (lot["c0"] * share).cast(RESULT)


def positions_asof(events: DataFrame, keys: list[str], day: Column, *, before: bool = False) -> DataFrame:
    """keys, branch, reason and one row for each account that holds shares on ``day`` (``before``: ahead of its events): ``account``, ``quantity``, ``cost``, ``unknown``."""
    upto = events.where(F.col("d") < day if before else F.col("d") <= day)
    out = average_by_account(upto, keys).where("error IS NULL").select(*keys, "branch", "reason", F.explode("buckets").alias("b"))
    return out.where("b.q <> 0").select(*keys, "branch", "reason", F.col("b.a").alias("account"), F.col("b.q").alias("quantity"), F.col("b.c").alias("cost"), F.col("b.unknown").alias("unknown"))
