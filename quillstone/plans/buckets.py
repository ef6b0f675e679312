"""Replays by account, with transfers and corporate actions, over the ledger; and the SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import buckets as bk
from .performance import cents
from .star import KEY, ORDER, ORDER_SQL, TRADES_SQL, dbl, trades

#: Fields of the actions that stand in place of some trades, as expressions that Spark and SQL read alike; k tells the kind.
_ACTION = {
    "kind": "CASE k WHEN 0 THEN 'STOCK_DIVIDEND' WHEN 1 THEN 'STOCK_SPLIT' WHEN 2 THEN 'BONUS_ISSUE' WHEN 3 THEN 'RIGHTS_ISSUE' WHEN 4 THEN 'OPENING_POSITION' WHEN 5 THEN 'REVERSE_SPLIT' ELSE 'REVERSE_SPLIT' END",
    "distribution": "CASE k WHEN 0 THEN '10:3' END",
    "split": "CASE k WHEN 1 THEN '1:2' WHEN 6 THEN '2:1' END",
    "shares": "CASE k WHEN 2 THEN CAST(5 AS DECIMAL(18,8)) END",
    "new_total": "CASE k WHEN 5 THEN CAST(40 AS DECIMAL(18,8)) END",
    "sub_quantity": "CASE k WHEN 3 THEN CAST(qty AS DECIMAL(18,8)) END",
    "sub_price": "CASE k WHEN 3 THEN CAST(7 AS DECIMAL(18,8)) END",
    "sub_amount": "CASE WHEN k = 3 AND line % 2 = 0 THEN CAST(qty * 7 + 1 AS DECIMAL(18,8)) END",
    "quantity": "CASE k WHEN 4 THEN CAST(qty AS DECIMAL(18,8)) END",
    "unit_cost": "CASE WHEN k = 4 AND line % 3 = 1 THEN CAST(3 AS DECIMAL(18,8)) END",
    "total_cost": "CASE WHEN k = 4 AND line % 3 = 2 THEN CAST(gross AS DECIMAL(18,8)) END",
}
_DAY = "1998-06-30"


def numbered(spark: SparkSession, d: str) -> DataFrame:
    account = F.when(F.col("supplier") % 13 == 0, F.lit(None)).otherwise(F.col("account_id"))
    t = trades(spark, d).withColumn("id", F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)).cast("bigint"))
    return t.withColumn("a", account).withColumn("k", F.when(F.col("order_id") % 11 == 0, F.floor(F.col("order_id") / 11) % 7))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events: every eleventh order is an action, sells of line 7 move to the next account, all others trade."""
    t = numbered(spark, d)
    plain = t.where("k IS NULL").withColumn("amount", F.col("gross")).withColumn("link", F.lit(None).cast("bigint"))
    moves = (F.col("side") == "SELL") & (F.col("line") == 7)
    stays = plain.where(~moves)
    legs = F.inline(F.array(F.struct(F.lit("OUT").alias("leg_side"), F.col("a").alias("leg_a"), F.lit(None).cast("bigint").alias("leg_link"), F.col("id").alias("leg_id")), F.struct(F.lit("IN").alias("leg_side"), ((F.coalesce("a", F.lit(0)) + 1) % 3).alias("leg_a"), F.col("id").alias("leg_link"), (F.col("id") + 100_000).alias("leg_id"))))
    moved = plain.where(moves).select(*plain.columns, legs).withColumns({"side": F.col("leg_side"), "a": F.col("leg_a"), "link": F.col("leg_link"), "id": F.col("leg_id")})
    given = t.where("k IS NOT NULL").select(*KEY, "id", F.when(F.col("line") % 2 == 0, F.col("a")).alias("a"), F.col("trade_date").alias("ex_date"), *[F.expr(e).alias(n) for n, e in _ACTION.items()])
    both = stays.unionByName(moved.select(*stays.columns))
    return bk.trade_events(both, KEY).unionByName(bk.action_events(given, KEY))


def fifo_accounts(spark: SparkSession, d: str) -> DataFrame:
    """FIFO of each security with transfers and actions: by account, or as one bucket where that contradicts."""
    f = bk.fifo_by_account(ledger(spark, d), KEY)
    add = lambda rows, value: F.aggregate(rows, F.lit(0).cast("decimal(38,12)"), lambda s, x: (s + value(x)).cast("decimal(38,12)"))
    return f.select(
        "user_id", "symbol", "branch", "reason", "skipped", F.size("closed").alias("closed"), F.size(F.filter("closed", lambda c: c["estimated"])).alias("estimated"),
        cents(add("closed", lambda c: c["proceeds"] - c["cost"])).alias("realised"), cents(add("closed", lambda c: c["cost"])).alias("sold_cost"),
        dbl(add("lots", lambda x: x["q"]).cast("decimal(28,7)")).alias("open_qty"), cents(add("lots", bk.lot_cost)).alias("open_cost"),
    )


def fifo_account_lots(spark: SparkSession, d: str) -> DataFrame:
    """Open lots of the securities that are replayed by account: shares, cost and days by account."""
    lots = bk.fifo_by_account(ledger(spark, d), KEY).where("branch = 'account'").select(*KEY, F.explode("lots").alias("x")).where("x.q > 0")
    return lots.groupBy("user_id", F.coalesce("x.a", F.lit(-1)).alias("account"), F.year("x.d").alias("year")).agg(F.count("*").alias("lots"), cents(F.sum("x.q")).alias("qty"), F.count_if(~F.col("x.known")).alias("unknown"))


def account_balances(spark: SparkSession, d: str) -> DataFrame:
    """Average cost of each security by account, or as one bucket; what contradicts even there holds nothing."""
    b = bk.average_by_account(ledger(spark, d), KEY)
    add = lambda value: F.aggregate("buckets", F.lit(0).cast("decimal(38,12)"), lambda s, x: (s + value(x)).cast("decimal(38,12)"))
    return b.select("user_id", "symbol", "branch", "reason", "error", F.size(F.filter("buckets", lambda x: x["q"] > 0)).alias("accounts"), dbl(add(lambda x: x["q"]).cast("decimal(28,7)")).alias("qty"), cents(add(lambda x: x["c"])).alias("cost"), cents(add(lambda x: x["unknown"])).alias("unknown"))


def positions_with_actions(spark: SparkSession, d: str) -> DataFrame:
    """What each account holds at the end of a day, actions of the time counted in."""
    p = bk.positions_asof(ledger(spark, d), KEY, F.lit(_DAY).cast("date"))
    return p.groupBy("user_id", "branch", F.coalesce("account", F.lit(-1)).alias("account")).agg(F.count("*").alias("n"), cents(F.sum("quantity")).alias("qty"))


def entitlement_with_actions(spark: SparkSession, d: str) -> DataFrame:
    """Who is entitled ahead of a day's events: shares by security, and the account if it is the only holder."""
    p = bk.positions_asof(ledger(spark, d), KEY, F.lit(_DAY).cast("date"), before=True)
    g = p.groupBy("user_id", "symbol").agg(F.count("*").alias("holders"), cents(F.sum("quantity")).alias("qty"), F.max(F.coalesce("account", F.lit(-1))).alias("account"))
    return g.select("user_id", "symbol", "holders", "qty", F.when(F.col("holders") == 1, F.col("account")).alias("sole_holder"))


QUERIES = {
    "fifo_accounts": fifo_accounts, "fifo_account_lots": fifo_account_lots, "account_balances": account_balances,
    "positions_with_actions": positions_with_actions, "entitlement_with_actions": entitlement_with_actions,
}

# Accounts in SQL: -1 stands for none.
_F = ", ".join(f"{e} AS {n}" for n, e in _ACTION.items())
_EVENTS = TRADES_SQL + f""",
 n AS (SELECT *, CASE WHEN order_id % 11 = 0 THEN (order_id // 11) % 7 END AS k, CASE WHEN supplier % 13 = 0 THEN -1 ELSE account_id END AS a, row_number() OVER (PARTITION BY user_id, symbol ORDER BY {ORDER_SQL}) AS id FROM trades),
 pick AS (SELECT user_id, symbol, id, CASE WHEN line % 2 = 0 THEN a ELSE -1 END AS a, trade_date, {_F} FROM n WHERE k IS NOT NULL),
 ev AS (
  SELECT user_id, symbol, trade_date AS d, 0 AS place, id, 0 AS leg, CASE WHEN distribution IS NOT NULL OR split IS NOT NULL THEN 'RATIO' WHEN shares IS NOT NULL THEN 'ADD' WHEN new_total IS NOT NULL THEN 'TOTAL' WHEN kind = 'RIGHTS_ISSUE' THEN 'RIGHTS' ELSE 'OPEN' END AS kind, a, 0 AS link,
   CAST(COALESCE(shares, new_total, sub_quantity, quantity) AS DOUBLE) AS q, CAST(CASE kind WHEN 'RIGHTS_ISSUE' THEN COALESCE(sub_amount, sub_quantity * 7) WHEN 'OPENING_POSITION' THEN COALESCE(total_cost, quantity * 3 + 0 * unit_cost) END AS DOUBLE) AS c,
   CASE WHEN distribution IS NOT NULL THEN 1.3 WHEN split = '1:2' THEN 2.0 WHEN split = '2:1' THEN 0.5 END::DOUBLE AS num FROM pick
  UNION ALL SELECT user_id, symbol, trade_date, CASE side WHEN 'BUY' THEN 1 ELSE 3 END, id, 0, side, a, 0, CAST(qty AS DOUBLE), CAST(CASE side WHEN 'BUY' THEN gross + fee ELSE gross - fee END AS DOUBLE), NULL FROM n WHERE k IS NULL AND NOT (side = 'SELL' AND line = 7)
  UNION ALL SELECT user_id, symbol, trade_date, 2, id, leg, CASE leg WHEN 0 THEN 'OUT' ELSE 'IN' END, CASE leg WHEN 0 THEN a ELSE (greatest(a, 0) + 1) % 3 END, id, CAST(qty AS DOUBLE), NULL, NULL FROM n, (VALUES (0), (1)) v(leg) WHERE k IS NULL AND side = 'SELL' AND line = 7)"""
_RUNS = """,
 one AS (SELECT user_id, symbol, count(DISTINCT a) FILTER (place > 0) <= 1 AND count(*) FILTER (place = 2) = 0 AS one FROM ev GROUP BY ALL),
 evs AS (SELECT user_id, symbol, true AS strict, d, id, kind, a, link, q, c, num, row_number() OVER (PARTITION BY user_id, symbol ORDER BY d, place, id, leg) AS rn FROM ev
  UNION ALL SELECT user_id, symbol, false, d, id, kind, -1, link, q, c, num, row_number() OVER (PARTITION BY user_id, symbol ORDER BY d, place, id, leg) FROM ev WHERE place <> 2)"""


def _row(source: str, fields: str, **values: str) -> str:
    return "{" + ", ".join(f"{f}: {values.get(f, f'{source}.{f}')}" for f in fields.split()) + "}"


_L, _B = "d a q q0 c known moving", "a q c unknown moving"
_TARGET = """list_distinct(list_transform(list_filter({rows}, lambda x: x.moving = 0 AND x.q > 1e-7), lambda x: x.a)) AS w"""


def _fifo_sql() -> str:
    kind = "STRUCT(d DATE, a BIGINT, q DOUBLE, q0 DOUBLE, c DOUBLE, known BOOLEAN, moving BIGINT)[]"
    scale = lambda f: _row("x", _L, q=f"round(x.q * {f}, 8)", q0=f"round(x.q0 * {f}, 8)")
    new = "[{d: d, a: t, q: q, q0: q, c: coalesce(c, 0), known: kind <> 'OPEN' OR c IS NOT NULL, moving: 0::BIGINT}]"
    kept = f"list_filter(list_transform(range(1, len(mine) + 1), lambda i: {_row('mine[i]', _L, q='mine[i].q - tk[i]')}), lambda x: x.q > 1e-7)"
    out = f"list_transform(list_filter(range(1, len(mine) + 1), lambda i: tk[i] > 0), lambda i: {_row('mine[i]', _L, q='tk[i]', moving='id')})"
    # A stable order by date: the place within the list decides between lots of a day.
    by_date = lambda rows: f"list_transform(list_sort(list_transform({rows}, lambda x, i: {{d: x.d, i: i, x: x}})), lambda y: y.x)"
    arrived = f"list_concat(mine, list_transform(list_filter(lots, lambda x: x.moving = link), lambda x: {_row('x', _L, a='t', moving='0::BIGINT')}))"
    cost = "coalesce(list_sum(list_transform(range(1, len(mine) + 1), lambda i: CASE WHEN tk[i] > 0 THEN mine[i].c * (tk[i] / mine[i].q0) ELSE 0 END)), 0)"
    return f""",
 st AS (
  SELECT DISTINCT user_id, symbol, strict, CAST(0 AS BIGINT) AS rn, CAST([] AS {kind}) AS lots, CAST(NULL AS VARCHAR) AS error, 0 AS skipped, 0 AS closed, 0 AS estimated, 0::DOUBLE AS realised, 0::DOUBLE AS sold FROM ev, (VALUES (true), (false)) v(strict)
  UNION ALL
  SELECT user_id, symbol, strict, rn, CASE WHEN bad IS NOT NULL OR over THEN lots
    WHEN kind = 'BUY' OR kind = 'RIGHTS' THEN list_concat(lots, {new})
    WHEN kind = 'OPEN' THEN CASE WHEN strict THEN list_concat(others, {by_date(f"list_concat(mine, {new})")}) ELSE list_concat(lots, {new}) END
    WHEN kind = 'SELL' THEN list_concat(others, {kept})
    WHEN kind = 'OUT' THEN list_concat(list_concat(others, {kept}), {out})
    WHEN kind = 'IN' THEN list_concat(list_filter(others, lambda x: x.moving <> link), {by_date(arrived)})
    WHEN kind = 'RATIO' THEN list_transform(lots, lambda x: CASE WHEN x.moving = 0 THEN {scale("num")} ELSE x END)
    WHEN held > 1e-7 THEN list_concat(others, list_transform(mine, lambda x: {scale("((CASE WHEN kind = 'ADD' THEN held ELSE 0 END + q) / held)")})) ELSE lots END,
   coalesce(error, bad), skipped + CAST(over AS INTEGER), closed + CAST(did AS INTEGER), estimated + CAST(did AND len(list_filter(range(1, len(mine) + 1), lambda i: tk[i] > 0 AND NOT mine[i].known)) > 0 AS INTEGER),
   realised + CASE WHEN did THEN c - ({cost}) ELSE 0 END, sold + CASE WHEN did THEN {cost} ELSE 0 END
  FROM (SELECT *, kind = 'SELL' AND bad IS NULL AND NOT over AS did FROM (SELECT *, error IS NULL AND NOT strict AND kind = 'SELL' AND q > held + 1e-6 AS over,
    CASE WHEN error IS NOT NULL THEN error WHEN kind = 'SELL' AND strict AND q > held + 1e-6 THEN 'sells more than the account has' WHEN kind = 'OUT' AND q > held + 1e-6 THEN 'moves more than the account has'
     WHEN kind = 'IN' AND len(list_filter(lots, lambda x: x.moving = link)) = 0 THEN 'arrives without having left' WHEN kind IN ('ADD', 'TOTAL', 'RIGHTS') AND a = -1 AND len(w) > 1 THEN 'is told to no account' END AS bad,
    list_transform(range(1, len(mine) + 1), lambda i: greatest(0, least(mine[i].q, q - coalesce(list_sum(list_transform(mine[1:i-1], lambda x: x.q)), 0)))) AS tk
   FROM (SELECT *, coalesce(list_sum(list_transform(mine, lambda x: x.q)), 0) AS held FROM (SELECT *, list_filter(lots, lambda x: x.moving = 0 AND x.a = t) AS mine, list_filter(lots, lambda x: NOT (x.moving = 0 AND x.a = t)) AS others
    FROM (SELECT *, CASE WHEN kind IN ('ADD', 'TOTAL', 'RIGHTS') AND a = -1 AND len(w) = 1 THEN w[1] ELSE a END AS t FROM (SELECT e.user_id, e.symbol, e.strict, e.rn, e.d, e.id, e.kind, e.a, e.link, e.q, e.c, e.num, s.lots, s.error, s.skipped, s.closed, s.estimated, s.realised, s.sold, {_TARGET.format(rows="s.lots")}
     FROM st s JOIN evs e ON e.user_id = s.user_id AND e.symbol = s.symbol AND e.strict = s.strict AND e.rn = s.rn + 1))))))),
 ends AS (SELECT *, CASE WHEN error IS NULL AND len(list_filter(lots, lambda x: x.moving <> 0)) > 0 THEN 'leaves without arriving' ELSE error END AS reason FROM st QUALIFY row_number() OVER (PARTITION BY user_id, symbol, strict ORDER BY rn DESC) = 1),
 f AS (SELECT e.*, CASE WHEN one THEN 'single' WHEN e.strict THEN 'account' ELSE 'merged' END AS branch, CASE WHEN NOT one THEN a.reason END AS why FROM ends e JOIN one USING (user_id, symbol) LEFT JOIN ends a ON a.user_id = e.user_id AND a.symbol = e.symbol AND a.strict WHERE e.strict = (NOT one AND a.reason IS NULL))"""


def _average_sql() -> str:
    kind = "STRUCT(a BIGINT, q DOUBLE, c DOUBLE, unknown DOUBLE, moving BIGINT)[]"
    each = lambda **v: f"list_transform(there, lambda x: CASE WHEN x.moving = 0 AND x.a = t THEN {_row('x', _B, **v)} ELSE x END)"
    scale = lambda f: _row("x", _B, q=f"round(x.q * {f}, 8)", unknown=f"round(x.unknown * {f}, 8)")
    part = "(CASE WHEN x.q - q > 1e-7 THEN (x.q - q) / x.q ELSE 0 END)"
    unknown = "CASE WHEN x.q - q > 1e-7 THEN x.unknown - round(x.unknown * (q / x.q), 8) ELSE 0 END"
    moved = "list_transform(list_filter(there, lambda x: x.moving = 0 AND x.a = t), lambda x: {a: t, q: q, c: x.c * (q / x.q), unknown: round(x.unknown * (q / x.q), 8), moving: id})"
    come = "list_filter(b, lambda x: x.moving = link)[1]"
    return f""",
 st AS (
  SELECT DISTINCT user_id, symbol, strict, CAST(0 AS BIGINT) AS rn, CAST([] AS {kind}) AS b, CAST(NULL AS VARCHAR) AS error FROM ev, (VALUES (true), (false)) v(strict)
  UNION ALL
  SELECT user_id, symbol, strict, rn, CASE WHEN bad IS NOT NULL THEN b
    WHEN kind IN ('BUY', 'RIGHTS') THEN {each(q="x.q + q", c="x.c + c")}
    WHEN kind = 'OPEN' THEN {each(q="x.q + q", c="x.c + coalesce(c, 0)", unknown="x.unknown + CASE WHEN c IS NULL THEN q ELSE 0 END")}
    WHEN kind = 'SELL' THEN {each(q="x.q - q", c=f"x.c * {part}", unknown="least(x.unknown, x.q - q)")}
    WHEN kind = 'OUT' THEN list_concat({each(q="x.q - q", c=f"x.c * {part}", unknown=unknown)}, {moved})
    WHEN kind = 'IN' THEN list_filter({each(q=f"x.q + {come}.q", c=f"x.c + {come}.c", unknown=f"x.unknown + {come}.unknown")}, lambda x: x.moving <> link)
    WHEN kind = 'RATIO' THEN list_transform(b, lambda x: CASE WHEN x.moving = 0 AND x.q > 1e-7 THEN {scale("num")} ELSE x END)
    ELSE list_transform(b, lambda x: CASE WHEN x.moving = 0 AND x.a = t AND x.q > 1e-7 THEN {scale("((CASE WHEN kind = 'ADD' THEN x.q ELSE 0 END + q) / x.q)")} ELSE x END) END, bad
  FROM (SELECT *, CASE WHEN len(list_filter(b, lambda x: x.moving = 0 AND x.a = t)) > 0 THEN b ELSE list_append(b, {{a: t, q: 0::DOUBLE, c: 0::DOUBLE, unknown: 0::DOUBLE, moving: 0::BIGINT}}) END AS there,
    CASE WHEN error IS NOT NULL THEN error WHEN kind = 'SELL' AND q > held + 1e-6 THEN 'sells more than the account has' WHEN kind = 'OUT' AND q > held + 1e-6 THEN 'moves more than the account has'
     WHEN kind = 'IN' AND len(list_filter(b, lambda x: x.moving = link)) = 0 THEN 'arrives without having left' WHEN kind IN ('ADD', 'TOTAL', 'RIGHTS') AND a = -1 AND len(w) > 1 THEN 'is told to no account' END AS bad
   FROM (SELECT *, coalesce(list_sum(list_transform(list_filter(b, lambda x: x.moving = 0 AND x.a = t), lambda x: x.q)), 0) AS held
    FROM (SELECT *, CASE WHEN kind IN ('ADD', 'TOTAL', 'RIGHTS') AND a = -1 AND len(w) = 1 THEN w[1] ELSE a END AS t FROM (SELECT e.user_id, e.symbol, e.strict, e.rn, e.id, e.kind, e.a, e.link, e.q, e.c, e.num, s.b, s.error, {_TARGET.format(rows="s.b")}
     FROM st s JOIN evs e ON e.user_id = s.user_id AND e.symbol = s.symbol AND e.strict = s.strict AND e.rn = s.rn + 1))))),
 ends AS (SELECT *, CASE WHEN error IS NULL AND len(list_filter(b, lambda x: x.moving <> 0)) > 0 THEN 'leaves without arriving' ELSE error END AS reason FROM st QUALIFY row_number() OVER (PARTITION BY user_id, symbol, strict ORDER BY rn DESC) = 1),
 f AS (SELECT e.user_id, e.symbol, e.b, CASE WHEN e.strict THEN 'account' ELSE 'merged' END AS branch, a.reason AS why, e.reason AS error FROM ends e JOIN ends a ON a.user_id = e.user_id AND a.symbol = e.symbol AND a.strict WHERE e.strict = (a.reason IS NULL)),
 p AS (SELECT user_id, symbol, branch, x.a AS account, x.q AS q FROM (SELECT *, unnest(b) AS x FROM f WHERE error IS NULL) WHERE abs(x.q) > 1e-7)"""


_C = "CAST(ROUND(CAST({} AS DECIMAL(28,6)), 2) AS DOUBLE)"
_SUM = "coalesce(list_sum(list_transform({}, lambda x: {})), 0)"
_FIFO = "WITH RECURSIVE " + _EVENTS + _RUNS + _fifo_sql()
_AVERAGE = "WITH RECURSIVE " + _EVENTS + _RUNS + _average_sql()
ORACLE = {
    "fifo_accounts": _FIFO + f" SELECT user_id, symbol, branch, why AS reason, skipped, closed, estimated, {_C.format('realised')} AS realised, {_C.format('sold')} AS sold_cost, ROUND(CAST({_SUM.format('lots', 'x.q')} AS DECIMAL(28,7)), 4)::DOUBLE AS open_qty, {_C.format(_SUM.format('lots', 'CASE WHEN x.q0 = 0 THEN x.c ELSE x.c * (x.q / x.q0) END'))} AS open_cost FROM f",
    "fifo_account_lots": _FIFO + f" SELECT user_id, x.a AS account, CAST(year(x.d) AS INTEGER) AS year, count(*) AS lots, {_C.format('SUM(x.q)')} AS qty, count(*) FILTER (NOT x.known) AS unknown FROM (SELECT user_id, unnest(lots) AS x FROM f WHERE branch = 'account') WHERE x.q > 1e-9 GROUP BY 1, 2, 3",
    "account_balances": _AVERAGE + f" SELECT user_id, symbol, branch, why AS reason, error, CAST(len(list_filter(b, lambda x: x.q > 1e-7)) AS INTEGER) AS accounts, ROUND(CAST({_SUM.format('b', 'x.q')} AS DECIMAL(28,7)), 4)::DOUBLE AS qty, {_C.format(_SUM.format('b', 'x.c'))} AS cost, {_C.format(_SUM.format('b', 'x.unknown'))} AS unknown FROM f",
    "positions_with_actions": "WITH RECURSIVE " + _EVENTS.replace("FROM trades)", f"FROM trades WHERE trade_date <= DATE '{_DAY}')") + _RUNS + _average_sql() + f" SELECT user_id, branch, account, count(*) AS n, {_C.format('SUM(q)')} AS qty FROM p GROUP BY 1, 2, 3",
    "entitlement_with_actions": "WITH RECURSIVE " + _EVENTS.replace("FROM trades)", f"FROM trades WHERE trade_date < DATE '{_DAY}')") + _RUNS + _average_sql() + f" SELECT user_id, symbol, count(*) AS holders, {_C.format('SUM(q)')} AS qty, CASE WHEN count(*) = 1 THEN max(account) END AS sole_holder FROM p GROUP BY 1, 2",
}
