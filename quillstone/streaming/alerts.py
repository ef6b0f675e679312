"""The life of an alert over its checks: new, escalated, reminded, resolved; over a stream or a whole table alike.

A check of a key either fires with a severity (info, warning, critical) or finds nothing.  The first that fires makes
the alert ``new``; a higher severity than the last, or than the last one that was told, ``escalate``s; an alert that was
never told, or not for ``reminder`` hours, is ``remind``ed of; else it is an ``update``.  A check that finds nothing
``resolve``s an active alert.  New, escalated and reminded alerts of warning or above are sent, recoveries of alerts that
were ever sent; ``delivered`` of the check tells whether a sending works.  A recovery that wasn't delivered is sent again
(``recover``) at later checks, for as many hours as reminders lie apart.  A fall in severity is silent, and the next rise
is told again.

Checks count in the order of (at, check_id), and one key's checks pass one after the other: that is what the state is.
A batch is dealt by key and sorted inside its partitions, and walked in Arrow batches with one key's state at a time, so
no key is gathered, however long.  A stream keeps checks back until the watermark has passed them and then takes them in
order, so late files change nothing as long as they are no later than ``late``.

Defined cases: an unknown or null severity finds nothing; null ``delivered`` is not delivered; rows with a null key or
time are left out, as they have no place in any order; repeated rows of one check_id are checks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Severities in their order, the least that is sent, and hours between reminders.
SEVERITIES = ["info", "warning", "critical"]
SENT_FROM = "warning"
REMINDER_HOURS = 24.0

_HOUR = 3_600_000_000
_START = (False, -1, 0, -1, 0, -1, 0, False)
_OUT = "key string, at_us long, check_id long, action string, sent boolean, severity string, notify_count int, first_us long"
_STATE = "active boolean, rank int, first long, told_at long, count int, told int, resolved long, recovery_due boolean, late_at array<long>, late_id array<long>, late_rank array<int>, late_ok array<boolean>"


def step(state: tuple, at: int, rank: int, delivered: bool, reminder_us: int) -> tuple[tuple, str, bool]:
    """The state after a check, its action and whether anything was sent and delivered; rank -1 finds nothing."""
    active, held, first, told_at, count, told, resolved, due = state
    sent_from = SEVERITIES.index(SENT_FROM)
    if rank < 0:
        if active:
            sent = count > 0 and delivered
            return (False, held, first, told_at, count, told, at, count > 0 and not sent), "resolve", sent
        if due and at - resolved <= reminder_us:
            return (*state[:7], not delivered), "recover", delivered
        return state, "noop", False
    if not active:
        action, first, told_at, count, told = "new", at, -1, 0, -1
    elif rank > held or 0 <= told < rank:
        action = "escalate"
    elif told_at < 0 or at - told_at >= reminder_us:
        action = "remind"
    else:
        action = "update"
    told = min(told, rank)
    sent = action != "update" and rank >= sent_from and delivered
    if sent:
        told_at, count, told = at, count + 1, rank
    return (True, rank, first, told_at, count, told, 0, False), action, sent


def _walk(key: str, state: tuple, checks: Iterator[tuple], reminder_us: int, out: list) -> tuple:
    for at, check_id, rank, delivered in checks:
        state, action, sent = step(state, at, rank, delivered, reminder_us)
        if action != "noop":
            out.append((key, at, check_id, action, sent, SEVERITIES[state[1]], state[4], state[2]))
    return state


def _frame(out: list) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
    return frame.astype({"at_us": "int64", "check_id": "int64", "notify_count": "int32", "first_us": "int64", "sent": "bool"})


def _ranked(checks: DataFrame) -> DataFrame:
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)) - 1, F.lit(-1)).cast("int")
    known = checks.where(F.col("key").isNotNull() & F.col("at").isNotNull())
    return known.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("check_id").cast("long"), F.lit(-1)).alias("check_id"), rank.alias("rank"), F.coalesce("delivered", F.lit(False)).alias("delivered"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.timestamp_micros("at_us").alias("at"), "check_id", "action", "sent", "severity", "notify_count", F.timestamp_micros("first_us").alias("first_seen"))


def transitions(checks: DataFrame, *, reminder_hours: float = REMINDER_HOURS, late: str = "1 day") -> DataFrame:
    """key, at, check_id, action, sent, severity, notify_count and first_seen of every check that isn't a noop.

    checks: key, at, check_id, severity, delivered; a batch or a stream.  A stream's result comes in append mode, once the
    watermark is past a check.
    """
    reminder_us = int(reminder_hours * _HOUR)
    rows = _ranked(checks)
    return _told(_stream(rows, reminder_us, late) if checks.isStreaming else _batch(rows, reminder_us))


def _batch(rows: DataFrame, reminder_us: int) -> DataFrame:
    timed = rows.select("key", F.unix_micros("at").alias("at"), "check_id", "rank", "delivered")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, _START
        for part in parts:
            out: list = []
            for k, of_key in part.groupby("key", sort=False):
                if k != key:
                    key, state = k, _START
                state = _walk(k, state, of_key[["at", "check_id", "rank", "delivered"]].itertuples(index=False), reminder_us, out)
            yield _frame(out)

    # The other columns only fix the order of repeated checks.
    return timed.repartition("key").sortWithinPartitions("key", "at", "check_id", "rank", "delivered").mapInPandas(walk, _OUT)


def _stream(rows: DataFrame, reminder_us: int, late: str) -> DataFrame:
    def take(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        kept = group.get if group.exists else (*_START, [], [], [], [])
        waiting = list(zip(*kept[8:], strict=True))
        for part in parts:
            waiting += zip(part["at_us"].tolist(), part["check_id"].tolist(), part["rank"].tolist(), part["delivered"].tolist(), strict=True)
        waiting.sort()
        passed = group.getCurrentWatermarkMs() * 1000
        ready = [w for w in waiting if w[0] <= passed]
        rest = waiting[len(ready) :]
        out: list = []
        state = _walk(key[0], tuple(kept[:8]), iter(ready), reminder_us, out)
        group.update((*state, *([list(c) for c in zip(*rest, strict=True)] if rest else [[], [], [], []])))
        if rest:
            group.setTimeoutTimestamp(max(-(-rest[0][0] // 1000), group.getCurrentWatermarkMs() + 1))
        yield _frame(out)

    marked = rows.withColumn("at_us", F.unix_micros("at")).withWatermark("at", late)
    return marked.groupBy("key").applyInPandasWithState(take, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
