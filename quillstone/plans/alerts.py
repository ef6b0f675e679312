"""The life of alerts over the events of each user; and the SQL for it, check by check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import alerts as al
from .star import table

_SEVERITY = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'info' END"


def checks_of(events: DataFrame) -> DataFrame:
    """Each event as a check of its user: some kinds fire, a fifth of the sendings fail."""
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("check_id"), F.expr(_SEVERITY).alias("severity"), (F.col("event_id") % 5 != 0).alias("delivered"))


def alert_transitions(spark: SparkSession, d: str) -> DataFrame:
    t = al.transitions(checks_of(table(spark, d, "events")))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return t.select("key", stamp("at"), "check_id", "action", "sent", "severity", "notify_count", stamp("first_seen"))


QUERIES = {"alert_transitions": alert_transitions}

_FIRES, _GAP = "n.rank >= 0", f"INTERVAL {int(al.REMINDER_HOURS)} HOUR"
ORACLE = {
    "alert_transitions": f"""WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS key, ts AS tm, event_id AS check_id, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'click' THEN 0 ELSE -1 END AS rank, event_id % 5 <> 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 s AS (SELECT key, CAST(0 AS BIGINT) AS rn, tm, check_id, 'noop' AS action, false AS sent, false AS active, -1 AS held, CAST(NULL AS TIMESTAMP) AS first, CAST(NULL AS TIMESTAMP) AS told_at, 0 AS n_told, -1 AS told, CAST(NULL AS TIMESTAMP) AS resolved, false AS due FROM c WHERE rn = 1
  UNION ALL SELECT key, rn, tm, check_id, action, sent, rank >= 0, CASE WHEN rank >= 0 THEN rank ELSE held END, CASE WHEN action = 'new' THEN tm ELSE first END,
   CASE WHEN sent AND rank >= 0 THEN tm WHEN action = 'new' THEN NULL ELSE told_at END, CASE WHEN action = 'new' THEN 0 ELSE n_told END + CASE WHEN sent AND rank >= 0 THEN 1 ELSE 0 END,
   CASE WHEN sent AND rank >= 0 THEN rank WHEN action = 'new' THEN -1 WHEN rank >= 0 THEN least(told, rank) ELSE told END, CASE WHEN action = 'resolve' THEN tm ELSE resolved END,
   CASE WHEN action = 'resolve' THEN n_told > 0 AND NOT sent WHEN action = 'recover' THEN NOT sent WHEN rank >= 0 THEN false ELSE due END
  FROM (SELECT *, CASE action WHEN 'resolve' THEN n_told > 0 AND ok WHEN 'recover' THEN ok WHEN 'noop' THEN false WHEN 'update' THEN false ELSE rank >= 1 AND ok END AS sent
   FROM (SELECT n.key, n.rn, n.tm, n.check_id, n.rank, n.ok, s.active, s.held, s.first, s.told_at, s.n_told, s.told, s.resolved, s.due,
     CASE WHEN NOT ({_FIRES}) AND s.active THEN 'resolve' WHEN NOT ({_FIRES}) AND s.due AND n.tm - s.resolved <= {_GAP} THEN 'recover' WHEN NOT ({_FIRES}) THEN 'noop' WHEN NOT s.active THEN 'new' WHEN n.rank > s.held OR (s.told >= 0 AND n.rank > s.told) THEN 'escalate' WHEN s.told_at IS NULL OR n.tm - s.told_at >= {_GAP} THEN 'remind' ELSE 'update' END AS action
    FROM s JOIN c n ON n.key = s.key AND n.rn = s.rn + 1)))
SELECT key, strftime(tm, '%Y-%m-%d %H:%M:%S.%f') AS "at", check_id, action, sent, CASE held WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity, CAST(n_told AS INTEGER) AS notify_count, strftime(first, '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM s WHERE action <> 'noop'"""
}
