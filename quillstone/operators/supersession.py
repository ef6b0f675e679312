"""Which notice of a dividend is the one in force.

Notices of an issuer name a dividend by an anchor (the end of its period, else of the financial year, else the day of
the announcement), its type and its nature.  The newest notice of a name supersedes the older ones; a withdrawal ends
the dividend.  Anchors other than the period's own end are loose, and a loose notice may mean another name:

- an update or a withdrawal supersedes only notices that are anchored in the same way; if an older one of its type and
  nature, whose financial year fits, is anchored otherwise, nobody knows which of the two it means;
- two new notices of one loose name with different ex-dates may be two dividends.

Such notices, notices without a complete name and unreadable ones without any name are ``unscoped``: the issuer has to
wait.  An unreadable notice that is the newest of its name blocks it, and the ex-dates seen under the name are kept.

What came before a notice is looked at as a set of distinct descriptions, of which a dividend type has a few a year;
no notice meets all others of its issuer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Anchors that are loose.
LOOSE = ["financial_year", "none"]


def resolve(notices: DataFrame) -> DataFrame:
    """notices with ``state`` (current, pending, withdrawn, blocked, superseded, unscoped), ``reason`` and ``ex_dates``.

    notices: issuer, sort_key (larger is newer, of an issuer unique), readable, anchor, basis (period_end,
    financial_year, none), type, nature, kind (new, update, withdrawal; null: unknown, taken for an update),
    year_end, ex_date, pending.  Null anchor, type or nature, or an empty text, leaves a name incomplete.
    """
    name = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("anchor", "type", "nature")]
    complete = name[0].isNotNull() & name[1].isNotNull() & name[2].isNotNull()
    nothing = name[0].isNull() & name[1].isNull() & name[2].isNull()
    rows = notices.withColumns({"__complete": complete, "__nothing": nothing, "__new": F.coalesce(F.col("kind") == "new", F.lit(False)), "__loose": F.coalesce(F.col("basis").isin(LOOSE), F.lit(False))})
    described = F.when(F.col("__complete"), F.struct(F.col("anchor").cast("string").alias("anchor"), "basis", "year_end", F.col("__new").alias("new"), F.col("__loose").alias("loose"), "ex_date"))
    family = Window.partitionBy("issuer", "type", "nature").orderBy("sort_key")
    rows = rows.withColumn("__before", F.collect_set(described).over(family.rowsBetween(Window.unboundedPreceding, -1)))

    def conflicting(o):
        fits = F.col("year_end").isNull() | o["year_end"].isNull() | (o["year_end"] == F.col("year_end"))
        loose = F.col("__loose") | o["loose"]
        anchor = o["anchor"] == F.col("anchor").cast("string")
        other_way = ~(anchor & o["basis"].eqNullSafe(F.col("basis")))
        other_day = F.col("ex_date").isNull() | ~o["ex_date"].eqNullSafe(F.col("ex_date"))
        return fits & loose & F.when(F.col("__new"), o["new"] & anchor & other_day).otherwise(other_way)

    doubt = F.col("__complete") & F.exists("__before", conflicting)
    reason = F.when(doubt & F.col("__new"), "two new notices, one loose name").when(doubt, "anchored otherwise than an older one").when(~F.col("readable") & F.col("__nothing"), "unreadable").when(F.col("readable") & ~F.col("__complete"), "no complete name")
    rows = rows.withColumn("reason", reason)
    # From here on a null in a name counts as a value of its own.
    named = Window.partitionBy("issuer", F.col("anchor").cast("string"), "type", "nature", F.col("reason").isNotNull())
    newest = F.row_number().over(named.orderBy(F.col("sort_key").desc()))
    rows = rows.withColumn("__newest", newest).withColumn("__days", F.array_sort(F.collect_set(F.when(F.col("readable"), F.col("ex_date"))).over(named)))
    state = (
        F.when(F.col("reason").isNotNull(), "unscoped").when(F.col("__newest") > 1, "superseded").when(~F.col("readable"), "blocked")
        .when(F.col("kind") == "withdrawal", "withdrawn").when(F.coalesce("pending", F.lit(False)), "pending").otherwise("current")
    )
    rows = rows.withColumn("state", state).withColumn("ex_dates", F.when(F.col("state") == "blocked", F.col("__days")))
    return rows.drop("__complete", "__nothing", "__new", "__loose", "__before", "__newest", "__days")
