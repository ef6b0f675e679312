"""Share splits, told from what companies restate.

Earnings a share of one period stand in several filings.  Where two filings that follow each other differ by a factor,
a split may lie between them.  A disclosed ratio counts as a split once a restatement bears it out: the quotient of
before and after is the product of the disclosed ratios that took effect between the two filings, and all of these but
one have been borne out already.  That is repeated until no further one is.  What then remains of a quotient, when the
known splits between its filings are taken out, tells splits that nobody disclosed: at least two periods must show the
same clean factor, and every filing before it must be older than every one after it; one such factor of a company, the
smallest, is accepted in each round, and the rest looked at again.

Rounds work on the pairs and ratios of all companies together and end when none changes; a company's ratios and pairs
stay few, and each round joins them by company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_factor
from .rounds import settled

# Quotients taken for corrections, how far a quotient may lie from a product, days that one split is disclosed in, periods.
NOISE, TOLERANCE, ONE_SPLIT_DAYS, PERIODS = 1.5, 0.02, 400, 2


def plain_quotient(ratio: Column) -> Column:
    """Whether a quotient is an ordinary correction."""
    return (ratio > 1 / NOISE) & (ratio < NOISE)


def restated_pairs(facts: DataFrame) -> DataFrame:
    """company, concept, period, before_filed, after_filed and ratio of values that consecutive filings of a period differ in.

    facts: company, concept, period, filed, value.  Of values of one filing the largest counts; nulls and zeros none.
    """
    one = facts.where("value <> 0").groupBy("company", "concept", "period", "filed").agg(F.max("value").alias("value"))
    w = Window.partitionBy("company", "concept", "period").orderBy("filed")
    pairs = one.select("company", "concept", "period", F.lag("filed").over(w).alias("before_filed"), F.col("filed").alias("after_filed"), F.lag("value").over(w).alias("before"), "value")
    pairs = pairs.where("before * value > 0").withColumn("ratio", F.col("before") / F.col("value"))
    return pairs.where(~plain_quotient(F.col("ratio"))).drop("before", "value")


def disclosed(ratios: DataFrame) -> DataFrame:
    """company, day and ratio of splits: of equal ratios in a row that lie less than ``ONE_SPLIT_DAYS`` from the first, the first.

    ratios: company, day, ratio; of several on one day the largest counts.  A company's ratios are one small array.
    """
    one = ratios.where("ratio > 0 AND day IS NOT NULL").groupBy("company", "day").agg(F.max("ratio").alias("ratio"))
    listed = one.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("day", "ratio"))).alias("all"))
    kind = one.select(F.array(F.struct("day", "ratio"))).schema[0].dataType
    kept = F.aggregate("all", F.array().cast(kind), lambda s, x: F.when((F.size(s) > 0) & (F.element_at(s, -1)["ratio"] == x["ratio"]) & (F.datediff(x["day"], F.element_at(s, -1)["day"]) < ONE_SPLIT_DAYS), s).otherwise(F.concat(s, F.array(x))))
    return listed.select("company", F.inline(kept))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda s, x: s * x)


def split_events(pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    """company, basis (disclosed, restated, unconfirmed), day (null for restated), factor, before_filed (newest filing before) and after_filed (oldest one after; null for disclosed).

    pairs as ``restated_pairs`` gives them, ratios as ``disclosed`` does.
    """
    within = (F.col("day") > F.col("before_filed")) & (F.col("day") <= F.col("after_filed"))
    keys = ["company", "concept", "period", "before_filed", "after_filed"]
    spans = settled(pairs.join(ratios.withColumnRenamed("ratio", "factor"), "company").where(within))
    sure = settled(ratios.limit(0).select("company", "day"))
    while True:
        marked = spans.join(sure.withColumn("sure", F.lit(True)), ["company", "day"], "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
        open_ = marked.groupBy(*keys, "ratio").agg(product(F.collect_list("factor")).alias("expected"), F.count_if(~F.col("sure")).alias("open"), F.min(F.when(~F.col("sure"), F.col("day"))).alias("day"))
        new = settled(open_.where((F.col("open") == 1) & (F.abs(F.col("ratio") / F.col("expected") - 1) <= TOLERANCE)).select("company", "day").distinct())
        if new.isEmpty():
            break
        sure = settled(sure.unionByName(new))
    # The filings that bear a split out: all pairs whose other splits are sure.
    marked = spans.join(sure.withColumn("sure", F.lit(1)), ["company", "day"], "left")
    fitting = marked.groupBy(*keys, "ratio").agg(product(F.collect_list("factor")).alias("expected"), F.count_if(F.col("sure").isNull()).alias("open"), F.collect_list("day").alias("days")).where((F.col("open") == 0) & (F.abs(F.col("ratio") / F.col("expected") - 1) <= TOLERANCE))
    newest = fitting.select("company", F.explode("days").alias("day"), "before_filed").groupBy("company", "day").agg(F.max("before_filed").alias("before_filed"))
    told = ratios.join(newest, ["company", "day"], "left").join(sure.withColumn("sure", F.lit(True)), ["company", "day"], "left")
    none = F.lit(None)
    out = settled(told.select("company", F.when(F.col("sure"), "disclosed").otherwise("unconfirmed").alias("basis"), "day", F.col("ratio").cast("double").alias("factor"), "before_filed", none.cast(pairs.schema["after_filed"].dataType).alias("after_filed")))
    # What disclosed splits leave of each quotient; pairs with an unconfirmed one between say nothing.
    explained = marked.groupBy(*keys, "ratio").agg(product(F.collect_list("factor")).alias("known"), F.count_if(F.col("sure").isNull()).alias("open"))
    rest = settled(pairs.join(explained, [*keys, "ratio"], "left").where("coalesce(open, 0) = 0").select(*keys, (F.col("ratio") / F.coalesce("known", F.lit(1.0))).alias("rest")))
    while True:
        clean = rest.where(~plain_quotient(F.col("rest"))).withColumn("factor", clean_factor(F.col("rest"))).where("factor IS NOT NULL")
        groups = clean.groupBy("company", "factor").agg(F.max("before_filed").alias("old"), F.min("after_filed").alias("young"), F.count_distinct("period").alias("periods")).where((F.col("periods") >= PERIODS) & (F.col("old") < F.col("young")))
        found = settled(groups.groupBy("company").agg(F.min_by(F.struct("factor", "old", "young"), "factor").alias("e")).select("company", "e.*"))
        if found.isEmpty():
            return out
        out = settled(out.unionByName(found.select("company", F.lit("restated").alias("basis"), none.cast(ratios.schema["day"].dataType).alias("day"), "factor", F.col("old").alias("before_filed"), F.col("young").alias("after_filed"))))
        over = (F.col("before_filed") <= F.col("old")) & (F.col("after_filed") >= F.col("young"))
        rest = settled(rest.join(found, "company", "left").withColumn("rest", F.when(over, F.col("rest") / F.col("factor")).otherwise(F.col("rest"))).select(*keys, "rest"))


def adjusted(facts: DataFrame, events: DataFrame) -> DataFrame:
    """facts with ``adjusted``: the value in today's shares, by every sure split that its filing is older than."""
    e = events.where("basis <> 'unconfirmed'").groupBy("company").agg(F.collect_list(F.struct("day", "before_filed", "factor")).alias("splits"))
    old = lambda x: F.when(x["day"].isNotNull(), F.col("filed") < x["day"]).otherwise(F.col("filed") <= x["before_filed"])
    factor = F.coalesce(product(F.transform(F.filter("splits", old), lambda x: x["factor"])), F.lit(1.0))
    return facts.join(e, "company", "left").withColumn("adjusted", F.col("value") / factor).drop("splits")
