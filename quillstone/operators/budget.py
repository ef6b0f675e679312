"""A budget shared among parts: floors first, then by weight, what small parts leave going to the others.

Filling up by weight in rounds ends where the parts, in the order of need to weight, no longer find their need within
their share of what is left: a part that doesn't leaves less than its share to the parts after it, so none of those
does either.  So one window over the parts of a key, in that order, tells at once which are filled and what the rest
have to share; no rounds are run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a cut text's room that its head keeps, and the room that a mark needs beside itself.
HEAD, MARK_ROOM = 0.6, 200


def shared(parts: DataFrame, keys: list[str], size: str, weight: str, order: str, total: Column, floor: int) -> DataFrame:
    """parts with ``quota``: whole numbers that add up to at most the total of the key, none above its part's size.

    Each part gets its floor (or its size, if that is less); where the floors don't fit, the parts of least weight get
    nothing, of equal weight the later ones.  The rest is filled up by weight.  Null sizes count as 0, null weights as
    1; weights below or at 0 keep the floor only.  ``total`` is one number a key; null counts as 0.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(1)).cast("long"), F.lit(0).cast("long"))
    rows = parts.withColumns({"__s": F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long")), "__w": w, "__t": F.coalesce(total, F.lit(0)).cast("long")})
    rank = Window.partitionBy(*keys).orderBy(F.col("__w").desc(), F.col(order))
    rows = rows.withColumn("__in", F.row_number().over(rank) * floor <= F.col("__t")) if floor else rows.withColumn("__in", F.lit(True))
    rows = rows.withColumn("__q", F.when(F.col("__in"), F.least(F.col("__s"), F.lit(floor).cast("long"))).otherwise(F.lit(0).cast("long")))
    need = F.when(F.col("__in") & (F.col("__w") > 0), F.col("__s") - F.col("__q")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("__need", need).withColumn("__by", F.when(F.col("__need") > 0, F.col("__w")).otherwise(F.lit(0).cast("long")))
    whole = Window.partitionBy(*keys)
    filling = Window.partitionBy(*keys).orderBy(F.try_divide("__need", "__by").asc_nulls_first(), F.col(order))
    ahead = filling.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("__pool", F.greatest(F.col("__t") - F.sum("__q").over(whole) - F.coalesce(F.sum("__need").over(ahead), zero), zero)).withColumn("__left", F.sum("__by").over(whole) - F.coalesce(F.sum("__by").over(ahead), zero))
    rows = rows.withColumn("__full", F.col("__need") * F.col("__left") <= F.col("__pool") * F.col("__by"))
    # What the parts that aren't filled share: the pool and the weights at the first of them.
    first = F.min(F.when(~F.col("__full"), F.struct(F.col("__need") / F.col("__by"), F.col(order), "__pool", "__left"))).over(whole)
    rows = rows.withColumn("__rest", first)
    share = F.floor(F.col("__rest.__pool") * F.col("__by") / F.col("__rest.__left")).cast("long")
    return rows.withColumn("quota", F.col("__q") + F.when(F.col("__full"), F.col("__need")).otherwise(F.coalesce(share, zero))).drop("__s", "__w", "__t", "__in", "__q", "__need", "__by", "__pool", "__left", "__full", "__rest")


def fitted(text: Column, limit: Column, mark: Column, keep_head: Column | None = None) -> Column:
    """A text in at most ``limit`` characters: head and tail around a mark that says what was left out, or mark and tail.

    A limit that leaves the mark no room keeps the tail alone; null texts stay null, a limit below 0 counts as 0.
    """
    limit = F.greatest(limit, F.lit(0))
    room = limit - F.length(mark)
    head = F.when(keep_head if keep_head is not None else F.lit(True), F.floor(room * HEAD)).otherwise(F.lit(0)).cast("int")
    end = lambda n: F.when(n > 0, F.right(text, n)).otherwise("")
    cut = F.concat(F.left(text, head), mark, end(room - head))
    return F.when(F.length(text) <= limit, text).when(room <= MARK_ROOM, end(limit)).otherwise(cut)
