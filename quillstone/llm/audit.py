"""Filter interaction audit by inclusion-exclusion (operator 11).

Five filters fail a document each by a condition of its own.  What a chain of filters removes at each step depends
on their order, but every such figure follows from the joint failures: for each of the 32 sets of filters, how many
documents fail all of them, summed as products of the filters' flags.

- Möbius inversion gives the survivors of a set: those that fail none of it are the sum over its subsets S of
  (-1)**|S| times the joint failures of S.  Survivors before and after a step give what it removes, and so what it
  finds gone already (redundant) and what no other filter would remove (unique).
- The number removed, as a game of the filters, has the Harsanyi dividends (-1)**(|S|+1) times the joint failures of
  S; a filter's Shapley value is the sum of the dividends of its sets, each shared equally.  Summed over all orders
  (value times 5!) it is a whole number.

How it is spread over Spark: a text becomes its flags and a SHA-256 digest in one pass.  Copies of one text are told
from the first of them by counts: rows are counted by digest, id, part and labels, then by digest, part and labels
with the smallest id and its rows, so that a text with any number of copies arrives as a few rows where its smallest
id in the whole table is found.  The 96 sums are partial before they are exchanged; what follows is one row a part.

Defined cases: a null text counts as empty; an empty text fails A only, unless it is a copy (E).  A null lang is the
part ''.  Rows with a null id count, but fail E never and make no other row fail it.  Of rows that repeat an id with
its text, all count and none is smaller than the other.  Labels: an id is good (toxic) if any of its label rows has
quality (toxic) 1; ids without labels are neither.  An empty table gives no rows.  Other columns of docs and labels,
whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of production: fewer words, percent of distinct words, percent of capitals, and the characters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
#: Rows without an id are spread over so many keys, as they meet no label.
SPREAD = 4096


def text_filters(text: Column) -> dict[str, Column]:
    """What fails a text by itself: few words, few distinct words, many capitals, marks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        "C": 100 * capitals > MAX_CAPITALS * F.length(text),
        "D": F.regexp_like(text, F.lit(MARKS)),
    }


def failures(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents counted by ``part``, flags ``A`` to ``E`` and ``good`` and ``toxic``: the count is ``n``.

    Each text gives its rows apart, so (part, flags, labels) may repeat.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = text_filters(text)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), *[c.alias(f) for f, c in own.items()], F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0))
    known = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        .withColumn("spread", F.lit(0).cast("long"))
    )
    no = F.lit(False)
    labelled = rows.join(known, ["id", "spread"], "left").select("id", "part", "digest", *own, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    kind = ["digest", "part", *own, "good", "toxic"]
    by_id = labelled.groupBy("id", *kind).agg(F.count("*").alias("n"))
    has_id = F.col("id").isNotNull()
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("with_id"), F.min(F.when(has_id, F.struct("id", "n"))).alias("least"))
    # A text has one row for each part and label here, however many copies it has.
    smallest = by_text.groupBy("digest").agg(F.min("least.id").alias("smallest"))
    told = by_text.join(smallest, "digest")
    copies = F.col("with_id") - F.when(F.col("least.id") == F.col("smallest"), F.col("least.n")).otherwise(0)
    halves = F.array(F.struct(no.alias("E"), (F.col("n") - copies).alias("n")), F.struct(F.lit(True).alias("E"), copies.alias("n")))
    return told.select("part", *own, "good", "toxic", F.inline(halves))


def joint_failures(counted: DataFrame, filters: str, weights: dict[str, Column]) -> DataFrame:
    """One row for each ``part``, with an array for each weight: element S sums the weight over the rows that fail every filter of the set S.

    A set is the sum of 2**i over its filters; a row counts by the product of their flags.
    """
    flags = [F.col(f).cast("long") for f in filters]
    sums = {}
    for name, weight in weights.items():
        sums[name] = [F.sum(reduce(mul, [flags[i] for i in range(len(flags)) if s >> i & 1], weight)) for s in range(1 << len(flags))]
    flat = counted.groupBy("part").agg(*[c.alias(f"{name}{s}") for name, sets in sums.items() for s, c in enumerate(sets)])
    return flat.select("part", *[F.array(*[F.col(f"{name}{s}") for s in range(len(sets))]).alias(name) for name, sets in sums.items()])


def members(s: int, filters: str) -> int:
    return sum(s >> i & 1 for i in range(len(filters)))


def combination(joint: str, weights: dict[int, int]) -> str:
    """The sum of weight times element, as SQL."""
    return " + ".join(f"{w} * {joint}[{s}]" for s, w in weights.items())


def survivors(joint: str, filters: str) -> Column:
    """Element T: the weight of rows that fail no filter of T."""
    sets = range(1 << len(filters))
    return F.expr(f"array({', '.join(combination(joint, {s: (-1) ** members(s, filters) for s in sets if s & t == s}) for t in sets)})")


def shapley(joint: str, filters: str) -> Column:
    """Element i: the Shapley value of filter i in what is removed, times the number of orders."""
    orders = factorial(len(filters))
    dividends = {s: -((-1) ** members(s, filters)) * (orders // members(s, filters)) for s in range(1, 1 << len(filters))}
    return F.expr(f"array({', '.join(combination(joint, {s: w for s, w in dividends.items() if s >> i & 1}) for i in range(len(filters)))})")


def by_order(joint: DataFrame, filters: str) -> DataFrame:
    """A row for each part, order of the filters and step, from the arrays ``n``, ``good_n`` and ``toxic_n`` of joint failures."""
    everything = (1 << len(filters)) - 1
    left = joint.select("part", F.col("n").alias("joint"), *[survivors(c, filters).alias(c) for c in ("n", "good_n", "toxic_n")], shapley("n", filters).alias("shapley"))
    orders = F.lit(",".join(map("".join, permutations(filters))))
    steps = left.withColumn("filter_order", F.explode(F.split(orders, ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    place = lambda f: F.locate(f, F.col("filter_order"))
    chosen = lambda holds: reduce(lambda a, b: a + b, [F.when(holds(place(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)])
    steps = steps.withColumn("before", chosen(lambda p: p < F.col("step"))).withColumn("own", chosen(lambda p: p == F.col("step")))
    at = lambda name, mask: F.get(F.col(name), mask)
    before, after = F.col("before"), F.col("before") + F.col("own")
    lost = lambda name: at(name, before) - at(name, after)
    return steps.select(
        "part", "filter_order", "step",
        at("n", after).alias("kept"),
        lost("n").alias("removed"),
        (at("joint", F.col("own")) - lost("n")).alias("redundant"),
        (at("n", everything - F.col("own")) - at("n", F.lit(everything))).alias("unique_fails"),
        lost("good_n").alias("good_lost"),
        lost("toxic_n").alias("toxic_lost"),
        at("shapley", F.bit_count(F.col("own") - 1)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of the five filters."""
    filters = "ABCDE"
    weights = {"n": F.col("n"), "good_n": F.col("good").cast("long") * F.col("n"), "toxic_n": F.col("toxic").cast("long") * F.col("n")}
    return by_order(joint_failures(failures(docs, labels, **columns), filters, weights), filters)


def op11_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns are the operator's."""
    return audit(docs, labels)
