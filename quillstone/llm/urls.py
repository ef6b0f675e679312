"""URL filters by a path-template tree (operator 8), in DataFrame functions.

Rules (a host and a path prefix each) decide what they fit; the longest wins.  The pages they decide are
the labels from which the rest is judged, unless labelled verdicts are given.  Per host the paths form a
tree, worked off to its longest path: number-like segments become wildcards (``*``), and sibling branches
whose shares of blocked pages the Hoeffding bound can't tell from their parent's are merged into one
(``?``).  A branch without labels keeps its segments: nothing tells which of them vary.  So labelled and
unlabelled siblings are never pooled, however many there are.

A round of jobs passes a whole trunk (levels without a second branch, however many, and whatever ends on
them) and the fork after it, so the rounds are as many as the forks on a labelled path, not as its segments.

A template is rejected when its smoothed labelled purity reaches ``REJECT``.  A node's purity is its share of
blocked pages, smoothed by ``PRIOR`` pages of what its parent passes on; a parent passes on its own share,
smoothed by ``BACKOFF`` pages of what it was passed, the host starting from 0.5.  So a branch without labels is
judged by its parent template and its host, if these have evidence enough; else it is allowed.

The tree is built from counts of distinct (host, path) pairs, never from the pages of one host in one
task.

Defined cases: a null url, or one without "://", has empty host and path and falls under no rule; it is
allowed.  Repeated rows give repeated results; rows with a null id are judged too; an empty table gives an
empty table.  Very long urls are read whole, deep paths to their end.  Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Mark of merged branches; no segment holds this character.
SIMILAR = "?"
MIN_LABELLED = 5
ALPHA = 0.05
#: Pages that what the parent passes on counts as, for a node's own purity and for what it passes on itself; and
#: the purity from which a template is rejected.
PRIOR, BACKOFF = 2.0, 10.0
REJECT = 0.8

# The rules of the query.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments_of(path: Column) -> Column:
    """All segments, number-like ones as wildcards that keep their ending."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, r"^(?:[0-9]+|[0-9a-fA-F]{12,}|[0-9a-fA-F-]{32,})(?=\.|$)", "*"))


def _passed(bad: Column, seen: Column, weight: float, given: Column) -> Column:
    return (bad + F.lit(weight) * given) / (seen + F.lit(weight))


def _trunks(at: DataFrame) -> DataFrame:
    """at with its node's trunk: the way that the largest of the node's rests takes, as far as no second branch leaves it.

    On a trunk nothing can merge, so all of its levels are passed at once.  Adds ``walked`` (levels that the row stays
    on the trunk), ``given`` as the node reached there passes it on, and ``done`` (the row ends on the trunk, is alone,
    or no label is left below the node).
    """
    node = ["host", "template"]
    width = at.groupBy(*node).agg(F.count("*").alias("paths"), F.sum("seen").alias("labels"), F.max("rest").alias("trunk"))
    apart = F.array_position(F.zip_with("rest", "trunk", lambda a, b: ~a.eqNullSafe(b)), F.lit(True)).cast("int")
    x = at.join(width, node).withColumn("open", (F.col("paths") > 1) & (F.col("labels") > 0)).withColumn("along", F.when(apart == 0, F.size("trunk")).otherwise(apart - 1))
    levels = x.where("open").groupBy(*node, "along").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), F.count("*").alias("n"), F.max(F.size("rest") > F.col("along")).alias("leaves"), F.first("given").alias("start"))
    here_on = Window.partitionBy(*node).orderBy(F.col("along").desc())
    steps = levels.select(*node, "along", "leaves", "start", *[F.sum(c).over(here_on).cast("double").alias(c) for c in ("seen", "bad", "n")])
    # One entry for each length at which a row leaves or ends: no more than a url has segments.
    per = steps.groupBy(*node).agg(F.min(F.when(F.col("leaves"), F.col("along"))).alias("fork"), F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("along", "seen", "bad", "n"))).alias("steps"))

    def step(state, s):
        # As many equal levels as lie between two entries; a row that is alone stops at the first of them.
        count = F.when(s["n"] == 1, F.least(s["along"] - state["at"], F.lit(1))).otherwise(s["along"] - state["at"])
        own = F.coalesce(F.try_divide(s["bad"], s["seen"]), state["given"])
        given = own + F.pow(F.lit(BACKOFF) / (s["seen"] + F.lit(BACKOFF)), count) * (state["given"] - own)
        return F.struct(s["along"].alias("at"), given.alias("given"), F.concat(state["all"], F.array(F.struct(s["along"].alias("k"), given.alias("v")))).alias("all"))

    begin = F.struct(F.lit(0).alias("at"), F.col("start").alias("given"), F.array().cast("array<struct<k:int,v:double>>").alias("all"))
    upto = F.filter("steps", lambda s: F.col("fork").isNull() | (s["along"] <= F.col("fork")))
    known = per.select(*node, "fork", F.map_from_entries(F.aggregate(upto, begin, step)["all"]).alias("givens"))
    y = x.join(known, node, "left").withColumn("walked", F.when(F.col("open"), F.least("along", F.coalesce("fork", "along"))).otherwise(0))
    done = ~F.col("open") | F.col("fork").isNull() | (F.col("along") < F.col("fork"))
    return y.withColumns({"done": done, "given": F.when(F.col("open"), F.element_at("givens", F.col("walked"))).otherwise(F.col("given"))})


def template_tree(labelled: DataFrame) -> DataFrame:
    """(host, segments) -> template, n_labelled and purity, from (host, segments, blocked: 1, 0 or null) rows."""
    columns = ["host", "segments", "seen", "bad", "template", "rest", "given", "done"]
    paths = labelled.groupBy("host", "segments").agg(F.count("blocked").alias("seen"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    hosts = paths.groupBy("host").agg(F.sum("seen").alias("h_seen"), F.sum("bad").alias("h_bad"))
    root = _passed(F.col("h_bad"), F.col("h_seen"), BACKOFF, F.lit(0.5))
    start = paths.join(hosts, "host").select("host", "segments", "seen", "bad", F.array().cast("array<string>").alias("template"), F.col("segments").alias("rest"), root.alias("given"), F.lit(False).alias("done"))
    at = materialize(start)
    bound = F.sqrt(F.lit(0.5) * F.log(F.lit(2 / ALPHA)))
    ended: list[DataFrame] = []
    while not at.isEmpty():
        trunk = _trunks(at.drop("done"))
        template = F.when(F.col("done"), F.concat("template", "rest")).otherwise(F.concat("template", F.slice("rest", F.lit(1), F.col("walked"))))
        rest = F.slice("rest", F.col("walked") + 1, F.size("rest"))
        walked = materialize(trunk.withColumns({"template": template, "rest": rest}).select(*columns))
        ended.append(walked.where("done"))
        # At the fork: branches that look like their parent become one.
        at = walked.where(~F.col("done")).withColumn("segment", F.get("rest", F.lit(0)))
        child = at.groupBy("host", "template", "segment").agg(F.sum("seen").alias("c_seen"), F.sum("bad").alias("c_bad"))
        parent = child.groupBy("host", "template").agg(F.count("segment").alias("children"), F.sum("c_seen").alias("p_seen"), F.sum("c_bad").alias("p_bad"))
        gap = F.abs(F.try_divide(F.col("c_bad"), F.col("c_seen")) - F.try_divide(F.col("p_bad"), F.col("p_seen")))
        similar = (F.col("c_seen") >= MIN_LABELLED) & (F.col("children") > 1) & (gap < bound * (F.try_divide(F.lit(1.0), F.sqrt("c_seen")) + F.try_divide(F.lit(1.0), F.sqrt("p_seen"))))
        to = F.when(F.col("segment").isNull(), F.col("segment")).when(F.coalesce(similar, F.lit(False)), F.lit(SIMILAR)).otherwise(F.col("segment"))
        step = child.join(parent, ["host", "template"]).select("host", "template", "segment", to.alias("to"), "c_seen", "c_bad")
        # What the node reached passes on to those below it.
        nodes = step.groupBy("host", "template", "to").agg(F.sum("c_seen").alias("n_seen"), F.sum("c_bad").alias("n_bad"))
        step = step.join(nodes.where("to IS NOT NULL"), ["host", "template", "to"], "left").select("host", "template", "segment", "to", "n_seen", "n_bad")
        left, right = at.alias("l"), step.alias("r")
        on = (F.col("l.host") == F.col("r.host")) & (F.col("l.template") == F.col("r.template")) & F.col("l.segment").eqNullSafe(F.col("r.segment"))
        ends = F.col("r.to").isNull()
        moved = left.join(right, on).select(
            "l.host", "l.segments", "l.seen", "l.bad", F.when(ends, F.col("l.template")).otherwise(F.concat("l.template", F.array("r.to"))).alias("template"),
            F.slice("l.rest", F.lit(2), F.size("l.rest")).alias("rest"), F.when(ends, F.col("l.given")).otherwise(_passed(F.col("r.n_bad"), F.col("r.n_seen"), BACKOFF, F.col("l.given"))).alias("given"), ends.alias("done"),
        )
        moved = materialize(moved)
        ended.append(moved.where("done"))
        at = moved.where(~F.col("done"))
    at = reduce(DataFrame.unionByName, ended, at)
    totals = at.groupBy("host", "template").agg(F.sum("seen").alias("n_labelled"), F.sum("bad").alias("n_bad"), F.min("given").alias("given"))
    purity = _passed(F.col("n_bad"), F.col("n_labelled"), PRIOR, F.col("given"))
    return at.select("host", "segments", "template").join(totals.withColumn("purity", purity), ["host", "template"]).select("host", "segments", F.array_join("template", "/").alias("template"), "n_labelled", "purity")


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = RULES, label_col: str | None = None) -> DataFrame:
    """id, host, path, rule, template, purity and verdict of every page; ``label_col`` may hold known verdicts (1: block, 0: allow)."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    known = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    parsed = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), known.alias("_known"))
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segments", segments_of(F.col("path")))
    blocked = F.coalesce("_known", F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("int")))
    tree = template_tree(ruled.select("host", "segments", blocked.alias("blocked")))
    out = ruled.join(tree, ["host", "segments"], "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), "template", "purity", verdict.alias("verdict"))


def op8_urls(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
