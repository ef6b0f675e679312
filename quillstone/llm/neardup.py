"""MinHash near-duplicates (operator 1).

1. Every text becomes a set of 64-bit word-shingle hashes.  One-permutation hashing cuts the hash range
   into ``BINS`` and keeps the smallest of each; an empty bin borrows from the first filled one of its
   own random order (optimal densification).  ``BANDS`` bands of ``ROWS`` bins give bucket keys: a pair
   at similarity 0.85 meets in none of them with probability (1-0.85**5)**25, below one in a million.
2. Texts with equal sets are one class, its representative the smallest id.
3. Shingles that stand in one text of all buckets alone can't be shared: they bound the similarities of a
   text, and a row that the bound keeps from every partner its bucket could hold leaves the bucket.
4. In each bucket the text with the fewest shingles of its own is linked with the others: a star, not all
   pairs.  Links are confirmed on the full sets and components formed.
5. Texts that then still share a bucket with another component are joined exactly: shingles are ordered
   by how few of these texts hold them, and only texts that share one of their rarest shingles, early
   enough that the rest suffices (prefix and positional filter), in different components, are compared.
   So no link between candidates is lost, yet a group of copies costs its size and not the square.

Defined cases: null and empty texts and those without words have an empty set and are alone.  Rows with
the same id and text give one row each, with the same component; rows of one id whose texts differ are texts of
their own, each with its own set and links.  Rows with a null id take part in no link and are their own component
(null).  Very long texts have whole sets; an empty table gives an empty table.  ``near_duplicates`` reads no other
column of docs, ``keep_one`` keeps all of them, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, materialize, set_aside
from .words import chunks, mix, shingle_sets

BINS, ROWS = 128, 5
BANDS = BINS // ROWS
SHINGLE = 5
#: Buckets' pairs whose signatures agree in fewer bins than this share are not compared in full: at a true
#: similarity of 0.85 the share has mean 0.85 and deviation 0.032.
SKETCH_SHARE = 0.65
#: Smaller sets fill too few bins for that; all their pairs are compared in full.
SKETCH_LEAST = 64
#: Sets of so few shingles also meet by their smallest hashes (a prefix in hash order), which misses none.
PREFIX_MOST = 18

_ORDER = np.stack([np.random.default_rng(1009 + i).permutation(BINS) for i in range(BINS)])
_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(57)


def signature(sorted_set: np.ndarray) -> np.ndarray:
    """Densified smallest hash of each bin."""
    at = np.searchsorted(sorted_set, _STARTS)
    least = sorted_set[np.minimum(at, len(sorted_set) - 1)]
    filled = (at < len(sorted_set)) & ((least >> np.uint64(57)) == np.arange(BINS, dtype=np.uint64))
    if not filled.all():
        donor = _ORDER[np.arange(BINS), filled[_ORDER].argmax(axis=1)]
        least = np.where(filled, least, least[donor])
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two independent words over a whole set; 0 and 0 of the empty one."""
    return int(np.bitwise_xor.reduce(mix(s)).astype(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64))


def mark_of(text_col: str) -> Column:
    return F.xxhash64(text_col)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """id, mark (a hash of the text), n_shingles, two words of a hash of the whole set, band keys and one byte of each bin's smallest hash."""

    def make(texts: list[str | None]) -> list[list]:
        n, one, two, bands, sketch = [], [], [], [], []
        for part in chunks(texts):
            for s in shingle_sets(part, shingle):
                n.append(len(s))
                for known, value in zip((one, two), set_hash(s), strict=True):
                    known.append(value)
                if not len(s):
                    bands.append(None), sketch.append(None)
                    continue
                sig = signature(s)
                keys = band_keys(sig)
                if len(s) <= PREFIX_MOST:
                    keys = np.concatenate((keys, mix(s[: len(s) - -(-percent * len(s) // 100) + 1]).view(np.int64)))
                bands.append(keys)
                sketch.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
        return [n, one, two, bands, sketch]

    rows = docs.select(F.col(id_col).alias("id"), mark_of(text_col).alias("mark"), F.col(text_col).alias("_text"))
    return add_columns(rows, "n_shingles bigint, set_one bigint, set_two bigint, bands array<bigint>, sketch binary", lambda: make)


def sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, the two words of the hash of the set, and the whole sorted shingle set."""

    def make(texts: list[str | None]) -> list[list]:
        found = [s for part in chunks(texts) for s in shingle_sets(part, shingle)]
        return [*zip(*map(set_hash, found), strict=True), [s.view(np.int64) for s in found]] if found else [[], [], []]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return add_columns(rows, "set_one bigint, set_two bigint, members array<bigint>", lambda: make)


def _share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of bins whose bytes agree."""
    x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(-1, BINS)
    y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(-1, BINS)
    return pd.Series((x == y).mean(axis=1))


def sketch_share(a: str, b: str) -> Column:
    return F.pandas_udf(_share, "double")(a, b)


def components(edges: DataFrame, node: str = "rep") -> DataFrame:
    """(node, component) of the undirected edges (a, b): the smallest node that is reachable.

    Labels shrink to the smallest among the neighbours, then jump to their label's label, until none
    changes; a star takes two rounds, a chain the logarithm of its length.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias(node), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col(node)).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col(node) == F.col("a"), "left").select(node, F.col("component").alias("was"), F.least("component", "near").alias("low"))
        target = labels.select(F.col(node).alias("low"), F.col("component").alias("jump"))
        fresh = materialize(lower.join(target, "low", "left").select(node, "was", F.least("low", "jump").alias("component")))
        labels = fresh.select(node, "component")
        if fresh.where("was <> component").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = 85) -> DataFrame:
    """id, mark, n_shingles, set_one, set_two, component_id (the smallest id that is linked, directly or not) and leads (whether the row's set stands for its component).

    Two texts are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets.
    """
    made = materialize(signatures(docs, id_col, text_col, shingle, percent))
    some = made.where("id is not null and n_shingles > 0")
    # A class is known by its smallest id and its set's hash: one id may have several texts.
    of_class = lambda i: F.struct(F.col(i).alias("id"), "set_one", "set_two")
    classes = materialize(some.groupBy("set_one", "set_two", "n_shingles").agg(F.min("id").alias("least")).select("set_one", "set_two", "n_shingles", of_class("least").alias("rep")))
    reps = some.join(classes.select("rep.id", "set_one", "set_two"), ["id", "set_one", "set_two"], "left_semi").dropDuplicates(["id", "set_one", "set_two"])
    reps = materialize(reps.select(of_class("id").alias("rep"), "n_shingles", "bands", "sketch"))

    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = materialize(buckets.join(shared, "key"))
    members = met.select("rep").distinct()
    # One text of each class: some text of the class's smallest id has its set.
    chosen = made.select("id", "mark", of_class("id").alias("rep")).join(members, "rep", "left_semi").groupBy("rep").agg(F.min("mark").alias("mark")).select(F.col("rep.id").alias("_id"), "mark")
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), mark_of(text_col).alias("mark"))
    texts = marked.join(chosen, ["_id", "mark"], "left_semi").dropDuplicates(["_id", "mark"])
    full = materialize(sets(texts, "_id", "_text", shingle).select(of_class("id").alias("rep"), "members"))

    # Shingles that no other text in any bucket has can't be in an intersection: the rest bounds every similarity.
    lone = full.select("rep", F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    lone = lone.groupBy("rep").agg(F.count("*").alias("lone"))
    known = materialize(reps.join(members, "rep").join(lone, "rep", "left").select("rep", "n_shingles", "sketch", (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("common")))

    def reaches(most: Column, n_a: Column, n_b: Column) -> Column:
        return most * (100 + percent) >= (n_a + n_b) * percent

    sized = met.join(known.select("rep", "n_shingles", "common"), "rep")
    span = sized.groupBy("key").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    partner = F.least(F.greatest("common", "low"), "high")  # the size of the best partner that the bucket could hold
    active = materialize(sized.join(span, "key").where(reaches(F.least(F.col("common"), partner), F.col("n_shingles"), partner)).drop("low", "high"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of the candidate pairs (a, b) those whose full sets are similar enough."""
        named = lambda p: known.select(F.col("rep").alias(p), F.col("n_shingles").alias(f"n_{p}"), F.col("sketch").alias(f"s_{p}"))
        sketched = pairs.join(named("b"), "b").join(named("a"), "a")
        alike = (F.least("n_a", "n_b") < SKETCH_LEAST) | (sketch_share("s_a", "s_b") >= SKETCH_SHARE)
        likely = materialize(sketched.where(alike).select("a", "b", "n_a", "n_b"))
        wanted = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
        some_sets = full.join(wanted, "rep", "left_semi")
        left, right = some_sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), some_sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b"))
        both: Column = F.size(F.array_intersect("set_a", "set_b"))
        return likely.join(right, "b").join(left, "a").withColumn("both", both).where(reaches(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")

    def mixed(rows: DataFrame, key: str) -> DataFrame:
        """The rows of the keys that hold several components, with the key's largest one as ``main``."""
        counts = rows.groupBy(key, "component").agg(F.count("*").alias("n"))
        kinds = counts.groupBy(key).agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component"))["component"].alias("main"))
        return rows.join(kinds.where("kinds > 1").select(key, "main"), key)

    # A star in every bucket, around the text with the fewest shingles of its own.
    best = F.min(F.struct((F.col("n_shingles") - F.col("common")).alias("rare"), "rep", "n_shingles", "common"))
    centre = active.groupBy("key").agg(best.alias("c")).select("key", F.col("c.rep").alias("centre"), F.col("c.n_shingles").alias("c_n"), F.col("c.common").alias("c_common"))
    near = active.join(centre, "key").where((F.col("rep") != F.col("centre")) & reaches(F.least("common", "c_common", "n_shingles", "c_n"), F.col("n_shingles"), F.col("c_n")))
    edges = materialize(confirmed(near.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()))
    labels = components(edges)

    # What still shares a bucket with another component is joined by rarest shingles.
    left = mixed(active.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "key")
    left = materialize(left.select("rep", "n_shingles", "component").distinct())
    tokens = full.join(left.select("rep"), "rep", "left_semi").select("rep", F.explode("members").alias("token"))
    ranked = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")), "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    needed = F.ceil(F.col("n_shingles") * percent / 100).cast("int")
    prefix = ranked.join(left, "rep").select("rep", "n_shingles", "component", F.posexplode(F.slice("order", F.lit(1), F.col("n_shingles").cast("int") - needed + 1)).alias("at", "t"))
    probes = materialize(mixed(prefix.where("t.df > 1").select("rep", "n_shingles", "component", "at", F.col("t.token").alias("token")), "token"))
    other = probes.select("token", F.col("rep").alias("o_rep"), F.col("n_shingles").alias("o_n"), F.col("component").alias("o_component"), F.col("at").alias("o_at"))
    possible = F.least(F.col("n_shingles") - F.col("at"), F.col("o_n") - F.col("o_at"))  # positional filter: what follows the shared shingle
    joined = probes.where("component <> main").join(other, "token").where((F.col("component") != F.col("o_component")) & reaches(possible, F.col("n_shingles"), F.col("o_n")))
    more = materialize(confirmed(joined.select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct()))
    if not more.isEmpty():
        edges = edges.unionByName(more)
        labels = components(edges)

    reached = classes.join(labels, "rep", "left").select("set_one", "set_two", "n_shingles", "rep", F.coalesce("component", "rep").alias("component"))
    out = made.select("id", "mark", "n_shingles", "set_one", "set_two").join(reached, ["set_one", "set_two", "n_shingles"], "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component.id")), F.col("id"))
    leads = F.coalesce((F.col("rep") == F.col("component")) & (F.col("id") == F.col("rep.id")), F.col("rep").isNull())
    return out.select(F.col("id").alias(id_col), "mark", "n_shingles", "set_one", "set_two", component.alias("component_id"), leads.alias("leads"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs, with all their columns, one for each component; rows with a null id all stay, and so does one row of each text without words."""
    aside, back = set_aside(docs, text_col)
    own = f"_kept{docs.columns.index(id_col)}"
    found = near_duplicates(aside, id_col=own, text_col="_text", percent=percent).where(F.col(own).isNotNull())
    # Texts of one id that aren't linked lead a component each; equal sets are one text.
    text = F.when(F.col("n_shingles") == 0, F.col("mark"))
    stays = found.where("leads").groupBy(own, "n_shingles", "set_one", "set_two", text.alias("empty")).agg(F.min("mark").alias("_mark"))
    goes = found.select(own, F.col("mark").alias("_mark")).join(stays.select(own, "_mark"), [own, "_mark"], "left_anti").distinct()
    named = aside.where(F.col(own).isNotNull()).withColumn("_mark", mark_of("_text"))
    named = named.join(goes, [own, "_mark"], "left_anti").dropDuplicates([own, "_mark"])
    return named.select(*back).unionByName(aside.where(F.col(own).isNull()).select(*back))


def op1_near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's columns; kept marks the smallest id of each component."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
