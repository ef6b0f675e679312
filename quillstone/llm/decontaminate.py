"""Benchmark decontamination by BM25 with block-max WAND (operator 5).

The test items form an inverted index of BM25 impacts; items of similar reach stand together in blocks,
and every term knows its largest impact in each block and overall.  Each text is cut into overlapping
passages, long enough that any item lies whole in one of them, and every passage is a query:

1. Its terms' lists, in the order of their first blocks, are added up by their largest impacts; where the sum
   first reaches the lowest threshold is the pivot.  No block before it can hold a match, and a passage without a
   pivot has none at all.
2. From there its bound for a block is the sum of its terms' largest impacts in the block; only blocks whose
   bound reaches the lowest threshold of their items are scored exactly.
3. An item is retrieved if the passage scores at least the item's threshold, and is then verified: shares of at
   least ``OVERLAP`` of the word n-grams of its question and of its answer must stand in the passage.

An item's threshold is the least that a passage which passes the verification can score (each word belongs to
at most ``GRAM`` n-grams, so the cheapest sufficient n-grams' impacts add up to no more than ``GRAM`` times the
score).  So retrieval misses nothing that verification would accept, edited copies included.

The index holds sparse postings and block maxima.  It is built on the driver from about ``SHARD_WORDS``
words of items at a time and broadcast; a larger benchmark is worked off in several such shards, chosen
by a hash of the item id, with document frequencies that Spark counts over all of them.

Defined cases: null and empty texts and those without words match nothing; items without words match
nothing, nor does anything match an empty benchmark; several items may match a text.  A text's row that stands
there twice gives its matches twice, one with a null id gives them with a null id.  Very long texts and items are
taken whole.  ``matches`` reads no other columns, ``drop_contaminated`` keeps all of them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, materialize, set_aside
from .words import PUNCTUATED, chunks, grams, word_hashes

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
PASSAGE = 5
#: Words of the items of a shard, an item itself counting as a few; and postings looked at together.
SHARD_WORDS, ITEM_WORDS = 1_000_000, 16
MOST_POSTINGS = 1_000_000
LEAST_STRIDE = 64
GRAM = 4
#: Shares of the question's and of the answer's n-grams that a passage must hold.
OVERLAP = 0.5


@dataclass
class Index:
    """A shard of the inverted index; terms by sorted hash, items in block order."""

    item_ids: list
    terms: np.ndarray
    filter: np.ndarray
    starts: np.ndarray  # postings of term t are those from starts[t] to starts[t + 1]
    items: np.ndarray  # of postings
    impacts: np.ndarray
    block_starts: np.ndarray  # the same for blocks
    blocks: np.ndarray
    block_max: np.ndarray
    list_max: np.ndarray  # of terms
    first_block: np.ndarray
    thresholds: np.ndarray  # of items
    block_thresholds: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    stride: int
    least: float
    sizes: list[int]  # words of an n-gram: GRAM, and fewer where a question or an answer has fewer


def item_parts(text: str | None) -> tuple[np.ndarray, int]:
    """Word hashes of the item, and how many of them are its question.

    The answer is what follows the last sentence end or line break inside, the second half if there is none.
    """
    raw = text.strip() if isinstance(text, str) else ""
    h, _ = word_hashes([raw.encode("utf-8", "surrogatepass")], PUNCTUATED)
    body = raw.rstrip(".!? \n\t")
    at = max(body.rfind(". "), body.rfind("? "), body.rfind("! "), body.rfind("\n"))
    k = len(word_hashes([body[: at + 1].encode("utf-8", "surrogatepass")], PUNCTUATED)[0]) if at > 0 else 0
    return h, len(h) // 2 if k < GRAM or len(h) - k < GRAM else k


def part_grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct n-grams of a question or an answer, where each stands first, and their words: fewer than GRAM words make one."""
    n = min(GRAM, len(h))
    return (*np.unique(grams(h, n), return_index=True), n) if n else (h[:0], np.zeros(0, dtype=np.int64), 1)


def enough(found: int, of: int, least: float) -> bool:
    return found >= least * of - 1e-9


def least_score(h: np.ndarray, k: int, impact: np.ndarray, least: float) -> float:
    """What a passage that holds enough of both parts' n-grams scores at least; impact is that of the word at each position, shared out among its repeats."""
    total = 0.0
    for part, weight in ((h[:k], impact[:k]), (h[k:], impact[k:])):
        found, first, n = part_grams(part)
        sums = np.sort(np.sum([weight[first + i] for i in range(n)], axis=0)) if len(found) else np.zeros(0)
        need = next((m for m in range(len(found) + 1) if enough(m, len(found), least)), len(found))
        total += float(sums[:need].sum()) / n
    return total


def build(items: list[tuple[object, str | None]], df: tuple[np.ndarray, np.ndarray] | None = None, n_items: int = 0, mean: float = 0.0, least: float = OVERLAP) -> Index | None:
    """The index of a shard's (id, text) pairs; df (sorted terms and counts), n_items and mean length are those of all shards, else of this one."""
    parts = [(i, *item_parts(t)) for i, t in items]
    parts = sorted((p for p in parts if len(p[1])), key=lambda p: len(p[1]))
    if not parts:
        return None
    lengths = np.array([len(p[1]) for p in parts], dtype=float)
    counted = [np.unique(p[1], return_inverse=True, return_counts=True) for p in parts]
    term, tf = (np.concatenate([c[k] for c in counted]) for k in (0, 2))
    item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(c[0]) for c in counted])
    order = np.argsort(term, kind="stable")
    term, tf, item = term[order], tf[order], item[order]
    terms, starts, own = np.unique(term, return_index=True, return_counts=True)
    count = own if df is None else df[1][np.searchsorted(df[0], terms)]
    n_items, mean = n_items or len(parts), mean or lengths.mean()
    idf = np.log1p((n_items - count + 0.5) / (count + 0.5))
    impacts = (np.repeat(idf, own) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))).astype(np.float32)
    by_item = np.empty(len(order))
    by_item[order] = impacts
    cut = np.cumsum([0, *(len(c[0]) for c in counted)])
    thresholds = np.array([least_score(p[1], p[2], (by_item[a:b] / c[2])[c[1]], least) for p, c, a, b in zip(parts, counted, cut[:-1], cut[1:], strict=True)]) * (1 - 1e-5)
    block = item // BLOCK_ITEMS
    first = np.flatnonzero(np.concatenate(([True], (np.diff(block) != 0) | (term[1:] != term[:-1]))))
    bits = np.zeros(1 << 20, dtype=bool)
    bits[terms >> np.uint64(44)] = True
    return Index(
        [p[0] for p in parts], terms, bits, np.append(starts, len(term)), item, impacts,
        np.append(np.searchsorted(first, starts), len(first)), block[first], np.maximum.reduceat(impacts, first), np.maximum.reduceat(impacts, starts), block[starts],
        thresholds, np.minimum.reduceat(thresholds, np.arange(0, len(parts), BLOCK_ITEMS)),
        [part_grams(p[1][: p[2]])[0] for p in parts], [part_grams(p[1][p[2] :])[0] for p in parts], int(max(LEAST_STRIDE, lengths.max())), least, sorted({GRAM, *(min(GRAM, n) for p in parts for n in (p[2], len(p[1]) - p[2]) if n)}),
    )


#: Cells of a table of sums; more are summed by sorting.
MOST_CELLS = 1 << 24


def sums(owner: np.ndarray, term: np.ndarray, starts: np.ndarray, targets: np.ndarray, values: np.ndarray, width: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys owner * width + target, and the sum of the (positive) values that each owner's terms have there; ``only`` (sorted) names the blocks wanted."""
    n = starts[term + 1] - starts[term]
    at = np.arange(n.sum()) + np.repeat(starts[term] - np.cumsum(n) + n, n)
    key = np.repeat(owner, n)
    low = int(owner.min())
    owners = int(owner.max()) - low + 1
    if only is not None:
        n_blocks = -(-width // BLOCK_ITEMS)
        wide = key * n_blocks + targets[at] // BLOCK_ITEMS
        if owners * n_blocks <= MOST_CELLS:
            wanted = np.zeros(owners * n_blocks, dtype=bool)
            wanted[only - low * n_blocks] = True
            kept = wanted[wide - low * n_blocks]
        else:
            kept = np.isin(wide, only)
        at, key = at[kept], key[kept]
    key = key * width + targets[at]
    if owners * width <= MOST_CELLS:
        total = np.bincount(key - low * width, values[at], owners * width)
        some = np.flatnonzero(total)
        return some + low * width, total[some]
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, values[at], len(key))


def pivots(index: Index, own: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The first block of each passage that could reach the lowest threshold; beyond all blocks if there is none."""
    n_blocks = len(index.block_thresholds)
    order = np.lexsort((index.first_block[term], own))
    who, reach = own[order], np.cumsum(index.list_max[term[order]].astype(float))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(who) != 0)))
    before = np.concatenate(([0.0], reach))[starts]
    reach -= np.repeat(before, np.diff(np.append(starts, len(who))))
    at = np.where(reach >= index.block_thresholds.min() * (1 - 1e-5), index.first_block[term[order]], n_blocks)
    return np.minimum.reduceat(at, starts)


def retrieve(index: Index, h: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first and last word of the passage, score) of every passage and item whose threshold it reaches."""
    hit = np.flatnonzero(index.filter[h >> np.uint64(44)])
    at = np.minimum(np.searchsorted(index.terms, h[hit]), len(index.terms) - 1)
    real = index.terms[at] == h[hit]
    hit, term = hit[real], at[real]
    found: list[tuple[int, int, int, int, float]] = []
    if not len(hit):
        return found
    # A text falls into segments of a quarter stride; a passage is five in a row, so any stride of words lies in one.
    width = -(-index.stride // 4)
    segments = np.maximum(1, -(-np.diff(offsets) // width))
    base = np.concatenate(([0], np.cumsum(segments)))
    text = np.searchsorted(offsets, hit, side="right") - 1
    segment = base[text] + (hit - offsets[text]) // width
    last = np.maximum(base[:-1], base[1:] - PASSAGE)  # first segment of a text's last passage
    starts = segment[:, None] - np.arange(PASSAGE)
    inside = (starts >= base[text][:, None]) & (starts <= last[text][:, None])
    pairs = np.sort((starts * len(index.terms) + term[:, None])[inside])
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]  # a term counts once in a passage
    passage, term = pairs // len(index.terms), pairs % len(index.terms)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(passage)) + 1, [len(passage)]))
    text = np.searchsorted(base, passage[cut[:-1]], side="right") - 1
    first_word = (passage[cut[:-1]] - base[text]) * width
    own = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    pivot = pivots(index, own, term)
    n_items, n_blocks = len(index.item_ids), len(index.block_thresholds)
    load = np.cumsum(np.where(pivot < n_blocks, np.add.reduceat(index.starts[term + 1] - index.starts[term], cut[:-1]), 0))
    for some in np.split(np.arange(len(load)), np.flatnonzero(np.diff(load // MOST_POSTINGS)) + 1):
        part = slice(cut[some[0]], cut[some[-1] + 1])
        mine, its = own[part], term[part]
        open_ = pivot[mine] < n_blocks
        mine, its = mine[open_], its[open_]
        if not len(mine):
            continue
        close, bound = sums(mine, its, index.block_starts, index.blocks, index.block_max, n_blocks)
        close = close[(close % n_blocks >= pivot[close // n_blocks]) & (bound >= index.block_thresholds[close % n_blocks] * (1 - 1e-5))]
        if not len(close):
            continue
        here = np.isin(mine, close // n_blocks)
        key, score = sums(mine[here], its[here], index.starts, index.items, index.impacts, n_items, close)
        good = score >= index.thresholds[key % n_items] * (1 - 1e-5)
        for k, s in zip(key[good], score[good], strict=True):
            p = k // n_items
            found.append((int(text[p]), int(k % n_items), int(first_word[p]), int(first_word[p]) + PASSAGE * width, float(s)))
    return found


def held(part: np.ndarray, n_words: dict[int, np.ndarray]) -> int:
    """How many of a part's n-grams stand among those of some words, given by length and sorted."""
    # Parts of fewer than GRAM words are one n-gram of their length.
    return max(int(np.isin(part, some).sum()) for n, some in n_words.items() if n == GRAM or len(part) == 1) if len(part) else 0


def ngrams(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    return {n: np.unique(grams(words, n)) for n in sizes}


def verified(index: Index | None, texts: list[str | None]) -> Iterator[tuple[int, object, float, float, float]]:
    """(row, item, score, question share, answer share) of a batch's texts and the items that one of their passages holds; of several passages the best."""
    row = 0
    for docs in chunks(texts) if index else ():
        h, offsets = word_hashes(docs, PUNCTUATED)
        by_text: dict[int, dict[int, list]] = {}
        for t, j, a, b, s in retrieve(index, h, offsets):
            by_text.setdefault(t, {}).setdefault(j, []).append((s, a, b))
        for t in sorted(by_text):
            own = h[offsets[t] : offsets[t + 1]]
            whole, cut = ngrams(own, index.sizes), {}
            for j in sorted(by_text[t]):
                parts = index.questions[j], index.answers[j]
                holds = lambda some, parts=parts: all(enough(held(p, some), len(p), index.least) for p in parts)
                if not holds(whole):
                    continue
                best = None
                for s, a, b in sorted(by_text[t][j], reverse=True):
                    if (a, b) not in cut:
                        cut[a, b] = ngrams(own[a:b], index.sizes)
                    some = cut[a, b]
                    if holds(some):
                        best = (s, *(held(p, some) / len(p) if len(p) else 1.0 for p in parts))
                        break
                if best:
                    yield row + t, index.item_ids[j], *best
        row += len(docs)


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = OVERLAP) -> DataFrame:
    """id, item, BM25 score of the best passage, and shares of the question and answer found there, of every verified pair."""
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out: DataFrame | None = None
    for index in indexes(benchmark, item_col, item_text, least=least):

        def make(texts: list[str | None], index=index) -> list:
            found: list[list] = [[] for _ in texts]
            for row, item, s, q, a in verified(index.value, texts):
                found[row].append({"item": item, "bm25": s, "question": q, "answer": a})
            return [found]

        found = add_columns(rows, f"found array<struct<item:{item_kind}, bm25:double, question:double, answer:double>>", lambda make=make: make)
        found = found.select(F.col("_id").alias(id_col), F.inline("found")).withColumnRenamed("item", item_col)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = OVERLAP) -> DataFrame:
    """The rows of docs, with all their columns, whose texts hold no item."""
    for index in indexes(benchmark, item_col, item_text, least=least):

        def make(texts: list[str | None], index=index) -> list:
            bad = {row for row, *_ in verified(index.value, texts)}
            return [[i in bad for i in range(len(texts))]]

        aside, back = set_aside(docs, text_col)
        docs = add_columns(aside, "_bad boolean", lambda make=make: make).where("not _bad").select(*back)
    return docs


def indexes(benchmark: DataFrame, item_col: str, item_text: str, shard_words: int = SHARD_WORDS, least: float = OVERLAP) -> Iterator[Broadcast]:
    """The broadcast index of each shard of the items."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [item_parts(t)[0] for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"].tolist(), "t": pdf["t"].tolist(), "n": [len(h) for h in own], "terms": [np.unique(h).view(np.int64) for h in own]})

    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    made = materialize(items.mapInPandas(words, f"i {items.schema['i'].dataType.simpleString()}, t string, n bigint, terms array<bigint>").where("n > 0"))
    total = made.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    shards = max(1, -(-(total.words + ITEM_WORDS * total.items) // shard_words))
    shard_of = F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(shards))
    if shards > 1:
        postings = made.select(shard_of.alias("shard"), F.explode("terms").alias("term"))
        df = materialize(postings.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("shard").alias("in")))
    for shard in range(shards):
        counts = None
        if shards > 1:
            found = df.where(F.array_contains("in", F.lit(shard).cast("bigint"))).select("term", "df").toPandas()
            term = found["term"].to_numpy(dtype=np.int64).view(np.uint64)
            order = np.argsort(term)
            counts = term[order], found["df"].to_numpy()[order]
        part = made.where(shard_of == shard).select("i", "t").collect()
        yield spark.sparkContext.broadcast(build([(r.i, r.t) for r in part], counts, total.items, total.words / total.items if total.items else 0.0, least))


def op5_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified (doc_id, item_id) pairs with their score and overlaps."""
    return matches(docs, benchmark)
