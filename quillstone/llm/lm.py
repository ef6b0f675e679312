"""Language-model scores by a weighted backoff automaton (operator 2).

Tokens are the words of a text and one end token.  The model is a word n-gram model with Dirichlet
smoothing: p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K), h' being h without its first word and the
lowest order add-one over the vocabulary and one unknown word.  Its automaton has

- a state for each seen history of up to ``ORDER`` - 1 words, and a root for the empty one;
- from a state h an arc for each seen follower w, which weighs log10 p(w | h) and leads to the longest seen
  history that ends in h w; from the root an arc for every word;
- from a state h a failure arc to h', which weighs log10(K / (c(h) + K)) and is taken, as often as needed,
  for a word without an arc.

Weights are doubles; a text's sum of them is the exact one, rounded once, so it doesn't depend on their order.  A
text is traversed once from left to right; the walk carries the state and adds up the weights of the arcs that it takes.  Long texts are walked in segments at the same time, each of which starts ``ORDER`` - 1
words early at the root: after those the state is that of the walk from the beginning.

How it is spread over Spark: texts are dealt into blocks of bounded size.  A block's distinct n-grams with
their training counts go to the shard of their hash; the shards send back to each block what other blocks
have counted of the same n-grams, and whether any holds them.  An n-gram of three words or more is sent only
if other blocks hold its first and its last words, since else no other can hold it; so nothing is missed.
Each block then builds the part of the automaton that its own texts can walk on.  Nothing passes
the driver, the model is never whole in one place, and what is exchanged grows with the corpus.

Defined cases: a null or empty text consists of the end token alone; without training rows every count is
0 and each token costs log10(1 / (V + 1)) with V = 0; an empty table gives an empty table.  Repeated rows are
counted and scored as often as they stand there; rows with a null id go by the remainder of the empty text.  Very
long texts stand in a block of their own size and are walked whole.  Other columns of docs, whatever their
names, are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import add_columns, id_remainder, scaled_partitions
from .words import chunks, mix, word_hashes

ORDER = 3
#: Strength of the backoff distribution, in observations.
STRENGTH = 8.0
BLOCK_CHARS = 6_000_000
SEGMENT = 256
#: Bits behind the point up to which sums of weights are exact: a coarse and a fine half, each an integer.
COARSE, FINE = 30, 66
_END = np.uint64(0x4F1BBCDCBFA53E0B)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end token, and their offsets."""
    parts, lengths = [], []
    for docs in chunks(texts):
        h, offsets = word_hashes(docs)
        parts.append(np.insert(h, offsets[1:], _END))
        lengths.append(np.diff(offsets) + 1)
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))


class Level:
    """The distinct n-grams of a block: keys in order, own counts, those of all blocks, and how they hang together."""

    def __init__(self, n: int, keys: np.ndarray, inside: np.ndarray, weight: np.ndarray, below: Level | None):
        self.n, self.at_position, self.inside = n, keys, inside
        self.keys, first, found = np.unique(keys[inside], return_index=True, return_inverse=True)
        self.index = np.full(len(keys), -1, dtype=np.int64)  # of the n-gram that ends at a position
        self.index[inside] = found
        self.own = np.bincount(found, weight[inside], len(self.keys)).astype(np.int64)
        self.total, self.shared = self.own, np.zeros(len(self.keys), dtype=bool)
        if below is not None:
            ends = np.flatnonzero(inside)[first]
            self.ends, self.prefix, self.suffix = ends, below.index[ends - 1], below.index[ends]
            self.asked = below.shared[self.prefix] & below.shared[self.suffix] if n > 2 else np.ones(len(self.keys), dtype=bool)
        else:
            self.asked = np.ones(len(self.keys), dtype=bool)

    def learn(self, told: np.ndarray) -> None:
        """Twice what other blocks have counted of the n-grams asked for, plus 1 if any of them holds it."""
        self.shared[self.asked] = (told & 1).astype(bool)
        self.total = self.own.copy()
        self.total[self.asked] += told >> 1


def levels(h: np.ndarray, offsets: np.ndarray, weight: np.ndarray, order: int, answers: dict[int, np.ndarray]) -> list[Level]:
    """The n-grams of orders 1 to ``order``; ``answers`` is what other blocks say of them, as far as it is known."""
    place = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
    out: list[Level] = []
    keys = h
    for n in range(1, order + 1):
        if n > 1:
            keys = mix(np.concatenate((keys[:1], keys[:-1])) * _STEP + h)
        out.append(Level(n, keys, place >= n - 1, weight, out[-1] if out else None))
        if n in answers:
            out[-1].learn(answers[n])
    return out


def weight_of(chance: np.ndarray) -> np.ndarray:
    """The C library's logarithm: numpy's own differs from it in the last bit on some processors."""
    return np.fromiter(map(math.log10, chance.tolist()), dtype=np.float64, count=len(chance))


def halves(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights as integers, multiples of 2**-COARSE and of 2**-FINE; a double that weighs 2**-13 or more loses nothing, a lighter one at most 2**-67."""
    coarse = np.rint(weights * 2.0**COARSE)
    fine = np.rint((weights - coarse * 2.0**-COARSE) * 2.0**FINE)
    return coarse.astype(np.int64), fine.astype(np.int64)


def exact_sums(parts: tuple[np.ndarray, np.ndarray], offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's weights as if in exact arithmetic, rounded once: integers add up in any order to the same."""
    coarse, fine = (np.add.reduceat(x, offsets[:-1]).tolist() for x in parts)
    return np.array([((a << (FINE - COARSE)) + b) / (1 << FINE) for a, b in zip(coarse, fine, strict=True)], dtype=np.float64)


class Automaton:
    """States 0 (the root) and one for each n-gram below the highest order; arcs sorted by state and word."""

    def __init__(self, grams: list[Level], words: int, tokens: int, strength: float):
        first = grams[0]
        self.words = max(len(first.keys), 1)
        base = np.concatenate(([1], 1 + np.cumsum([len(g.keys) for g in grams])))
        chance = (first.total + 1.0) / (tokens + words + 1.0)
        self.base = weight_of(chance)
        self.root_to = np.where(first.total > 0, base[0] + np.arange(len(first.keys)), 0)
        self.fail, self.fail_weight = np.zeros(base[-2], dtype=np.int64), np.zeros(base[-2])
        arcs, to, weights = [], [], []
        for below, g in zip(grams, grams[1:], strict=False):
            states = base[below.n - 1] + np.arange(len(below.keys))
            self.fail[states] = 0 if below.n == 1 else base[below.n - 2] + below.suffix
            self.fail_weight[states] = weight_of(strength / (below.total + strength))
            chance = (g.total + strength * chance[g.suffix]) / (below.total[g.prefix] + strength)
            seen = np.flatnonzero(g.total > 0)
            arcs.append((base[below.n - 1] + g.prefix[seen]) * self.words + first.index[g.ends[seen]])
            to.append(base[g.n - 1] + seen if g is not grams[-1] else base[below.n - 1] + g.suffix[seen])
            weights.append(weight_of(chance[seen]))
        order = np.argsort(arcs := np.concatenate([np.zeros(0, dtype=np.int64), *arcs]))
        self.arcs, self.to, self.weights = arcs[order], np.concatenate([np.zeros(0, dtype=np.int64), *to])[order], np.concatenate([np.zeros(0), *weights])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a word each, and the weights of the arcs taken: failure arcs first, as many as it needs."""
        after, weight = np.zeros(len(state), dtype=np.int64), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            some = left[at_root]
            after[some] = self.root_to[word[some]]
            weight[some] += self.base[word[some]]
            left = left[~at_root]
            if not len(left):
                break
            want = state[left] * self.words + word[left]
            at = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1) if len(self.arcs) else np.zeros(len(left), dtype=np.int64)
            has = self.arcs[at] == want if len(self.arcs) else np.zeros(len(left), dtype=bool)
            after[left[has]] = self.to[at[has]]
            weight[left[has]] += self.weights[at[has]]
            left = left[~has]
            weight[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return after, weight

    def walk(self, word: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
        """The weight of each position's step."""
        lens = np.diff(offsets)
        parts = -(-lens // SEGMENT)
        text = np.repeat(np.arange(len(lens)), parts)
        inner = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        warm = np.minimum(inner, order - 1)
        start, size = offsets[text] + inner - warm, np.minimum(lens[text] - inner, SEGMENT) + warm
        by = np.argsort(-size, kind="stable")
        start, size, warm = start[by], size[by], warm[by]
        out = np.zeros(len(word))
        state = np.zeros(len(start), dtype=np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))  # segments longer than t come first
            at = start[:n] + t
            state[:n], weight = self.step(state[:n].copy(), word[at])
            counts = t >= warm[:n]
            out[at[counts]] = weight[counts]
        return out


def pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: most are small."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)


def score(docs: DataFrame, trained: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: float = STRENGTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, trained, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows where ``trained`` holds."""
    size = docs.agg(F.sum(F.length(text_col)).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_chars))
    shards = max(scaled_partitions(docs.sparkSession), min(blocks, 100_000))
    block = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(blocks)).cast("int")
    chosen = docs.select(block.alias("block"), F.col(id_col).alias("id"), F.coalesce(trained, F.lit(False)).alias("trained"), F.col(text_col).alias("_text"))

    def compressor():
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        return lambda texts: [[packer.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]]

    grouped = add_columns(chosen, "packed binary", compressor).groupBy("block")
    message = "shard int, block int, n int, keys binary, counts binary, words bigint, tokens bigint"
    as_table = lambda rows, schema: pa.Table.from_pylist(rows, schema)
    messages = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64())])

    def read(table: pa.Table, upto: int, answers: pa.Table | None) -> tuple[np.ndarray, np.ndarray, list[Level]]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        h, offsets = tokens_of([unpacker.decompress(b).decode("utf-8", "surrogatepass") for b in table["packed"].to_pylist()])
        weight = np.repeat(np.asarray(table["trained"].to_pylist(), dtype=np.int64), np.diff(offsets))
        told: dict[int, list] = {n: [] for n in range(1, upto + 1)}
        for n, shard, counts in zip(*(answers[c].to_pylist() for c in ("n", "shard", "counts")), strict=True) if answers is not None else ():
            if 0 < n <= upto:
                told[n].append((shard, counts))
        # An order without any answer was either not asked for yet, or nothing of it was.
        known = {n: np.concatenate([np.zeros(0, dtype=np.int64), *(unpack(c) for _, c in sorted(parts))]) for n, parts in told.items() if answers is not None and (parts or n < upto)}
        return h, offsets, levels(h, offsets, weight, upto, known)

    def send(block: int, grams: list[Level]) -> list[dict]:
        out = []
        for g in grams:
            keys, counts = g.keys[g.asked], g.own[g.asked]
            shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else [0]
            out += [{"shard": int(shard[a]), "block": block, "n": g.n, "keys": pack_keys(keys[a:b]), "counts": pack(counts[a:b])} for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def count(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return as_table([], messages)
        _, _, grams = read(table, 2, None)
        return as_table(send(table["block"][0].as_py(), grams[:order]), messages)

    def count_more(n: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            if answers.num_rows and answers["block"][0].as_py() == -1:
                # The shards' totals: each shard passes them on to some of the blocks.
                words, tokens = (sum(x or 0 for x in answers[c].to_pylist()) for c in ("words", "tokens"))
                return as_table([{"shard": s, "block": -1, "n": 0, "keys": b"", "counts": b"", "words": words, "tokens": tokens} for s in range(min(shards, blocks))] if n == 3 else [], messages)
            if not table.num_rows or n > order:
                return as_table([], messages)
            return as_table(send(table["block"][0].as_py(), read(table, n, answers)[2][n - 1 :]), messages)

        return run

    def gather(table: pa.Table) -> pa.Table:
        """For each block: what the others have counted of its n-grams, in the order of its message; tokens and distinct words of this shard."""
        out: list[dict] = []
        if not table.num_rows:
            return as_table(out, messages)
        rows = table.to_pylist()
        shard = rows[0]["shard"]
        for n in sorted({r["n"] for r in rows}):
            part = [r for r in rows if r["n"] == n]
            if n == 0:
                out += [{"shard": shard, "block": b, "n": 0, "counts": b"", "words": r["words"], "tokens": r["tokens"]} for r in part for b in range(shard, blocks, min(shards, blocks))]
                continue
            counts = [unpack(r["counts"]) for r in part]
            keys, place = np.unique(np.concatenate([unpack_keys(r["keys"]) for r in part]), return_inverse=True)
            own = np.concatenate(counts)
            total = np.bincount(place, own, len(keys)).astype(np.int64)
            rest = 2 * (total[place] - own) + (np.bincount(place, minlength=len(keys))[place] > 1)
            at = 0
            for r, c in zip(part, counts, strict=True):
                out.append({"shard": shard, "block": r["block"], "n": n, "counts": pack(rest[at : at + len(c)])})
                at += len(c)
            if n == 1:
                out.append({"shard": shard, "block": -1, "n": 0, "counts": b"", "words": int((total > 0).sum()), "tokens": int(total.sum())})
        return as_table(out, messages)

    answered = [grouped.applyInArrow(count, message).groupBy("shard").applyInArrow(gather, message)]
    for n in range(3, max(order, 3) + 1):
        known = reduce(DataFrame.unionByName, answered)
        answered.append(grouped.cogroup(known.groupBy("block")).applyInArrow(count_more(n), message).groupBy("shard").applyInArrow(gather, message))

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    fields = [("id", id_type), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema(fields).empty_table()
        h, offsets, grams = read(table, order, answers)
        words, tokens = (sum(x or 0 for x in answers[c].to_pylist()) for c in ("words", "tokens"))
        automaton = Automaton(grams, words, tokens, strength)
        word = grams[0].index
        add = lambda x: np.add.reduceat(x, offsets[:-1])
        found = [np.diff(offsets), add((grams[0].total[word] > 0).astype(np.int64)), np.full(len(offsets) - 1, tokens), exact_sums(tuple(x[word] for x in halves(automaton.base)), offsets), exact_sums(halves(automaton.walk(word, offsets, order)), offsets)]
        return pa.table([table["id"], table["trained"], *found], schema=pa.schema(fields))

    out = grouped.cogroup(reduce(DataFrame.unionByName, answered).groupBy("block")).applyInArrow(walk, schema)
    return out.withColumnRenamed("id", id_col)


def op2_lm(docs: DataFrame) -> DataFrame:
    """The contract's columns: rows whose remainder is 2 are held out."""
    out = score(docs, id_remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
