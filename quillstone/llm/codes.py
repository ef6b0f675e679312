"""Vector code compression: product quantisation in integers (operator 12).

Vectors become integers and are cut into equal parts; each part position has a codebook, refined by rounds of
assigning every part to its nearest entry and moving the entries to the floors of their parts' means.

The nearest entry is found by exponion search.  A part starts at its previous entry a, at distance u.  Whatever entry
is as near as a lies within 2 u of a, by the triangle inequality; so only the front of a's list of entries, sorted by
their distance from a, is scanned, up to the squared distance 4 u**2 itself, which keeps ties.  All distances are
exact integers, and of the nearest entries that of the lowest index wins.  Rows of one previous entry are scanned
together, in bands of similar length of their fronts.

How it is spread over Spark: the integers are a table in the shared folder, and each round writes it anew with its
codes, so a lost executor repeats tasks of one round only.  Sums and counts by part, entry and position are made in
each task and added up by Spark as decimals; entries x components numbers a round pass the driver, and the codebooks,
whose size the parameters fix, are sent to the tasks.  Errors are added up by label beside labels of few rows: those
labels that hold more than a 10,000th of the rows, of which there are less than 10,000, are broadcast, all others joined.

Defined cases: rows whose vector is null or holds a null or a component that isn't finite take no part.  A shorter
vector ends in zeros, up to the longest and to a multiple of the parts; empty vectors are all zeros.  Entries start
as the rows of the smallest ids (null ids last, repeated ids by their vectors); with fewer rows than entries the
codebook is shorter.  Entries may be equal: the lower index takes the parts.  Integers beyond 64 bits count as the
limit, and so does an error.  An empty table gives no rows.  Repeated rows give a row each.  Other columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are searched at once.
BATCH = 8192
#: Doubles hold all integers up to this.
EXACT = 1 << 53
LARGEST = (1 << 63) - 1
#: A label with more than one in so many rows is broadcast with its sum.
HOT = 10_000


@dataclass
class Codebook:
    """The entries of one part position, and for each entry all entries by their distance from it."""

    entries: np.ndarray
    near: np.ndarray
    distances: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Codebook:
        wide = entries.astype(object) if spread(entries, entries) >= EXACT else entries
        apart = np.array([((wide - e) ** 2).sum(axis=1) for e in wide]).reshape(len(wide), len(wide))
        near = np.argsort(apart, axis=1, kind="stable")
        return Codebook(entries, near, np.take_along_axis(apart, near, axis=1))

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, and the squared distance, from its previous entry on."""
        kind = object if spread(x, self.entries) >= EXACT else np.float64
        x, entries = x.astype(kind), self.entries.astype(kind)
        here = ((x - entries[start]) ** 2).sum(axis=1)
        best, distance = start.copy(), here.copy()
        inner = (x**2).sum(axis=1)
        size = (entries**2).sum(axis=1)
        order = np.argsort(start, kind="stable")
        cuts = np.flatnonzero(np.diff(start[order], prepend=-1, append=len(entries)))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[lo:hi]
            a = start[rows[0]]
            fronts = np.searchsorted(self.distances[a], 4 * here[rows], side="right")
            by = np.argsort(fronts, kind="stable")
            rows, fronts = rows[by], fronts[by]
            at = 0
            while at < len(rows):
                # Rows whose fronts are at most twice as long, but 16 at least.
                upto = int(np.searchsorted(fronts, max(16, 2 * fronts[at]), side="right"))
                band = rows[at:upto]
                front = self.near[a, : fronts[upto - 1]]
                found = inner[band, None] - 2 * (x[band] @ entries[front].T) + size[front]
                least = found.min(axis=1)
                best[band] = np.where(found == least[:, None], front, len(entries)).min(axis=1)
                distance[band] = least
                at = upto
        return best, distance


def spread(x: np.ndarray, entries: np.ndarray) -> int:
    """No squared distance, nor any sum on the way to it or to a search radius, is larger."""
    large = max(1, *(max(abs(int(v.max())), abs(int(v.min()))) for v in (x, entries) if v.size)) if x.size or entries.size else 1
    return 16 * max(x.shape[1], 1) * large**2


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of an array, which end in zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def assigned(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """rows, whose last columns are ``ints`` and ``codes``, with new codes and ``error``, the squared distances summed over the parts."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("codes array<int>, error bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook.of(b) for b in shared.value]
        for part in batches_of(batches):
            x = rows_of(part.column(part.num_columns - 2), width).reshape(part.num_rows, len(found), -1)
            before = rows_of(part.column(part.num_columns - 1), len(found))
            got = [book.nearest(x[:, p], before[:, p]) for p, book in enumerate(found)]
            codes = np.stack([c for c, _ in got], axis=1).astype(np.int32)
            error = sum(d.astype(object) if d.dtype == object else d.astype(np.int64) for _, d in got)
            if error.dtype == object:
                error = np.array([min(e, LARGEST) for e in error.tolist()], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, len(found)), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(error, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def summed(rows: DataFrame, shape: tuple[int, int, int]) -> dict[tuple[int, int], dict[int, int]]:
    """By part and entry: the sum of the entry's parts at each position, and their number at position -1."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=object)
        for part in batches_of(batches):
            x = rows_of(part.column(0), parts * width).reshape(part.num_rows, parts, width)
            codes = rows_of(part.column(1), parts)
            exact = x.size and max(abs(int(x.max())), abs(int(x.min()))) * part.num_rows < EXACT
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                for k in range(width):
                    if exact:
                        total[p, :, k] += np.bincount(codes[:, p], x[:, p, k], entries).astype(np.int64)
                    else:
                        np.add.at(total[p, :, k], codes[:, p], x[:, p, k].astype(object))
        used = np.argwhere(count > 0)
        sums = [[Decimal(int(count[p, e])), *map(Decimal, total[p, e].tolist())] for p, e in used]
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "sums"])

    made = rows.select("ints", "codes").mapInArrow(run, "part int, entry int, sums array<decimal(38,0)>")
    flat = made.select("part", "entry", F.posexplode("sums").alias("place", "value")).groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
    out: dict[tuple[int, int], dict[int, int]] = {}
    for r in flat.collect():  # parts x entries x (components of a part + 1) numbers
        out.setdefault((r.part, r.entry), {})[r.place - 1] = int(r.value)
    return out


def moved(books: list[np.ndarray], sums: dict[tuple[int, int], dict[int, int]]) -> list[np.ndarray]:
    """Each entry at the floor of its parts' mean; unused entries stay."""
    out = [b.copy() for b in books]
    for (p, e), at in sums.items():
        out[p][e] = [at[k] // at[-1] for k in range(out[p].shape[1])]
    return out


def compress(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(``id``, ``keep0`` and on, ``ints``, ``codes`` and ``error`` of each row that takes part; the codebooks, an array for each part)."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    kept = rows.where(vector.isNotNull() & finite).select(F.col(id_col).alias("id"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)], ints.alias("ints"))
    kept = materialize(kept.withColumn("codes", F.array_repeat(F.lit(0), parts)))
    longest = kept.agg(F.max(F.size("ints")).alias("n")).first().n or 0
    wide = -(-longest // parts)
    # Ids alone first, so that no task gathers many vectors; then the few rows up to the last of these ids.
    least = kept.where(F.col("id").isNotNull()).select("id").orderBy("id").limit(entries).agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    near = kept.where(F.col("id") <= F.lit(least.last)) if least.n == entries else kept
    seeds = near.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    start = np.zeros((len(seeds), parts * wide), dtype=np.int64)
    for i, r in enumerate(seeds):
        start[i, : len(r.ints)] = r.ints
    books = [start[:, p * wide : (p + 1) * wide] for p in range(parts)]
    if not seeds:
        return kept.withColumn("error", F.lit(0).cast("long")).limit(0), books
    for _ in range(rounds):
        coded = materialize(assigned(kept, books, parts * wide).drop("error"))
        books = moved(books, summed(coded, (parts, len(seeds), wide)))
        kept = coded
    return materialize(assigned(kept, books, parts * wide)), books


def restore(coded: DataFrame, books: list[np.ndarray], *, scale: int = SCALE) -> DataFrame:
    """``id`` and ``vector``: the entries that the codes name, in the vectors' own scale (up to the zeros at the end)."""
    tables = [[[float(v) / scale for v in e] for e in b] for b in books]
    shared = coded.sparkSession.sparkContext.broadcast(np.array(tables, dtype=np.float64))
    schema = StructType([coded.schema["id"], *StructType.fromDDL("vector array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for part in batches_of(batches):
            codes = rows_of(part.column(1), len(found))
            vectors = found[np.arange(len(found)), codes].reshape(part.num_rows, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, max(vectors.shape[1], 1))[: part.num_rows + 1], pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], schema.names)

    return coded.select("id", "codes").mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def with_label_errors(coded: DataFrame, label: str) -> DataFrame:
    """coded with ``label_error``, the errors of all rows of the label together (nulls are one label)."""
    largest = F.lit(LARGEST).cast("decimal(38,0)")
    sums = materialize(coded.groupBy(F.col(label).alias("_of")).agg(F.count("*").alias("_n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("long").alias("label_error")))
    rows = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot, rare = (sums.where(test).drop("_n") for test in (F.col("_n") * HOT > rows, F.col("_n") * HOT <= rows))
    same = coded[label].eqNullSafe(F.col("_of"))
    common = F.broadcast(hot)
    of_hot = coded.join(common, same).drop("_of")
    of_rare = coded.join(common.drop("label_error"), same, "left_anti").join(rare, same).drop("_of")
    return of_hot.unionByName(of_rare)


def op12_codes(embeddings: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's codes, errors and codebooks."""
    coded, books = compress(embeddings, keep=("label",))
    code = F.concat(*[F.lpad(F.lower(F.hex(F.get("codes", F.lit(p)))), 2, "0") for p in range(PARTS)])
    out = with_label_errors(coded, "keep0")
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
