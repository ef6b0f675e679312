"""SentencePiece encoding and decoding for merge-type vocabularies (operator 13).

A text's blanks become the mark U+2581, one more of which stands before it.  Characters are the first symbols; an
agenda holds every adjacent pair of symbols that together are a piece, by score, the highest first, of equal scores
the leftmost.  The first pair of the agenda merges, its neighbours give new pairs, and pairs of symbols that are no
longer there are passed over when their turn comes.  Symbols that are no piece at last become the byte pieces of
their UTF-8 bytes.

No merge crosses a place where a mark follows another character, if no piece does; then a text is cut there, and the
ids of each distinct chunk are kept in a bounded cache of the task.  Otherwise the text is one chunk.

With ``check_path`` the sentencepiece library reads that file and every Arrow batch is compared with what it gives: the
ids of each chunk that is new to the task, and every decoded text; the job ends at the first difference.

The model file is read on the driver and broadcast; its size is that of the file.  Read are merge-type models with
byte fallback, the mark before the text, and no character map; others are refused, not encoded differently.

Defined cases: a null text counts as empty, an empty text has no ids and decodes to the empty string.  Names of
control pieces in a text are ordinary text.  Decoding shows a null list of ids as the empty string, control pieces as
nothing, the unknown piece by its surface and every byte that ends no character as U+FFFD; ids outside the vocabulary
are left out.  Very long texts and chunks are encoded whole.  Repeated rows and rows with null ids give a row each,
an empty table none.  Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARK = "▁"
CACHE_CHUNKS = 300_000
#: Chunks of up to so many characters keep their agenda in an array, many chunks at once; longer ones in a heap.
SHORT_CHUNK = 32
NEVER = float("inf")
#: Chunks longer than this are encoded anew each time.
LONG_CHUNK = 64
#: Rows that leave a task at once.
OUT_ROWS = 1024
# Fixed values of the model format: kinds of pieces, the merge type.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2

codecs.register_error("quillstone_bytewise", lambda e: ("�", e.start + 1))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message: integers, and bytes of all other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 2: -1, 5: 4}[key & 7]
        size = varint() if size < 0 else size
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """Pieces in the order of their ids, with scores and kinds, and what the file says of unknowns and blanks."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    unknown: str = " ⁇ "

    @staticmethod
    def read(path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        out, trainer, normalizer = Model(), {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                out.pieces.append(piece.get(1, b"").decode())
                out.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                out.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        # Numbers of the options in the model format: 3 type, 24 mark as suffix, 35 byte fallback, 44 unknown surface; 2 character map, 3 mark before, 4 blanks removed, 5 blanks marked.
        if trainer.get(3, 1) != MERGES or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1) or {USER_DEFINED, UNUSED} & {*out.kinds}:
            raise ValueError("a merge-type model with byte fallback, a mark before the text and no character map is needed")
        out.unknown = trainer[44].decode() if 44 in trainer else out.unknown
        return out


def without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row without its element at the given place."""
    stay = np.ones(rows.shape, dtype=bool)
    stay[np.arange(len(rows)), at] = False
    return rows[stay].reshape(len(rows), -1)


class Encoder:
    """Ids and decoded texts; lives inside a task."""

    def __init__(self, model: Model, check=None):
        """check: the library's processor of the same file, to compare with."""
        self.check = check
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.cost = {p: -model.scores[i] for p, i in self.ids.items()}
        self.packed = {p: struct.pack("<i", i) for p, i in self.ids.items()}
        self.packed_bytes = {int(p[3:5], 16): struct.pack("<i", i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        # The symbol of each character: its piece, else a number below zero.
        self.letters = -1 - np.arange(0x110000, dtype=np.int64)
        alone = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.letters[list(alone)] = list(alone.values())
        # Every way to put a piece together from two, by the ids of the two.
        halves = sorted(((self.ids[p[:k]] << 32) | self.ids[p[k:]], self.cost[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.keys = np.array([h[0] for h in halves] + [1 << 62], dtype=np.int64)
        self.key_cost, self.key_piece = np.array([h[1] for h in halves] + [NEVER]), np.array([h[2] for h in halves] + [-1], dtype=np.int64)
        crossed = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.chunks = re.compile(".+" if crossed else f"{MARK}+[^{MARK}]*", re.DOTALL)
        shown = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda p: model.unknown.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.shown = np.array([shown[k](p) for p, k in zip(model.pieces, model.kinds, strict=True)], dtype=object)
        self.kinds = np.array(model.kinds)
        self.cache: dict[str, bytes] = {}

    def scan(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Symbols of chunks of one length, a row each; (indices of the chunks, rows) as their agendas run empty.

        An agenda is an array, the cost of each pair at its left symbol's place.  All chunks take the best pair of
        theirs at the same time, so they have lost one symbol each and keep a common length.
        """
        symbols = self.letters[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")].reshape(len(chunks), -1)
        agenda, merged = self.pairs(symbols[:, :-1], symbols[:, 1:])
        index = np.arange(len(chunks))
        while agenda.shape[1]:
            at = agenda.argmin(axis=1)  # of equal costs the leftmost
            row = np.arange(len(at))
            work = agenda[row, at] < NEVER
            if not work.all():
                yield index[~work], symbols[~work]
                index, symbols, agenda, merged, at = index[work], symbols[work], agenda[work], merged[work], at[work]
                row = np.arange(len(at))
            if not len(index):
                return
            symbols[row, at] = merged[row, at]
            symbols, agenda, merged = without(symbols, at + 1), without(agenda, at), without(merged, at)
            for left in (at - 1, at):
                ok = (left >= 0) & (left < agenda.shape[1])
                r, k = row[ok], left[ok]
                agenda[r, k], merged[r, k] = self.pairs(symbols[r, k], symbols[r, k + 1])
        yield index, symbols

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of the piece that two symbols make together, where they make one."""
        key = np.where((left >= 0) & (right >= 0), (left << 32) | right, -1)
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.key_cost[at], NEVER), np.where(found, self.key_piece[at], -1)

    def packed_rows(self, symbols: np.ndarray) -> list[bytes]:
        """Rows of ids as bytes; characters that are no piece become their byte pieces."""
        data, wide = symbols.astype("<i4").tobytes(), 4 * symbols.shape[1]
        out = [data[k : k + wide] for k in range(0, len(data), wide)]
        for r in np.flatnonzero((symbols < 0).any(axis=1)).tolist():
            out[r] = b"".join(struct.pack("<i", i) if i >= 0 else self.packed_char(chr(-1 - i)) for i in symbols[r].tolist())
        return out

    def packed_char(self, char: str) -> bytes:
        return b"".join(self.packed_bytes[b] for b in char.encode("utf-8", "replace"))

    def merge_long(self, chunk: str) -> list[str]:
        """The symbols that are left of a long chunk: its agenda is a heap of pairs, and the symbols are a linked list."""
        symbols: list[str] = list(chunk)
        n = len(symbols)
        cost = self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[pair], i, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            right = after[i]
            if not left or right >= n or len(left) + len(symbols[right]) != len(pair):
                continue
            symbols[i], symbols[right] = pair, ""
            after[i] = beyond = after[right]
            if beyond < n:
                before[beyond] = i
                if (grown := pair + symbols[beyond]) in cost:
                    heapq.heappush(agenda, (cost[grown], i, grown))
            if (ahead := before[i]) >= 0 and (grown := symbols[ahead] + pair) in cost:
                heapq.heappush(agenda, (cost[grown], ahead, grown))
        return [s for s in symbols if s]

    def learn(self, chunks: list[str]) -> None:
        """Puts the chunks' ids, as little-endian 32-bit integers, into the cache."""
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c), []).append(c)
        for length, group in by_length.items():
            if length > SHORT_CHUNK:
                self.cache.update((c, b"".join(self.packed.get(x) or self.packed_char(x) for x in self.merge_long(c))) for c in group)
                continue
            for index, symbols in self.scan(group):
                self.cache.update(zip(map(group.__getitem__, index.tolist()), self.packed_rows(symbols), strict=True))

    def compare(self, chunks: list[str]) -> None:
        """A chunk alone is what the library encodes when it is given the chunk without its first mark, which it sets itself."""
        told = [c for c in chunks if len(c) > 1]
        mine = list(map(self.cache.__getitem__, told))
        theirs = self.check.encode([c[1:] for c in told], num_threads=1)
        flat = np.array(list(chain.from_iterable(theirs)), dtype="<i4").tobytes()
        if b"".join(mine) != flat or [len(m) for m in mine] != [4 * len(t) for t in theirs]:
            wrong = next(c for c, m, t in zip(told, mine, theirs, strict=True) if np.frombuffer(m, dtype="<i4").tolist() != t)
            raise ValueError(f"{wrong!r}: not as the sentencepiece library encodes")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit integers."""
        cut = [self.chunks.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache = self.cache
        new = [c for c in set().union(*cut) if c not in cache]
        self.learn(new)
        if self.check:
            self.compare(new)
        out = [np.frombuffer(b"".join(map(cache.__getitem__, chunks)), dtype="<i4") for chunks in cut]
        for c in new:
            if len(c) > LONG_CHUNK:
                del cache[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.shown))]
        data = b"".join(self.shown[ids].tolist())
        # The mark before the text: one blank of the first piece that shows anything, unless a byte stands there.
        front = ids[:1] if len(ids) and self.kinds[ids[0]] != CONTROL else ids[self.kinds[ids] != CONTROL][:1]
        if len(front) and self.kinds[front[0]] == NORMAL and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return self.decode_runs(ids)

    def decode_runs(self, ids: np.ndarray) -> str:
        """As ``decode``, where some bytes are no characters: runs of byte pieces are decoded by themselves."""
        is_byte = self.kinds[ids] == BYTE
        cuts = np.flatnonzero(np.diff(is_byte)) + 1
        out, bare = [], True
        for run in np.split(ids, cuts):
            if self.kinds[run[0]] == BYTE:
                out.append(b"".join(self.shown[run].tolist()).decode("utf-8", "quillstone_bytewise"))
                bare = False
                continue
            text = b"".join(self.shown[run].tolist()).decode("utf-8")
            first = run[self.kinds[run] != CONTROL][:1]
            if bare and len(first):
                text = text[1:] if self.kinds[first[0]] == NORMAL and text[:1] == " " else text
                bare = False
            out.append(text)
        return "".join(out)


def lists_of(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *ids]), pa.int32()))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", check_path: str | None = None) -> DataFrame:
    """id, ``ids`` (array of int) and ``decoded``; every batch is compared with the library's, if it is given a file."""
    model = docs.sparkSession.sparkContext.broadcast(Model.read(path))
    library = docs.sparkSession.sparkContext.broadcast(Path(check_path).read_bytes() if check_path else b"")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = StructType([rows.schema[0], *StructType.fromDDL("ids array<int>, decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = None
        if library.value:
            from sentencepiece import SentencePieceProcessor

            check = SentencePieceProcessor(model_proto=library.value)
        encoder = Encoder(model.value, check)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = encoder.encode(texts)
                decoded = list(map(encoder.decode, ids))
                if check:
                    for i, (mine, shown) in enumerate(zip(ids, decoded, strict=True)):
                        if shown != check.decode(mine.tolist()):
                            raise ValueError(f"{part.column(0)[i].as_py()}: not as the sentencepiece library decodes")
                yield pa.RecordBatch.from_arrays([part.column(0), lists_of(ids), pa.array(decoded, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``decoded``, the text of an array of ids (null elements are left out)."""
    model = encoded.sparkSession.sparkContext.broadcast(Model.read(path))
    rows = encoded.select(F.col(id_col), F.array_compact(F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))).alias("_ids"))
    schema = StructType([rows.schema[0], *StructType.fromDDL("decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                texts = [encoder.decode(np.asarray(ids, dtype=np.int32)) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns, from the operator's ids and texts; every batch is checked."""
    path = path or default_path()
    out = encode(docs, path, check_path=path)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
