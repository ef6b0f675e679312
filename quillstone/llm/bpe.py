"""BPE encoding and decoding (operator 6).

A word is a contiguous array of part ids beside an array of the ranks of adjacent pairs.  The smallest
rank is searched again and again, its boundary deleted and the neighbouring ranks refreshed; all new words
of one length take each such step together, as rows of two arrays.  Words of more than ``LONG_WORD`` parts take a heap over the same parts, so that no word costs the square of its
length.  Every Spark task keeps the distinct words that it has met in a bounded cache.

Files of the byte-level kind with word ends are read (normalisers NFC, white space to one blank, lower
case; no decoder: decoding joins the tokens with blanks).  The vocabulary is read once on the driver and
broadcast; its size is that of the file.

Defined cases: a null text counts as empty, an empty text has no ids and decodes to the empty string.
Special tokens in a text become their ids.  Repeated rows and rows with null ids give a row each, an empty table
none.  Very long texts and words are encoded whole.  Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

LONG_WORD = 64
CACHE_WORDS = 100_000
#: Rows that leave a task at once.
OUT_ROWS = 256
_NONE = 1 << 62
#: Stands before a special token among the words of a text; no word holds it with a letter after it.
_MARK = "\0<"


@dataclass
class Vocabulary:
    """What a tokenizer file says: token ids, merges (left, right, whole id) in rank order, special tokens, word-splitting pattern."""

    ids: dict[str, int]
    merges: np.ndarray
    special: dict[str, int]
    pattern: str
    word_end: str

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        split = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        ids = model["vocab"]
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], dtype=np.int64).reshape(-1, 3)
        return Vocabulary(ids, merges, {t["content"]: t["id"] for t in data["added_tokens"]}, split, model["end_of_word_suffix"] or "")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Ids and tokens of texts; lives inside a task."""

    def __init__(self, vocab: Vocabulary):
        token = {i: t for t, i in vocab.ids.items()} | {i: t for t, i in vocab.special.items()}
        keys = (vocab.merges[:, 0] << 32) | vocab.merges[:, 1]
        order = np.argsort(keys)
        self.pairs, self.pair_rank = np.append(keys[order], _NONE), np.append(order, _NONE)
        self.rank: dict[int, int] = {}
        self.keys = keys
        self.merged = vocab.merges[:, 2]
        letters = byte_letters()
        self.inner = np.array([vocab.ids.get(c, -1) for c in letters])
        self.last = np.array([vocab.ids.get(c + vocab.word_end, -1) for c in letters])
        self.names = np.array([token.get(i, "") for i in range(max(token, default=0) + 1)], dtype=object)
        self.words = regex.compile(vocab.pattern)
        # The same pattern for lower-case ASCII texts.
        self.plain_words = re.compile(vocab.pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9"))
        self.special = vocab.special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.cache: dict[str, bytes] = {}

    def _scan(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Part ids of words of one length, a row each; (indices of the words, rows) as their merging ends.

        Every step scans each word's ranks for the smallest, deletes that boundary and refreshes the ranks
        beside it; the words still at work have lost one boundary each, so they keep a common length.
        """
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)
        parts = self.inner[flat]
        parts[:, -1] = self.last[flat[:, -1]]
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        index = np.arange(len(words))
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            work = least < _NONE
            if not work.all():
                yield index[~work], parts[~work]
                index, parts, ranks, at, least = index[work], parts[work], ranks[work], at[work], least[work]
            if not len(index):
                return
            row = np.arange(len(index))
            parts[row, at] = self.merged[least]
            stay = np.ones(parts.shape, dtype=bool)
            stay[row, at + 1] = False
            parts = parts[stay].reshape(len(row), -1)
            stay = np.ones(ranks.shape, dtype=bool)
            stay[row, at] = False
            ranks = ranks[stay].reshape(len(row), -1)
            for left in (at - 1, at):
                ok = (left >= 0) & (left < ranks.shape[1])
                r, k = row[ok], left[ok]
                ranks[r, k] = self.ranks(parts[r, k], parts[r, k + 1])
        yield index, parts

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NONE)

    def _heap(self, parts: list[int]) -> list[int]:
        if not self.rank:
            self.rank = dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True))
        get, n = self.rank.get, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i] << 32) | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = int(self.merged[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (k := get((parts[x] << 32) | parts[after[x]], _NONE)) != _NONE:
                    heapq.heappush(heap, (k, x, parts[x], parts[after[x]]))
        return [p for p, there in zip(parts, alive, strict=True) if there]

    def learn(self, words: list[str]) -> None:
        """Puts the words' ids, as little-endian unsigned 32-bit integers, into the cache."""
        by_length: dict[int, tuple[list[str], list[bytes]]] = defaultdict(lambda: ([], []))
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            group = by_length[len(data)]
            group[0].append(w)
            group[1].append(data)
        for length, (names, group) in by_length.items():
            if length > LONG_WORD:
                found = ((np.array([i]), np.array([self._heap([*self.inner[list(d[:-1])].tolist(), int(self.last[d[-1]])])])) for i, d in enumerate(group))
            else:
                found = self._scan(group)
            for index, parts in found:
                data, wide = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
                self.cache.update(zip(map(names.__getitem__, index.tolist()), (data[k : k + wide] for k in range(0, len(data), wide)), strict=True))

    def pieces(self, text: str | None) -> list[str]:
        """Words and special tokens of a text, in order; a special token stands as itself, with its mark before it."""
        if not isinstance(text, str) or not text:
            return []
        out: list[str] = []
        for piece in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if piece in self.special:
                out.append(_MARK + piece)
                continue
            if piece.isascii():
                out += self.plain_words.findall(piece.lower())
                continue
            plain = unicodedata.normalize("NFC", piece)
            out += self.words.findall("".join(map(str.lower, plain)) if "Σ" in plain else plain.lower())  # letter by letter: no final sigma
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        distinct = set().union(*cut)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache.update((_MARK + t, struct.pack("<I", i)) for t, i in self.special.items())
        self.learn([w for w in distinct if w not in self.cache])
        out = [b"".join(map(self.cache.__getitem__, words)) for words in cut]
        for w in distinct:
            if len(w) > LONG_WORD:
                self.cache.pop(w)
        return out

    def decode(self, ids: bytes | None) -> str:
        """The tokens joined with blanks; ids outside the vocabulary are left out."""
        found = np.frombuffer(ids or b"", dtype="<u4")
        names = self.names[found[found < len(self.names)]].tolist()
        return " ".join(names if all(names) else filter(None, names))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (the text that the ids decode to)."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slices of the incoming batch: only OUT_ROWS texts at a time are Python strings.
        encoder = Encoder(vocab.value)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                ids = encoder.encode(part.column(1).to_pylist())
                texts = list(map(encoder.decode, ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids binary, decoded string")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text of packed ids: tokens joined with blanks; ids outside the vocabulary are left out."""
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def start():
        encoder = Encoder(vocab.value)
        return lambda ids: [list(map(encoder.decode, ids))]

    return add_columns(encoded.select(F.col(id_col), F.col(ids_col).alias("_ids")), "decoded string", start)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns, from the operator's ids and texts."""
    out = encode(docs, path or default_path())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
