"""Vectorised word hashing of whole texts, for use inside Spark tasks.

A text is lower-cased (A-Z only) and cut at the bytes 0x20 and 0x09-0x0D.  Each word gets a 64-bit hash of
its bytes, for a batch of texts at once: eight bytes at a time are mixed into a running value that starts
from the word's length.  Words of up to eight bytes can't collide with others of their length; for longer
ones every step goes through a full mixer, so no family of words is known to collide.  Words of more than
``LONG_WORD`` bytes are hashed by BLAKE2b one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
LONG_WORD = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Cuts at every ASCII character that is no letter or digit; other characters belong to words.
PUNCTUATED = np.ones(256, dtype=bool)
PUNCTUATED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_KEEP = (np.uint64(_MASK) >> (np.uint64(8) * np.arange(7, -1, -1, dtype=np.uint64))).astype(np.uint64)  # the first 1 to 8 bytes

CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive UTF-8 texts in lists of about ``limit`` bytes (null: empty); a longer text stands alone."""
    out: list[bytes] = []
    size = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if out and size + len(b) + 1 > limit:
            yield out
            out, size = [], 0
        out.append(b)
        size += len(b) + 1
    if out:
        yield out


def word_hashes(docs: list[bytes], gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets: words of text i are hashes[offsets[i]:offsets[i+1]])."""
    lens = np.fromiter((len(d) + 1 for d in docs), dtype=np.int64, count=len(docs))
    ends = np.cumsum(lens)
    joined = np.frombuffer(b" ".join(docs) + b" " * 8, dtype=np.uint8)
    word = ~gaps[joined[:-7]]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.searchsorted(starts, ends)))
    buf = _LOWER[joined]
    lanes = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    left = stops - starts
    h = left.astype(np.uint64) * np.uint64(_MULT)
    long = np.flatnonzero(left > LONG_WORD)
    now = np.flatnonzero(left <= LONG_WORD) if len(long) else np.arange(len(left))
    at, left = starts[now], left[now]
    while len(now):
        h[now] = mix(h[now] ^ (lanes[at] & _KEEP[np.minimum(left, 8) - 1]))
        more = left > 8
        now, at, left = now[more], at[more] + 8, left[more] - 8
    for i in long:
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : stops[i]].tobytes(), digest_size=8).digest(), "little")
    return h, offsets


_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position but the last n-1."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    out = np.full(m, (n * _MULT) & _MASK, dtype=np.uint64)
    for i in range(n):
        out = mix(out + h[i : i + m] * (_STEP[i % 8] + np.uint64(2 * (i // 8)))) if i % 8 == 7 else out + (h[i : i + m] ^ (h[i : i + m] >> np.uint64(29))) * _STEP[i % 8]
    return mix(out)


def shingle_sets(docs: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingles of each text; with fewer words the whole sequence is one shingle."""
    h, offsets = word_hashes(docs)
    all_grams = grams(h, n)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        k = int(b - a)
        if k >= n:
            yield np.unique(all_grams[a : b - n + 1])
        elif k:
            yield grams(h[a:b], k)
        else:
            yield h[:0]
