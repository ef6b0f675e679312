"""Quality classifier by compression (operator 7).

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.  A text is cut into
blocks of ``BLOCK_BYTES``, every block is compressed with either dictionary, and the difference of the
total sizes divided by their sum is the feature; a logistic curve fitted on labelled texts turns it into
a probability.  Whole texts are scored; only the fit uses a bounded sample of labelled rows.

Defined cases: a null text counts as empty; an empty text gets the feature 0 and so the curve's value
there; null labels are ignored, and of labels that contradict each other for one id the majority counts, at a tie
none; without both classes among the labels every score is the smoothed share of
good labels, on an empty table there is none.  A row with a null id is scored as any other.  Repeated rows give
repeated results.  Very long texts are scored whole; labelled texts of more than ``SAMPLE_CHARS`` characters stay
out of the fit.  Other columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, id_remainder

BLOCK_BYTES = 4096
#: Bounds of the labelled sample: rows of each class, and characters of a row that may enter it; longer labelled texts are only scored.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
DICT_BYTES = 64 * 1024


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class _Sizer:
    """Compressed sizes under the two dictionaries; built once in a task."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.packers = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=3)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def feature(self, text: str | None) -> float:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if not data:
            return 0.0
        view = memoryview(data)
        g, b = (sum(len(p.compress(view[i : i + BLOCK_BYTES])) for i in range(0, len(data), BLOCK_BYTES)) for p in self.packers)
        return (b - g) / (b + g)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton steps on the penalised likelihood."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2) * len(y) / 100, a.T @ (y - p) - ridge * len(y) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """At most ``rows`` labelled ids of each class in the order of a hash of the id, with their texts: (key, text, label).

    The ids are chosen among the labels alone; 2 * ``rows`` ids are what the join broadcasts, so no text is shuffled.
    """
    votes = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)").groupBy("key").agg(F.avg("label").alias("share"))
    marks = votes.where("share <> 0.5").select("key", F.round("share").cast("int").alias("label"))
    chosen = [marks.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(rows) for v in (0, 1)]
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where(F.length("text").between(1, chars))
    return texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "key")


def class_sizes(labels: DataFrame, label: str) -> tuple[int, int]:
    """Rows labelled 0 and 1."""
    n = labels.agg(*(F.count(F.when(F.col(label) == v, 1)).alias(f"n{v}") for v in (0, 1))).first()
    return n.n0, n.n1


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> CompressionModel:
    """Dictionaries from one half of the sample, the curve from the other half."""
    import zstandard

    sample = labelled_sample(docs, labels, label, id_col, text_col, sample_rows).toPandas().sort_values(["key", "text"], ignore_index=True)
    good, bad = (sample[sample.label == v].text.tolist() for v in (1, 0))
    if len(good) < 2 or len(bad) < 2:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
        return CompressionModel(b"", b"", 0.0, math.log(share / (1 - share)))
    pieces = {}
    for name, texts in (("good", good), ("bad", bad)):
        blocks = [b[i : i + BLOCK_BYTES] for t in texts[::2] for b in [t.encode("utf-8", "surrogatepass")] for i in range(0, len(b), BLOCK_BYTES)]
        try:
            pieces[name] = zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, blocks)) // 8)), blocks).as_bytes()
        except zstandard.ZstdError:  # too few texts for training: their own ends serve as a raw dictionary
            pieces[name] = b"".join(blocks)[-DICT_BYTES:]
    sizer = _Sizer(pieces["good"], pieces["bad"])
    x = np.array([sizer.feature(t) for t in good[1::2] + bad[1::2]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    slope, offset = _logistic(x, y)
    n0, n1 = class_sizes(labels, label)
    offset += math.log(n1 / n0) - math.log(len(good) / len(bad))  # the sample holds as many of either class
    return CompressionModel(pieces["good"], pieces["bad"], slope, offset)


def score(docs: DataFrame, model: CompressionModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, feature and score in [0, 1] of every text."""

    def start():
        sizer = _Sizer(model.good, model.bad) if model.good else None

        def make(texts: list[str | None]) -> list:
            x = np.array([sizer.feature(t) if sizer else 0.0 for t in texts], dtype=float)
            return [x, 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -700, 700)))]

        return make

    return add_columns(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "feature double, score double", start)


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: folds by crc32 of the id, threshold 0.3."""
    learn = labels.where(id_remainder(F.col("doc_id"), 5) != 0)
    scored = score(docs, fit(docs, learn))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
