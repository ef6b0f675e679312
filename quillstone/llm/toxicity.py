"""Toxicity by gradient-boosted trees over dense features (operator 10).

1. Lexicon: from labelled texts, words and word beginnings whose document frequency in toxic texts is
   high against that in the others (counted in Spark; the list is bounded by ``LEXICON_SIZE``).
2. Features of every whole text: lexicon densities, second-person proximity, rates of capitals,
   punctuation and obfuscation.
3. Spark ML's gradient-boosted trees on a bounded sample of labelled rows, isotonic calibration on
   labelled rows that the trees haven't seen.

Defined cases: a null text counts as empty; texts without words get the smoothed share of toxic labels as
their score; null labels are ignored; without both classes among the labels every score is the smoothed share of toxic labels.
Rows with null ids are scored as any other, repeated rows give repeated results, an empty table none.  Very
long texts are scored whole.  ``score`` reads no other column of docs; ``reject`` keeps all of them, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, id_remainder, materialize, set_aside
from .quality import class_sizes, labelled_sample

#: Bounds of the fit: labelled rows of each class, characters of such a row (longer ones are only scored), and terms in the learned lexicon.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 50_000
LEXICON_SIZE = 400
MIN_TOXIC_DF = 3
MIN_TOXIC_SHARE = 0.008
MIN_LIFT = 8.0
PREFIXES = (4, 5)

# Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes su vosotros".split()

FEATURES = ["hits", "density", "distinct", "weight", "near_you", "you", "capitals", "shouted", "marks", "symbols", "obfuscated", "length"]

_WORD = re.compile(r"[^\W_]+")
_SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
_OBFUSCATED = re.compile(r"[0-9@$*!|]+[a-z]")


def lexicon_terms(words: Column) -> Column:
    """The distinct words of an array and their beginnings, written with a star."""

    def starts(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *map(starts, PREFIXES)))


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """term -> log lift, from (text, label) rows; at most ``LEXICON_SIZE`` terms reach the driver.

    Copies of one text would count its words again and again, so of the texts whose long words have the
    same smallest hash only one counts.
    """
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)"))
    sketch = F.coalesce(F.array_min(F.transform(F.filter(words, lambda w: F.length(w) >= 7), lambda w: F.xxhash64(w))), F.xxhash64("text"))
    labelled = materialize(labelled.select("text", "label", sketch.alias("sketch")).dropDuplicates(["label", "sketch"]))
    totals = labelled.agg(F.sum("label").alias("t"), F.count("label").alias("n")).first()
    toxic, clean = float(totals.t or 0), float((totals.n or 0) - (totals.t or 0))
    if not toxic or not clean:
        return {}
    counts = labelled.select("label", F.explode(lexicon_terms(words)).alias("term")).groupBy("term").agg(F.sum("label").alias("t"), F.count("label").alias("n")).where(F.col("t") >= max(MIN_TOXIC_DF, MIN_TOXIC_SHARE * toxic))
    lift = F.log(((F.col("t") + 0.1) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.1) / (clean + 1)))
    top = counts.select("term", lift.alias("lift"), "t").where(F.col("lift") >= F.log(F.lit(MIN_LIFT))).orderBy((F.col("lift") * F.col("t")).desc(), "term").limit(LEXICON_SIZE)
    return {r.term: float(r.lift) for r in top.collect()}


def features(docs: DataFrame, lexicon: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns and the array ``features``."""
    whole = {t: v for t, v in lexicon.items() if not t.endswith("*")}
    begin = {t[:-1]: v for t, v in lexicon.items() if t.endswith("*")}
    first = {t[:4] for t in begin} | {t[:4] for t in whole}
    you = frozenset(SECOND_PERSON)

    def weigh(w: str) -> float:
        return max(whole.get(w, 0.0), *(begin.get(w[:n], 0.0) for n in PREFIXES))

    def one(text: str | None) -> list[float]:
        if not isinstance(text, str) or not text:
            return [0.0] * len(FEATURES)
        low = text.lower()
        toks = _WORD.findall(low)
        n = max(len(toks), 1)
        hits = [(i, v) for i, w in enumerate(toks) if w[:4] in first and (v := weigh(w)) > 0]
        yous = {i for i, w in enumerate(toks) if w in you}
        near = sum(any(j in yous for j in range(i - 4, i + 5)) for i, _ in hits)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        caps = int(((data >= 65) & (data <= 90)).sum())
        shouted = len(_SHOUTED.findall(text))
        marks = text.count("!") + text.count("?")
        symbols = sum(text.count(c) for c in "#$%&*@|")
        return [
            float(len(hits)), len(hits) / n, float(len({toks[i] for i, _ in hits})), sum(v for _, v in hits) / n, near / n, len(yous) / n,
            caps / len(text), shouted / n, marks / len(text), symbols / len(text), len(_OBFUSCATED.findall(low)) / n, float(len(toks)),
        ]

    rows = docs.select(F.col(id_col), *map(F.col, keep), F.col(text_col).alias("_text"))
    return add_columns(rows, "features array<double>", lambda: lambda texts: [[one(t) for t in texts]])


def score(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", trees: int = 20, depth: int = 3) -> DataFrame:
    """id, raw tree probability and calibrated score of every text, learned from ``labels``."""
    return fitted(docs, labels, label=label, id_col=id_col, text_col=text_col, trees=trees, depth=depth)(docs)


def reject(docs: DataFrame, labels: DataFrame, *, most: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score stays below ``most``."""
    aside, back = set_aside(docs, text_col)
    scored = fitted(docs, labels, id_col=id_col, text_col=text_col)(aside, "_kept0", "_text", tuple(aside.columns[1:-1]))
    return scored.where(F.col("score") < most).select(*back)


def fitted(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", trees: int = 20, depth: int = 3) -> Callable[..., DataFrame]:
    """Learns from ``labels``; the function that comes back adds raw and score to the id and kept columns of texts."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, SAMPLE_ROWS, SAMPLE_CHARS)
    sample = materialize(sample.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(4))))
    seen = {(r.fold == 0, r.label) for r in sample.select("fold", "label").distinct().collect()}
    if seen != {(True, 0), (True, 1), (False, 0), (False, 1)}:
        n = sample.agg(F.sum("label").alias("t"), F.count("label").alias("n")).first()
        prior = F.lit(((n.t or 0) + 1) / (n.n + 2))
        return lambda texts, id_col=id_col, text_col=text_col, keep=(): texts.select(F.col(id_col), *keep, prior.alias("raw"), prior.alias("score"))
    lexicon = learn_lexicon(sample.where("fold <> 0"))
    rows = materialize(features(sample, lexicon, id_col="key", keep=("label", "fold")))
    vectors = rows.withColumn("vector", array_to_vector("features"))
    n0, n1 = class_sizes(labels, label)
    held = {r.label: r.n for r in sample.where("fold = 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = GBTClassifier(featuresCol="vector", labelCol="label", predictionCol="guess", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, minInstancesPerNode=2).fit(vectors.where("fold <> 0").coalesce(2))
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    calibration = raw(vectors.where("fold = 0")).select(F.col("label").cast("double").alias("label"), "raw", F.when(F.col("label") == 1, n1 / held[1]).otherwise(n0 / held[0]).alias("weight"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score", weightCol="weight").fit(calibration)

    def apply(texts: DataFrame, id_col: str = id_col, text_col: str = text_col, keep: tuple[str, ...] = ()) -> DataFrame:
        scored = raw(features(texts, lexicon, id_col=id_col, text_col=text_col, keep=keep).withColumn("vector", array_to_vector("features")))
        out = curve.transform(scored.select(F.col(id_col), *keep, "raw", (F.element_at("features", -1) == 0).alias("_wordless")))
        score = F.when(F.col("_wordless"), F.lit((n1 + 1) / (n0 + n1 + 2))).otherwise(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
        return out.select(F.col(id_col), *keep, "raw", score.alias("score"))

    return apply


def op10_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: folds by crc32 of the id, threshold 0.5."""
    learn = labels.where(id_remainder(F.col("doc_id"), 5) != 0)
    return score(docs, learn).select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
