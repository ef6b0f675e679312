"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_neighbours
from .audit import op11_audit
from .bpe import op6_bpe
from .codes import op12_codes
from .common import table
from .decontaminate import op5_decontaminate
from .licenses import op9_licenses
from .lm import op2_lm
from .neardup import op1_near_duplicates
from .oracles import ORACLE_SQL as ORACLE_SQL
from .pieces import op13_pieces
from .quality import op7_quality
from .secrets import op3_secrets
from .toxicity import op10_toxicity
from .urls import op8_urls


def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_bpe(table(spark, sf_dir, "documents"))


def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secrets(table(spark, sf_dir, "documents"))


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_near_duplicates(table(spark, sf_dir, "documents"))


def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_urls(table(spark, sf_dir, "pages"))


def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_licenses(table(spark, sf_dir, "documents"))


def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_lm(table(spark, sf_dir, "documents"))


def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_neighbours(table(spark, sf_dir, "embeddings"))


def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_codes(table(spark, sf_dir, "embeddings"))


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_pieces(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": q1,
    "op2_lm": q2,
    "op3_secrets": q3,
    "op4_neighbours": q4,
    "op5_decontaminate": q5,
    "op6_bpe": q6,
    "op7_quality": q7,
    "op8_urls": q8,
    "op9_licenses": q9,
    "op10_toxicity": q10,
    "op11_audit": q11,
    "op12_codes": q12,
    "op13_pieces": q13,
}
