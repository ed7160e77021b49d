"""One registered query per operator: ``name -> (builder, oracle_sql or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import (bwtmerge, chat, decontaminate, fmindex, jaccard, language, pieces, pii, quality, resample, secrets, topk,
                          whiten)
from tillroll.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwtmerge.report(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.report(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.report(table(spark, sf_dir, "embeddings"))


ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_secret_scan": (op2_secret_scan, secrets.ORACLE),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_exact_topk": (op4_exact_topk, topk.ORACLE),
    "op5_quality": (op5_quality, None),
    "op6_substring_dedup": (op6_substring_dedup, None),
    "op7_decontaminate": (op7_decontaminate, None),
    "op8_sentencepiece": (op8_sentencepiece, None),
    "op9_jaccard_join": (op9_jaccard_join, None),
    "op10_pii": (op10_pii, None),
    "op11_resample": (op11_resample, resample.ORACLE),
    "op12_chat_format": (op12_chat_format, chat.ORACLE),
    "op13_whiten": (op13_whiten, None),
}
