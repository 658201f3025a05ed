"""The queries of this subpackage and their SQL; __spark_entry__ adds them if the subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, jaccard, lines, mixing, ogg, rnnlm, suffix, toxicity, warc
from .common import Scratch, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnnlm.scored(table(spark, sf_dir, "documents"), Scratch(spark))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derived_digests(table(spark, sf_dir, "pages"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_ogg_media, op3_decontamination, op4_soft_mixing, op5_recurrent_lm, op6_html_extraction, op7_line_dedup, op8_ngram_jaccard_join, op9_warc_derivatives, op10_suffix_array_dedup)}
ORACLE_SQL: dict[str, str] = {}
