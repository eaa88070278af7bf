"""Queries of the llm problems over a folder of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import packing, source_syntax, text_quality, tokenizer


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return source_syntax.malformed(table(spark, d, "documents"))


def p1_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return source_syntax.diagnose_sources(table(spark, d, "documents"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return source_syntax.rates(source_syntax.diagnose_sources(table(spark, d, "documents")))


def p1_causes(spark: SparkSession, d: str) -> DataFrame:
    return source_syntax.causes(source_syntax.diagnose_sources(table(spark, d, "documents")))


def p1_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return source_syntax.against_outcomes(
        source_syntax.diagnose_sources(table(spark, d, "documents")), table(spark, d, "source_outcomes"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenizer.count_documents(table(spark, d, "documents")))


def p7_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rate(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.statistics(text_quality.measure_documents(table(spark, d, "documents"), table(spark, d, "common_words")))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_diagnostics, p1_rates, p1_causes, p1_outcomes, p6_ids, p7_containers, p7_fill_rate, p8_found, p8_statistics)}
