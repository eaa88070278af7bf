"""Queries of the general data problems over a folder of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpointed, own_folder, table
from . import hierarchy, incremental, nested_json, snapshots

#: Journal numbers of ``jobs`` are issued in steps of 100; others may occur.
JOURNAL_STEP = 100


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circles(hierarchy.hierarchy(table(spark, d, "readiness_modules")))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "readiness_modules"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(checkpointed(p2_hierarchy(spark, d)))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(checkpointed(p2_hierarchy(spark, d)))


def _indexes(spark: SparkSession) -> tuple[snapshots.OrdinalIndex, snapshots.OrdinalIndex]:
    folder = own_folder(spark, "ordinals")
    return snapshots.OrdinalIndex(spark, f"{folder}/inventory"), snapshots.OrdinalIndex(spark, f"{folder}/comparison")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    first, second = _indexes(spark)
    return snapshots.inventory_deltas(table(spark, d, "inventory"), table(spark, d, "seals"), first).unionByName(
        snapshots.comparison_deltas(table(spark, d, "comparison_rows"), second))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("snapshot", "delta").count().withColumnRenamed("count", "n_records")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.replay(table(spark, d, "jobs"), table(spark, d, "runs"), JOURNAL_STEP)


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    return incremental.processed_intervals(table(spark, d, "jobs"), table(spark, d, "runs"), JOURNAL_STEP)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.found(table(spark, d, "binding_reports"), table(spark, d, "native_cases"))


def p5_reports(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.reports(table(spark, d, "binding_reports"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.files(table(spark, d, "binding_reports"))


def p5_calls(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.calls(table(spark, d, "binding_reports"))


def p5_targets(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.targets(table(spark, d, "binding_reports"))


def p5_cases(spark: SparkSession, d: str) -> DataFrame:
    return nested_json.cases(table(spark, d, "native_cases"))


QUERIES = {f.__name__: f for f in (
    p2_found, p2_hierarchy, p2_descendants, p2_paths, p3_found, p3_counts, p4_found, p4_intervals, p5_found, p5_reports, p5_files, p5_calls, p5_targets, p5_cases)}
