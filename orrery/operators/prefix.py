"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_total(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """``name``: sum of ``value`` up to each row of its group, in ``order``.

    Rows are range-partitioned on (group, order), so a large group is many
    partitions; totals of whole partitions are summed up apart (one row per
    group and partition) and added to the sums inside each.  The partitioned
    rows are checkpointed, since both sides must see the same partitions."""
    rows = checkpointed(df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(group, "_part").agg(F.sum(value).alias("_sum")).select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_own", F.sum(value).over(inside)).join(base, [group, "_part"]).withColumn(name, F.col("_own") + F.col("_base")).drop("_own", "_base", "_part")
