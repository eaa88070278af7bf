"""Structural metrics over logical edges, with exact ratios.

Ratios keep integer numerator and denominator and are rounded once, half to
even, at scale 12.  A zero denominator is NOT_APPLICABLE, unknown inputs make
a metric WITHHELD; neither has a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 12


def ratio(n: Column, d: Column) -> Column:
    """Exact quotient of integers, rounded half to even at scale 12."""
    a, b = n.cast("decimal(20,0)"), d.cast("decimal(20,0)")
    return F.bround(a / F.nullif(b, F.lit(0).cast("decimal(20,0)")), SCALE).cast("decimal(38,12)")


def status(d: Column, unknown: Column | None = None) -> Column:
    s = F.when(d == 0, "NOT_APPLICABLE").otherwise("COMPLETE")
    return s if unknown is None else F.when(unknown > 0, "WITHHELD").otherwise(s)


def degrees(edges: DataFrame) -> DataFrame:
    """(context, node, fan_in, fan_out): distinct neighbours, self excluded.

    Both directions are tagged rows of one aggregation, so there is one
    shuffle, combined on the map side."""
    e = edges.where("source <> target").select("context", "source", "target").distinct()
    both = e.select("context", F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return both.groupBy("context", F.col("x.node").alias("node")).agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def instability(degree: DataFrame) -> DataFrame:
    """Ce / (Ca + Ce) of every node."""
    total = F.col("fan_in") + F.col("fan_out")
    return degree.withColumn("instability", ratio(F.col("fan_out"), total)).withColumn("status", status(total))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected ordered pairs over n(n-1), per context."""
    pairs = edges.where("source <> target").select("context", "source", "target").distinct().groupBy("context").agg(F.count("*").alias("pairs"))
    n = nodes.select("context", "identity").distinct().groupBy("context").agg(F.count("*").alias("n_nodes"))
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return n.join(pairs, "context", "left").select("context", "n_nodes", F.coalesce("pairs", F.lit(0)).alias("pairs")).withColumn(
        "density", ratio(F.col("pairs"), possible)).withColumn("status", status(possible))


def abstractness(types: DataFrame) -> DataFrame:
    """Abstract types over types, per (context, owner)."""
    return types.groupBy("context", "owner").agg(F.count("*").alias("n_types"), F.count_if("abstract").alias("n_abstract")).withColumn(
        "abstractness", ratio(F.col("n_abstract"), F.col("n_types"))).withColumn("status", status(F.col("n_types")))


def distance(abstract: DataFrame, degree: DataFrame) -> DataFrame:
    """|A + I - 1| from the exact operands: |a(ci+ce) + ce n - n(ci+ce)| / (n(ci+ce))."""
    d = degree.withColumnRenamed("node", "owner")
    t = F.col("fan_in") + F.col("fan_out")
    j = abstract.join(d, ["context", "owner"], "left").na.fill(0, ["fan_in", "fan_out"])
    numerator = F.abs(F.col("n_abstract") * t + F.col("fan_out") * F.col("n_types") - F.col("n_types") * t)
    denominator = F.col("n_types") * t
    return j.select("context", "owner", ratio(numerator, denominator).alias("distance"), status(denominator).alias("status"))


def hotspots(degree: DataFrame, top: int) -> DataFrame:
    """The ``top`` nodes by fan-in + fan-out of each context (a feature), with
    the exact population beside each."""
    w = Window.partitionBy("context").orderBy(F.desc("degree"), "node")
    d = degree.select("context", "node", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    # counting the degree keeps both sides alike, so their exchange is reused
    population = d.groupBy("context").agg(F.count("degree").alias("population"))
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).join(population, "context").select("context", "place", "node", "degree", "population")


def concentration(degree: DataFrame) -> DataFrame:
    """Largest fan-in over connected pairs."""
    return degree.groupBy("context").agg(F.max("fan_in").alias("most"), F.sum("fan_in").alias("pairs")).withColumn(
        "concentration", ratio(F.col("most"), F.col("pairs"))).withColumn("status", status(F.col("pairs")))


def crossings(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Logical edges between different layers; (context, node, layer)."""
    a = layers.select("context", F.col("node").alias("source"), F.col("layer").alias("from_layer"))
    b = layers.select("context", F.col("node").alias("target"), F.col("layer").alias("to_layer"))
    return edges.select("context", "source", "target").distinct().join(a, ["context", "source"]).join(b, ["context", "target"]).groupBy("context").agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("from_layer") != F.col("to_layer")).alias("n_crossings"))
