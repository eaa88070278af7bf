"""Ranked search of named entities by many terms at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a name that are looked up for prefixes; longer terms are compared
#: behind them.
PREFIX = 4


def search(entities: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """(term, place, identity, form): the first ``size`` entities (identity,
    name) of each term, best form first and then by identity.

    Forms: 1 the identity itself, 2 the exact name, 3 the name in another
    case, 4 a name that begins with the term in any case.  Every form is an
    equi-join; terms shorter than ``PREFIX`` find prefixes by their own length.
    Null and empty terms find nothing.  Only ``size`` rows per term and
    partition are ever sorted together (a top-k, which is the feature)."""
    t = terms.select("term").where(F.coalesce(F.length("term"), F.lit(0)) > 0).distinct()
    e = entities.select("identity", "name").where("identity is not null").distinct()
    lower = t.withColumn("key", F.lower("term")).withColumn("head", F.substring(F.lower("term"), 1, PREFIX))
    one = e.join(t.withColumnRenamed("term", "identity"), "identity").select(F.col("identity").alias("term"), "identity", F.lit(1).alias("form"))
    case = e.withColumn("key", F.lower("name")).join(lower, "key").select("term", "identity", F.when(F.col("name") == F.col("term"), 2).otherwise(3).alias("form"))
    heads = e.withColumn("head", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda n: F.substring(F.lower("name"), F.lit(1), n)))))
    begins = heads.join(lower, "head").where(F.lower("name").startswith(F.col("key")) & (F.lower("name") != F.col("key"))).select("term", "identity", F.lit(4).alias("form"))
    best = one.unionByName(case).unionByName(begins).groupBy("term", "identity").agg(F.min("form").alias("form"))
    # two levels: a term with a third of all matches is cut down in pieces first
    piece = Window.partitionBy("term", "piece").orderBy("form", "identity")
    whole = Window.partitionBy("term").orderBy("form", "identity")
    cut = best.withColumn("piece", F.pmod(F.xxhash64("identity"), F.lit(64))).withColumn("place", F.row_number().over(piece)).where(F.col("place") <= size)
    return cut.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= size).select("term", "place", "identity", "form")
