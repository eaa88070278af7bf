"""Views of the star schema as a graph: modules, packages, types, worlds.

region = module, nation = package, customer and supplier = types; an order
line is an occurrence of "customer depends on supplier" in the world of its
order's year.  Its quantity tells what is known: 48 and more is a resolved
occurrence, 46 and 47 an unresolved one, less is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

WORLDS = [str(y) for y in range(1995, 2002)]


def packages(spark: SparkSession, d: str) -> DataFrame:
    """(package, name, module); a module is unknown for nations without region."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(F.col("n_nationkey").alias("package"), F.col("n_name").alias("name"), F.col("r_name").alias("module"))


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """(source package, target package, world, quantity, kind, before): one row
    per order line.  Types are small beside the lines, which are read once."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    order = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = line.join(order, line.l_orderkey == order.o_orderkey).join(customer, F.col("o_custkey") == customer.c_custkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return j.select(
        F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.year("o_orderdate").cast("string").alias("world"),
        F.col("l_quantity").alias("quantity"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderdate") < "1998-01-01").alias("before"), "l_suppkey", "o_custkey")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, world, truth) of the package graph; false has no row."""
    o = occurrences(spark, d).where("quantity >= 46").groupBy("source", "target", "world").agg(F.max("quantity").alias("q"))
    return o.select("source", "target", "world", F.when(F.col("q") >= 48, True).alias("truth"))


def named_edges(edges: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Names and modules of both endpoints."""
    p = packages(spark, d)
    s = p.select(F.col("package").alias("source"), F.col("name").alias("source_name"), F.col("module").alias("source_module"))
    t = p.select(F.col("package").alias("target"), F.col("name").alias("target_name"), F.col("module").alias("target_module"))
    return edges.join(s, "source").join(t, "target")


PACKAGES = "pk AS (SELECT n_nationkey AS package, n_name AS name, r_name AS module FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"
OCC = """occ AS (SELECT c_nationkey AS source, s_nationkey AS target, year(o_orderdate)::varchar AS world, l_quantity AS quantity, o_orderpriority AS kind,
 o_orderdate < '1998-01-01' AS before, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
FACTS = OCC + """, fa AS (SELECT source, target, world, CASE WHEN max(quantity) >= 48 THEN true END AS truth FROM occ WHERE quantity >= 46 GROUP BY ALL)"""
MEASURED = FACTS + """, me AS (SELECT source, target, count(*) FILTER (truth) AS n_true, 7 - count(*) AS n_false, count(*) FILTER (truth IS NULL) AS n_unknown, min(world) FILTER (truth) AS witness FROM fa GROUP BY ALL)"""
CLASSIFIED = MEASURED + """, cl AS (SELECT *, CASE WHEN n_unknown > 0 THEN 'UNKNOWN' WHEN n_false = 0 THEN 'MUST' WHEN n_true = 0 THEN 'NEVER' ELSE 'MAY' END AS quantifier FROM me)"""
