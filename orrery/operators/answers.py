"""Filters, pages and populations behind reports and drill-downs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import traversal
from .prefix import running_total


def matching(rows: DataFrame, equals: dict[str, str] | None = None, contains: dict[str, str] | None = None, any_of: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows that equal every value of ``equals``, contain every text of
    ``contains`` in any case, and hold ``any_of``'s value in one of its columns.
    A null meets no condition."""
    for c, v in (equals or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        rows = rows.where(F.lower(c).contains(v.lower()))
    if any_of:
        value, columns = any_of
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c) == value, F.lit(False))
        rows = rows.where(hit)
    return rows


def paged(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``rows`` with their ``place`` in the group, from 1 on, and their ``page``.

    Places are counted in two levels, so a group of any size has pages."""
    placed = running_total(rows.withColumn("_one", F.lit(1)), group, order, "_one", "place").drop("_one")
    return placed.withColumn("page", F.floor((F.col("place") - 1) / size).cast("bigint"))


def page_census(pages: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """(group, page, n, first, last, sound) of every page; ``sound`` unless a
    place is missing or a page that is not the last is not full."""
    p = pages.groupBy(group, "page").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.min("place").alias("low"), F.max("place").alias("high"))
    last = p.groupBy(group).agg(F.max("page").alias("_end"))
    full = (F.col("low") == F.col("page") * size + 1) & (F.col("high") - F.col("low") + 1 == F.col("n")) & ((F.col("page") == F.col("_end")) | (F.col("n") == size))
    return p.join(last, group).select(group, "page", "n", "first", "last", full.alias("sound"))


def same_population(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n_left, n_right, equal): are the members the same on both sides?
    Groups of one side only are unequal."""
    both = left.select(group, member, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(group, member, F.lit(0).alias("l"), F.lit(1).alias("r")))
    m = both.groupBy(group, member).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return m.groupBy(group).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), (F.count_if(F.col("l") != F.col("r")) == 0).alias("equal"))


def ordered(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(context, node, rank, status): configuration order by before and after
    links.  ORDERED nodes have the length of the longest way to them; nodes on
    a circle are CYCLE and what waits for one is HELD, both without a rank."""
    known = nodes.select("context", "node").distinct()
    e = edges.select("context", "source", "target").distinct()
    alone = known.join(e.where("source <> target").select("context", F.col("source").alias("node")).union(e.where("source <> target").select("context", "target")).distinct(), ["context", "node"], "left_anti")
    rank = traversal.schedule(e).unionByName(alone.withColumn("rank", F.lit(0)))
    circle = traversal.components(e).where("cyclic").select("context", "node", F.lit(True).alias("circle"))
    j = known.join(rank, ["context", "node"], "left").join(circle, ["context", "node"], "left")
    status = F.when(F.col("circle"), "CYCLE").when(F.col("rank").isNull(), "HELD").otherwise("ORDERED")
    return j.select("context", "node", F.when(status == "ORDERED", F.col("rank")).alias("rank"), status.alias("status"))


def topology(edges: DataFrame, choices: DataFrame) -> DataFrame:
    """(context, component, size, n_boundaries, n_conflicts) of the circles of a
    graph with open choices: ``choices`` (context, requirement, source, target)
    are its candidate edges.  A boundary is an edge that leaves the component; a
    requirement with several targets inside one component is a conflict, since
    only one of them can be selected."""
    c = traversal.components(edges)
    node = c.where("cyclic").select("context", "node", "component", "size")
    a = node.select("context", F.col("node").alias("source"), F.col("component").alias("from"))
    b = node.select("context", F.col("node").alias("target"), F.col("component").alias("into"))
    out = edges.join(a, ["context", "source"]).join(b, ["context", "target"], "left").where("into is null or into <> from").groupBy("context", F.col("from").alias("component")).agg(F.count("*").alias("n_boundaries"))
    inner = choices.join(a, ["context", "source"]).join(b, ["context", "target"]).where("into = from").groupBy("context", F.col("from").alias("component"), "requirement").agg(F.count_distinct("target").alias("k")).where("k > 1")
    clash = inner.groupBy("context", "component").agg(F.count("*").alias("n_conflicts"))
    return node.select("context", "component", "size").distinct().join(out, ["context", "component"], "left").join(clash, ["context", "component"], "left").na.fill(0, ["n_boundaries", "n_conflicts"])


def gap_scopes(observations: DataFrame, keys: list[str], at: str, gaps: str) -> DataFrame:
    """(keys, scope, gap): CURRENT gaps are those of the last observation of a
    key, HISTORY those of the ones before; the union of both is ALL.  Ties of
    the last observation are all current."""
    last = observations.groupBy(*keys).agg(F.max(at).alias("_last"))
    same = observations.join(last, keys).withColumn("scope", F.when(F.col(at) == F.col("_last"), "CURRENT").otherwise("HISTORY"))
    one = same.select(*keys, "scope", F.explode(gaps).alias("gap")).distinct()
    return one.unionByName(one.withColumn("scope", F.lit("ALL"))).distinct()


def top(rows: DataFrame, group: str, by: str, key: str, size: int) -> DataFrame:
    """The first ``size`` rows of each group by ``by`` descending, then ``key``
    (a limit of details, which is the feature); cut in pieces first."""
    piece = Window.partitionBy(group, "_piece").orderBy(F.col(by).desc(), F.col(key))
    whole = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(key))
    cut = rows.withColumn("_piece", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("place", F.row_number().over(piece)).where(F.col("place") <= size)
    return cut.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= size).drop("_piece")
