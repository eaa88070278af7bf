"""The knowledge graph: contexts, nodes, edges; loading, scans, integrity.

A graph is a set of DataFrames.  Everything is scoped by ``context``; facts of
different contexts are never fused.  Exact repeats of a row count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table

TARGET = T.StructType([T.StructField("state", T.StringType()), T.StructField("identities", T.ArrayType(T.StringType())), T.StructField("unresolved_reference", T.StringType())])
NODE = T.StructType([T.StructField("identity", T.StringType()), T.StructField("context", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType()))])
EDGE = T.StructType([
    T.StructField("identity", T.StringType()), T.StructField("context", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("target", TARGET), T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("region", T.StringType())])
CONTEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("identity", "snapshot", "analysis", "evidence")])

CONTAINMENT = ("graph.contains", "graph.declares", "graph.owns-source")
IDENTITY = r"^[a-z][a-z0-9.\-]*:(sha256:[0-9a-f]{64}|.+)$"


@dataclass(frozen=True)
class Graph:
    contexts: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Graph:
        return Graph(*(table(spark, folder, f"kg_{t}") for t in ("contexts", "nodes", "edges")))

    def in_context(self, *contexts: str) -> Graph:
        """Only the given contexts; the filter reaches the parquet scan."""
        return Graph(self.contexts.where(F.col("identity").isin(*contexts)), self.nodes.where(F.col("context").isin(*contexts)), self.edges.where(F.col("context").isin(*contexts)))

    # -- normal forms -------------------------------------------------------
    def distinct_nodes(self) -> DataFrame:
        return self.nodes.dropDuplicates(["context", "identity", "kind"])

    def relationships(self) -> DataFrame:
        """Distinct edges with flat target columns; nothing is promoted."""
        return self.edges.select(
            "context", "identity", "kind", "source", F.col("target.state").alias("state"), F.col("target.identities").alias("targets"),
            F.col("target.unresolved_reference").alias("reference"), "region").distinct()

    def endpoints(self, *kinds: str) -> DataFrame:
        """One row per edge and target identity."""
        e = self.edges.where(F.col("kind").isin(*kinds)) if kinds else self.edges
        return e.select("context", "identity", "kind", "source", F.col("target.state").alias("state"), "region",
                        F.explode("target.identities").alias("target")).distinct()

    def pairs(self, *kinds: str, loops: bool = True) -> DataFrame:
        """Distinct resolved endpoints: what structure needs, in one shuffle
        (repeated rows and parallel edges fall together)."""
        e = self.edges.where(F.col("kind").isin(*kinds)) if kinds else self.edges
        x = e.where(F.col("target.state") == "RESOLVED").select("context", "source", F.explode("target.identities").alias("target"))
        return (x if loops else x.where("source <> target")).distinct()

    def logical(self, *kinds: str, loops: bool = True) -> DataFrame:
        """Logical edges: resolved edges grouped by endpoints."""
        x = self.endpoints(*kinds).where("state = 'RESOLVED'")
        if not loops:
            x = x.where("source <> target")
        return x.groupBy("context", "source", "target").agg(F.count("*").alias("n_supports"), F.sort_array(F.collect_set("kind")).alias("kinds"))

    # -- scans ---------------------------------------------------------------
    def by_kind(self, *kinds: str) -> DataFrame:
        return self.distinct_nodes().where(F.col("kind").isin(*kinds))

    def page(self, context: str, after: str | None, size: int) -> DataFrame:
        """Keyset page of one partition's nodes."""
        n = self.nodes.where(F.col("context") == context).select("identity", "kind").distinct()
        return (n.where(F.col("identity") > after) if after is not None else n).orderBy("identity").limit(size)

    def adjacency(self, context: str, node: str, incoming: bool) -> DataFrame:
        x = self.endpoints().where(F.col("context") == context)
        return x.where(F.col("target" if incoming else "source") == node)

    def evidence(self, *digests: str) -> DataFrame:
        """Nodes that rest on any of the digests."""
        return self.nodes.where(F.arrays_overlap("evidence", F.array(*map(F.lit, digests))))

    def manifest(self) -> DataFrame:
        """Counts of the distinct rows, one row per table."""
        def count(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
            return df.select(*keys).distinct().agg(F.count("*").alias("n_rows")).withColumn("part", F.lit(name))

        return count(self.contexts, "contexts", ["identity"]).unionByName(count(self.nodes, "nodes", ["context", "identity"])).unionByName(count(self.edges, "edges", ["context", "identity"]))

    # -- integrity -----------------------------------------------------------
    def violations(self) -> DataFrame:
        """(rule, context, identity) of every broken invariant.

        Skewed contexts do no harm: the anti joins are on (context, identity)."""
        n, e = self.nodes, self.relationships()
        known = n.select("context", F.col("identity").alias("node")).distinct()
        conflict = n.select("context", "identity", "kind").distinct().groupBy("context", "identity").agg(F.count("*").alias("m")).where("m > 1")
        homeless = n.select("context", "identity").distinct().join(self.contexts.select(F.col("identity").alias("context")).distinct(), "context", "left_anti")
        source = e.select("context", "identity", F.col("source").alias("node")).join(known, ["context", "node"], "left_anti")
        target = e.select("context", "identity", F.explode("targets").alias("node")).join(known, ["context", "node"], "left_anti")
        size = F.coalesce(F.size("targets"), F.lit(0))
        shape = e.where(~(((F.col("state") == "RESOLVED") & (size == 1)) | ((F.col("state") == "CANDIDATES") & (size >= 2)) | ((F.col("state") == "UNRESOLVED") & (size == 0) & F.col("reference").isNotNull())))
        bare = n.where(F.coalesce(F.size("evidence"), F.lit(0)) < 1)
        named = n.where(~F.col("identity").rlike(IDENTITY))
        parts = {"conflicting-node": conflict, "unknown-context": homeless, "dangling-source": source, "dangling-target": target, "target-shape": shape, "node-without-evidence": bare, "malformed-identity": named}
        out = None
        for rule, df in parts.items():
            part = df.select(F.lit(rule).alias("rule"), "context", "identity").distinct()
            out = part if out is None else out.unionByName(part)
        return out
