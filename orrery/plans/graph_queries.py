"""Scans, filters, joins, traversal and metrics over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, traversal
from ..session import table
from ..sources.graph import CONTAINMENT, Graph
from .registry import query

N = "n AS (SELECT DISTINCT context, identity, kind FROM kg_nodes)"
X = """x AS (SELECT DISTINCT context, identity, kind, source, target.state AS state, region, unnest(target.identities) AS dst FROM kg_edges)"""
LE = X + """, le AS (SELECT context, source, dst AS target, count(*) AS n_supports, list_sort(list(DISTINCT kind)) AS kinds
 FROM x WHERE state = 'RESOLVED' GROUP BY context, source, dst)"""
REL = """rel AS (SELECT DISTINCT context, identity, kind, source, target.state AS state, target.identities AS targets, target.unresolved_reference AS reference, region FROM kg_edges)"""
DEP = X + """, d AS (SELECT DISTINCT context, source, dst AS target FROM x WHERE state = 'RESOLVED' AND kind IN ('java.extends', 'java.implements'))"""
ALL = X + """, d AS (SELECT DISTINCT context, source, dst AS target FROM x WHERE state = 'RESOLVED')"""
#: The kinds whose paths and circles are enumerated: single paths are results
#: there, of which a denser graph has exponentially many.
INHERITANCE = ("java.extends", "java.implements")


def _inheritance(spark: SparkSession, d: str) -> DataFrame:
    return Graph.load(spark, d).pairs(*INHERITANCE)


def _join(array: str) -> F.Column:
    return F.array_join(array, ",")


# -- scans ---------------------------------------------------------------------
@query("SELECT 'contexts' AS part, count(DISTINCT identity) AS n_rows FROM kg_contexts UNION ALL SELECT 'nodes', count(*) FROM (SELECT DISTINCT context, identity FROM kg_nodes) "
       "UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT context, identity FROM kg_edges)")
def s_manifest(spark, d):
    return Graph.load(spark, d).manifest()


@query("SELECT c.identity AS context, c.snapshot, coalesce(n.m, 0) AS n_nodes, coalesce(e.m, 0) AS n_edges FROM (SELECT DISTINCT identity, snapshot FROM kg_contexts) c "
       "LEFT JOIN (SELECT context, count(DISTINCT identity) AS m FROM kg_nodes GROUP BY 1) n ON n.context = c.identity "
       "LEFT JOIN (SELECT context, count(DISTINCT identity) AS m FROM kg_edges GROUP BY 1) e ON e.context = c.identity")
def s_partitions(spark, d):
    g = Graph.load(spark, d)
    n = g.nodes.select("context", "identity").distinct().groupBy("context").agg(F.count("*").alias("n_nodes"))
    e = g.edges.select("context", "identity").distinct().groupBy("context").agg(F.count("*").alias("n_edges"))
    return g.contexts.select(F.col("identity").alias("context"), "snapshot").distinct().join(n, "context", "left").join(e, "context", "left").na.fill(0, ["n_nodes", "n_edges"])


@query(f"WITH {N} SELECT context, identity, kind FROM n WHERE kind IN ('PACKAGE', 'MODULE')")
def s_by_kind(spark, d):
    return Graph.load(spark, d).by_kind("PACKAGE", "MODULE").select("context", "identity", "kind")


@query(f"WITH {X} SELECT context, dst AS node, source, kind, state FROM x")
def s_incoming(spark, d):
    return Graph.load(spark, d).endpoints().select("context", F.col("target").alias("node"), "source", "kind", "state", "identity").drop("identity")


@query("SELECT DISTINCT o.status, n.context, n.identity, n.digest FROM (SELECT context, identity, unnest(evidence) AS digest FROM kg_nodes) n JOIN source_outcomes o ON o.raw_digest = n.digest")
def s_evidence(spark, d):
    """Nodes to the source outcomes that their evidence names."""
    n = Graph.load(spark, d).nodes.select("context", "identity", F.explode("evidence").alias("digest"))
    o = table(spark, d, "source_outcomes").select(F.col("raw_digest").alias("digest"), "status")
    return n.join(o, "digest").select("status", "context", "identity", "digest").distinct()


@query(f"""WITH {N}, {REL},
k AS (SELECT context, identity AS node FROM n)
SELECT DISTINCT rule, context, identity FROM (
 SELECT 'conflicting-node' AS rule, context, identity FROM n GROUP BY context, identity HAVING count(*) > 1
 UNION ALL SELECT 'unknown-context', context, identity FROM n WHERE context NOT IN (SELECT identity FROM kg_contexts)
 UNION ALL SELECT 'dangling-source', context, identity FROM rel WHERE (context, source) NOT IN (SELECT (context, node) FROM k)
 UNION ALL SELECT 'dangling-target', context, identity FROM (SELECT context, identity, unnest(targets) AS t FROM rel) WHERE (context, t) NOT IN (SELECT (context, node) FROM k)
 UNION ALL SELECT 'target-shape', context, identity FROM rel WHERE NOT (state = 'RESOLVED' AND len(targets) = 1 OR state = 'CANDIDATES' AND len(targets) >= 2 OR state = 'UNRESOLVED' AND len(targets) = 0 AND reference IS NOT NULL)
 UNION ALL SELECT 'node-without-evidence', context, identity FROM kg_nodes WHERE coalesce(len(evidence), 0) < 1)""")
def s_violations(spark, d):
    return Graph.load(spark, d).violations()


# -- entities and edges -----------------------------------------------------------
@query(f"WITH {N}, r AS (SELECT context, identity, kind, row_number() OVER (PARTITION BY context ORDER BY identity) AS place FROM n) SELECT context, place::int AS place, identity, kind FROM r WHERE place BETWEEN 11 AND 20")
def q_page2(spark, d):
    """Second keyset page of ten nodes of every context (the page is the feature)."""
    w = Window.partitionBy("context").orderBy("identity")
    return Graph.load(spark, d).distinct_nodes().withColumn("place", F.row_number().over(w)).where("place between 11 and 20").select("context", "place", "identity", "kind")


@query(f"WITH {N} SELECT context, identity, kind FROM n WHERE identity LIKE 'package:%' OR contains(identity, 'abc')")
def q_entities(spark, d):
    """Entity search: qualified prefix or canonical part."""
    i = F.col("identity")
    return Graph.load(spark, d).distinct_nodes().where(i.startswith("package:") | i.contains("abc")).select("context", "identity", "kind")


@query(f"WITH {LE} SELECT context, source, target, n_supports, array_to_string(kinds, ',') AS kinds FROM le")
def q_edges(spark, d):
    return Graph.load(spark, d).logical().withColumn("kinds", _join("kinds"))


@query(f"WITH {REL} SELECT context, identity, kind, source, state, coalesce(array_to_string(targets, ','), '') AS targets, reference, region FROM rel")
def q_relationships(spark, d):
    return Graph.load(spark, d).relationships().withColumn("targets", F.coalesce(_join("targets"), F.lit("")))


@query(f"WITH {X}, c AS (SELECT DISTINCT context, source AS parent, dst AS child, kind FROM x WHERE state = 'RESOLVED' AND kind IN ('graph.contains', 'graph.declares', 'graph.owns-source')), {N} "
       "SELECT c.context, parent, child, c.kind, n.kind AS child_kind FROM c JOIN n ON n.context = c.context AND n.identity = c.child")
def q_children(spark, d):
    g = Graph.load(spark, d)
    c = g.endpoints(*CONTAINMENT).where("state = 'RESOLVED'").select("context", F.col("source").alias("parent"), F.col("target").alias("child"), "kind").distinct()
    return c.join(g.distinct_nodes().select("context", F.col("identity").alias("child"), F.col("kind").alias("child_kind")), ["context", "child"])


@query(f"WITH {DEP}, r AS (SELECT *, (row_number() OVER (PARTITION BY context, source ORDER BY target))::int AS place FROM d) SELECT * FROM r WHERE place <= 3")
def q_dependencies(spark, d):
    e = _inheritance(spark, d)
    return traversal.neighbourhood(e, e.select("context", F.col("source").alias("start")).distinct(), 3)


@query(f"WITH {N}, {LE} SELECT 'node' AS part, kind, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edge', k, count(*) FROM (SELECT unnest(kinds) AS k FROM le) GROUP BY k")
def q_summary(spark, d):
    g = Graph.load(spark, d)
    n = g.distinct_nodes().groupBy("kind").agg(F.count("*").alias("n")).withColumn("part", F.lit("node"))
    e = g.logical().select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")).withColumn("part", F.lit("edge"))
    return n.unionByName(e)


@query(f"WITH {REL} SELECT kind, state, count(*) AS n FROM rel GROUP BY ALL")
def q_edge_states(spark, d):
    return Graph.load(spark, d).relationships().groupBy("kind", "state").agg(F.count("*").alias("n"))


@query(f"""WITH {N}, {X} SELECT x.context, s.kind AS source_kind, t.kind AS target_kind, CASE WHEN state = 'RESOLVED' THEN 'DEFINITE' ELSE 'UNKNOWN' END AS truth, count(*) AS n
FROM x JOIN n s ON s.context = x.context AND s.identity = x.source JOIN n t ON t.context = x.context AND t.identity = x.dst GROUP BY ALL""")
def j_endpoints(spark, d):
    """Edges joined to both endpoints; targets not resolved are demoted to unknown."""
    g = Graph.load(spark, d)
    n = g.distinct_nodes()
    x = g.endpoints().join(n.select("context", F.col("identity").alias("source"), F.col("kind").alias("source_kind")), ["context", "source"]).join(
        n.select("context", F.col("identity").alias("target"), F.col("kind").alias("target_kind")), ["context", "target"])
    return x.groupBy("context", "source_kind", "target_kind", F.when(F.col("state") == "RESOLVED", "DEFINITE").otherwise("UNKNOWN").alias("truth")).agg(F.count("*").alias("n"))


@query(f"WITH {N}, {LE}, t AS (SELECT context, identity FROM n WHERE kind = 'TYPE') SELECT le.context, le.source, le.target FROM le SEMI JOIN t a ON a.context = le.context AND a.identity = le.source "
       "SEMI JOIN t b ON b.context = le.context AND b.identity = le.target WHERE le.source <> le.target")
def j_induced(spark, d):
    """Subgraph induced by the type nodes, without loops (semi joins)."""
    g = Graph.load(spark, d)
    t = g.by_kind("TYPE").select("context", "identity")
    return g.pairs(loops=False).join(t.withColumnRenamed("identity", "source"), ["context", "source"], "left_semi").join(
        t.withColumnRenamed("identity", "target"), ["context", "target"], "left_semi")


@query(f"""WITH {X}, r AS (SELECT *, row_number() OVER (PARTITION BY context, source, dst, kind ORDER BY region IS NULL, region, identity) AS place FROM x)
SELECT context, source, dst AS target, kind, identity, region FROM r WHERE place = 1""")
def p_preferred_encoding(spark, d):
    """One encoding of each fact: with a region before without, then the least."""
    w = Window.partitionBy("context", "source", "target", "kind").orderBy(F.col("region").isNull(), "region", "identity")
    return Graph.load(spark, d).endpoints().withColumn("place", F.row_number().over(w)).where("place = 1").select("context", "source", "target", "kind", "identity", "region")


# -- metrics ----------------------------------------------------------------------
DEG = f"""{LE}, p AS (SELECT DISTINCT context, source, target FROM le WHERE source <> target),
g AS (SELECT context, node, sum(i)::bigint AS fan_in, sum(o)::bigint AS fan_out FROM (SELECT context, source AS node, 0 AS i, 1 AS o FROM p UNION ALL SELECT context, target, 1, 0 FROM p) GROUP BY ALL)"""


@query(f"WITH {DEG} SELECT * FROM g")
def m_degrees(spark, d):
    return metrics.degrees(Graph.load(spark, d).pairs())


@query(f"WITH {DEG} SELECT *, round_even(fan_out::decimal(20,0) / (fan_in + fan_out), 12) AS instability, 'COMPLETE' AS status FROM g")
def m_instability(spark, d):
    return metrics.instability(metrics.degrees(Graph.load(spark, d).pairs()))


@query(f"""WITH {DEG}, {N}, c AS (SELECT context, count(DISTINCT identity) AS n_nodes FROM n GROUP BY 1), q AS (SELECT context, count(*) AS pairs FROM p GROUP BY 1)
SELECT c.context, n_nodes, coalesce(pairs, 0) AS pairs, round_even(coalesce(pairs, 0) / nullif(n_nodes * (n_nodes - 1), 0), 12) AS density,
 CASE WHEN n_nodes * (n_nodes - 1) = 0 THEN 'NOT_APPLICABLE' ELSE 'COMPLETE' END AS status FROM c LEFT JOIN q USING (context)""")
def m_density(spark, d):
    g = Graph.load(spark, d)
    return metrics.density(g.pairs(), g.nodes)


@query(f"""WITH {DEG}, r AS (SELECT context, node, fan_in + fan_out AS degree, row_number() OVER (PARTITION BY context ORDER BY fan_in + fan_out DESC, node) AS place, count(*) OVER (PARTITION BY context) AS population FROM g)
SELECT context, place::int AS place, node, degree, population FROM r WHERE place <= 5""")
def m_hotspots(spark, d):
    return metrics.hotspots(metrics.degrees(Graph.load(spark, d).pairs()), 5)


@query(f"WITH {DEG} SELECT context, max(fan_in) AS most, sum(fan_in)::bigint AS pairs, round_even(max(fan_in) / sum(fan_in), 12) AS concentration, 'COMPLETE' AS status FROM g GROUP BY context")
def m_concentration(spark, d):
    return metrics.concentration(metrics.degrees(Graph.load(spark, d).pairs()))


@query(f"""WITH {N}, {LE}, l AS (SELECT DISTINCT context, identity AS node, kind AS layer FROM n)
SELECT e.context, count(*) AS n_edges, count(*) FILTER (a.layer <> b.layer) AS n_crossings FROM (SELECT DISTINCT context, source, target FROM le) e
JOIN l a ON a.context = e.context AND a.node = e.source JOIN l b ON b.context = e.context AND b.node = e.target GROUP BY 1""")
def m_crossings(spark, d):
    g = Graph.load(spark, d)
    return metrics.crossings(g.pairs(), g.distinct_nodes().select("context", F.col("identity").alias("node"), F.col("kind").alias("layer")))


@query(f"""WITH {N}, {REL} SELECT 'declarations' AS part, kind AS name, '' AS detail, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edges', kind, state, count(*) FROM rel GROUP BY kind, state
UNION ALL SELECT 'files', status, state, count(*) FROM (SELECT DISTINCT source, path, raw_digest, status, state FROM source_outcomes) GROUP BY status, state""")
def m_inventory(spark, d):
    g = Graph.load(spark, d)
    a = g.distinct_nodes().groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("declarations").alias("part"), "name", F.lit("").alias("detail"), "n")
    b = g.relationships().groupBy(F.col("kind").alias("name"), F.col("state").alias("detail")).agg(F.count("*").alias("n")).select(F.lit("edges").alias("part"), "name", "detail", "n")
    c = table(spark, d, "source_outcomes").select("source", "path", "raw_digest", "status", "state").distinct().groupBy(F.col("status").alias("name"), F.col("state").alias("detail")).agg(
        F.count("*").alias("n")).select(F.lit("files").alias("part"), "name", "detail", "n")
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {REL} SELECT context, count(*) AS attempted, count(*) FILTER (state = 'RESOLVED') AS resolved, (1000 * count(*) FILTER (state = 'RESOLVED') // count(*))::bigint AS per_mille,
 1000 * count(*) FILTER (state = 'RESOLVED') // count(*) >= 950 AS deep FROM rel GROUP BY context""")
def m_quality(spark, d):
    """Resolved of attempted facts, in whole per mille, against 950."""
    r = Graph.load(spark, d).relationships().groupBy("context").agg(F.count("*").alias("attempted"), F.count_if(F.col("state") == "RESOLVED").alias("resolved"))
    return r.withColumn("per_mille", F.floor(1000 * F.col("resolved") / F.col("attempted")).cast("bigint")).withColumn("deep", F.col("per_mille") >= 950)


@query(f"""WITH {N}, {REL}, k AS (SELECT DISTINCT context, identity, kind FROM n) SELECT rel.context, coalesce(k.kind, 'EXCLUDED') AS target_kind, count(*) AS n FROM
(SELECT context, identity, unnest(targets) AS t FROM rel) rel LEFT JOIN k ON k.context = rel.context AND k.identity = rel.t GROUP BY ALL""")
def m_exposure(spark, d):
    g = Graph.load(spark, d)
    t = g.relationships().select("context", F.explode("targets").alias("t"))
    n = g.distinct_nodes().select("context", F.col("identity").alias("t"), F.col("kind").alias("target_kind"))
    return t.join(n, ["context", "t"], "left").groupBy("context", F.coalesce("target_kind", F.lit("EXCLUDED")).alias("target_kind")).agg(F.count("*").alias("n"))


@query("""SELECT source, path, n_lines FROM (SELECT source, path, len(regexp_extract_all(text, '\\r\\n|\\r|\\n')) + CASE WHEN text <> '' AND NOT regexp_matches(text, '[\\r\\n]$') THEN 1 ELSE 0 END AS n_lines FROM documents WHERE text IS NOT NULL)""")
def m_loc(spark, d):
    """Physical lines of each document: CRLF, CR and LF end one line each."""
    from ..functions.scalars import physical_lines
    return table(spark, d, "documents").where("text is not null").select("source", "path", physical_lines(F.col("text")).cast("bigint").alias("n_lines"))


@query("SELECT state, count(*) AS n_runs, count(*) FILTER (upper(state) = 'FAILED') AS n_failed, sum(epoch_us(finished_at) - epoch_us(started_at))::bigint AS micros FROM runs GROUP BY state")
def m_operational(spark, d):
    """Measured durations and failures of runs; open runs have none."""
    us = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return table(spark, d, "runs").groupBy("state").agg(F.count("*").alias("n_runs"), F.count_if(F.upper("state") == "FAILED").alias("n_failed"), F.sum(us).alias("micros"))


# -- traversal ----------------------------------------------------------------------
#: What is asked for: nodes whose digest begins with a zero, one in sixteen.
def _asked(edges: DataFrame) -> DataFrame:
    return edges.where(F.substring(F.md5("source"), 1, 1) == "0").select("context", F.col("source").alias("start")).distinct()


def _reach(edges: str) -> str:
    """Breadth-first levels to the end, each node kept with its first."""
    return f"""WITH RECURSIVE {edges}, st AS (SELECT DISTINCT context, source AS start FROM d WHERE substr(md5(source), 1, 1) = '0'),
r(context, start, "end", distance) USING KEY (context, start, "end") AS (SELECT context, start, start, 0 FROM st UNION
 SELECT r.context, r.start, d.target, min(r.distance + 1) FROM r JOIN d ON d.context = r.context AND d.source = r."end"
 LEFT JOIN recurring.r k ON k.context = r.context AND k.start = r.start AND k."end" = d.target WHERE k.start IS NULL GROUP BY ALL) """


FLIPPED = X + """, d AS (SELECT DISTINCT context, dst AS source, source AS target FROM x WHERE state = 'RESOLVED')"""


@query(_reach(ALL) + 'SELECT context, start, "end", distance::int AS distance FROM r WHERE distance > 0')
def g_reach(spark, d):
    """Nearest distance from the nodes asked for to every node, over all edges."""
    e = Graph.load(spark, d).pairs()
    return traversal.reachability(e, _asked(e))


@query(_reach(FLIPPED) + 'SELECT context, start AS changed, count(*) AS n_impacted FROM r WHERE distance > 0 GROUP BY ALL')
def g_impact(spark, d):
    """How many nodes a change of each node asked for reaches against the edges."""
    e = traversal.flip(Graph.load(spark, d).pairs())
    return traversal.reachability(e, _asked(e)).groupBy("context", F.col("start").alias("changed")).agg(F.count("*").alias("n_impacted"))


PATHS = f"""WITH RECURSIVE {DEP}, r AS (SELECT context, source AS start, target AS "end", [source, target] AS path FROM d WHERE source <> target
 UNION ALL SELECT r.context, r.start, d.target, list_append(r.path, d.target) FROM r JOIN d ON d.context = r.context AND d.source = r."end" WHERE len(r.path) < 20 AND NOT list_contains(r.path, d.target)) """


@query(PATHS + "SELECT context, start, \"end\", array_to_string(path, ',') AS path, len(path)::int AS n FROM r")
def g_paths(spark, d):
    e = _inheritance(spark, d)
    return traversal.simple_paths(e, e.select("context", F.col("source").alias("start")).distinct()).withColumn("path", _join("path"))


@query(PATHS + "SELECT context, start, \"end\", len(path)::int AS n, array_to_string(path, ',') AS path FROM (SELECT *, row_number() OVER (PARTITION BY context, start, \"end\" ORDER BY len(path), path) AS place FROM r) WHERE place = 1")
def g_shortest(spark, d):
    e = _inheritance(spark, d)
    return traversal.shortest(e, e.select("context", F.col("source").alias("start")).distinct()).withColumn("path", _join("path"))


@query(f"""WITH RECURSIVE {ALL}, r AS (SELECT context, source AS a, target AS b FROM d UNION SELECT r.context, r.a, d.target FROM r JOIN d ON d.context = r.context AND d.source = r.b),
v AS (SELECT context, source AS node FROM d UNION SELECT context, target FROM d),
m AS (SELECT v.context, v.node, least(v.node, coalesce(min(r.b) FILTER (q.a IS NOT NULL), v.node)) AS component FROM v LEFT JOIN r ON r.context = v.context AND r.a = v.node LEFT JOIN r q ON q.context = r.context AND q.a = r.b AND q.b = r.a GROUP BY v.context, v.node)
SELECT m.context, m.node, m.component, count(*) OVER (PARTITION BY m.context, m.component) AS size, (m.context, m.node, m.node) IN (SELECT (context, a, b) FROM r) AS cyclic FROM m""")
def g_scc(spark, d):
    return traversal.components(Graph.load(spark, d).pairs())


@query(f"""WITH RECURSIVE {DEP}, r AS (SELECT context, [source] AS path, target AS tip FROM d WHERE target >= source
 UNION ALL SELECT r.context, list_append(r.path, r.tip), d.target FROM r JOIN d ON d.context = r.context AND d.source = r.tip WHERE len(r.path) < 20 AND r.tip > r.path[1] AND NOT list_contains(r.path, r.tip) AND d.target >= r.path[1])
SELECT context, array_to_string(path, ',') AS path, len(path)::int AS n FROM r WHERE tip = path[1]""")
def g_cycles(spark, d):
    return traversal.cycles(_inheritance(spark, d)).withColumn("path", _join("path"))


@query(f"""WITH RECURSIVE {ALL}, e AS (SELECT * FROM d WHERE source <> target), r AS (SELECT context, source AS a, target AS b FROM e UNION SELECT r.context, r.a, e.target FROM r JOIN e ON e.context = r.context AND e.source = r.b),
cyc AS (SELECT DISTINCT context, a AS node FROM r WHERE a = b), bad AS (SELECT * FROM cyc UNION SELECT r.context, r.b FROM r JOIN cyc ON cyc.context = r.context AND cyc.node = r.a),
v AS (SELECT context, source AS node FROM e UNION SELECT context, target FROM e), ok AS (SELECT * FROM v WHERE (context, node) NOT IN (SELECT (context, node) FROM bad)),
w AS (SELECT context, node, 0 AS rank FROM ok UNION SELECT w.context, e.target, w.rank + 1 FROM w JOIN e ON e.context = w.context AND e.source = w.node WHERE (e.context, e.target) IN (SELECT (context, node) FROM ok))
SELECT context, node, max(rank) AS rank FROM w GROUP BY ALL""")
def g_schedule(spark, d):
    """Topological rank of every node that no circle holds up."""
    return traversal.schedule(Graph.load(spark, d).pairs())
