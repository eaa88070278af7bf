"""Scans, round trips, canonical forms, search and integrity on planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import search, traversal
from ..session import own_folder, table
from ..sources import documents as docs
from ..sources import extract
from ..sources.graph import Graph
from .graph_queries import LE, REL, N, X
from .registry import query


def _first_context(g: Graph) -> str:
    return g.contexts.agg(F.min("identity")).first()[0]


# -- scans and round trips ----------------------------------------------------------
@query("""WITH c AS (SELECT min(identity) AS context FROM kg_contexts)
SELECT 'node' AS part, identity, kind FROM (SELECT DISTINCT identity, kind FROM kg_nodes WHERE context = (SELECT context FROM c))
UNION ALL SELECT 'edge', identity, kind FROM (SELECT DISTINCT identity, kind FROM kg_edges WHERE context = (SELECT context FROM c))""")
def s_context(spark: SparkSession, d: str) -> DataFrame:
    """Everything of one context; the filter reaches the scans."""
    g = Graph.load(spark, d)
    own = g.in_context(_first_context(g))
    return own.nodes.select(F.lit("node").alias("part"), "identity", "kind").distinct().unionByName(own.edges.select(F.lit("edge").alias("part"), "identity", "kind").distinct())


@query(f"WITH {N}, {REL} SELECT 'node' AS part, context, kind, count(DISTINCT identity) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', context, kind, count(DISTINCT identity) FROM rel GROUP BY ALL")
def k_snapshot(spark, d):
    """The canonical snapshot, written and read again: what it holds."""
    folder = own_folder(spark, "snapshot")
    docs.save_graph(Graph.load(spark, d), folder)
    g = Graph.load(spark, folder)
    parts = [df.select(F.lit(p).alias("part"), F.col("context").cast("string").alias("context"), "kind", "identity").groupBy("part", "context", "kind").agg(F.count_distinct("identity").alias("n")) for p, df in (("node", g.nodes), ("edge", g.edges))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {REL} SELECT context, state, count(*) AS n_edges, sum(coalesce(len(targets), 0))::bigint AS n_targets, count(reference) AS n_references FROM rel GROUP BY ALL")
def s_graph_json(spark, d):
    """The graph as JSON lines, written and read again with explicit schemas."""
    folder = own_folder(spark, "graph-json")
    docs.save_graph_json(Graph.load(spark, d), folder)
    r = docs.load_graph_json(spark, folder).relationships()
    return r.groupBy("context", "state").agg(F.count("*").alias("n_edges"), F.sum(F.coalesce(F.size("targets"), F.lit(0))).cast("bigint").alias("n_targets"), F.count("reference").alias("n_references"))


@query("SELECT DISTINCT kind, identity AS key, context AS scope, len(evidence)::varchar AS n_evidence FROM kg_nodes WHERE identity > 'module'")
def s_ndjson(spark, d):
    """An NDJSON table written, and scanned behind a key."""
    folder = own_folder(spark, "table")
    n = table(spark, d, "kg_nodes")
    docs.write_table(n.select("kind", F.col("identity").alias("key"), F.col("context").alias("scope"), F.create_map(F.lit("n_evidence"), F.size("evidence").cast("string")).alias("fields")), folder)
    return docs.scan_table(spark, folder, after="module").select("kind", "key", "scope", F.col("fields")["n_evidence"].alias("n_evidence")).distinct()


def _outline_sql() -> str:
    parts = []
    for language, (suffix, noise, patterns) in extract.OUTLINE.items():
        q = lambda x: "'" + x.replace("'", "''") + "'"
        for what, p in patterns.items():
            parts.append(f"SELECT doc_id, '{language}' AS language, '{what}' AS what, unnest(regexp_extract_all(regexp_replace(text, {q(noise)}, ' ', 'g'), {q(p)}, 1)) AS name FROM documents WHERE text IS NOT NULL AND regexp_matches(path, {q(suffix)})")
    return "SELECT doc_id, language, what, name, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@query(_outline_sql())
def s_outline(spark, d):
    """Imports, declarations and calls of the source files of four languages."""
    return extract.outline(table(spark, d, "documents"))


# -- scalar functions ------------------------------------------------------------------
@query("""SELECT DISTINCT identity, '{"identity":' || to_json(identity)::varchar || ',"kind":' || to_json(kind)::varchar || '}' AS canonical,
 'fact:sha256:' || sha256('[' || to_json(context)::varchar || ',' || to_json(identity)::varchar || ']') AS fact, left(split_part(identity, ':', -1), 12) AS short FROM kg_nodes""")
def f_identities(spark, d):
    """Canonical JSON, derived identities and short ids of the nodes."""
    n = table(spark, d, "kg_nodes").select("context", "identity", "kind").distinct()
    return n.select("identity", scalars.canonical_json({"kind": F.col("kind"), "identity": F.col("identity")}).alias("canonical"),
                    scalars.derived_identity("fact", F.col("context"), F.col("identity")).alias("fact"), scalars.short_id(F.col("identity")).alias("short")).distinct()


@query("""WITH q AS (SELECT DISTINCT identity, 'sha256:' || sha256(context) AS query, 'sha256:' || sha256('other') AS other FROM kg_nodes)
SELECT identity, translate(rtrim(to_base64(encode(query || chr(10) || identity)), '='), '+/', '-_') AS cursor, true AS own, false AS foreign_cursor, false AS garbled FROM q""")
def f_cursors(spark, d):
    """Page cursors: made, accepted by their query, refused by others."""
    n = table(spark, d, "kg_nodes").select("identity", scalars.digest(F.col("context")).alias("query")).distinct()
    c = n.withColumn("cursor", scalars.cursor(F.col("query"), F.col("identity")))
    return c.select("identity", "cursor", scalars.cursor_valid(F.col("cursor"), F.col("query")).alias("own"), scalars.cursor_valid(F.col("cursor"), scalars.digest(F.lit("other"))).alias("foreign_cursor"),
                    scalars.cursor_valid(F.concat(F.lit("%"), F.col("cursor")), F.col("query")).alias("garbled"))


@query("""WITH v AS (SELECT DISTINCT revision, k, decode(v) AS j FROM inventory)
SELECT revision, k, json_extract_string(j, '$.digest') AS digest, json_extract_string(j, '$.attr.level')::bigint AS level, json_extract_string(j, '$.tags[0]') AS first_tag, json_extract_string(j, '$.note') AS note FROM v""")
def f_json_paths(spark, d):
    """Values at JSON paths of the evidence."""
    v = table(spark, d, "inventory").select("revision", "k", F.decode("v", "UTF-8").alias("j")).distinct()
    at = {n: F.get_json_object("j", p) for n, p in (("digest", "$.digest"), ("first_tag", "$.tags[0]"), ("note", "$.note"))}
    return v.select("revision", "k", F.get_json_object("j", "$.attr.level").cast("bigint").alias("level"), *[c.alias(n) for n, c in at.items()])


# -- graph -----------------------------------------------------------------------------
@query(f"""WITH {X}, d AS (SELECT DISTINCT context, source, dst AS target FROM x WHERE state = 'RESOLVED'), p AS (SELECT *, row_number() OVER (PARTITION BY context, source ORDER BY target) AS place FROM d)
SELECT context, source, target, place::int AS place FROM p WHERE place <= 3""")
def g_expand(spark, d):
    """The first three neighbours of every node (the page is the feature)."""
    e = Graph.load(spark, d).pairs()
    return traversal.neighbourhood(e, e.select("context", F.col("source").alias("start")).distinct(), 3).select("context", "source", "target", "place")


@query("""WITH t AS (SELECT DISTINCT word AS term FROM common_words UNION SELECT DISTINCT upper(left(regexp_extract(path, '([^/]+)[.][^./]+$', 1), 5)) FROM documents WHERE regexp_extract(path, '([^/]+)[.][^./]+$', 1) <> ''),
e AS (SELECT DISTINCT source || '/' || path AS identity, regexp_extract(path, '([^/]+)[.][^./]+$', 1) AS name FROM documents),
m AS (SELECT t.term, e.identity, CASE WHEN e.identity = t.term THEN 1 WHEN e.name = t.term THEN 2 WHEN lower(e.name) = lower(t.term) THEN 3 ELSE 4 END AS form FROM t JOIN e ON starts_with(lower(e.name), lower(t.term)) OR e.identity = t.term WHERE t.term <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY form, identity) AS place FROM m) SELECT term, place::int AS place, identity, form FROM p WHERE place <= 5""")
def q_search(spark, d):
    """Ranked search: the five best files for every term."""
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "path").alias("identity"), F.regexp_extract("path", r"([^/]+)[.][^./]+$", 1).alias("name"))
    terms = table(spark, d, "common_words").select(F.col("word").alias("term")).union(files.select(F.upper(F.substring("name", 1, 5))))
    return search.search(files, terms, 5)


# -- integrity, on faults that are planted -------------------------------------------------
PLANTED = f"""WITH pn AS (SELECT identity, context, kind, evidence FROM kg_nodes UNION ALL SELECT identity, context, kind || '.other', evidence FROM kg_nodes WHERE md5(identity) < '1'
 UNION ALL SELECT 'Bad ' || identity, context, kind, evidence FROM kg_nodes WHERE md5(identity) LIKE '1%' UNION ALL SELECT identity, 'nowhere:' || context, kind, evidence FROM kg_nodes WHERE md5(identity) LIKE '2%'
 UNION ALL SELECT identity, context, kind, []::varchar[] FROM kg_nodes WHERE md5(identity) LIKE '3%'),
pe AS (SELECT identity, context, source, target.state AS state, target.identities AS targets, target.unresolved_reference AS reference FROM kg_edges
 UNION ALL SELECT 'a:' || identity, context, 'gone:' || source, target.state, target.identities, target.unresolved_reference FROM kg_edges WHERE md5(identity) LIKE '4%'
 UNION ALL SELECT 'b:' || identity, context, source, 'RESOLVED', ['gone:' || source], NULL FROM kg_edges WHERE md5(identity) LIKE '5%'
 UNION ALL SELECT 'c:' || identity, context, source, 'CANDIDATES', [source], NULL FROM kg_edges WHERE md5(identity) LIKE '6%'),
k AS (SELECT DISTINCT context, identity AS node FROM pn)
SELECT DISTINCT rule, context, identity FROM (
 SELECT 'conflicting-node' AS rule, context, identity FROM pn GROUP BY context, identity HAVING count(DISTINCT kind) > 1
 UNION ALL SELECT 'unknown-context', context, identity FROM pn WHERE context NOT IN (SELECT identity FROM kg_contexts)
 UNION ALL SELECT 'dangling-source', context, identity FROM pe WHERE (context, source) NOT IN (SELECT (context, node) FROM k)
 UNION ALL SELECT 'dangling-target', context, identity FROM (SELECT context, identity, unnest(targets) AS t FROM pe) WHERE (context, t) NOT IN (SELECT (context, node) FROM k)
 UNION ALL SELECT 'target-shape', context, identity FROM pe WHERE NOT coalesce(state = 'RESOLVED' AND len(targets) = 1 OR state = 'CANDIDATES' AND len(targets) >= 2 OR state = 'UNRESOLVED' AND len(targets) = 0 AND reference IS NOT NULL, false)
 UNION ALL SELECT 'node-without-evidence', context, identity FROM pn WHERE coalesce(len(evidence), 0) < 1
 UNION ALL SELECT 'malformed-identity', context, identity FROM pn WHERE NOT regexp_matches(identity, '^[a-z][a-z0-9.-]*:(sha256:[0-9a-f]{{64}}|.+)$'))"""


@query(PLANTED)
def s_planted_violations(spark, d):
    """Every invariant, on a graph with a fault of each kind planted in it."""
    g = Graph.load(spark, d)

    def some(df: DataFrame, digit: str) -> DataFrame:
        return df.where(F.substring(F.md5("identity"), 1, 1) == digit)

    n, e = g.nodes, g.edges
    nodes = n.unionByName(some(n, "0").withColumn("kind", F.concat("kind", F.lit(".other")))).unionByName(some(n, "1").withColumn("identity", F.concat(F.lit("Bad "), "identity"))).unionByName(
        some(n, "2").withColumn("context", F.concat(F.lit("nowhere:"), "context"))).unionByName(some(n, "3").withColumn("evidence", F.array().cast("array<string>")))

    def target(state: str, at) -> F.Column:
        return F.struct(F.lit(state).alias("state"), F.array(at).alias("identities"), F.lit(None).cast("string").alias("unresolved_reference"))

    edges = e.unionByName(some(e, "4").withColumns({"identity": F.concat(F.lit("a:"), "identity"), "source": F.concat(F.lit("gone:"), "source")})).unionByName(
        some(e, "5").withColumns({"target": target("RESOLVED", F.concat(F.lit("gone:"), "source")), "identity": F.concat(F.lit("b:"), "identity")})).unionByName(
        some(e, "6").withColumns({"target": target("CANDIDATES", F.col("source")), "identity": F.concat(F.lit("c:"), "identity")}))
    return Graph(g.contexts, nodes, edges).violations()


@query("""WITH f AS (SELECT DISTINCT source, path FROM documents UNION SELECT source, 'copy/' || path FROM documents WHERE substr(md5(path), 1, 1) = '0')
SELECT source, regexp_extract(path, '([^/]+)$', 1) AS name, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1""")
def w_planted_ambiguous(spark, d):
    """Logical names with more than one owner, where copies are planted."""
    f = table(spark, d, "documents").select("source", "path")
    both = f.union(f.where(F.substring(F.md5("path"), 1, 1) == "0").select("source", F.concat(F.lit("copy/"), "path"))).distinct()
    return both.groupBy("source", F.regexp_extract("path", "([^/]+)$", 1).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {X}, {LE.split(', le AS', 1)[1].join(('le AS', ''))} SELECT k AS kind, count(*) AS n_logical, sum(n_supports)::bigint AS n_supports FROM (SELECT unnest(kinds) AS k, n_supports FROM le) GROUP BY k")
def q_edge_histogram(spark, d):
    """Logical edges and their supports by kind, as counted at publication."""
    e = Graph.load(spark, d).logical()
    return e.select(F.explode("kinds").alias("kind"), "n_supports").groupBy("kind").agg(F.count("*").alias("n_logical"), F.sum("n_supports").alias("n_supports"))
