"""Reports, drill-downs, pages and configuration order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from ..session import own_folder, table
from ..sources.graph import Graph
from ..sources.results import ResultStore
from .data_queries import BRIDGE, _bridge
from .graph_queries import N, X
from .registry import query

O = """o AS (SELECT DISTINCT source, path, raw_digest, status, observed_at, problems FROM source_outcomes)"""


@query(BRIDGE + """, q2 AS (SELECT DISTINCT identity AS requirement, context FROM kg_edges)
SELECT context, count(*) AS n_requirements, count(*) FILTER (state = 'BOUND') AS n_bound, count(*) FILTER (state <> 'BOUND') AS n_obligations, true AS balanced FROM s JOIN q2 USING (requirement) GROUP BY context""")
def v_bridge_accounting(spark, d):
    """Concrete bindings against obligations in each context; they must add up."""
    context = Graph.load(spark, d).edges.select(F.col("identity").alias("requirement"), "context").distinct()
    n, bound, other = F.count("*"), F.count_if(F.col("state") == "BOUND"), F.count_if(F.col("state") != "BOUND")
    return _bridge(spark, d).join(context, "requirement").groupBy("context").agg(n.alias("n_requirements"), bound.alias("n_bound"), other.alias("n_obligations"), (n == bound + other).alias("balanced"))


@query("SELECT DISTINCT context, identity, source, target.unresolved_reference AS reference FROM kg_edges WHERE target.state = 'UNRESOLVED' AND contains(lower(target.unresolved_reference), 'queue')")
def p_bridge_rows(spark, d):
    """Rows by category and by text in any case."""
    r = Graph.load(spark, d).relationships()
    return answers.matching(r, equals={"state": "UNRESOLVED"}, contains={"reference": "Queue"}).select("context", "identity", "source", "reference").distinct()


@query("SELECT DISTINCT space, k FROM comparison_rows WHERE split_part(space, '/', 3) = 'left' OR k = 'left' OR space = 'left'")
def p_section_rows(spark, d):
    """Section rows in which one of several columns has a value."""
    r = table(spark, d, "comparison_rows").select("space", "k", F.split("space", "/")[2].alias("side"))
    return answers.matching(r, any_of=("left", ("side", "k", "space"))).select("space", "k").distinct()


@query(f"""WITH {O}, l AS (SELECT source, path, max(observed_at) AS last FROM o GROUP BY ALL),
g AS (SELECT DISTINCT o.source, o.path, CASE WHEN observed_at = last THEN 'CURRENT' ELSE 'HISTORY' END AS scope, unnest(problems) AS p FROM o JOIN l ON l.source = o.source AND l.path = o.path),
u AS (SELECT * FROM g UNION SELECT source, path, 'ALL', p FROM g)
SELECT scope, p.reason AS reason, p.requirement AS requirement, count(*) AS n FROM u GROUP BY ALL""")
def v_gap_scopes(spark, d):
    """Gaps of the current answers, of earlier ones, and of all."""
    o = table(spark, d, "source_outcomes").select("source", "path", "observed_at", "problems")
    return answers.gap_scopes(o, ["source", "path"], "observed_at", "problems").groupBy("scope", F.col("gap.reason").alias("reason"), F.col("gap.requirement").alias("requirement")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT DISTINCT context, identity, unnest(evidence) AS digest FROM kg_nodes), o AS (SELECT raw_digest AS digest, count(DISTINCT path) AS files, count(DISTINCT status) FILTER (status <> 'DECODED') AS bad, max(observed_at) AS seen FROM source_outcomes WHERE raw_digest IS NOT NULL GROUP BY 1)
SELECT context, identity, count(*) AS n_evidence, count(files) AS n_known, (coalesce(sum(files), 0))::bigint AS n_files, count(*) FILTER (coalesce(bad, 0) > 0) AS n_doubtful, max(seen) AS last_seen FROM n LEFT JOIN o USING (digest) GROUP BY ALL""")
def v_explain(spark, d):
    """What each entity rests on: evidence, the files behind it, doubts, and
    when it was last seen; contents and locations are left out."""
    n = Graph.load(spark, d).nodes.select("context", "identity", F.explode("evidence").alias("digest")).distinct()
    o = table(spark, d, "source_outcomes").where("raw_digest is not null").groupBy(F.col("raw_digest").alias("digest")).agg(
        F.count_distinct("path").alias("files"), F.count_distinct(F.when(F.col("status") != "DECODED", F.col("status"))).alias("bad"), F.max("observed_at").alias("seen"))
    return n.join(o, "digest", "left").groupBy("context", "identity").agg(
        F.count("*").alias("n_evidence"), F.count("files").alias("n_known"), F.coalesce(F.sum("files"), F.lit(0)).alias("n_files"), F.count_if(F.coalesce("bad", F.lit(0)) > 0).alias("n_doubtful"), F.max("seen").alias("last_seen"))


@query(f"""WITH {N}, i AS (SELECT DISTINCT context, identity FROM n), p AS (SELECT *, (row_number() OVER (PARTITION BY context ORDER BY identity) - 1) // 50 AS page FROM i)
SELECT context, page, count(*) AS n, min(identity) AS first, max(identity) AS last, true AS sound FROM p GROUP BY ALL""")
def w_pages(spark, d):
    """Every page of every context, with its ordinals checked."""
    i = table(spark, d, "kg_nodes").select("context", "identity").distinct()
    return answers.page_census(answers.paged(i, "context", "identity", 50), "context", "identity", 50)


@query("""WITH s AS (SELECT DISTINCT regexp_replace(space, '/(left|right)$', '') AS section, CASE WHEN space LIKE '%/right' THEN 'r' ELSE 'l' END AS side, k FROM comparison_rows),
m AS (SELECT section, k, bool_or(side = 'l') AS l, bool_or(side = 'r') AS r FROM s GROUP BY ALL) SELECT section, count(*) FILTER (l) AS n_left, count(*) FILTER (r) AS n_right, bool_and(l = r) AS equal FROM m GROUP BY section""")
def u_population(spark, d):
    """Do both sides of a section cover the same subjects?"""
    s = table(spark, d, "comparison_rows").select(F.regexp_replace("space", "/(left|right)$", "").alias("section"), F.regexp_extract("space", "/(left|right)$", 1).alias("side"), "k")
    out = answers.same_population(s.where("side = 'left'").drop("side"), s.where("side = 'right'").drop("side"), "section", "k")
    return out.select("section", F.col("n_left").cast("bigint"), F.col("n_right").cast("bigint"), "equal")


@query("SELECT doc_id, source || ':' || replace(path, '/', '.') AS qualified FROM documents")
def f_qualified(spark, d):
    """Names from percent-coded symbol tuples."""
    coded = table(spark, d, "documents").select("doc_id", F.concat_ws("/", F.url_encode("source"), F.url_encode("path")).alias("symbol"))
    part = lambda k: F.url_decode(F.split("symbol", "/")[k])
    return coded.select("doc_id", F.concat(part(0), F.lit(":"), F.replace(part(1), F.lit("/"), F.lit("."))).alias("qualified"))


@query("SELECT * FROM (VALUES ('policy.waivers', 'NOT_APPLICABLE'), ('policy.audit', 'WITHHELD')) v(metric, status)")
def p_audit(spark, d):
    """No waiver or audit trail is recorded: fixed answers."""
    return spark.createDataFrame([("policy.waivers", "NOT_APPLICABLE"), ("policy.audit", "WITHHELD")], "metric string, status string")


@query(f"""WITH RECURSIVE {X}, u AS (SELECT DISTINCT context, source, dst AS target FROM x WHERE state IN ('RESOLVED', 'CANDIDATES')),
r AS (SELECT context, source AS a, target AS b FROM u UNION SELECT r.context, r.a, u.target FROM r JOIN u ON u.context = r.context AND u.source = r.b),
cyc AS (SELECT context, a AS node FROM r WHERE a = b), m AS (SELECT c.context, c.node, least(c.node, min(r.b)) AS component FROM cyc c JOIN r ON r.context = c.context AND r.a = c.node JOIN r q ON q.context = r.context AND q.a = r.b AND q.b = r.a GROUP BY c.context, c.node),
s AS (SELECT context, component, count(*) AS size FROM m GROUP BY ALL),
o AS (SELECT a.context, a.component, count(*) AS n FROM u JOIN m a ON a.context = u.context AND a.node = u.source LEFT JOIN m b ON b.context = u.context AND b.node = u.target WHERE b.component IS NULL OR b.component <> a.component GROUP BY ALL),
f AS (SELECT context, component, count(*) AS n FROM (SELECT x.context, a.component, x.identity FROM x JOIN m a ON a.context = x.context AND a.node = x.source JOIN m b ON b.context = x.context AND b.node = x.dst AND b.component = a.component WHERE x.state = 'CANDIDATES' GROUP BY ALL HAVING count(DISTINCT x.dst) > 1) GROUP BY ALL)
SELECT s.context, s.component, s.size, coalesce(o.n, 0) AS n_boundaries, coalesce(f.n, 0) AS n_conflicts FROM s LEFT JOIN o USING (context, component) LEFT JOIN f USING (context, component)""")
def g_bridge_topology(spark, d):
    """Circles of the graph with its candidates, their boundaries, and choices
    that cannot be made together."""
    x = Graph.load(spark, d).endpoints()
    edges = x.where("state in ('RESOLVED', 'CANDIDATES')").select("context", "source", "target").distinct()
    return answers.topology(edges, x.where("state = 'CANDIDATES'").select("context", F.col("identity").alias("requirement"), "source", "target").distinct())


@query("""WITH RECURSIVE k AS (SELECT DISTINCT plan, id FROM readiness_modules WHERE id IS NOT NULL), e AS (SELECT DISTINCT r.plan, d.needed AS a, r.id AS b FROM (SELECT plan, id, unnest(dependencies) AS needed FROM readiness_modules) d JOIN k r ON r.id = d.id JOIN k n ON n.id = d.needed),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b), cyc AS (SELECT a AS id FROM c WHERE a = b), held AS (SELECT DISTINCT c.b AS id FROM c JOIN cyc ON cyc.id = c.a),
w AS (SELECT id, 0 AS rank FROM k WHERE id NOT IN (SELECT id FROM held) AND id NOT IN (SELECT id FROM cyc) UNION SELECT e.b, w.rank + 1 FROM w JOIN e ON e.a = w.id WHERE e.b NOT IN (SELECT id FROM held) AND e.b NOT IN (SELECT id FROM cyc)),
m AS (SELECT id, max(rank) AS rank FROM w GROUP BY id)
SELECT k.plan AS context, k.id AS node, m.rank::int AS rank, CASE WHEN k.id IN (SELECT id FROM cyc) THEN 'CYCLE' WHEN m.rank IS NULL THEN 'HELD' ELSE 'ORDERED' END AS status FROM k LEFT JOIN m USING (id)""")
def g_configuration_order(spark, d):
    """Order in which modules can be configured; circles and what waits for
    them are told apart."""
    r = table(spark, d, "readiness_modules")
    known = r.select(F.col("plan").alias("context"), F.col("id").alias("node")).where("node is not null").distinct()
    e = r.select(F.col("plan").alias("context"), F.col("id").alias("target"), F.explode("dependencies").alias("source")).where("target is not null").join(known.select("context", F.col("node").alias("source")), ["context", "source"], "left_semi")
    return answers.ordered(e, known)


@query("""SELECT 'nodes' AS section, kind, count(*) AS n FROM (SELECT DISTINCT context, identity, kind FROM kg_nodes) GROUP BY ALL
UNION ALL SELECT 'edges', kind, count(*) FROM (SELECT DISTINCT context, identity, kind FROM kg_edges) GROUP BY ALL""")
def k_result_store(spark, d):
    """Result sections written, and read by a second attempt that makes none."""
    g, folder = Graph.load(spark, d), own_folder(spark, "results")

    def refuse():
        raise RuntimeError("made twice")

    for attempt in range(2):
        store = ResultStore(spark, folder, "inputs")
        parts = [store.section(n, refuse if attempt else (lambda df=df: df.select("context", "identity", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n")))).select(F.lit(n).alias("section"), "kind", "n")
                 for n, df in (("nodes", g.nodes), ("edges", g.edges))]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {X}, d AS (SELECT DISTINCT context, source, dst AS target FROM x WHERE state = 'RESOLVED' AND source <> dst), g AS (SELECT context, node, count(DISTINCT other) AS n FROM (SELECT context, source AS node, 'o' || target AS other FROM d UNION ALL SELECT context, target, 'i' || source FROM d) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, node) AS place FROM g) SELECT context, node, n, place::int AS place FROM p WHERE place <= 50""")
def m_details(spark, d):
    """At most fifty detail rows of the coupling metric in each context."""
    e = Graph.load(spark, d).pairs(loops=False)
    n = e.select("context", F.col("source").alias("node")).unionByName(e.select("context", F.col("target").alias("node"))).groupBy("context", "node").agg(F.count("*").alias("n"))
    return answers.top(n, "context", "n", "node", 50)
