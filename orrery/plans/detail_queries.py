"""Further operators of the inventory: descriptions, activations, checks,
visual graphs, bundles, pages, ledgers and declarations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bridges, expressions, metrics, regions, traversal
from ..session import checkpointed, table
from ..sources import extract
from ..sources.graph import Graph
from .graph_queries import DEG, LE, N, REL, X
from .region_queries import KEYS, NAMED, _classified, _findings, _measured
from .registry import query
from .views import CLASSIFIED, FACTS, MEASURED, OCC, facts, named_edges, occurrences

CAND = X + ", d AS (SELECT DISTINCT context, source, dst AS target FROM x WHERE state = 'CANDIDATES')"

#: Levels of a climb to the owning type, the member's own counted; the reference's bound.
OWNER_LEVELS = 64


# -- entities --------------------------------------------------------------------------
@query(f"""WITH {N}, s AS (SELECT c.identity AS context, any_value(s.repository) AS repository FROM kg_contexts c LEFT JOIN seals s ON s.revision = c.snapshot GROUP BY 1),
o AS (SELECT raw_digest, min(source) AS source, count(DISTINCT path) AS n_paths FROM source_outcomes GROUP BY 1), v AS (SELECT DISTINCT context, identity, unnest(evidence) AS digest FROM kg_nodes),
w AS (SELECT v.context, v.identity, min(o.source) AS source, sum(o.n_paths)::bigint AS n_paths FROM v JOIN o ON o.raw_digest = v.digest GROUP BY ALL)
SELECT n.context, n.identity, n.kind, coalesce(w.source, s.repository) AS repository, coalesce(w.n_paths, 0) AS n_paths FROM n LEFT JOIN w ON w.context = n.context AND w.identity = n.identity LEFT JOIN s ON s.context = n.context""")
def q_describe(spark, d):
    """Nodes widened from their evidence; what evidence does not tell comes from the context."""
    g = Graph.load(spark, d)
    o = table(spark, d, "source_outcomes").groupBy(F.col("raw_digest").alias("digest")).agg(F.min("source").alias("source"), F.count_distinct("path").alias("n_paths"))
    w = g.nodes.select("context", "identity", F.explode("evidence").alias("digest")).distinct().join(o, "digest").groupBy("context", "identity").agg(F.min("source").alias("source"), F.sum("n_paths").alias("n_paths"))
    s = g.contexts.select(F.col("identity").alias("context"), "snapshot").join(table(spark, d, "seals").select(F.col("revision").alias("snapshot"), "repository"), "snapshot", "left").groupBy("context").agg(F.max("repository").alias("repository"))
    return g.distinct_nodes().select("context", "identity", "kind").join(w, ["context", "identity"], "left").join(s, "context", "left").select(
        "context", "identity", "kind", F.coalesce("source", "repository").alias("repository"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('meridian-core', 'harbor-ledger') AND (lang IS NULL OR lang NOT IN ('json', 'xml'))")
def q_population(spark, d):
    """Conjunctive population filter; exclusion only where metadata is known."""
    return table(spark, d, "documents").select("doc_id", "source", "lang").where(F.col("source").isin("meridian-core", "harbor-ledger") & ~F.coalesce(F.col("lang").isin("json", "xml"), F.lit(False)))


@query(f"WITH {N}, {X}, c AS (SELECT DISTINCT x.context, x.source, x.dst FROM x WHERE state = 'RESOLVED' AND x.kind IN ('graph.contains', 'graph.declares')) SELECT DISTINCT p.context, p.identity FROM n p JOIN c ON c.context = p.context AND c.source = p.identity JOIN n t ON t.context = c.context AND t.identity = c.dst AND t.kind = 'TYPE' WHERE p.kind IN ('PACKAGE', 'MODULE')")
def p_owners(spark, d):
    """Packages and modules that own an eligible type."""
    g = Graph.load(spark, d)
    own = g.endpoints("graph.contains", "graph.declares").where("state = 'RESOLVED'").select("context", F.col("source").alias("identity"), "target")
    t = g.by_kind("TYPE").select("context", F.col("identity").alias("target"))
    return g.by_kind("PACKAGE", "MODULE").select("context", "identity").join(own.join(t, ["context", "target"], "left_semi"), ["context", "identity"], "left_semi").distinct()


@query(f"""WITH {FACTS}, ac AS (SELECT source AS package, world, CASE WHEN count(*) >= 12 THEN true WHEN count(*) < 6 THEN false END AS truth FROM (SELECT DISTINCT source, target, world FROM occ WHERE quantity > 30) GROUP BY ALL)
SELECT fa.source, fa.target, fa.world, fa.truth AND a.truth AND b.truth AS truth FROM fa JOIN ac a ON a.package = fa.source AND a.world = fa.world JOIN ac b ON b.package = fa.target AND b.world = fa.world""")
def p_activation(spark, d):
    """Edge truth and the activation of both endpoints, per world (Kleene AND)."""
    n = occurrences(spark, d).where("quantity > 30").select("source", "target", "world").distinct().groupBy(F.col("source").alias("package"), "world").agg(F.count("*").alias("n"))
    ac = n.select("package", "world", F.when(F.col("n") >= 12, True).when(F.col("n") < 6, False).alias("active"))
    f = facts(spark, d).join(ac.withColumnRenamed("package", "source"), ["source", "world"]).join(ac.select(F.col("package").alias("target"), "world", F.col("active").alias("there")), ["target", "world"])
    return f.select("source", "target", "world", (F.col("truth") & F.col("active") & F.col("there")).alias("truth"))


@query("SELECT DISTINCT id, revision, upper(state) AS state, digest IS NOT NULL AS has_digest FROM jobs")
def p_redacted(spark, d):
    """Allow-listed projection: a digest shows only whether there is one."""
    allowed = F.map_filter(F.create_map(F.lit("id"), F.col("id"), F.lit("state"), F.upper("state"), F.lit("digest"), F.col("digest")), lambda k, v: k.isin("id", "state"))
    return table(spark, d, "jobs").select(allowed["id"].alias("id"), "revision", allowed["state"].alias("state"), F.col("digest").isNotNull().alias("has_digest")).distinct()


# -- joins ----------------------------------------------------------------------------------
OWNERS = f"""{N}, {LE}, ow AS (SELECT x.context, x.dst AS node, min(x.source) AS owner FROM x JOIN n ON n.context = x.context AND n.identity = x.source AND n.kind IN ('MODULE', 'PACKAGE') WHERE state = 'RESOLVED' AND x.kind IN ('graph.contains', 'graph.declares') GROUP BY ALL)"""


@query(f"WITH {OWNERS} SELECT le.context, a.owner AS caller, b.owner AS handler, count(*) AS n_edges, count(DISTINCT le.target) AS n_targets FROM le JOIN ow a ON a.context = le.context AND a.node = le.source JOIN ow b ON b.context = le.context AND b.node = le.target WHERE a.owner <> b.owner GROUP BY ALL")
def j_service_edges(spark, d):
    """Edges between the owners of both ends."""
    g = Graph.load(spark, d)
    kinds = g.by_kind("MODULE", "PACKAGE").select("context", F.col("identity").alias("source"))
    ow = g.endpoints("graph.contains", "graph.declares").where("state = 'RESOLVED'").join(kinds, ["context", "source"], "left_semi").groupBy("context", F.col("target").alias("node")).agg(F.min("source").alias("owner"))
    e = g.pairs()
    a, b = ow.select("context", F.col("node").alias("source"), F.col("owner").alias("caller")), ow.select("context", F.col("node").alias("target"), F.col("owner").alias("handler"))
    return e.join(a, ["context", "source"]).join(b, ["context", "target"]).where("caller <> handler").groupBy("context", "caller", "handler").agg(F.count("*").alias("n_edges"), F.count_distinct("target").alias("n_targets"))


@query(f"""WITH {X}, a AS (SELECT DISTINCT context, source, dst FROM x WHERE state = 'RESOLVED' AND kind = 'graph.depends-on'), b AS (SELECT DISTINCT context, source, dst FROM x WHERE state = 'RESOLVED' AND kind LIKE 'java.%')
SELECT 'unsupported' AS finding, context, source, dst AS target FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'unprojected', context, source, dst FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def j_projection_check(spark, d):
    """Projected dependencies against the relations that support them, both ways."""
    g, on = Graph.load(spark, d), ["context", "source", "target"]
    x = g.endpoints().where("state = 'RESOLVED'")
    a, b = x.where("kind = 'graph.depends-on'").select(*on).distinct(), x.where("kind like 'java.%'").select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("finding", F.lit("unsupported")).unionByName(b.join(a, on, "left_anti").withColumn("finding", F.lit("unprojected")))


@query("WITH p AS (SELECT repository, revision, lag(revision) OVER (PARTITION BY repository ORDER BY sealed_at, revision) AS parent FROM seals) SELECT revision, parent, count(*) OVER (PARTITION BY parent) <= 1 AS proven FROM p WHERE parent IS NOT NULL")
def j_ancestry(spark, d):
    """Link of each sealed revision to its one predecessor."""
    w = Window.partitionBy("repository").orderBy("sealed_at", "revision")
    p = table(spark, d, "seals").select("revision", F.lag("revision").over(w).alias("parent")).where("parent is not null")
    return p.withColumn("proven", F.count("*").over(Window.partitionBy("parent")) <= 1)


# -- metrics -----------------------------------------------------------------------------------
@query(f"""WITH {DEG}, m AS (SELECT context, max(fan_in) AS a, max(fan_out) AS b, sum(fan_in)::bigint AS c, count(*) AS n FROM g GROUP BY context)
SELECT context, unnest(['max_fan_in', 'max_fan_out', 'pairs', 'connected']) AS metric, unnest([a, b, c, n])::bigint AS value FROM m""")
def m_batch(spark, d):
    """Several metrics of every context in one pass."""
    m = metrics.degrees(Graph.load(spark, d).pairs()).groupBy("context").agg(F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"), F.sum("fan_in").alias("pairs"), F.count("*").alias("connected"))
    return m.unpivot("context", ["max_fan_in", "max_fan_out", "pairs", "connected"], "metric", "value")


@query(f"WITH {DEG}, c AS (SELECT context, max(fan_in) / sum(fan_in) AS v FROM g GROUP BY context) SELECT context, round(least(1.0, greatest(0.0, (v - 0.01) / 0.05)), 9) AS penalty FROM c")
def a_ramp(spark, d):
    """Penalty ramp of the concentration of each context."""
    c = metrics.degrees(Graph.load(spark, d).pairs()).groupBy("context").agg((F.max("fan_in") / F.sum("fan_in")).alias("v"))
    return c.select("context", F.round(scalars.ramp(F.col("v"), 0.01, 0.06), 9).alias("penalty"))


@query("""WITH c AS (SELECT DISTINCT source, path FROM documents), e AS (SELECT source, path, count(*) AS n FROM source_outcomes GROUP BY ALL),
r AS (SELECT coalesce(c.source, e.source) AS source, CASE WHEN c.path IS NULL THEN 'FOREIGN' WHEN n IS NULL THEN 'OMITTED' ELSE 'EMITTED' END AS status FROM c FULL JOIN e ON c.source = e.source AND c.path = e.path)
SELECT source, count(*) FILTER (status = 'EMITTED') AS emitted, count(*) FILTER (status = 'OMITTED') AS omitted, count(*) FILTER (status = 'FOREIGN') AS "foreign", bool_and(status = 'EMITTED') AS complete FROM r GROUP BY source""")
def v_coverage(spark, d):
    """Coverage counters of each repository and whether it is complete."""
    r = bridges.reconcile(table(spark, d, "documents"), table(spark, d, "source_outcomes"), ["source", "path"])
    n = {s: F.count_if(F.col("status") == s.upper()).alias(s) for s in ("emitted", "omitted", "foreign")}
    return r.groupBy("source").agg(*n.values(), F.bool_and(F.col("status") == "EMITTED").alias("complete"))


# -- graph -------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {OWNERS}, d AS (SELECT DISTINCT context, source, target FROM le WHERE list_has_any(kinds, ['java.extends', 'java.implements'])), r AS (SELECT context, source AS a, target AS b FROM d UNION SELECT r.context, r.a, d.target FROM r JOIN d ON d.context = r.context AND d.source = r.b)
SELECT n.context, n.identity, n.kind, ow.owner AS parent, (n.context, n.identity, n.identity) IN (SELECT (context, a, b) FROM r) AS in_cycle FROM n LEFT JOIN ow ON ow.context = n.context AND ow.node = n.identity""")
def g_visual(spark, d):
    """Nodes of the visual graph: compound parent and circle flag."""
    g = Graph.load(spark, d)
    kinds = g.by_kind("MODULE", "PACKAGE").select("context", F.col("identity").alias("source"))
    ow = g.endpoints("graph.contains", "graph.declares").where("state = 'RESOLVED'").join(kinds, ["context", "source"], "left_semi").groupBy("context", F.col("target").alias("identity")).agg(F.min("source").alias("parent"))
    cyc = traversal.components(g.pairs("java.extends", "java.implements")).where("cyclic").select("context", F.col("node").alias("identity"), F.lit(True).alias("in_cycle"))
    return g.distinct_nodes().select("context", "identity", "kind").join(ow, ["context", "identity"], "left").join(cyc, ["context", "identity"], "left").na.fill(False, ["in_cycle"])


@query(f"""WITH RECURSIVE {CAND}, r(context, start, "end", distance) USING KEY (context, start, "end") AS (SELECT DISTINCT context, target, target, 0 FROM d UNION
 SELECT r.context, r.start, d.source, min(r.distance + 1) FROM r JOIN d ON d.context = r.context AND d.target = r."end"
 LEFT JOIN recurring.r k ON k.context = r.context AND k.start = r.start AND k."end" = d.source WHERE k.start IS NULL GROUP BY ALL)
SELECT context, start, "end", distance::int AS distance FROM r WHERE distance > 0""")
def g_bridge_impact(spark, d):
    """Who is reached against candidate edges from each target."""
    e = Graph.load(spark, d).endpoints().where("state = 'CANDIDATES'").select("context", "source", "target").distinct()
    back = traversal.flip(e)
    return traversal.reachability(back, back.select("context", F.col("source").alias("start")).distinct())


@query("""WITH m AS (SELECT id, max(target) AS target FROM readiness_modules GROUP BY id), x AS (SELECT DISTINCT id, unnest(dependencies) AS needed FROM readiness_modules),
w AS (SELECT DISTINCT x.id FROM x JOIN m ON m.id = x.needed WHERE m.target IS NULL) SELECT m.id FROM m WHERE target IS NULL AND id NOT IN (SELECT id FROM w)""")
def g_ready(spark, d):
    """Open modules whose known prerequisites are all done."""
    r = table(spark, d, "readiness_modules")
    m = r.groupBy("id").agg(F.max("target").alias("target"))
    open_ = m.where("target is null").select("id")
    waiting = r.select("id", F.explode("dependencies").alias("needed")).join(open_.withColumnRenamed("id", "needed"), "needed", "left_semi").select("id").distinct()
    return open_.join(waiting, "id", "left_anti")


@query(f"""WITH RECURSIVE {N}, {X}, p AS (SELECT context, dst AS node, min(source) AS up FROM x WHERE state = 'RESOLVED' AND kind IN ('graph.contains', 'graph.declares') AND source <> dst GROUP BY ALL),
k AS (SELECT context, identity, min(kind) AS kind FROM n GROUP BY ALL),
s AS (SELECT context, identity, identity AS tip, kind, 0 AS steps FROM k WHERE kind IN ('METHOD', 'FIELD')
 UNION ALL SELECT s.context, s.identity, p.up, k.kind, s.steps + 1 FROM s JOIN p ON p.context = s.context AND p.node = s.tip JOIN k ON k.context = p.context AND k.identity = p.up WHERE s.kind <> 'TYPE' AND s.steps < 63)
SELECT context, identity, tip AS owner, steps FROM s WHERE kind = 'TYPE'""")
def g_climb(spark, d):
    """Nearest owning type of members, within ``OWNER_LEVELS`` levels."""
    g = Graph.load(spark, d)
    up = g.endpoints("graph.contains", "graph.declares").where("state = 'RESOLVED' and source <> target").groupBy("context", F.col("target").alias("tip")).agg(F.min("source").alias("up"))
    kind = checkpointed(g.nodes.groupBy("context", "identity").agg(F.min("kind").alias("kind")))
    parent = up.join(kind.select("context", F.col("identity").alias("up"), (F.col("kind") == "TYPE").alias("found")), ["context", "up"])
    parent = parent.join(kind.where("kind <> 'TYPE'").select("context", F.col("identity").alias("tip")), ["context", "tip"], "left_semi")
    members = kind.where("kind in ('METHOD', 'FIELD')").select("context", "identity")
    owned = traversal.climb(parent, OWNER_LEVELS).withColumnRenamed("tip", "identity")
    return owned.join(members, ["context", "identity"], "left_semi").select("context", "identity", "owner", "steps")


# -- truth -----------------------------------------------------------------------------------------------
@query(f"""WITH {FACTS}, pk AS (SELECT n_nationkey AS package, r_name AS module FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT fa.world, fa.truth AND CASE WHEN a.module = 'ASIA' THEN NULL ELSE a.module = 'EUROPE' END AND b.module = 'ASIA' AS t FROM fa JOIN pk a ON a.package = fa.source JOIN pk b ON b.package = fa.target),
g AS (SELECT world, max(CASE WHEN t THEN 2 WHEN NOT t THEN 0 ELSE 1 END) AS r FROM j GROUP BY world) SELECT world, CASE r WHEN 2 THEN true WHEN 0 THEN false END AS truth FROM g""")
def t_rule_condition(spark, d):
    """Is a rule broken, per world: OR over edges of truth AND eligibility, where
    eligibility itself may be unknown."""
    e = named_edges(facts(spark, d), spark, d)
    covered = F.when(F.col("source_module") == "ASIA", F.lit(None).cast("boolean")).otherwise(F.col("source_module") == "EUROPE")
    return regions.fold(e.select("world", (F.col("truth") & covered & (F.col("target_module") == "ASIA")).alias("truth")).withColumn("k", F.lit(0)), ["k"], every=False).select("world", "truth")


@query(f"""WITH {MEASURED}, cw AS (SELECT source, target, min(world) AS counter FROM (SELECT k.source, k.target, w.world FROM (SELECT DISTINCT source, target FROM fa) k CROSS JOIN (SELECT unnest(range(1995, 2002))::varchar AS world) w ANTI JOIN fa ON fa.source = k.source AND fa.target = k.target AND fa.world = w.world) GROUP BY ALL)
SELECT me.source, me.target, witness, counter, coalesce(fa.truth, false) AS replayed FROM me LEFT JOIN cw USING (source, target) LEFT JOIN fa ON fa.source = me.source AND fa.target = me.target AND fa.world = witness""")
def t_replay(spark, d):
    """Witness and counter-witness of each edge; the witness replayed on the facts."""
    from .views import WORLDS

    f = facts(spark, d)
    seen = f.groupBy(*KEYS).agg(F.collect_set("world").alias("seen"))
    counter = seen.select(*KEYS, F.array_min(F.array_except(F.array(*map(F.lit, WORLDS)), "seen")).alias("counter"))
    m = _measured(spark, d).select(*KEYS, "witness").join(counter, KEYS)
    replay = f.where("truth").select(*KEYS, F.col("world").alias("witness"), F.lit(True).alias("replayed"))
    return m.join(replay, [*KEYS, "witness"], "left").na.fill(False, ["replayed"])


@query(f"""WITH {OCC}, t AS (SELECT DISTINCT source, target, before, ascii(kind) - 49 AS v, quantity % 2 = 1 AS flag FROM occ WHERE quantity >= 40),
e AS (SELECT DISTINCT source, target FROM t), a AS (SELECT i FROM range(64) r(i)),
h AS (SELECT e.source, e.target, a.i, coalesce(bool_or(t.before AND (a.i >> t.v) & 1 = 1 AND ((a.i >> 5) & 1 = 1) = t.flag), false) AS l, coalesce(bool_or(NOT t.before AND (a.i >> t.v) & 1 = 1 AND ((a.i >> 5) & 1 = 1) = t.flag), false) AS r
 FROM e CROSS JOIN a JOIN t ON t.source = e.source AND t.target = e.target GROUP BY ALL),
g AS (SELECT source, target, bool_or(l) AS l, bool_or(r) AS r, bool_and(NOT l OR r) AS onward, bool_and(NOT r OR l) AS back FROM h GROUP BY ALL)
SELECT source, target, CASE WHEN NOT l AND NOT r THEN 'ABSENT' WHEN NOT l THEN 'INTRODUCED' WHEN NOT r THEN 'RESOLVED' WHEN onward AND back THEN 'PERSISTED' WHEN onward THEN 'WIDENED' WHEN back THEN 'NARROWED' ELSE 'CHANGED' END AS verdict FROM g""")
def t_symbolic_delta(spark, d):
    """Symbolic regions of every edge before and after a date, terms over the
    kinds of its occurrences and a flag, compared by satisfiability proofs."""
    o = occurrences(spark, d).where("quantity >= 40")
    term = F.array(F.concat(F.lit("kind"), F.substring("kind", 1, 1)), F.when(F.col("quantity") % 2 == 1, "flag").otherwise("!flag"))
    sides = o.groupBy(*KEYS).agg(F.collect_set(F.when(F.col("before"), term)).alias("left"), F.collect_set(F.when(~F.col("before"), term)).alias("right"))
    return regions.symbolic_delta(sides, KEYS)


# -- windows, pages, sets ------------------------------------------------------------------------------------
@query("SELECT source, name, n FROM (SELECT source, regexp_extract(path, '[^/]+$') AS name, count(DISTINCT path) AS n FROM documents GROUP BY ALL) WHERE n > 1")
def w_ambiguous(spark, d):
    """Logical names with more than one owner in a scope."""
    return table(spark, d, "documents").select("source", "path").distinct().groupBy("source", F.regexp_extract("path", "([^/]+)$", 1).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def q_offset_page(spark, d):
    """Third report page of fifty (the page is the feature)."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


@query("SELECT DISTINCT context, identity, evidence[1] AS first_evidence, coalesce(len(evidence), 0) > 1 AS more FROM kg_nodes")
def q_bounded_list(spark, d):
    """Lists cut to one entry with a mark that there is more (a display form)."""
    return table(spark, d, "kg_nodes").select("context", "identity", F.slice("evidence", 1, 1)[0].alias("first_evidence"), (F.coalesce(F.size("evidence"), F.lit(0)) > 1).alias("more")).distinct()


@query("""WITH v AS (SELECT id, revision, max(upper(state)) AS state, max(reason) AS reason, max(size) AS size FROM jobs GROUP BY ALL), p AS (SELECT *, lag(revision) OVER w AS was, lag(state) OVER w AS s, lag(reason) OVER w AS r, lag(size) OVER w AS z FROM v WINDOW w AS (PARTITION BY id ORDER BY revision))
SELECT id, revision, concat_ws(',', CASE WHEN reason IS DISTINCT FROM r THEN 'reason' END, CASE WHEN size IS DISTINCT FROM z THEN 'size' END, CASE WHEN state IS DISTINCT FROM s THEN 'state' END) AS drift FROM p WHERE was IS NOT NULL""")
def u_map_drift(spark, d):
    """Fields that differ from one version of a job to the next."""
    v = table(spark, d, "jobs").groupBy("id", "revision").agg(F.max(F.upper("state")).alias("state"), F.max("reason").alias("reason"), F.max("size").alias("size"))
    w = Window.partitionBy("id").orderBy("revision")
    fields = ("reason", "size", "state")
    p = v.select("id", "revision", F.lag("revision").over(w).alias("was"), *fields, *[F.lag(f).over(w).alias(f"_{f}") for f in fields]).where("was is not null")
    return p.select("id", "revision", F.concat_ws(",", *[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]).alias("drift"))


@query(f"WITH {REL} SELECT DISTINCT context, kind FROM rel EXCEPT SELECT DISTINCT context, kind FROM rel WHERE state = 'CANDIDATES'")
def u_unselected(spark, d):
    """Relation kinds of each context without any candidate (ALL minus selected)."""
    r = Graph.load(spark, d).relationships().select("context", "kind", "state")
    return r.select("context", "kind").distinct().exceptAll(r.where("state = 'CANDIDATES'").select("context", "kind").distinct())


# -- findings, evolution, ledgers ------------------------------------------------------------------------------
@query(f"WITH {NAMED} SELECT fi.rule, fi.source, fi.target, count(*) AS n_supports, count(DISTINCT occ.world) AS n_worlds, max(occ.quantity) AS strongest, count(DISTINCT occ.kind) AS n_kinds FROM fi JOIN occ ON occ.source = fi.source AND occ.target = fi.target WHERE fi.quantifier IN ('MUST', 'MAY') GROUP BY ALL")
def r_bundle(spark, d):
    """Evidence bundle of each finding: its supporting occurrences."""
    f = _findings(spark, d).where("quantifier in ('MUST', 'MAY')").select("rule", "source", "target")
    o = occurrences(spark, d).groupBy("source", "target").agg(F.count("*").alias("n_supports"), F.count_distinct("world").alias("n_worlds"), F.max("quantity").alias("strongest"), F.count_distinct("kind").alias("n_kinds"))
    return f.join(o, ["source", "target"])


@query("""WITH l AS (SELECT DISTINCT unnest(evidence) AS digest FROM kg_nodes), r AS (SELECT DISTINCT raw_digest AS digest FROM source_outcomes)
SELECT coalesce(l.digest, r.digest) AS digest, CASE WHEN l.digest IS NULL THEN 'RIGHT_ONLY' WHEN r.digest IS NULL THEN 'LEFT_ONLY' ELSE 'BOTH' END AS side FROM l FULL JOIN r ON l.digest = r.digest""")
def e_evidence_delta(spark, d):
    """Evidence named by nodes against evidence observed."""
    a = table(spark, d, "kg_nodes").select(F.explode("evidence").alias("digest")).distinct().withColumn("l", F.lit(True))
    b = table(spark, d, "source_outcomes").select(F.col("raw_digest").alias("digest")).distinct().withColumn("r", F.lit(True))
    return a.join(b, "digest", "full").select("digest", F.when(F.col("l").isNull(), "RIGHT_ONLY").when(F.col("r").isNull(), "LEFT_ONLY").otherwise("BOTH").alias("side"))


@query(f"""WITH {OCC}, b AS (SELECT o_custkey AS site, before, l_suppkey AS bean, sum(quantity) AS q FROM occ GROUP BY ALL), s AS (SELECT site, before, arg_max(bean, (q, -bean)) AS bean FROM b GROUP BY ALL), l AS (SELECT * FROM s WHERE before), r AS (SELECT * FROM s WHERE NOT before)
SELECT coalesce(l.site, r.site) AS site, l.bean AS old_bean, r.bean AS new_bean, CASE WHEN l.site IS NULL THEN 'BOUND' WHEN r.site IS NULL THEN 'UNBOUND' WHEN l.bean <> r.bean THEN 'REBOUND' ELSE 'SAME' END AS change FROM l FULL JOIN r ON l.site = r.site""")
def e_binding_changes(spark, d):
    """Selected target of each site from left to right."""
    q = occurrences(spark, d).groupBy(F.col("o_custkey").alias("site"), "before", F.col("l_suppkey").alias("bean")).agg(F.sum("quantity").alias("q"))
    s = q.groupBy("site", "before").agg(F.max_by("bean", F.struct("q", (-F.col("bean")).alias("b"))).alias("bean"))
    l, r = s.where("before").select("site", F.col("bean").alias("old_bean")), s.where("not before").select("site", F.col("bean").alias("new_bean"))
    change = F.when(F.col("old_bean").isNull(), "BOUND").when(F.col("new_bean").isNull(), "UNBOUND").when(F.col("old_bean") != F.col("new_bean"), "REBOUND").otherwise("SAME")
    return l.join(r, "site", "full").select("site", "old_bean", "new_bean", change.alias("change"))


@query("""WITH g AS (SELECT DISTINCT source, path, observed_at, unnest(problems).reason AS reason FROM source_outcomes), k AS (SELECT source, path, max(observed_at) AS at FROM source_outcomes WHERE status = 'DECODED' GROUP BY ALL)
SELECT g.source, g.path, g.reason, CASE WHEN reason LIKE '%ENCODING%' OR reason LIKE '%CHARSET%' THEN 'ENCODING' WHEN reason LIKE '%SIZE%' OR reason LIKE '%LIMIT%' THEN 'LIMIT' ELSE 'OTHER' END AS family, coalesce(k.at > g.observed_at, false) AS resolved FROM g LEFT JOIN k ON k.source = g.source AND k.path = g.path""")
def v_resolution(spark, d):
    """Gaps by catalogued family, and whether a later observation resolved them."""
    o = table(spark, d, "source_outcomes")
    g = o.select("source", "path", "observed_at", F.explode("problems").alias("p")).select("source", "path", "observed_at", F.col("p.reason").alias("reason")).distinct()
    k = o.where("status = 'DECODED'").groupBy("source", "path").agg(F.max("observed_at").alias("at"))
    r = F.col("reason")
    family = F.when(r.contains("ENCODING") | r.contains("CHARSET"), "ENCODING").when(r.contains("SIZE") | r.contains("LIMIT"), "LIMIT").otherwise("OTHER")
    return g.join(k, ["source", "path"], "left").select("source", "path", "reason", family.alias("family"), F.coalesce(F.col("at") > F.col("observed_at"), F.lit(False)).alias("resolved"))


@query("""WITH c AS (SELECT DISTINCT c.identity AS context, s.repository, s.sealed_at FROM kg_contexts c JOIN seals s ON s.revision = c.snapshot) SELECT context AS right_context, lag(context) OVER (PARTITION BY repository ORDER BY sealed_at, context) AS left_context, repository FROM c""")
def v_comparison_pairs(spark, d):
    """Contexts of a repository in order, each with the one before it."""
    c = table(spark, d, "kg_contexts").select(F.col("identity").alias("context"), F.col("snapshot").alias("revision")).distinct().join(table(spark, d, "seals"), "revision").select("context", "repository", "sealed_at").distinct()
    return c.select(F.col("context").alias("right_context"), F.lag("context").over(Window.partitionBy("repository").orderBy("sealed_at", "context")).alias("left_context"), "repository")


@query(f"""WITH {CLASSIFIED}, t AS (SELECT source, count(*) AS total, count(*) FILTER (quantifier = 'UNKNOWN') AS gaps FROM cl GROUP BY source)
SELECT source, 'edges' AS operation, CASE WHEN total = 0 THEN 'NOT_APPLICABLE' WHEN gaps > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, least(total, 20) AS n_items, total AS exact_total, total > 20 AS continues FROM t""")
def k_envelope(spark, d):
    """Result envelope of a paged query per subject: status, bounds, continuation."""
    t = _classified(spark, d).groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quantifier") == "UNKNOWN").alias("gaps"))
    status = F.when(F.col("total") == 0, "NOT_APPLICABLE").when(F.col("gaps") > 0, "PARTIAL").otherwise("COMPLETE")
    return t.select("source", F.lit("edges").alias("operation"), status.alias("status"), F.least("total", F.lit(20)).alias("n_items"), F.col("total").alias("exact_total"), (F.col("total") > 20).alias("continues"))


# -- declarations -----------------------------------------------------------------------------------------------
@query("""SELECT doc_id, 'import' AS what, unnest(regexp_extract_all(text, '(?m)^import\\s+(?:static\\s+)?([A-Za-z_$][\\w$.]*)', 1)) AS name FROM documents WHERE regexp_matches(path, '(?i)\\.java$') AND text IS NOT NULL
UNION SELECT doc_id, 'type', unnest(regexp_extract_all(text, '(?m)^(?:(?:public|protected|private|abstract|final|sealed|static|strictfp) +)*(?:class|interface|enum|record) +([A-Za-z_$][\\w$]*)', 1)) FROM documents WHERE regexp_matches(path, '(?i)\\.java$') AND text IS NOT NULL
UNION SELECT doc_id, 'package', unnest(regexp_extract_all(text, '(?m)^package\\s+([A-Za-z_$][\\w$.]*)', 1)) FROM documents WHERE regexp_matches(path, '(?i)\\.java$') AND text IS NOT NULL""")
def s_declarations(spark, d):
    """Packages, imports and top-level types of Java files, by their lines."""
    return extract.declarations(table(spark, d, "documents"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(?:from|import) +([A-Za-z_.][\\w.]*)', 1)) AS module FROM documents WHERE regexp_matches(path, '(?i)\\.pyi?$') AND text IS NOT NULL")
def s_python_imports(spark, d):
    return extract.python_imports(table(spark, d, "documents"))


# -- expressions and discovery ------------------------------------------------------------------------------------
_EXPRESSIONS = {"big": "${size:0} > 50000 and !(${state} == 'PENDING')", "known": "#{${digest:none} != 'none'}", "label": "'${state}/${reason:none}' == 'RUNNING/STEP'", "half": "(${size} / 2 + 1) % 2 < 1 ? true : ${flag:false}"}


@query("""SELECT id, revision, sequence, loaded_at, coalesce(size, 0) > 50000 AND upper(state) <> 'PENDING' AS big, coalesce(digest, 'none') <> 'none' AS known, upper(state) || '/' || coalesce(reason, 'none') = 'RUNNING/STEP' AS label,
 CASE WHEN size IS NULL THEN NULL ELSE (size / 2.0 + 1) % 2 < 1 END AS half FROM jobs""")
def b_expressions(spark, d):
    """Expressions judged over the properties of every job row."""
    j = table(spark, d, "jobs")
    props = {"size": F.col("size").cast("string"), "state": F.upper("state"), "digest": F.col("digest"), "reason": F.col("reason"), "flag": F.lit(None).cast("string")}
    rows = j.select("id", "revision", "sequence", "loaded_at", *[c.alias(f"property_{n}") for n, c in props.items()])
    return rows.select("id", "revision", "sequence", "loaded_at", *[expressions.compile_expression(x).alias(n) for n, x in _EXPRESSIONS.items()])


@query("""SELECT user_id, ts, event_id, CASE WHEN b THEN 'NOT_REACHED' WHEN value > 480 THEN 'ERROR' WHEN event_type = 'refund' THEN 'UNKNOWN' WHEN value > 20 THEN 'DISCOVERED' ELSE 'SKIPPED' END AS state
FROM (SELECT *, coalesce(max((value > 480)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS b FROM events)""")
def b_discovery(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "refund", F.col("value") > 20).alias("verdict"), (F.col("value") > 480).alias("error"))
    return bridges.discovery(e, "user_id", "ts", "event_id", "verdict", "error")
