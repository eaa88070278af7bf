"""Evolution, ledgers, bridges, bindings, exports, functions and event queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bridges, evolution, policy
from ..operators.metrics import ratio
from ..operators.prefix import running_total
from ..session import table
from ..sources import documents as docs
from ..sources.graph import Graph
from ..streaming import events as streams
from .graph_queries import LE, N
from .region_queries import NAMED, _findings
from .registry import query
from .views import OCC, occurrences

# -- evolution ------------------------------------------------------------------------
@query("""WITH l AS (SELECT repository AS side_key, count(*) AS n FROM seals WHERE selection = 'sources' GROUP BY 1), r AS (SELECT source AS side_key, count(*) AS n FROM (SELECT DISTINCT source FROM documents) GROUP BY 1)
SELECT coalesce(l.side_key, r.side_key) AS name, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right,
CASE WHEN l.n > 1 OR r.n > 1 THEN 'AMBIGUOUS' WHEN r.n IS NULL THEN 'LEFT_ONLY' WHEN l.n IS NULL THEN 'RIGHT_ONLY' ELSE 'MATCHED' END AS alignment FROM l FULL JOIN r USING (side_key)""")
def e_alignment(spark, d):
    left = table(spark, d, "seals").where("selection = 'sources'").select(F.col("repository").alias("name"))
    right = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return evolution.align(left, right, "name")


@query("""WITH p AS (SELECT *, lag(revision) OVER w AS lr, lag(selection) OVER w AS ls, lag(digest) OVER w AS ld FROM seals WINDOW w AS (PARTITION BY repository ORDER BY sealed_at, revision))
SELECT revision, concat_ws(',', CASE WHEN ls <> selection THEN 'SELECTION_DRIFT' END, CASE WHEN ld <> digest THEN 'DIGEST_DRIFT' END) AS drift, CASE WHEN ls = selection AND ld = digest THEN 'COMPARABLE' ELSE 'QUALIFIED' END AS verdict FROM p WHERE lr IS NOT NULL""")
def e_compatibility(spark, d):
    """Configuration drift of each sealed revision against the one before."""
    w = Window.partitionBy("repository").orderBy("sealed_at", "revision")
    s = table(spark, d, "seals")
    p = s.select("revision", F.lag("revision").over(w).alias("left_revision"), *[x for f in ("selection", "digest") for x in (F.lag(f).over(w).alias(f"left_{f}"), F.col(f).alias(f"right_{f}"))]).where("left_revision is not null")
    return evolution.compatibility(p, ["selection", "digest"]).select("revision", F.array_join("drift", ",").alias("drift"), "verdict")


SIDES = f"""WITH {OCC}, g AS (SELECT before, o_custkey AS source, l_suppkey AS target, count(*) AS multiplicity, max(kind) AS kind, min(quantity) AS location FROM occ GROUP BY ALL),
l AS (SELECT * FROM g WHERE before), r AS (SELECT * FROM g WHERE NOT before)"""


@query(SIDES + """ SELECT coalesce(l.source, r.source) AS source, coalesce(l.target, r.target) AS target, CASE WHEN l.source IS NULL THEN 'ADDED' WHEN r.source IS NULL THEN 'REMOVED' WHEN l.kind <> r.kind THEN 'CHANGED'
WHEN l.multiplicity <> r.multiplicity OR l.location <> r.location THEN 'SUPPORT_CHANGED' ELSE 'UNCHANGED' END AS delta, concat_ws(',', CASE WHEN l.multiplicity <> r.multiplicity THEN 'multiplicity' END, CASE WHEN l.location <> r.location THEN 'location' END) AS axes
FROM l FULL JOIN r ON l.source = r.source AND l.target = r.target""")
def e_relation_delta(spark, d):
    """Type edges before and after 1998 with the axes of changed support."""
    o = occurrences(spark, d).groupBy("before", F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.count("*").alias("multiplicity"), F.max("kind").alias("kind"), F.min("quantity").alias("location"))
    return evolution.delta(o.where("before"), o.where("not before"), ["source", "target"], ["kind"], ["multiplicity", "location"])


@query("""WITH o AS (SELECT o_custkey AS entity, o_orderdate < '1998-01-01' AS before, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT * FROM o WHERE before), r AS (SELECT * FROM o WHERE NOT before)
SELECT coalesce(l.entity, r.entity) AS entity, CASE WHEN l.entity IS NULL THEN 'ADDED' WHEN r.entity IS NULL THEN 'REMOVED' WHEN l.n <> r.n THEN 'CHANGED' ELSE 'UNCHANGED' END AS delta FROM l FULL JOIN r ON l.entity = r.entity""")
def e_entity_delta(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity"), (F.col("o_orderdate") < "1998-01-01").alias("before")).agg(F.count("*").alias("n"))
    return evolution.delta(o.where("before"), o.where("not before"), ["entity"], ["n"]).select("entity", "delta")


@query("""WITH o AS (SELECT o_custkey AS subject, year(o_orderdate)::int AS position, max(o_totalprice) > 400000 AS present FROM orders GROUP BY ALL),
x AS (SELECT *, lag(present) OVER w AS was, max(present::int) OVER (PARTITION BY subject ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever, min(CASE WHEN present THEN position END) OVER (PARTITION BY subject ORDER BY position ROWS UNBOUNDED PRECEDING) AS earliest FROM o WINDOW w AS (PARTITION BY subject ORDER BY position))
SELECT subject, position, CASE WHEN present AND was IS NULL THEN 'FIRST' WHEN present AND was THEN 'PERSISTED' WHEN present AND ever = 1 THEN 'REINTRODUCED' WHEN present THEN 'INTRODUCED' WHEN coalesce(was, false) THEN 'RESOLVED' ELSE 'CLEAN' END AS transition, earliest FROM x""")
def e_history(spark, d):
    """Finding history: a finding is a year with a very dear order."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject"), F.year("o_orderdate").alias("position")).agg((F.max("o_totalprice") > 400000).alias("present"))
    return policy.previous(o, ["subject"], "position", "present").select("subject", "position", "transition", "earliest")


@query(f"""WITH {OCC}, m AS (SELECT source, count(DISTINCT target) FILTER (before AND quantity >= 48) AS ln, count(*) FILTER (before) AS ld, count(DISTINCT target) FILTER (NOT before AND quantity >= 48) AS rn, count(*) FILTER (NOT before) AS rd FROM occ GROUP BY source),
x AS (SELECT source, rn * ld - ln * rd AS n, ld * rd AS d, ln, rd FROM m WHERE ld > 0 AND rd > 0)
SELECT source, (n / gcd(abs(n)::hugeint, d::hugeint))::bigint AS delta_n, (d / gcd(abs(n)::hugeint, d::hugeint))::bigint AS delta_d, CASE WHEN ln = 0 THEN NULL ELSE round(100.0 * n::double / rd / ln, 6) END AS percent FROM x""")
def e_metric_delta(spark, d):
    """Exact change of a ratio from left to right, reduced."""
    o, b = occurrences(spark, d), F.col("before")
    big = F.col("quantity") >= 48
    m = o.groupBy("source").agg(F.count_distinct(F.when(b & big, F.col("target"))).alias("ln"), F.count_if(b).alias("ld"), F.count_distinct(F.when(~b & big, F.col("target"))).alias("rn"), F.count_if(~b).alias("rd"))
    return evolution.fraction_delta(m.where("ld > 0 and rd > 0")).select("source", "delta_n", "delta_d", "percent")


@query("""WITH l AS (SELECT c_mktsegment AS dimension, round(avg(o_totalprice)) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < '1998-01-01' GROUP BY 1),
r AS (SELECT c_mktsegment AS dimension, CASE WHEN c_mktsegment <> 'BUILDING' THEN round(avg(o_totalprice)) END AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= '1998-01-01' GROUP BY 1)
SELECT coalesce(l.dimension, r.dimension) AS dimension, l.v AS before, r.v AS after, r.v - l.v AS difference, CASE WHEN r.dimension IS NULL THEN 'LEFT_ONLY' WHEN l.dimension IS NULL THEN 'RIGHT_ONLY' WHEN (l.v IS NULL) <> (r.v IS NULL) THEN 'APPLICABILITY_CHANGED' ELSE 'PAIRED' END AS state FROM l FULL JOIN r ON l.dimension = r.dimension""")
def e_score_delta(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("dimension"), (F.col("o_orderdate") < "1998-01-01").alias("before_")).agg(F.round(F.avg("o_totalprice")).alias("v"))
    right = o.where("not before_").withColumn("v", F.when(F.col("dimension") != "BUILDING", F.col("v")))
    return evolution.paired(o.where("before_"), right, "dimension", "v")


@query(f"""{SIDES.replace('WITH', 'WITH', 1)}, f AS (SELECT before, source, target FROM g WHERE multiplicity >= 2) SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target,
CASE WHEN a.source IS NULL THEN CASE WHEN (b.source, b.target) IN (SELECT (source, target) FROM l) THEN 'INTRODUCED' ELSE 'UNKNOWN_TO_PRESENT' END WHEN b.source IS NULL THEN CASE WHEN (a.source, a.target) IN (SELECT (source, target) FROM r) THEN 'RESOLVED' ELSE 'PRESENT_TO_UNKNOWN' END ELSE 'PERSISTED' END AS transition
FROM (SELECT * FROM f WHERE before) a FULL JOIN (SELECT * FROM f WHERE NOT before) b ON a.source = b.source AND a.target = b.target""")
def e_finding_transition(spark, d):
    """Findings (edges with several supports) from left to right; a finding whose
    edge is not seen on the other side is unknown there, never resolved."""
    g = occurrences(spark, d).groupBy("before", F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.count("*").alias("m"))
    both = g.groupBy("source", "target").agg(F.max(F.when(F.col("before"), F.col("m"))).alias("l"), F.max(F.when(~F.col("before"), F.col("m"))).alias("r"))
    a, b = F.coalesce(F.col("l") >= 2, F.lit(False)), F.coalesce(F.col("r") >= 2, F.lit(False))
    state = F.when(a & b, "PERSISTED").when(b & F.col("l").isNull(), "UNKNOWN_TO_PRESENT").when(b, "INTRODUCED").when(F.col("r").isNull(), "PRESENT_TO_UNKNOWN").otherwise("RESOLVED")
    return both.where(a | b).select("source", "target", state.alias("transition"))


@query("SELECT split_part(space, '/', 2) AS section, count(*) AS n_rows, count(DISTINCT space) AS n_spaces FROM (SELECT DISTINCT space, k, payload FROM comparison_rows) GROUP BY 1")
def e_sections(spark, d):
    """Rows of each section of the comparisons."""
    return table(spark, d, "comparison_rows").select("space", "k", "payload").distinct().groupBy(F.split("space", "/")[1].alias("section")).agg(F.count("*").alias("n_rows"), F.count_distinct("space").alias("n_spaces"))


@query("""WITH r AS (SELECT space, ('0x' || substr(md5(k || chr(31) || payload), 1, 12))::bigint AS h, row_number() OVER (PARTITION BY space ORDER BY k, payload) AS place FROM (SELECT DISTINCT space, k, payload FROM comparison_rows))
SELECT space, count(*) AS n_rows, (sum(h) % 1000000007)::bigint AS digest, (sum(h % 1000003 * (place % 1000003)) % 1000000007)::bigint AS ordered_digest FROM r GROUP BY space""")
def e_census(spark, d):
    """Rows of every section side with a digest of their set and one of their order."""
    return evolution.census(table(spark, d, "comparison_rows").select("space", "k", "payload").distinct(), "space", ["k", "payload"])


# -- ledgers and bridges -----------------------------------------------------------------
@query("""SELECT source, path, count(DISTINCT status) AS n_answers, count(*) AS n_attempts, count(*) FILTER (status IS NULL) AS n_empty, max(observed_at) AS last_at,
CASE WHEN count(DISTINCT status) > 1 THEN 'CONFLICTED' WHEN count(DISTINCT status) = 0 THEN 'PENDING' WHEN count(*) FILTER (status IS NULL) > 0 THEN 'NARROWED' ELSE 'SATISFIED' END AS state FROM source_outcomes GROUP BY source, path""")
def v_ledger_state(spark, d):
    return bridges.ledger(table(spark, d, "source_outcomes"), ["source", "path"], "status", "observed_at")


@query("""SELECT p.reason, p.requirement, count(*) AS n_gaps, count(DISTINCT source) AS n_sources FROM (SELECT DISTINCT source, path, raw_digest, unnest(problems) AS p FROM source_outcomes) GROUP BY ALL""")
def v_gaps(spark, d):
    """Gaps by reason and requirement."""
    o = table(spark, d, "source_outcomes").select("source", "path", "raw_digest", F.explode("problems").alias("p")).distinct()
    return o.groupBy(F.col("p.reason").alias("reason"), F.col("p.requirement").alias("requirement")).agg(F.count("*").alias("n_gaps"), F.count_distinct("source").alias("n_sources"))


@query("""WITH c AS (SELECT DISTINCT source, path FROM documents), e AS (SELECT source, path, count(*) AS n FROM source_outcomes GROUP BY ALL)
SELECT coalesce(c.source, e.source) AS source, coalesce(c.path, e.path) AS path, coalesce(n, 0) AS n_emitted, CASE WHEN c.path IS NULL THEN 'FOREIGN' WHEN n IS NULL THEN 'OMITTED' ELSE 'EMITTED' END AS status FROM c FULL JOIN e ON c.source = e.source AND c.path = e.path""")
def v_reconcile(spark, d):
    """Documents (census) against outcomes (emissions)."""
    return bridges.reconcile(table(spark, d, "documents"), table(spark, d, "source_outcomes"), ["source", "path"])


BRIDGE = f"""WITH {N}, q AS (SELECT DISTINCT identity, context, kind, target.state AS state, target.identities AS ids, region FROM kg_edges),
c AS (SELECT q.identity AS requirement, CASE WHEN t.identity IS NULL THEN 'OPEN' WHEN state = 'CANDIDATES' AND region IS NULL THEN 'UNCERTAIN' ELSE 'EXACT' END AS fit, region IS NOT NULL AS unrouted
 FROM (SELECT identity, context, state, region, unnest(ids) AS id FROM q) q LEFT JOIN (SELECT DISTINCT context, identity FROM n) t ON t.context = q.context AND t.identity = q.id UNION ALL SELECT identity, 'NONE', false FROM q WHERE len(ids) = 0),
s AS (SELECT requirement, CASE WHEN count(*) FILTER (fit = 'EXACT') > 1 THEN 'AMBIGUOUS' WHEN count(*) FILTER (fit = 'UNCERTAIN') > 0 OR count(*) FILTER (fit = 'EXACT') = 1 AND count(*) FILTER (fit = 'OPEN') > 0 THEN 'CANDIDATE'
 WHEN count(*) FILTER (fit = 'EXACT') = 1 AND bool_or(unrouted) THEN 'CONTRACT_ONLY' WHEN count(*) FILTER (fit = 'EXACT') = 1 THEN 'BOUND' ELSE 'UNRESOLVED' END AS state FROM c GROUP BY requirement)"""


def _bridge(spark, d):
    g = Graph.load(spark, d)
    e = g.relationships()
    known = g.nodes.select("context", F.col("identity").alias("id")).distinct().withColumn("known", F.lit(True))
    spread = e.select(F.col("identity").alias("requirement"), "context", "state", "region", F.explode_outer("targets").alias("id")).join(known, ["context", "id"], "left")
    fit = F.when(F.col("id").isNull(), "NONE").when(F.col("known").isNull(), "OPEN").when((F.col("state") == "CANDIDATES") & F.col("region").isNull(), "UNCERTAIN").otherwise("EXACT")
    return bridges.states(spread.select("requirement", fit.alias("fit"), (F.col("region").isNotNull() & F.col("id").isNotNull()).alias("unrouted")))


@query(BRIDGE + " SELECT * FROM s")
def v_bridge_states(spark, d):
    """Binding state of every relation, by the candidates it names."""
    return _bridge(spark, d)


@query(BRIDGE + f", o AS (SELECT unnest({list(bridges.STATES)!r}) AS state) SELECT o.state, count(s.requirement) AS n FROM o LEFT JOIN s USING (state) GROUP BY 1")
def v_bridge_counts(spark, d):
    return bridges.counts(_bridge(spark, d))


@query("""WITH r AS (SELECT requirement, count(*) AS n FROM (SELECT DISTINCT l_partkey AS requirement, l_suppkey FROM lineitem) GROUP BY 1)
SELECT l.l_partkey AS requirement, l.l_suppkey AS candidate, CASE WHEN bool_or(p.p_size IS NULL) THEN 'UNCERTAIN' ELSE 'EXACT' END AS fit FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part p ON p_partkey = l_partkey JOIN supplier s ON s_suppkey = l_suppkey
WHERE (p.p_size % 5) = (s.s_nationkey % 5) GROUP BY ALL""")
def v_compatible(spark, d):
    """Candidates that agree with the requirement in its operand."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("requirement"), (F.col("p_size") % 5).alias("lane"))
    req = table(spark, d, "lineitem").select(F.col("l_partkey").alias("requirement"), F.col("l_suppkey").alias("candidate")).distinct().join(part, "requirement")
    ends = table(spark, d, "supplier").select(F.col("s_suppkey").alias("endpoint"), (F.col("s_nationkey") % 5).alias("lane"))
    return bridges.compatible(req, ends, ["lane"])


ROUTES = ["/orders/{id}/open", "/orders/{id}/{state}", "/orders/list", "/{kind}/{id}/closed", "/customers/{id}", "/orders/*/x", "/orders/../x"]


@query(f"""WITH q AS (SELECT '/orders/' || o_orderkey || '/' || CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'part' END AS request FROM orders)
SELECT request, unnest(CASE WHEN request LIKE '%/open' THEN ['/orders/{{id}}/open', '/orders/{{id}}/{{state}}'] WHEN request LIKE '%/closed' THEN ['/orders/{{id}}/{{state}}', '/{{kind}}/{{id}}/closed'] ELSE ['/orders/{{id}}/{{state}}'] END) AS route FROM q""")
def j_uri_match(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("part")
    calls = table(spark, d, "orders").select(F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string"), F.lit("/"), state).alias("request"))
    return bridges.uri_join(calls, spark.createDataFrame([(r,) for r in ROUTES], "route string"))


@query("""WITH f AS (SELECT DISTINCT source AS scope, path FROM documents), r AS (SELECT DISTINCT source AS scope, regexp_extract(path, '^(.*)/[^/]+/[^/]+$', 1) AS root FROM source_outcomes WHERE path LIKE '%/%/%')
SELECT f.scope, f.path, max_by(r.root, length(r.root)) AS root FROM f JOIN r ON r.scope = f.scope AND starts_with(f.path, r.root || '/') GROUP BY ALL""")
def j_prefix_owner(spark, d):
    """Each document to the deepest source root that contains it."""
    f = table(spark, d, "documents").select(F.col("source").alias("scope"), "path").distinct()
    r = table(spark, d, "source_outcomes").where(F.col("path").like("%/%/%")).select(F.col("source").alias("scope"), F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+$", 1).alias("root"))
    return bridges.prefix_join(f, r)


@query("""WITH c AS (SELECT DISTINCT word AS name, lang AS call FROM common_words), h AS (SELECT DISTINCT lang AS handler, word FROM common_words), s AS (SELECT handler, unnest([word, lower(word[1]) || word[2:], word || 'Async']) AS name FROM h) SELECT DISTINCT call, handler FROM c JOIN s USING (name)""")
def j_rpc_spelling(spark, d):
    w = table(spark, d, "common_words")
    return bridges.rpc_join(w.select(F.col("word").alias("name"), F.col("lang").alias("call")), w.select(F.col("lang").alias("handler"), "word"), scalars.rpc_spellings(F.col("word")))


@query("""WITH RECURSIVE m AS (SELECT id, max(CASE WHEN target IS NULL THEN 'OPEN' ELSE 'SATISFIED' END) AS state FROM (SELECT id, max(target) AS target FROM readiness_modules GROUP BY id) GROUP BY id), x AS (SELECT DISTINCT id, unnest(dependencies) AS needed FROM readiness_modules),
h AS (SELECT x.id FROM x JOIN m ON m.id = x.needed WHERE m.state = 'OPEN' UNION SELECT x.id FROM x JOIN h ON h.id = x.needed) SELECT m.id, CASE WHEN h.id IS NOT NULL THEN 'PENDING' ELSE m.state END AS state, h.id IS NOT NULL AS blocked FROM m LEFT JOIN h ON h.id = m.id""")
def v_prerequisites(spark, d):
    r = table(spark, d, "readiness_modules")
    m = r.groupBy("id").agg(F.max("target").alias("t")).select("id", F.when(F.col("t").isNull(), "OPEN").otherwise("SATISFIED").alias("state"))
    return bridges.prerequisites(m, r.select("id", F.explode("dependencies").alias("needed")).distinct())


@query("SELECT plan, language, count(DISTINCT id) AS n_modules, count(DISTINCT id) FILTER (target IS NULL) AS n_open FROM (SELECT plan, id, target, unnest(languages) AS language FROM readiness_modules) GROUP BY ALL")
def v_readiness(spark, d):
    """Readiness of each plan by language."""
    r = table(spark, d, "readiness_modules").select("plan", "id", "target", F.explode("languages").alias("language"))
    return r.groupBy("plan", "language").agg(F.count_distinct("id").alias("n_modules"), F.count_distinct(F.when(F.col("target").isNull(), F.col("id"))).alias("n_open"))


@query("""SELECT id, revision, sequence, loaded_at, CASE WHEN m IS NULL OR revision > m THEN 'ACCEPTED' ELSE 'REJECTED' END AS verdict FROM (SELECT *, max(revision) OVER (PARTITION BY id ORDER BY loaded_at, sequence, revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT DISTINCT id, revision, sequence, loaded_at FROM jobs))""")
def v_admission(spark, d):
    """Fence check of delivered job versions in order of arrival."""
    return streams.fenced_batch(table(spark, d, "jobs").select("id", "revision", "sequence", "loaded_at").distinct())


# -- bindings ------------------------------------------------------------------------------
BEANS = """WITH si AS (SELECT c_custkey AS site, c_nationkey AS type, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS wanted, c_custkey % 2 = 0 AS optional, 's' || (c_custkey % 50) AS site_name FROM customer),
be AS (SELECT s_suppkey AS bean, s_nationkey AS type, ['BUILDING', 'AUTOMOBILE', 'MACHINERY'][s_suppkey % 3 + 1] AS qualifier, s_acctbal > -500 AS autowire, s_acctbal > 0 AS by_default, s_acctbal > 8000 AS "primary", s_acctbal < 1000 AS fallback, 's' || (s_suppkey % 50) AS bean_name, (s_suppkey % 7)::int AS priority FROM supplier),
ca AS (SELECT *, autowire AND CASE WHEN wanted IS NOT NULL THEN qualifier = wanted ELSE by_default END AS eligible FROM si JOIN be USING (type)),
g AS (SELECT site, count(*) FILTER (eligible) AS n, max(bean) FILTER (eligible) AS b1, count(*) FILTER (eligible AND "primary") AS np, max(bean) FILTER (eligible AND "primary") AS b2, count(*) FILTER (eligible AND NOT fallback) AS nr, max(bean) FILTER (eligible AND NOT fallback) AS b3,
 max(bean) FILTER (eligible AND bean_name = site_name) AS b4, min(priority) FILTER (eligible) AS lo, bool_or(optional) AS optional FROM ca GROUP BY site),
h AS (SELECT g.*, (SELECT count(*) FROM ca WHERE ca.site = g.site AND eligible AND priority = lo) AS nl, (SELECT max(bean) FROM ca WHERE ca.site = g.site AND eligible AND priority = lo) AS b5 FROM g)"""


def _injection(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    sites = c.select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("type"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("wanted"), (F.col("c_custkey") % 2 == 0).alias("optional"), F.concat(F.lit("s"), F.col("c_custkey") % 50).alias("site_name"))
    beans = s.select(
        F.col("s_suppkey").alias("bean"), F.col("s_nationkey").alias("type"), F.element_at(F.array(*map(F.lit, ("BUILDING", "AUTOMOBILE", "MACHINERY"))), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("qualifier"), (F.col("s_acctbal") > -500).alias("autowire"),
        (F.col("s_acctbal") > 0).alias("by_default"), (F.col("s_acctbal") > 8000).alias("primary"), (F.col("s_acctbal") < 1000).alias("fallback"), F.concat(F.lit("s"), F.col("s_suppkey") % 50).alias("bean_name"), (F.col("s_suppkey") % 7).cast("int").alias("priority"))
    return sites, beans


@query(BEANS + """, k AS (SELECT site, n, CASE WHEN n = 0 AND optional THEN 'ABSENT_OPTIONAL' WHEN n = 0 THEN 'UNSATISFIED' WHEN n = 1 THEN 'SELECTED' WHEN np > 1 THEN 'AMBIGUOUS' WHEN np = 1 OR nr = 1 OR b4 IS NOT NULL OR nl = 1 THEN 'SELECTED' ELSE 'AMBIGUOUS' END AS state,
 CASE WHEN n = 1 THEN b1 WHEN np = 1 THEN b2 WHEN nr = 1 THEN b3 WHEN b4 IS NOT NULL THEN b4 WHEN nl = 1 THEN b5 END AS bean FROM h) SELECT site, n, state, CASE WHEN state = 'SELECTED' THEN bean END AS bean FROM k""")
def b_select(spark, d):
    """Injection binding: one bean per site by the selection cascade, for the
    sites whose type is registered at all."""
    sites, beans = _injection(spark, d)
    return bridges.bindings(sites.join(beans.select("type").distinct(), "type", "left_semi"), beans)


@query(BEANS + " SELECT type, count(DISTINCT site) AS n_sites, count(DISTINCT bean) FILTER (eligible) AS n_beans, count(*) FILTER (eligible) AS n_pairs FROM ca GROUP BY type")
def b_inventory(spark, d):
    return bridges.inventory(*_injection(spark, d))


@query("""SELECT user_id, ts, event_id, CASE WHEN b OR value IS NULL OR event_type = 'refund' THEN 'UNKNOWN' WHEN value > 20 THEN 'ACCEPTED' ELSE 'SKIPPED' END AS state
FROM (SELECT *, coalesce(max((value IS NULL OR event_type = 'refund')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS b FROM events)""")
def b_registration(spark, d):
    """Registration steps of each user in order; a refund is undecidable."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "refund", F.col("value") > 20).alias("verdict"))
    return bridges.registration(e, "user_id", "ts", "event_id", "verdict")


@query("""WITH x AS (SELECT s_nationkey AS condition, s_acctbal > 3000 AS definite, s_acctbal > 0 AS possible, s_acctbal > 6000 AS "primary" FROM supplier), g AS (SELECT condition, count(*) FILTER (definite) AS s, count(*) FILTER (possible) AS m, count(*) FILTER (definite AND "primary") AS p, count(*) FILTER (possible AND "primary") AS q FROM x GROUP BY 1)
SELECT condition, CASE WHEN s > 0 THEN true WHEN m = 0 THEN false END AS present, CASE WHEN s > 0 THEN false WHEN m = 0 THEN true END AS missing, CASE WHEN m = 0 THEN false WHEN s = 1 AND m = 1 THEN true WHEN p > 1 THEN false WHEN p = 1 AND q = 1 THEN true WHEN q > 0 THEN NULL WHEN s > 1 THEN false END AS single_candidate FROM g""")
def b_conditions(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("condition"), (F.col("s_acctbal") > 3000).alias("definite"), (F.col("s_acctbal") > 0).alias("possible"), (F.col("s_acctbal") > 6000).alias("primary"))
    return bridges.bean_conditions(s)


# -- exports ---------------------------------------------------------------------------------
@query(f"WITH {NAMED} SELECT sha256(rule || '|' || source || '|' || target) AS finding_key, '{{\"ruleId\":\"' || rule || '\",\"level\":\"' || CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END || '\",\"message\":{{\"text\":\"forbidden edge ' || source || ' -> ' || target || '\"}},\"partialFingerprints\":{{\"findingKey\":\"' || sha256(rule || '|' || source || '|' || target) || '\"}}}}' AS result FROM fi WHERE quantifier IN ('MUST', 'MAY')")
def k_sarif(spark, d):
    return docs.sarif(_findings(spark, d).where("quantifier in ('MUST', 'MAY')"))


@query(f"WITH {N}, {LE} SELECT context, 1 AS part, '<node id=\"' || identity || '\"><data key=\"kind\">' || kind || '</data></node>' AS line FROM n UNION ALL SELECT context, 2, '<edge source=\"' || source || '\" target=\"' || target || '\"/>' FROM le")
def k_graphml(spark, d):
    g = Graph.load(spark, d)
    return docs.graphml(g.distinct_nodes(), g.pairs())


@query(f"WITH {N}, {LE} SELECT context, 'nodes' AS part, '{{\"data\":{{\"id\":\"' || identity || '\",\"kind\":\"' || kind || '\"}}}}' AS element FROM n UNION ALL SELECT context, 'edges', '{{\"data\":{{\"id\":\"' || source || '->' || target || '\",\"source\":\"' || source || '\",\"target\":\"' || target || '\"}}}}' FROM le")
def k_cytoscape(spark, d):
    g = Graph.load(spark, d)
    return docs.cytoscape(g.distinct_nodes(), g.pairs())


# -- functions, sources and pages ----------------------------------------------------------------
@query("""SELECT doc_id, 'sha256:' || sha256(text) AS digest, regexp_extract(replace(path, '/', '.'), '^(.*)\\.[^.]*$', 1) AS package, CASE WHEN n_chars = 0 OR n_chars IS NULL THEN 0 ELSE 1000 * length(trim(text)) // n_chars END AS per_mille,
 NOT regexp_matches(path, '(^/)|(^[A-Za-z]:)|\\\\|(^|/)\\.\\.?(/|$)|//') AS safe FROM documents WHERE text IS NOT NULL""")
def f_scalars(spark, d):
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", scalars.digest(F.col("text")).alias("digest"), scalars.package_of(F.replace(F.col("path"), F.lit("/"), F.lit("."))).alias("package"),
                    scalars.per_mille(F.length(F.regexp_replace("text", r"^\p{Z}+|\p{Z}+$", "")), F.coalesce("n_chars", F.lit(0))).alias("per_mille"), scalars.safe_path(F.col("path")).alias("safe"))


@query("""SELECT source, path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'json' THEN 'json' WHEN 'xml' THEN 'xml' WHEN 'md' THEN 'markdown' WHEN 'rst' THEN 'restructuredtext' WHEN 'adoc' THEN 'asciidoc' WHEN 'txt' THEN 'text' ELSE 'unclassified' END AS language,
 CASE WHEN regexp_matches(path, '(^|/)(gen|generated)(/|$)') AND regexp_matches(path, '(^|/)(test|tests)(/|$)') THEN 'GENERATED_TEST' WHEN regexp_matches(path, '(^|/)(gen|generated)(/|$)') THEN 'GENERATED_MAIN' WHEN regexp_matches(path, '(^|/)(test|tests)(/|$)') THEN 'TEST' WHEN regexp_matches(path, '(^|/)main(/|$)') THEN 'MAIN' ELSE 'OTHER' END AS role FROM documents""")
def s_classify_files(spark, d):
    return docs.classify_files(table(spark, d, "documents"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '\\r\\n')) AS n_crlf, len(regexp_extract_all(text, '\\n')) - len(regexp_extract_all(text, '\\r\\n')) AS n_lf, len(regexp_extract_all(text, '\\r')) - len(regexp_extract_all(text, '\\r\\n')) AS n_cr FROM documents WHERE text IS NOT NULL""")
def s_line_ends(spark, d):
    c = docs.decode_text(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", c["n_crlf"].cast("bigint").alias("n_crlf"), c["n_lf"].cast("bigint").alias("n_lf"), c["n_cr"].cast("bigint").alias("n_cr"))


@query("WITH n AS (SELECT identity, context, row_number() OVER (PARTITION BY context ORDER BY identity) AS place, sum(octet_length(encode(identity))) OVER (PARTITION BY context ORDER BY identity) AS used FROM (SELECT DISTINCT identity, context FROM kg_nodes)) SELECT context, identity, used::bigint AS used FROM n WHERE used <= 2000")
def q_byte_page(spark, d):
    """Byte-bounded first page of each context (a running sum of lengths)."""
    n = Graph.load(spark, d).nodes.select("context", "identity").distinct().withColumn("bytes", F.octet_length("identity"))
    return running_total(n, "context", "identity", "bytes", "used").where("used <= 2000").select("context", "identity", "used")


@query("SELECT o_orderpriority AS kind, count(*) AS n, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*), 12) AS closed FROM orders GROUP BY 1")
def q_ratio(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("closed"))


# -- events -------------------------------------------------------------------------------------
@query("SELECT user_id, event_id, event_type AS stage, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS micros FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def st_stage_durations(spark, d):
    return streams.stage_durations(table(spark, d, "events"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def st_windows(spark, d):
    return streams.windowed(table(spark, d, "events"))


@query("""WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, g""")
def st_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))
