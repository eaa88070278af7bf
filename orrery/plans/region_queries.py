"""Truth regions, policies and assessment over the package graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy, regions, traversal
from ..operators.metrics import abstractness, degrees, distance
from ..session import checkpointed, table
from .registry import query
from .views import CLASSIFIED, FACTS, MEASURED, OCC, PACKAGES, WORLDS, facts, named_edges, occurrences, packages

KEYS = ["source", "target"]
R = "(CASE WHEN truth THEN 2 WHEN NOT truth THEN 0 ELSE 1 END)"
TRUTH = "CASE r WHEN 2 THEN true WHEN 0 THEN false END"


def _measured(spark, d):
    return regions.measure(facts(spark, d), KEYS, len(WORLDS))


def _classified(spark, d):
    return regions.classify(_measured(spark, d))


@query(f"WITH {CLASSIFIED} SELECT * FROM cl")
def t_classify(spark, d):
    return _classified(spark, d)


@query(f"WITH {MEASURED} SELECT *, CASE WHEN n_true > 0 AND n_false > 0 THEN 'MAY' WHEN n_unknown > 0 THEN 'UNKNOWN' WHEN n_true > 0 THEN 'MUST' ELSE 'NEVER' END AS quantifier FROM me")
def t_classify_open(spark, d):
    return regions.classify_open(_measured(spark, d))


for _mode, _where in {"MUST": "quantifier = 'MUST'", "MAY": "quantifier = 'MAY'", "MAY_AND_MUST": "quantifier IN ('MAY', 'MUST')", "BOUNDED_UNION": "quantifier <> 'NEVER'", "UNKNOWN_OVERLAY": "quantifier = 'UNKNOWN'", "REALIZED": "n_true > 0"}.items():
    def _projected(spark, d, mode=_mode):
        return regions.project(_classified(spark, d), mode).select("source", "target", "quantifier")

    _projected.__name__ = f"t_{_mode.lower()}"
    query(f"WITH {CLASSIFIED} SELECT source, target, quantifier FROM cl WHERE {_where}")(_projected)


@query(f"WITH {MEASURED} SELECT source, target, witness, CASE WHEN n_true > 0 THEN 'SAT' WHEN n_unknown > 0 THEN 'UNKNOWN' ELSE 'UNSAT' END AS verdict FROM me")
def t_witness(spark, d):
    return regions.check(_measured(spark, d)).select("source", "target", "witness", "verdict")


@query(f"WITH {FACTS}, k AS (SELECT DISTINCT source, target FROM fa), w AS (SELECT unnest({WORLDS!r}) AS world) SELECT k.source, k.target, w.world, CASE WHEN fa.world IS NULL THEN true WHEN truth THEN false END AS truth "
       "FROM k CROSS JOIN w LEFT JOIN fa ON fa.source = k.source AND fa.target = k.target AND fa.world = w.world")
def t_negate(spark, d):
    return regions.negate(facts(spark, d), KEYS, WORLDS)


@query(f"WITH {FACTS}, g AS (SELECT source, world, max({R}) AS r FROM fa GROUP BY ALL) SELECT source, world, {TRUTH} AS truth FROM g")
def t_combine_or(spark, d):
    """Does the package depend on anything, per world?"""
    return regions.fold(facts(spark, d), ["source"], every=False)


@query(f"WITH {FACTS}, g AS (SELECT source, world, min({R}) AS r FROM fa GROUP BY ALL) SELECT source, world, {TRUTH} AS truth FROM g")
def t_combine_and(spark, d):
    return regions.fold(facts(spark, d), ["source"], every=True)


@query(f"WITH {FACTS} SELECT source, target, array_to_string(list_sort(list(world)), ',') AS worlds FROM fa WHERE truth GROUP BY ALL")
def t_realizations(spark, d):
    return facts(spark, d).where("truth").groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list("world")), ",").alias("worlds"))


_TERMS = [("c1", "a", 0), ("c1", "a", 1), ("c1", "b", 2), ("c2", "a", 3), ("c2", "b", 4), ("c2", "b", 5), ("c2", "b", 6)]


@query(f"""WITH {FACTS}, s AS (SELECT source, world, max({R}) AS r FROM fa WHERE source <> target GROUP BY ALL),
t(condition, term, source) AS (VALUES {", ".join(map(str, _TERMS))}), z AS (SELECT condition, term, count(*) AS size FROM t GROUP BY ALL),
h AS (SELECT condition, term, size, world, CASE WHEN count(*) < size THEN 0 ELSE min(r) END AS r FROM s JOIN t USING (source) JOIN z USING (condition, term) GROUP BY condition, term, size, world),
g AS (SELECT condition, world, max(r) AS r FROM h GROUP BY ALL) SELECT condition, world, {TRUTH} AS truth FROM g""")
def t_condition_dnf(spark, d):
    """OR of AND terms over "the package depends on another one"."""
    s = regions.fold(facts(spark, d).where("source <> target"), ["source"], every=False)
    return regions.condition(s, "source", spark.createDataFrame(_TERMS, "condition string, term string, source int"))


@query(f"""WITH {OCC}, a AS (SELECT source, target, kind AS world, max(quantity) >= 48 AS truth FROM occ WHERE before GROUP BY ALL), b AS (SELECT source, target, kind AS world, CASE WHEN max(quantity) >= 48 THEN true WHEN max(quantity) < 46 THEN false END AS truth FROM occ WHERE NOT before GROUP BY ALL)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, coalesce(a.world, b.world) AS world,
CASE WHEN a.source IS NULL THEN 'RIGHT_ONLY' WHEN b.source IS NULL THEN 'LEFT_ONLY' WHEN a.truth IS NULL OR b.truth IS NULL THEN 'UNCERTAIN' WHEN a.truth AND b.truth THEN 'PERSISTED' WHEN a.truth THEN 'RESOLVED' WHEN b.truth THEN 'INTRODUCED' ELSE 'CLEAN' END AS transition
FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target AND a.world = b.world""")
def t_region_delta(spark, d):
    """Per edge and kind, from the orders before 1998 to those after."""
    o = occurrences(spark, d).withColumnRenamed("world", "year").withColumnRenamed("kind", "world")
    a = o.where("before").groupBy(*KEYS, "world").agg((F.max("quantity") >= 48).alias("truth"))
    b = o.where("not before").groupBy(*KEYS, "world").agg(F.when(F.max("quantity") >= 48, True).when(F.max("quantity") < 46, False).alias("truth"))
    return regions.delta(a, b, KEYS)


# -- policy -----------------------------------------------------------------------
POLICY = """schema: policy:v1
rules:
  - id: no-asia-from-europe
    kind: FORBIDDEN
    severity: ERROR
    from.modules: [EUROPE]
    to.modules: [ASIA]
  - id: africa-stays-home
    kind: BOUNDARY
    severity: WARNING
    from.modules: [AFRICA]
    to.modules: [AFRICA]
  - id: acyclic-america
    kind: ACYCLIC
    severity: INFO
    from.modules: [AMERICA]
    to.modules: [AMERICA]
  - id: layered
    kind: LAYERS
    severity: WARNING
    layers.top: [EUROPE, AMERICA]
    layers.middle: [ASIA]
    layers.bottom: [AFRICA]
"""
NAMED = "RECURSIVE " + CLASSIFIED + f""", {PACKAGES}, ne AS (SELECT cl.*, a.name AS source_name, a.module AS source_module, b.name AS target_name, b.module AS target_module FROM cl JOIN pk a ON a.package = cl.source JOIN pk b ON b.package = cl.target),
ly AS (SELECT *, CASE WHEN source_module IN ('EUROPE', 'AMERICA') THEN 0 WHEN source_module = 'ASIA' THEN 1 WHEN source_module = 'AFRICA' THEN 2 END AS la, CASE WHEN target_module IN ('EUROPE', 'AMERICA') THEN 0 WHEN target_module = 'ASIA' THEN 1 WHEN target_module = 'AFRICA' THEN 2 END AS lb FROM ne),
ac AS (SELECT fa.* FROM fa JOIN pk a ON a.package = source JOIN pk b ON b.package = target WHERE a.module = 'AMERICA' AND b.module = 'AMERICA'),
cw AS (SELECT world, true AS sure, source, target FROM ac WHERE truth UNION ALL SELECT world, false, source, target FROM ac),
cr AS (SELECT world, sure, source AS a, target AS b FROM cw UNION SELECT cr.world, cr.sure, cr.a, cw.target FROM cr JOIN cw ON cw.world = cr.world AND cw.sure = cr.sure AND cw.source = cr.b),
co_ AS (SELECT source, target, world, max(sure) AS sure FROM cw WHERE (world, sure, target, source) IN (SELECT (world, sure, a, b) FROM cr) GROUP BY ALL),
cq AS (SELECT source, target, CASE WHEN count(*) FILTER (NOT sure) > 0 THEN 'UNKNOWN' WHEN count(*) = 7 THEN 'MUST' ELSE 'MAY' END AS quantifier FROM co_ GROUP BY ALL),
fi AS (SELECT 'no-asia-from-europe' AS rule, 'ERROR' AS severity, * FROM ly WHERE source_module = 'EUROPE' AND target_module = 'ASIA' UNION ALL SELECT 'africa-stays-home', 'WARNING', * FROM ly WHERE source_module = 'AFRICA' AND target_module <> 'AFRICA'
 UNION ALL SELECT 'acyclic-america', 'INFO', ly.* REPLACE (cq.quantifier AS quantifier) FROM ly JOIN cq ON cq.source = ly.source AND cq.target = ly.target UNION ALL SELECT 'layered', 'WARNING', * FROM ly WHERE la < lb)"""
RULES = "ru(rule, severity) AS (VALUES ('no-asia-from-europe', 'ERROR'), ('africa-stays-home', 'WARNING'), ('acyclic-america', 'INFO'), ('layered', 'WARNING'))"
COUNTS = f"""{NAMED}, {RULES}, co AS (SELECT ru.rule, ru.severity, count(*) FILTER (quantifier = 'NEVER') AS never, count(*) FILTER (quantifier = 'UNKNOWN') AS unknown, count(*) FILTER (quantifier = 'MAY') AS may, count(*) FILTER (quantifier = 'MUST') AS must FROM ru LEFT JOIN fi USING (rule) GROUP BY ALL)"""


def _rules():
    return policy.compile_policy(POLICY)


def _findings(spark, d):
    f = checkpointed(facts(spark, d))
    return policy.evaluate(policy.bind(named_edges(regions.classify(regions.measure(f, KEYS, len(WORLDS))), spark, d), _rules(), f, len(WORLDS)))


@query(f"WITH {NAMED} SELECT rule, severity, source, target, quantifier FROM fi")
def p_findings(spark, d):
    return _findings(spark, d).select("rule", "severity", "source", "target", "quantifier")


@query(f"WITH {COUNTS} SELECT * FROM co")
def p_counts(spark, d):
    return policy.counts(_findings(spark, d), _rules())


@query(f"WITH {COUNTS} SELECT rule, CASE WHEN must > 0 THEN 'VIOLATED' WHEN may > 0 THEN 'POSSIBLY_VIOLATED' WHEN unknown > 0 THEN 'UNKNOWN' ELSE 'SATISFIED' END AS verdict FROM co")
def p_verdicts(spark, d):
    return policy.verdicts(policy.counts(_findings(spark, d), _rules())).select("rule", "verdict")


@query(f"WITH {COUNTS} SELECT rule, round_even((must + may) / 625, 12) AS density, round_even((must + may + never) / nullif(must + may + never + unknown, 0), 12) AS coverage FROM co")
def p_shares(spark, d):
    return policy.shares(policy.counts(_findings(spark, d), _rules()), 625)


@query("SELECT doc_id, CASE WHEN lang IS NULL THEN NULL ELSE lang = 'java' END AS is_java, CASE WHEN lang = 'java' AND source = 'meridian-core' THEN true WHEN source <> 'meridian-core' OR lang <> 'java' THEN false END AS selected, lang IS NULL OR lang <> 'de' AS kept FROM documents")
def p_selector(spark, d):
    """Kleene selection over partly missing metadata; known exclusion keeps what is missing."""
    s = policy.Selector(names=("java",), modules=("meridian-core",))
    return table(spark, d, "documents").select(
        "doc_id", policy.Selector(names=("java",)).matches(F.col("lang"), F.col("source")).alias("is_java"), s.matches(F.col("lang"), F.col("source")).alias("selected"),
        (~F.coalesce(F.col("lang") == "de", F.lit(False))).alias("kept"))


@query(f"""WITH {NAMED}, v AS (SELECT DISTINCT rule, severity, source, target, unnest([source, target]) AS node FROM fi WHERE quantifier IN ('MUST', 'MAY'))
SELECT node, count(*) AS n_violations, max(CASE severity WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END) AS worst FROM (SELECT DISTINCT rule, source, target, node, severity FROM v) GROUP BY node""")
def p_nodes(spark, d):
    return policy.node_findings(_findings(spark, d))


@query(f"""WITH {NAMED}, ch AS (SELECT package AS node FROM pk WHERE package < 5), re AS (SELECT source AS node FROM cl WHERE quantifier = 'MUST' AND target IN (SELECT node FROM ch) UNION SELECT cl.source FROM re JOIN cl ON cl.target = re.node WHERE quantifier = 'MUST'),
hi AS (SELECT node, max(how) AS how FROM (SELECT node, 2 AS how FROM ch UNION ALL SELECT node, 1 FROM re) GROUP BY node),
pe AS (SELECT rule, source, target, max(how) AS how, max(CASE severity WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END) AS s, max(CASE quantifier WHEN 'MUST' THEN 3 WHEN 'MAY' THEN 2 ELSE 1 END) AS q
 FROM fi JOIN hi ON hi.node IN (fi.source, fi.target) WHERE quantifier <> 'NEVER' GROUP BY ALL)
SELECT rule, count(*) FILTER (how = 2) AS n_direct, count(*) FILTER (how = 1) AS n_transitive, max(s) AS worst_severity, max(q) AS highest_quantifier FROM pe GROUP BY rule""")
def p_impact(spark, d):
    """Findings of each rule that a change of some packages touches."""
    changed = packages(spark, d).where("package < 5").select(F.col("package").alias("node"))
    must = regions.project(_classified(spark, d), "MUST").select(F.lit("").alias("context"), "source", "target")
    reached = traversal.reachability(traversal.flip(must), changed.select(F.lit("").alias("context"), F.col("node").alias("start"))).select(F.col("end").alias("node")).distinct()
    return policy.impact(_findings(spark, d), changed, reached)


@query(f"""WITH {NAMED}, x AS (SELECT *, row_number() OVER (ORDER BY rule, source, target) AS place FROM fi) SELECT rule, source, target FROM x WHERE place <= 20""")
def p_budget(spark, d):
    """The global finding budget (a report limit)."""
    return policy.budgeted(_findings(spark, d), 20).select("rule", "source", "target")


DOCUMENT = """
schema: architecture-policy:v1
id: regions.boundaries
version: "1"
rules:
  - {id: forbidden, version: "1", kind: FORBIDDEN_DEPENDENCY, severity: ERROR, scope: PACKAGE, relationships: [graph.depends-on], from: {modules: [EUROPE]}, to: {modules: [ASIA], names: ["*"]}}
  - id: boundary
    version: "1"
    kind: BOUNDARY
    severity: WARNING
    scope: PACKAGE
    relationships: [graph.depends-on]
    from: {modules: [AFRICA]}
    allowed:
      modules: [AFRICA, ASIA]
  - id: circles   # within one module
    version: "1"
    kind: ACYCLIC
    severity: INFO
    scope: PACKAGE
    relationships:
    - graph.depends-on
    within: {modules: [AMERICA]}
  - id: layers
    version: "1"
    kind: LAYER_BOUNDARY
    severity: WARNING
    scope: PACKAGE
    relationships: [graph.depends-on]
    layers:
      - {name: top, select: {modules: [EUROPE, AMERICA]}}
      - name: middle
        select: {modules: [ASIA]}
      - {name: bottom, select: {modules: [AFRICA]}}
    allowed:
      - {from: top, to: [middle]}
      - {from: middle, to: [bottom]}
      - {from: bottom, to: []}
"""
LAYER = "CASE WHEN {m} IN ('EUROPE', 'AMERICA') THEN 'top' WHEN {m} = 'ASIA' THEN 'middle' WHEN {m} = 'AFRICA' THEN 'bottom' END"


@query(f"""WITH {NAMED}, dl AS (SELECT *, {LAYER.format(m="source_module")} AS sl, {LAYER.format(m="target_module")} AS tl FROM ne),
df AS (SELECT 'forbidden' AS rule, 'ERROR' AS severity, source, target, quantifier FROM dl WHERE source_module = 'EUROPE' AND target_module = 'ASIA' AND target_name IS NOT NULL
 UNION ALL SELECT 'boundary', 'WARNING', source, target, quantifier FROM dl WHERE source_module = 'AFRICA' AND target_module NOT IN ('AFRICA', 'ASIA')
 UNION ALL SELECT 'circles', 'INFO', source, target, quantifier FROM cq
 UNION ALL SELECT 'layers', 'WARNING', source, target, quantifier FROM dl WHERE sl <> tl AND (sl, tl) NOT IN (('top', 'middle'), ('middle', 'bottom')))
SELECT rule, severity, source, target, quantifier FROM df""")
def p_document(spark, d):
    """Findings of a policy document in the declared format."""
    f = checkpointed(facts(spark, d))
    edges = named_edges(regions.classify(regions.measure(f, KEYS, len(WORLDS))), spark, d)
    return policy.evaluate(policy.bind(edges, policy.compile_document(DOCUMENT).rules, f, len(WORLDS))).select("rule", "severity", "source", "target", "quantifier")


DIM = """CASE rule WHEN 'no-asia-from-europe' THEN 'boundaries' WHEN 'africa-stays-home' THEN 'boundaries' WHEN 'acyclic-america' THEN 'cyclicity' ELSE 'policy' END"""
ROOTS = f"""{NAMED}, ro AS (SELECT {DIM} AS dimension, source, target, max(CASE severity WHEN 'ERROR' THEN 25 WHEN 'WARNING' THEN 10 ELSE 2 END) AS penalty FROM fi WHERE quantifier IN ('MUST', 'MAY') GROUP BY ALL)"""


def _dimensions(spark, d):
    dim = F.expr(DIM)
    f = _findings(spark, d).withColumn("dimension", dim)
    return policy.score(f, cap=100)


@query(f"WITH {ROOTS} SELECT dimension, (100 - least(sum(penalty), 100))::bigint AS score FROM ro GROUP BY dimension")
def a_dimension(spark, d):
    return _dimensions(spark, d)


@query(f"""WITH {ROOTS}, sc AS (SELECT dimension, 100 - least(sum(penalty), 100) AS score FROM ro GROUP BY dimension), w(dimension, weight) AS (VALUES ('boundaries', 25), ('cyclicity', 20), ('policy', 25))
SELECT round_even(sum(weight * score) / sum(weight), 12) AS score, 'PARTIAL' AS status FROM sc JOIN w USING (dimension)""")
def a_score(spark, d):
    return policy.total_score(_dimensions(spark, d))


@query(f"""WITH {OCC}, {PACKAGES}, e AS (SELECT DISTINCT source, target FROM occ WHERE source <> target), g AS (SELECT package, (SELECT count(*) FROM e WHERE e.target = package) AS fan_in, (SELECT count(*) FROM e WHERE e.source = package) AS fan_out FROM pk),
t AS (SELECT s_nationkey AS package, count(*) AS n_types, count(*) FILTER (s_acctbal > 5000) AS n_abstract FROM supplier GROUP BY 1)
SELECT 'all' AS context, t.package AS owner, round_even(abs(n_abstract * (fan_in + fan_out) + fan_out * n_types - n_types * (fan_in + fan_out)) / nullif(n_types * (fan_in + fan_out), 0), 12) AS distance,
CASE WHEN n_types * (fan_in + fan_out) = 0 THEN 'NOT_APPLICABLE' ELSE 'COMPLETE' END AS status FROM t JOIN g USING (package)""")
def m_distance(spark, d):
    """Distance from the main sequence of the packages, rolled up from types."""
    e = occurrences(spark, d).select(F.lit("all").alias("context"), "source", "target")
    types = table(spark, d, "supplier").select(F.lit("all").alias("context"), F.col("s_nationkey").alias("owner"), (F.col("s_acctbal") > 5000).alias("abstract"))
    return distance(abstractness(types), degrees(e))


@query("SELECT 'all' AS context, s_nationkey AS owner, count(*) AS n_types, count(*) FILTER (s_acctbal > 5000) AS n_abstract, round_even(count(*) FILTER (s_acctbal > 5000) / count(*), 12) AS abstractness, 'COMPLETE' AS status FROM supplier GROUP BY 2")
def m_abstractness(spark, d):
    return abstractness(table(spark, d, "supplier").select(F.lit("all").alias("context"), F.col("s_nationkey").alias("owner"), (F.col("s_acctbal") > 5000).alias("abstract")))


@query(f"WITH {OCC}, {PACKAGES} SELECT a.module AS source, b.module AS target, count(*) AS n_occurrences, count(DISTINCT world) AS n_worlds FROM occ JOIN pk a ON a.package = source JOIN pk b ON b.package = target WHERE a.module <> b.module GROUP BY ALL")
def m_rollup(spark, d):
    """Type edges rolled up to modules; edges inside a module are dropped."""
    return named_edges(occurrences(spark, d), spark, d).where("source_module <> target_module").groupBy(F.col("source_module").alias("source"), F.col("target_module").alias("target")).agg(
        F.count("*").alias("n_occurrences"), F.count_distinct("world").alias("n_worlds"))


@query(f"""WITH RECURSIVE {FACTS}, w AS (SELECT source, target, list_sort(list(world)) AS ws FROM fa WHERE truth AND source <> target GROUP BY ALL),
r AS (SELECT source AS start, target AS "end", [source, target] AS path, ws FROM w UNION ALL SELECT r.start, w.target, list_append(r.path, w.target), list_intersect(r.ws, w.ws) FROM r JOIN w ON w.source = r."end"
 WHERE len(r.path) < 3 AND NOT list_contains(r.path, w.target) AND len(list_intersect(r.ws, w.ws)) > 0)
SELECT start, "end", count(*) AS n_paths, max(len(ws))::int AS most_worlds FROM r GROUP BY ALL""")
def g_joint_paths(spark, d):
    """Paths that exist in one and the same world on all their edges; a prefix
    whose worlds do not meet is cut off."""
    e = facts(spark, d).where("truth and source <> target").groupBy(*KEYS).agg(F.collect_set("world").alias("ws"))
    hop = e.select(F.col("source").alias("tip"), F.col("target").alias("to"), F.col("ws").alias("more"))
    one = e.select(F.col("source").alias("start"), F.col("target").alias("end"), F.array("source", "target").alias("path"), "ws")
    two = one.join(hop, one.end == hop.tip).where(~F.array_contains("path", F.col("to"))).select(
        "start", F.col("to").alias("end"), F.array_append("path", F.col("to")).alias("path"), F.array_intersect("ws", "more").alias("ws")).where(F.size("ws") > 0)
    return one.unionByName(two).groupBy("start", "end").agg(F.count("*").alias("n_paths"), F.max(F.size("ws")).alias("most_worlds"))


@query(f"""WITH RECURSIVE {FACTS}, w AS (SELECT world, source, target FROM fa WHERE truth AND source <> target),
r AS (SELECT world, source AS start, target AS "end" FROM w UNION SELECT r.world, r.start, w.target FROM r JOIN w ON w.world = r.world AND w.source = r."end")
SELECT start, "end", count(*) AS n_worlds, CASE count(*) WHEN 7 THEN 'MUST' ELSE 'MAY' END AS quantifier FROM r WHERE start <> "end" GROUP BY ALL""")
def g_conditional_reach(spark, d):
    """In how many worlds, and whether in all, a package is reached over edges
    that are there together: a way of any length counts in the worlds that all
    its edges share, so each world is followed by itself."""
    e = facts(spark, d).where("truth").select(F.col("world").alias("context"), "source", "target")
    r = traversal.reachability(e, e.select("context", F.col("source").alias("start")).distinct())
    n = F.count("*")
    return r.groupBy("start", "end").agg(n.alias("n_worlds"), F.when(n == len(WORLDS), "MUST").otherwise("MAY").alias("quantifier"))


@query(f"""WITH RECURSIVE {CLASSIFIED}, {PACKAGES}, e AS (SELECT source, target FROM cl WHERE quantifier <> 'NEVER'),
r AS (SELECT source AS head, target AS node FROM e WHERE target >= source UNION SELECT r.head, e.target FROM r JOIN e ON e.source = r.node WHERE r.node <> r.head AND e.target >= r.head)
SELECT DISTINCT p.name FROM r JOIN pk p ON p.package = r.head WHERE r.node = r.head""")
def p_acyclic(spark, d):
    """Packages that head a circle of any length among edges not excluded."""
    e = regions.project(_classified(spark, d), "BOUNDED_UNION").select(F.lit("").alias("context"), "source", "target")
    return traversal.heads(e).join(packages(spark, d), F.col("node") == F.col("package")).select("name").distinct()


# -- finite configuration domains ----------------------------------------------------
_DOMAIN = {"profile_cloud": [True, False], "profile_test": [True, False], "property_cache": ["true", "false", "?", None], "web_mode": ["SERVLET", "REACTIVE", "NONE"]}
_CONDITIONS = {
    "cached": ("PROPERTY", "cache", "", True), "web": ("NOT", ("WEB_MODE", "NONE")), "both": ("ALL", ("PROFILE", "cloud"), ("PROPERTY", "cache", "true", False)),
    "either": regions.profile_expression("cloud | !test"), "opaque": ("ANY", ("OPAQUE",), ("PROFILE", "test"))}


@query("""WITH w AS (SELECT i AS world, CASE i % 2 WHEN 0 THEN true ELSE false END AS c, CASE i // 2 % 2 WHEN 0 THEN true ELSE false END AS t, [ 'true', 'false', '?', NULL ][i // 4 % 4 + 1] AS p, ['SERVLET', 'REACTIVE', 'NONE'][i // 16 + 1] AS m FROM range(48) r(i)),
e AS (SELECT world, unnest(['cached', 'web', 'both', 'either', 'opaque']) AS condition, unnest([CASE WHEN p IS NULL THEN true WHEN p = '?' THEN NULL ELSE p <> 'false' END, m <> 'NONE', c AND (CASE WHEN p IS NULL THEN false WHEN p = '?' THEN NULL ELSE p = 'true' END), c OR NOT t, NULL OR t]) AS truth FROM w)
SELECT condition, count(*) FILTER (truth) AS n_true, count(*) FILTER (NOT truth) AS n_false, count(*) FILTER (truth IS NULL) AS n_unknown FROM e GROUP BY condition""")
def t_conditions(spark, d):
    """Conditions judged in every world of a finite configuration domain."""
    w, _ = regions.worlds(spark, _DOMAIN)
    rows = w.select(F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), regions.evaluate(c).alias("truth")) for n, c in _CONDITIONS.items()])).alias("x")).select("x.*")
    return rows.groupBy("condition").agg(F.count_if("truth").alias("n_true"), F.count_if(~F.col("truth")).alias("n_false"), F.count_if(F.col("truth").isNull()).alias("n_unknown"))
