"""Declarative architecture rules: compile, bind, evaluate, count, assess."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import QUANTIFIER, SEVERITY, matches_pattern, rank
from ..session import checkpointed
from ..sources import strict_yaml
from ..sources.graph import CONTAINMENT
from . import regions, traversal
from .metrics import ratio

DIMENSIONS = ("names", "modules", "packages", "origins", "sourceSets", "identities")
KINDS = ("FORBIDDEN", "BOUNDARY", "ACYCLIC", "LAYERS")
#: Penalties of the score model.
PENALTY = {"INFO": 2, "WARNING": 10, "ERROR": 25}
#: Weights of the dimensions of the score model.
WEIGHTS = {"boundaries": 25, "cyclicity": 20, "coupling": 20, "policy": 25, "hotspots": 10}


@dataclass(frozen=True)
class Selector:
    """OR inside a dimension, AND across dimensions; missing metadata is unknown."""

    names: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    packages: tuple[str, ...] = ()
    origins: tuple[str, ...] = ()
    sourceSets: tuple[str, ...] = ()
    identities: tuple[str, ...] = ()

    def matches(self, name: Column, module: Column, **more: Column) -> Column:
        """``more`` gives the other dimensions; one that is asked for and not
        given is unknown."""
        parts = []
        for dimension in DIMENSIONS:
            patterns = getattr(self, dimension)
            value = {"names": name, "modules": module, **more}.get(dimension, F.lit(None).cast("string"))
            if patterns:
                parts.append(reduce(lambda a, b: a | b, [matches_pattern(value, p) for p in patterns]))
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    severity: str
    source: Selector = field(default_factory=Selector)
    target: Selector = field(default_factory=Selector)
    layers: tuple[tuple[str, Selector], ...] = ()
    #: (layer, layers it may use); without it a layer may use those behind it
    allowed: tuple[tuple[str, tuple[str, ...]], ...] | None = None
    version: str = ""
    scope: str = ""
    relationships: tuple[str, ...] = ()


class PolicyError(ValueError):
    def __init__(self, code: str, line: int):
        super().__init__(f"{code} (line {line})")
        self.code, self.line = code, line


def compile_policy(text: str) -> list[Rule]:
    """Strict reader of the policy document: a ``rules`` list of flat records;
    no anchors, aliases, tags or unknown fields; every problem has its line."""
    rules: list[dict] = []
    seen = False
    for no, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if re.search(r"(^|\s)[&*!][A-Za-z]", line):
            raise PolicyError("ANCHORS_NOT_ALLOWED", no)
        if line.startswith("schema:"):
            if line.split(":", 1)[1].strip() != "policy:v1":
                raise PolicyError("UNKNOWN_SCHEMA", no)
            continue
        if line == "rules:":
            if seen:
                raise PolicyError("DUPLICATE_FIELD", no)
            seen = True
            continue
        m = re.fullmatch(r"  (- |  )([a-z_.]+):\s*(.+)", line)
        if not m or not seen:
            raise PolicyError("MALFORMED_LINE", no)
        first, key, value = m.groups()
        if first == "- ":
            rules.append({"line": no})
        if not rules:
            raise PolicyError("MALFORMED_LINE", no)
        if key in rules[-1]:
            raise PolicyError("DUPLICATE_FIELD", no)
        rules[-1][key] = (value, no)
    out: list[Rule] = []
    for r in rules:
        line = r.pop("line")
        extra = set(r) - {"id", "kind", "severity", "from.names", "from.modules", "to.names", "to.modules"} - {k for k in r if k.startswith("layers.")}
        if extra:
            raise PolicyError("UNKNOWN_FIELD", r[min(extra)][1])
        for k in ("id", "kind", "severity"):
            if k not in r:
                raise PolicyError("MISSING_FIELD", line)
        if r["kind"][0] not in KINDS:
            raise PolicyError("UNKNOWN_KIND", r["kind"][1])
        if r["severity"][0] not in SEVERITY:
            raise PolicyError("UNKNOWN_SEVERITY", r["severity"][1])
        if any(o.id == r["id"][0] for o in out):
            raise PolicyError("DUPLICATE_RULE", r["id"][1])

        def values(k: str, r: dict = r) -> tuple[str, ...]:
            return tuple(x.strip() for x in r[k][0].strip("[]").split(",")) if k in r else ()

        layers = tuple((k.split(".", 1)[1], Selector(modules=values(k))) for k in r if k.startswith("layers."))
        out.append(Rule(r["id"][0], r["kind"][0], r["severity"][0], Selector(values("from.names"), values("from.modules")), Selector(values("to.names"), values("to.modules")), layers))
    return out


#: Rule kinds of the policy document with their own fields, the
#: scopes, and the fields of every rule.
FIELDS = {"FORBIDDEN_DEPENDENCY": ("from", "to"), "BOUNDARY": ("from", "allowed"), "LAYER_BOUNDARY": ("layers", "allowed"), "ACYCLIC": ("within",)}
SCOPES = ("TYPE", "PACKAGE", "MODULE")
HEADER = ("id", "version", "kind", "severity", "scope", "relationships")
SCHEMA = "architecture-policy:v1"
MAX_STRINGS, MAX_RULES, MAX_SCALAR = 128, 256, 512


@dataclass(frozen=True)
class Policy:
    id: str
    version: str
    rules: list[Rule]


def compile_document(text: str) -> Policy:
    """The policy document ``architecture-policy:v1`` in strict YAML.

    Every rule has exactly its kind's fields; strings, lists and selectors are
    checked, and the first problem is raised with its code and line."""
    try:
        return _policy(strict_yaml.read(text))
    except strict_yaml.YamlError as e:
        raise PolicyError(e.code, e.line) from e


def _policy(root: strict_yaml.Node) -> Policy:
    top = _fields(root, ("schema", "id", "version", "rules"))
    if _string(top["schema"]) != SCHEMA:
        raise PolicyError("UNSUPPORTED_SCHEMA", top["schema"].line)
    nodes = _items(top["rules"])
    if not 1 <= len(nodes) <= MAX_RULES:
        raise PolicyError("RULE_COUNT_LIMIT", top["rules"].line)
    rules: list[Rule] = []
    for n in nodes:
        r = _rule(n)
        if any(r.id == other.id for other in rules):
            raise PolicyError("DUPLICATE_RULE_ID", n.line)
        rules.append(r)
    return Policy(_string(top["id"]), _string(top["version"]), rules)


def _rule(node: strict_yaml.Node) -> Rule:
    if not isinstance(node.value, dict):
        raise PolicyError("EXPECTED_MAPPING", node.line)
    if "kind" not in node.value:
        raise PolicyError("MISSING_FIELD", node.line)
    kind = _one_of(node.value["kind"], FIELDS)
    f = _fields(node, (*HEADER, *FIELDS[kind]))
    relationships = _strings(f["relationships"])
    if any(x in CONTAINMENT for x in relationships):
        raise PolicyError("INVALID_RULE", f["relationships"].line)
    head = {"id": _string(f["id"]), "version": _string(f["version"]), "severity": _one_of(f["severity"], SEVERITY), "scope": _one_of(f["scope"], SCOPES), "relationships": relationships}
    if kind == "FORBIDDEN_DEPENDENCY":
        return Rule(kind="FORBIDDEN", source=_selector(f["from"]), target=_selector(f["to"]), **head)
    if kind == "BOUNDARY":
        return Rule(kind="BOUNDARY", source=_selector(f["from"]), target=_selector(f["allowed"]), **head)
    if kind == "ACYCLIC":
        return Rule(kind="ACYCLIC", source=_selector(f["within"]), target=_selector(f["within"]), **head)
    layers = [(_string(x["name"]), _selector(x["select"])) for x in (_fields(n, ("name", "select")) for n in _items(f["layers"]))]
    rows = [(_string(x["from"]), _strings(x["to"], empty=True)) for x in (_fields(n, ("from", "to")) for n in _items(f["allowed"]))]
    names = [n for n, _ in layers]
    if len(set(names)) < len(names) or any(a not in names or not set(b) <= set(names) for a, b in rows):
        raise PolicyError("INVALID_RULE", node.line)
    if len({a for a, _ in rows}) < len(rows):
        raise PolicyError("DUPLICATE_LAYER_SOURCE", f["allowed"].line)
    return Rule(kind="LAYERS", layers=tuple(layers), allowed=tuple(rows), **head)


def _fields(node: strict_yaml.Node, names: tuple[str, ...]) -> dict[str, strict_yaml.Node]:
    if not isinstance(node.value, dict):
        raise PolicyError("EXPECTED_MAPPING", node.line)
    for k, n in node.value.items():
        if k not in names:
            raise PolicyError("UNKNOWN_FIELD", n.line)
    if len(node.value) < len(names):
        raise PolicyError("MISSING_FIELD", node.line)
    return node.value


def _items(node: strict_yaml.Node) -> list[strict_yaml.Node]:
    if not isinstance(node.value, list):
        raise PolicyError("EXPECTED_SEQUENCE", node.line)
    return node.value


def _string(node: strict_yaml.Node) -> str:
    if not isinstance(node.value, str):
        raise PolicyError("EXPECTED_STRING", node.line)
    if len(node.value) > MAX_SCALAR or "\0" in node.value or not node.value.strip():
        raise PolicyError("SCALAR_LIMIT", node.line)
    return node.value


def _strings(node: strict_yaml.Node, empty: bool = False) -> tuple[str, ...]:
    values = [_string(n) for n in _items(node)]
    if not empty and not values or len(values) > MAX_STRINGS:
        raise PolicyError("INVALID_STRING_LIST", node.line)
    if len(set(values)) < len(values):
        raise PolicyError("DUPLICATE_VALUE", node.line)
    return tuple(sorted(values))


def _one_of(node: strict_yaml.Node, names) -> str:
    if _string(node) not in names:
        raise PolicyError("UNKNOWN_ENUM", node.line)
    return node.value


def _selector(node: strict_yaml.Node) -> Selector:
    if not isinstance(node.value, dict):
        raise PolicyError("EXPECTED_MAPPING", node.line)
    for k, n in node.value.items():
        if k not in DIMENSIONS:
            raise PolicyError("UNKNOWN_FIELD", n.line)
        for p in _strings(n):
            if "*" in p and p != "*" and not re.fullmatch(r"[^*]+\.\*\*", p):
                raise PolicyError("INVALID_RULE", n.line)
    if not node.value:
        raise PolicyError("INVALID_RULE", node.line)
    return Selector(**{k: _strings(n) for k, n in node.value.items()})


def layer_of(rule: Rule, name: Column, module: Column) -> Column:
    """Layer of an entity; '?' if several match or a match is unknown."""
    hits = [(n, s.matches(name, module)) for n, s in rule.layers]
    sure = reduce(lambda a, b: a + b, [F.coalesce(m.cast("int"), F.lit(0)) for _, m in hits])
    unknown = reduce(lambda a, b: a | b, [m.isNull() for _, m in hits])
    named = F.coalesce(*[F.when(m, F.lit(n)) for n, m in hits])
    return F.when((sure > 1) | unknown, "?").otherwise(named)


def eligible(rule: Rule) -> Column:
    """Three-valued: does an edge (source_name, source_module, target_name,
    target_module) break the rule, if it is there?"""
    s, t = (F.col("source_name"), F.col("source_module")), (F.col("target_name"), F.col("target_module"))
    a, b = rule.source.matches(*s), rule.target.matches(*t)
    if rule.kind == "FORBIDDEN":
        return a & b
    if rule.kind == "BOUNDARY":
        return a & ~b
    if rule.kind == "ACYCLIC":
        return a & rule.target.matches(*t)
    order = {n: k for k, (n, _) in enumerate(rule.layers)}
    la, lb = layer_of(rule, *s), layer_of(rule, *t)
    if rule.allowed is not None:
        pairs = [f"{a}\0{b}" for a, row in rule.allowed for b in row]
        free = (la == lb) | F.concat_ws("\0", la, lb).isin(*pairs) if pairs else la == lb
        return F.when((la == "?") | (lb == "?"), F.lit(None).cast("boolean")).otherwise(F.coalesce(~free, F.lit(False)))
    ra, rb = (F.create_map(*[x for n, k in order.items() for x in (F.lit(n), F.lit(k))])[v] for v in (la, lb))
    return F.when((la == "?") | (lb == "?"), F.lit(None).cast("boolean")).otherwise(F.coalesce(ra < rb, F.lit(False)))


def bind(edges: DataFrame, rules: list[Rule], facts: DataFrame | None = None, n_worlds: int = 1) -> DataFrame:
    """Candidates: edges that a rule covers or may cover; rules are a driver
    list, so all of them are judged in one pass over the edges.  An ACYCLIC
    rule keeps the edges on circles, judged on ``facts`` world by world."""
    verdicts = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), eligible(r).alias("covered")) for r in rules])
    found = edges.withColumn("v", F.explode(verdicts)).select("*", "v.*").drop("v").where("covered is null or covered")
    if all(r.kind != "ACYCLIC" for r in rules):
        return found
    if facts is None:  # one world; what not every world has is open in it
        facts = edges.where("quantifier <> 'NEVER'").select("source", "target", F.lit("").alias("world"), F.when(F.col("quantifier") == "MUST", True).alias("truth"))
    held = found.where("kind = 'ACYCLIC'")
    judged = regions.classify(regions.measure(on_circles(held, facts), ["rule", "source", "target"], n_worlds)).select("rule", "source", "target", "quantifier")
    circles = held.drop("quantifier").join(judged, ["rule", "source", "target"])
    return found.where("kind <> 'ACYCLIC'").unionByName(circles.withColumn("covered", F.lit(True)))


def on_circles(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """(rule, source, target, world, truth): candidates on a circle, loops
    included, of their rule's candidates in a world; unknown if no circle is
    there for sure.

    An edge lies on a circle if one strong component holds both its ends."""
    truth = F.col("truth") & F.col("covered")
    e = candidates.select("rule", "source", "target", "covered").distinct().join(facts, ["source", "target"]).where(F.coalesce(truth, F.lit(True)))
    e = e.withColumn("sure", F.explode(F.when(truth, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    e = checkpointed(e.select("rule", "source", "target", "world", "sure", F.to_json(F.struct("rule", "world", "sure")).alias("context")))
    node = traversal.components(e.select("context", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))).where("cyclic")
    ends = [node.select("context", F.col("node").alias(f"{side}_node"), F.col("component").alias(f"{side}_component")) for side in ("source", "target")]
    on = e.withColumns({f"{side}_node": F.col(side).cast("string") for side in ("source", "target")}).join(ends[0], ["context", "source_node"]).join(ends[1], ["context", "target_node"])
    on = on.where("source_component = target_component").groupBy("rule", "source", "target", "world").agg(F.max("sure").alias("sure"))
    return on.select("rule", "source", "target", "world", F.when(F.col("sure"), True).alias("truth"))


def evaluate(candidates: DataFrame) -> DataFrame:
    """Findings: quantifier of the edge, demoted to UNKNOWN where coverage is."""
    q = F.when(F.col("covered").isNull() & (F.col("quantifier") != "NEVER"), "UNKNOWN").otherwise(F.col("quantifier"))
    return candidates.withColumn("quantifier", q).withColumn("finding_key", F.sha2(F.concat_ws("|", "rule", "source", "target"), 256))


def counts(findings: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings by rule and quantifier, with explicit zeros for every rule."""
    spark = findings.sparkSession
    domain = spark.createDataFrame([(r.id, r.severity) for r in rules], "rule string, severity string")
    names = list(QUANTIFIER)
    p = findings.groupBy("rule").agg(*[F.count_if(F.col("quantifier") == n).alias(n.lower()) for n in names])
    return domain.join(p, "rule", "left").na.fill(0, [n.lower() for n in names])


def verdicts(counted: DataFrame) -> DataFrame:
    """Rule verdicts from their findings."""
    return counted.withColumn("verdict", F.when(F.col("must") > 0, "VIOLATED").when(F.col("may") > 0, "POSSIBLY_VIOLATED").when(F.col("unknown") > 0, "UNKNOWN").otherwise("SATISFIED"))


def shares(counted: DataFrame, n_edges: int) -> DataFrame:
    """Finding density and decided share of each rule, as exact ratios."""
    found = F.col("must") + F.col("may")
    total = found + F.col("never") + F.col("unknown")
    return counted.select("rule", ratio(found, F.lit(n_edges)).alias("density"), ratio(total - F.col("unknown"), total).alias("coverage"))


def node_findings(findings: DataFrame) -> DataFrame:
    """Violations and worst severity of each endpoint."""
    f = findings.where("quantifier in ('MUST', 'MAY')")
    both = f.select(F.explode(F.array("source", "target")).alias("node"), "rule", "severity", "source", "target").distinct()
    return both.groupBy("node").agg(F.count("*").alias("n_violations"), F.max(rank(F.col("severity"), SEVERITY)).alias("worst"))


def impact(findings: DataFrame, changed: DataFrame, reached: DataFrame) -> DataFrame:
    """Per rule: findings that touch a changed node directly or only a reached
    one, the worst severity and the highest quantifier."""
    direct = changed.select("node", F.lit(2).alias("how"))
    near = reached.select("node", F.lit(1).alias("how"))
    hit = direct.unionByName(near).groupBy("node").agg(F.max("how").alias("how"))
    ends = findings.where("quantifier <> 'NEVER'").select("rule", "severity", "quantifier", "finding_key", F.explode(F.array("source", "target")).alias("node"))
    per = ends.join(hit, "node").groupBy("rule", "finding_key").agg(F.max("how").alias("how"), F.max(rank(F.col("severity"), SEVERITY)).alias("s"), F.max(rank(F.col("quantifier"), QUANTIFIER)).alias("q"))
    return per.groupBy("rule").agg(F.count_if(F.col("how") == 2).alias("n_direct"), F.count_if(F.col("how") == 1).alias("n_transitive"), F.max("s").alias("worst_severity"), F.max("q").alias("highest_quantifier"))


def score(findings: DataFrame, cap: int = 100) -> DataFrame:
    """Per root (directed route) the largest penalty, summed, capped, taken off 100."""
    penalty = rank(F.col("severity"), PENALTY)
    roots = findings.where("quantifier in ('MUST', 'MAY')").groupBy("dimension", "source", "target").agg(F.max(penalty).alias("penalty"))
    return roots.groupBy("dimension").agg(F.sum("penalty").alias("sum")).select("dimension", (100 - F.least(F.col("sum"), F.lit(cap))).cast("bigint").alias("score"))


def total_score(dimensions: DataFrame, withheld: Column | None = None) -> DataFrame:
    """Weighted mean over the dimensions; any gap withholds the value."""
    w = rank(F.col("dimension"), WEIGHTS)
    value = ratio(F.sum(w * F.col("score")), F.sum(w))
    gap = F.count_if(F.col("score").isNull()) > 0 if withheld is None else withheld
    return dimensions.agg(F.when(gap, F.lit(None)).otherwise(value).alias("score"), F.when(gap, "WITHHELD").otherwise("PARTIAL").alias("status"))


def budgeted(findings: DataFrame, size: int) -> DataFrame:
    """The first ``size`` findings over all rules (a feature: a report limit).

    Sorted by range partitions, not in one task: limit over a global order."""
    return findings.orderBy("rule", "source", "target").limit(size)


def previous(history: DataFrame, keys: list[str], position: str, present: str) -> DataFrame:
    """State of each key before each position, and the earliest sighting."""
    w = Window.partitionBy(*keys).orderBy(position)
    p = F.col(present)
    before = F.lag(p).over(w)
    ever = F.max(p.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(p & before.isNull(), "FIRST").when(p & before, "PERSISTED").when(p & (F.coalesce(ever, F.lit(0)) == 1), "REINTRODUCED").when(p, "INTRODUCED").when(F.coalesce(before, F.lit(False)), "RESOLVED").otherwise("CLEAN")
    return history.withColumn("transition", state).withColumn("earliest", F.min(F.when(p, F.col(position))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
