"""Graph, regions, policy, traversal, sources and streams on small inputs."""

import datetime as dt
import itertools
import random
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars
from orrery.operators import bridges, evolution, expressions, metrics, policy, regions, traversal
from orrery.sources import documents as docs
from orrery.sources import extract
from orrery.sources.graph import CONTEXT, EDGE, NODE, Graph
from orrery.streaming import events


def edges(spark, pairs, context="c"):
    return spark.createDataFrame([(context, a, b) for a, b in pairs], "context string, source string, target string")


# -- metrics -------------------------------------------------------------------------
def test_martin_metrics(spark):
    e = edges(spark, [("p", "q"), ("r", "p"), ("p", "q"), ("p", "p")])
    d = {r["node"]: r for r in metrics.instability(metrics.degrees(e)).collect()}
    assert (d["p"]["fan_in"], d["p"]["fan_out"], float(d["p"]["instability"])) == (1, 1, 0.5)
    types = spark.createDataFrame([("c", "p", True), ("c", "p", False), ("c", "q", False), ("c", "r", False)], "context string, owner string, abstract boolean")
    a = metrics.abstractness(types)
    dist = {r["owner"]: r for r in metrics.distance(a, metrics.degrees(e)).collect()}
    assert float(dist["p"]["distance"]) == 0.0
    alone = spark.createDataFrame([("c", "z")], "context string, identity string")
    row = metrics.density(e.limit(0), alone).first()
    assert row["status"] == "NOT_APPLICABLE" and row["density"] is None


def test_ratio_is_half_even(spark):
    assert str(spark.range(1).select(metrics.ratio(F.lit(1), F.lit(3)).alias("x")).first()["x"]) == "0.333333333333"


def test_running_total_over_partitions(spark):
    from orrery.operators.prefix import running_total

    rows = [(g, k, (7 * k) % 5) for g, n in (("a", 300), ("b", 3)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v bigint").repartition(3)
    want, total = {}, {}
    for g, k, v in rows:
        total[g] = total.get(g, 0) + v
        want[g, k] = total[g]
    assert {(r["g"], r["k"]): r["t"] for r in running_total(df, "g", "k", "v", "t").collect()} == want


# -- traversal ------------------------------------------------------------------------
def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_both_ways(spark):
    r = random.Random(5)
    pairs = {(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(20)}
    e = edges(spark, pairs)
    want = brute_components(pairs)
    for limit in (traversal.TASK_EDGES, 0):
        got = {x["node"]: x for x in traversal.components(e, limit).collect()}
        assert {n: x["component"] for n, x in got.items()} == want
        for n, x in got.items():
            assert x["size"] == sum(v == want[n] for v in want.values())
            assert x["cyclic"] == (x["size"] > 1 or (n, n) in pairs)


def test_components_and_schedule_follow_all_kinds(spark, tmp_path):
    from orrery.plans.graph_queries import g_schedule, g_scc

    pairs = [("a", "b", "java.calls"), ("b", "a", "graph.contains"), *[(f"n{k:02}", f"n{k + 1:02}", "java.calls") for k in range(12)]]
    spark.createDataFrame([], NODE).write.parquet(str(tmp_path / "kg_nodes.parquet"))
    spark.createDataFrame([(f"e{k}", "c", kind, a, ("RESOLVED", [b], None), [], None) for k, (a, b, kind) in enumerate(pairs)], EDGE).write.parquet(str(tmp_path / "kg_edges.parquet"))
    spark.createDataFrame([], CONTEXT).write.parquet(str(tmp_path / "kg_contexts.parquet"))
    assert {r["node"] for r in g_scc(spark, str(tmp_path)).collect() if r["cyclic"]} == {"a", "b"}
    assert {r["node"]: r["rank"] for r in g_schedule(spark, str(tmp_path)).collect()} == {f"n{k:02}": k for k in range(13)}


def test_schedule_goes_on_until_nothing_is_ready(spark):
    e = edges(spark, [(f"n{k:03}", f"n{k + 1:03}") for k in range(104)])
    assert {r["node"]: r["rank"] for r in traversal.schedule(e).collect()} == {f"n{k:03}": k for k in range(105)}
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("a", "a"), ("g", "c")])
    for limit in (traversal.TASK_EDGES, 0):
        assert {r["node"]: r["rank"] for r in traversal.schedule(e, None, limit).collect()} == {"a": 0, "g": 0, "b": 1, "c": 2}


def test_climb_to_the_owning_type(spark):
    chain = [("c", f"m{k:03}", f"m{k + 1:03}", False) for k in range(80)] + [("c", "m080", "T", True)]
    rest = [("c", "x", "y", False), ("c", "y", "x", False), ("c", "z", "x", False), ("c", "open", "end", False), ("d", "m000", "U", True)]
    parents = spark.createDataFrame(chain + rest, "context string, tip string, up string, found boolean")
    got = {(r["context"], r["tip"]): (r["owner"], r["steps"]) for r in traversal.climb(parents, 64).collect()}
    assert got == {("c", f"m{80 - k:03}"): ("T", k + 1) for k in range(63)} | {("d", "m000"): ("U", 1)}


def test_members_deeper_than_three_levels_have_their_type(spark, tmp_path):
    from orrery.plans.detail_queries import g_climb

    kinds = {"T": "TYPE", **{f"m{k}": "METHOD" for k in range(1, 10)}, "f": "FIELD"}
    up = {"m1": "T", **{f"m{k}": f"m{k - 1}" for k in range(2, 10)}, "f": "m9"}
    spark.createDataFrame([(n, "c", k, []) for n, k in kinds.items()], NODE).write.parquet(str(tmp_path / "kg_nodes.parquet"))
    spark.createDataFrame([(f"e{n}", "c", "graph.contains", u, ("RESOLVED", [n], None), [], None) for n, u in up.items()], EDGE).write.parquet(str(tmp_path / "kg_edges.parquet"))
    spark.createDataFrame([], CONTEXT).write.parquet(str(tmp_path / "kg_contexts.parquet"))
    got = {(r["identity"], r["owner"], r["steps"]) for r in g_climb(spark, str(tmp_path)).collect()}
    assert got == {(f"m{k}", "T", k) for k in range(1, 10)} | {("f", "T", 10)}


def test_paths_cycles_and_schedule(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "a"), ("d", "d"), ("x", "y")]
    e = edges(spark, pairs)
    cycles = {tuple(r["path"]) for r in traversal.cycles(e, 4).collect()}
    assert cycles == {("a", "b", "c"), ("a", "b"), ("d",)}
    starts = edges(spark, [("a", "a")]).select("context", F.col("source").alias("start"))
    paths = traversal.simple_paths(e, starts, 4)
    assert {tuple(r["path"]) for r in paths.collect()} == {("a", "b"), ("a", "b", "c"), ("a", "b", "c", "d")}
    assert {(r["end"], r["distance"]) for r in traversal.reachability(e, starts, 5).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {(r["end"], r["distance"]) for r in traversal.reachability(e, starts, 3).collect()} == {("b", 1), ("c", 2)}
    ranks = {r["node"]: r["rank"] for r in traversal.schedule(e, 10).collect()}
    assert ranks == {"x": 0, "y": 1}
    assert traversal.components(e.limit(0)).count() == 0 and traversal.cycles(e.limit(0), 3).count() == 0


@pytest.mark.parametrize("task_edges", [1_000_000, 0])
def test_reachability_and_shortest_paths_against_breadth_first_search(spark, monkeypatch, task_edges):
    monkeypatch.setattr(traversal, "START_CHUNK", 7)
    r = random.Random(5)
    pairs = {c: {(f"{r.randrange(n):02d}", f"{r.randrange(n):02d}") for _ in range(2 * n)} for c, n in (("p", 40), ("q", 9))}
    pairs["q"] |= {(f"x{k:02d}", f"x{k + 1:02d}") for k in range(11)}
    e = spark.createDataFrame([(c, a, b) for c, ps in pairs.items() for a, b in ps] * 2, "context string, source string, target string")
    starts = spark.createDataFrame([(c, a) for c, ps in pairs.items() for a, _ in ps] + [("p", "nowhere"), ("none", "00")], "context string, start string")
    want = {}
    for c, ps in pairs.items():
        for s in {a for a, _ in ps}:
            level, seen = {s: (s,)}, {s}
            while level:
                new = {}
                for a, b in ps:
                    if a in level and b not in seen:
                        new[b] = min(new.get(b, (*level[a], b)), (*level[a], b))
                seen |= new.keys()
                want |= {(c, s, b): p for b, p in new.items()}
                level = new
    got = [tuple(x) for x in traversal.reachability(e, starts, None, task_edges).collect()]
    assert len(got) == len(want) and {x[:3]: x[3] for x in got} == {k: len(p) - 1 for k, p in want.items()}
    if task_edges:
        got = [tuple(x) for x in traversal.shortest(e, starts).select("context", "start", "end", "path", "n").collect()]
        assert len(got) == len(want) and all(tuple(p) == want[c, s, b] and n == len(p) for c, s, b, p, n in got)
    assert traversal.reachability(e.limit(0), starts).count() == 0 and traversal.reachability(e, starts.limit(0)).count() == 0


def test_reachability_of_one_context_larger_than_a_task_can_hold(spark):
    """1,024 starts lead over a hub to 1,100 ends: 1.1 million rows, whose
    contexts alone are more than 2 GB."""
    context = "c" * 2048
    e = spark.createDataFrame([(context, f"s{k}", "hub") for k in range(1024)] + [(context, "hub", f"e{k}") for k in range(1100)], "context string, source string, target string")
    starts = e.where("target = 'hub'").select("context", F.col("source").alias("start"))
    got = traversal.reachability(e, starts).groupBy("distance").agg(F.count("*"), F.countDistinct("start"), F.countDistinct("end"), F.min(F.length("context"))).collect()
    assert {tuple(x) for x in got} == {(1, 1024, 1024, 1, 2048), (2, 1024 * 1100, 1024, 1100, 2048)}


def test_reachability_hands_on_rows_while_they_are_found(spark):
    """Work is cut into chunks and passes, rows into bounded pieces; nothing is
    lost or repeated at the cuts."""
    r = np.random.default_rng(3)
    n = 700
    a, b = r.integers(0, n, 2400).astype(np.int32), r.integers(0, n, 2400).astype(np.int32)
    a, b = a[a != b], b[a != b]
    batch = pa.RecordBatch.from_pydict({"context": pa.array(["c"] * len(a) + ["c"] * n), "at": pa.array([f"{x:03d}" for x in [*a, *range(n)]]), "to": pa.array([f"{x:03d}" for x in b] + [None] * n)})
    graphs = list(traversal._numbered_graph(300_000)(iter([batch.slice(0, 1000), batch.slice(1000)])))
    assert len(graphs) > 4
    got, largest = [], 0
    for row in traversal._reach(None, 100)(iter(graphs)):
        x = row.to_pylist()[0]
        largest = max(largest, len(x["pairs"]))
        got += [(x["starts"][p & 1023], x["ends"][p >> 10], x["distances"][p >> 10]) for p in x["pairs"]]
    assert largest <= traversal.ROW_PAIRS + 512 * 100
    near = {x: {int(q) for q in b[a == x]} for x in range(n)}
    want = []
    for s in range(n):
        level, seen, d = {s}, {s}, 0
        while level := set().union(*(near[x] for x in level)) - seen:
            d, seen = d + 1, seen | level
            want += [(f"{s:03d}", f"{x:03d}", d) for x in level]
    used = {f"{x:03d}" for x in {*a, *b}}
    assert sorted(got) == sorted(w for w in want if w[0] in used)


def test_conditional_paths_of_all_literal_choices():
    """a -> b -> c -> d: a path is possible where all its conditions meet."""
    literals = [("var", "p"), ("not", ("var", "p")), ("var", "q"), ("not", ("var", "q"))]
    for edges_ in itertools.product(literals, repeat=3):
        possible = any(all(({"p": p, "q": q}[x[1]] if x[0] == "var" else not {"p": p, "q": q}[x[1][1]]) for x in edges_) for p in (True, False) for q in (True, False))
        model = regions.satisfiable(("and", *edges_))
        assert (model is not None) == possible
        prefix = regions.satisfiable(("and", *edges_[:2]))
        assert prefix is not None or model is None  # a prefix that is cut off has no way on


def test_symbolic_delta_of_rows(spark):
    cases = [(1, [["a"]], [["a", "!a"]], "RESOLVED"), (2, [], [["a"]], "INTRODUCED"), (3, [["a", "b"], ["a", "!b"]], [["a"]], "PERSISTED"), (4, [["a"]], [["a", "b"]], "NARROWED"), (5, [["a", "b"]], [["a"]], "WIDENED"),
             (6, [["a"]], [["b"]], "CHANGED"), (7, [], [], "ABSENT"), (8, None, [["a"]], "UNCERTAIN"), (9, [[]], [["a"], ["!a"]], "PERSISTED")]
    df = spark.createDataFrame(cases, "k int, left array<array<string>>, right array<array<string>>, want string")
    got = {r["k"]: r["verdict"] for r in regions.symbolic_delta(df, ["k"]).collect()}
    assert got == {c[0]: c[3] for c in cases} and regions.symbolic_delta(df.limit(0), ["k"]).count() == 0


# -- truth regions -----------------------------------------------------------------------
def test_kleene_fold_and_classification(spark):
    rows = spark.createDataFrame([("e", "w1", True), ("e", "w1", None), ("e", "w2", True), ("f", "w1", False), ("g", "w1", True), ("g", "w2", True)], "k string, world string, truth boolean")
    both = {(r["k"], r["world"]): r["truth"] for r in regions.fold(rows, ["k"], True).collect()}
    assert both["e", "w1"] is None and both["e", "w2"] is True
    m = regions.measure(regions.fold(rows, ["k"], True), ["k"], 2)
    q = {r["k"]: r["quantifier"] for r in regions.classify(m).collect()}
    assert q == {"e": "UNKNOWN", "f": "NEVER", "g": "MUST"}
    neg = {(r["k"], r["world"]): r["truth"] for r in regions.negate(regions.fold(rows, ["k"], True), ["k"], ["w1", "w2"]).collect()}
    assert neg["f", "w2"] is True and neg["g", "w1"] is False and neg["e", "w1"] is None


def evaluate(f, model):
    op = f[0]
    if op == "var":
        return model[f[1]]
    if op == "const":
        return f[1]
    if op == "not":
        return not evaluate(f[1], model)
    return (all if op == "and" else any)(evaluate(x, model) for x in f[1:])


def test_satisfiability_against_truth_table():
    r = random.Random(2142)
    names = "abcd"
    for _ in range(100):
        f = ("and", *[("or", *[("var", v) if r.random() < 0.5 else ("not", ("var", v)) for v in r.choices(names, k=3)]) for _ in range(12)])
        models = [dict(zip(names, bits, strict=True)) for bits in itertools.product((True, False), repeat=4)]
        any_model = any(evaluate(f, m) for m in models)
        got = regions.satisfiable(f)
        assert (got is not None) == any_model
        if got is not None:
            assert evaluate(f, {n: got.get(n, False) for n in names})
    a, b = ("var", "a"), ("var", "b")
    assert regions.implies(("and", a, b), a) and not regions.implies(a, b)
    assert regions.equivalent(("not", ("and", a, b)), ("or", ("not", a), ("not", b)))
    hard = ("and", *[("or", ("var", f"x{k}"), ("var", f"y{k}")) for k in range(20)])
    assert regions.implies(hard, a, max_steps=3) is None and regions.delta_of(hard, a, max_steps=3) == "UNCERTAIN"
    assert regions.satisfiable(("and", a, ("not", a))) is None and regions.satisfiable(("const", True)) == {}
    assert regions.satisfiable(("and", *[("or", ("var", f"x{k}"), ("var", f"y{k}")) for k in range(20)]), max_steps=3) == "UNKNOWN"


def test_worlds_and_profiles(spark):
    w, n = regions.worlds(spark, {"a": [1, 2], "b": ["x", "y", "z"]})
    assert n == 6 and {(r["a"], r["b"]) for r in w.collect()} == set(itertools.product([1, 2], ["x", "y", "z"]))
    assert regions.worlds(spark, {"a": list(range(100)), "b": list(range(100))}) == (None, 4097)
    assert regions.profile_expression("a & !(b | c)") == ("ALL", ("PROFILE", "a"), ("NOT", ("ANY", ("PROFILE", "b"), ("PROFILE", "c"))))
    for bad in ("a & b | c", "a &", "(a", "a b", ""):
        with pytest.raises(ValueError):
            regions.profile_expression(bad)


# -- policy ----------------------------------------------------------------------------------
GOOD = "schema: policy:v1\nrules:\n  - id: r1\n    kind: FORBIDDEN\n    severity: ERROR\n    from.names: [a.**]\n    to.names: [b]\n"


@pytest.mark.parametrize("text,code,line", [
    (GOOD.replace("policy:v1", "policy:v2"), "UNKNOWN_SCHEMA", 1), (GOOD.replace("FORBIDDEN", "NEVER"), "UNKNOWN_KIND", 4), (GOOD.replace("ERROR", "FATAL"), "UNKNOWN_SEVERITY", 5),
    (GOOD + "    color: red\n", "UNKNOWN_FIELD", 8), (GOOD + GOOD[GOOD.index("  - id"):], "DUPLICATE_RULE", 8), (GOOD.replace("[b]", "&x [b]"), "ANCHORS_NOT_ALLOWED", 7), (GOOD.replace("    severity: ERROR\n", ""), "MISSING_FIELD", 3),
    (GOOD + "    kind: FORBIDDEN\n", "DUPLICATE_FIELD", 8), ("rules:\nnonsense\n", "MALFORMED_LINE", 2),
])
def test_policy_problems_have_their_line(text, code, line):
    with pytest.raises(policy.PolicyError) as e:
        policy.compile_policy(text)
    assert (e.value.code, e.value.line) == (code, line)


ACYCLIC = "schema: policy:v1\nrules:\n  - id: r\n    kind: ACYCLIC\n    severity: INFO\n    from.modules: [M]\n    to.modules: [M]\n"
NAMED = "source bigint, target bigint, source_name string, source_module string, target_name string, target_module string, quantifier string"


def test_acyclic_rules_find_circles_only(spark):
    rules = policy.compile_policy(ACYCLIC)

    def found(pairs, quantifiers=None, module=None, facts=None, n_worlds=1):
        module = module or {}
        e = spark.createDataFrame([(a, b, str(a), module.get(a, "M"), str(b), module.get(b, "M"), q) for (a, b), q in zip(pairs, quantifiers or ["MUST"] * len(pairs))], NAMED)
        f = facts and spark.createDataFrame(facts, "source bigint, target bigint, world string, truth boolean")
        return {(r["source"], r["target"]): r["quantifier"] for r in policy.evaluate(policy.bind(e, rules, f, n_worlds)).collect()}

    ring = [(1, 2), (2, 3), (3, 1)]
    assert found([(1, 2), (2, 3), (1, 3)]) == {}
    assert found([*ring, (3, 4)]) == dict.fromkeys(ring, "MUST")
    assert found(ring, ["MUST", "NEVER", "MUST"]) == {} and found([(5, 5)]) == {(5, 5): "MUST"}
    assert found(ring, module={2: "N"}) == {} and found(ring, module={2: None}) == dict.fromkeys(ring, "UNKNOWN")
    module = {1: "M", 2: "M", 3: "M"}
    # a circle must be there in one and the same world
    apart = [(1, 2, "u", True), (2, 1, "v", True)]
    assert found([(1, 2), (2, 1)], ["MAY"] * 2, module, apart, 2) == {}
    assert found([(1, 2), (2, 1)], ["MUST", "MAY"], module, [*apart, (1, 2, "v", True)], 2) == {(1, 2): "MAY", (2, 1): "MAY"}
    assert found([(1, 2), (2, 1)], ["MUST", "UNKNOWN"], module, [(1, 2, "u", True), (2, 1, "u", None)], 1) == {(1, 2): "UNKNOWN", (2, 1): "UNKNOWN"}


def test_heads_of_circles_of_any_length(spark):
    r = random.Random(3)
    for _ in range(3):
        pairs = sorted({(r.randrange(12), r.randrange(12)) for _ in range(16)})
        ring = [(20, 21), (21, 22), (22, 23), (23, 20), (22, 24)]
        got = {x["node"] for x in traversal.heads(spark.createDataFrame([("c", a, b) for a, b in pairs + ring], "context string, source bigint, target bigint")).collect()}
        want = {20}
        for v in range(12):
            seen, front = set(), {v}
            while front:
                front = {b for a, b in pairs if a in front and b >= v} - seen
                seen |= front
            want |= {v} & seen
        assert got == want


def test_missing_metadata_is_unknown(spark):
    rules = policy.compile_policy(GOOD)
    e = spark.createDataFrame([("1", "2", "a.x", None, "b", None, "MUST"), ("1", "3", None, None, "b", None, "MUST"), ("1", "4", "ax", None, "b", None, "MUST")],
                              "source string, target string, source_name string, source_module string, target_name string, target_module string, quantifier string")
    got = {(r["source"], r["target"]): r["quantifier"] for r in policy.evaluate(policy.bind(e, rules)).collect()}
    assert got == {("1", "2"): "MUST", ("1", "3"): "UNKNOWN"}


def test_impact_reaches_over_several_edges(spark, tmp_path):
    from orrery.plans.region_queries import p_impact

    # customer of nation n depends on supplier of nation t in all worlds: 9 -> 8 -> 7 -> 0; packages below 5 are changed
    pairs = [(7, 0), (8, 7), (9, 8)]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("region", [(0, "EUROPE"), (1, "ASIA"), (2, "AMERICA")], "r_regionkey bigint, r_name string")
    put("nation", [(n, f"N{n}", {9: 0, 8: 1}.get(n, 2)) for n in range(10)], "n_nationkey bigint, n_name string, n_regionkey bigint")
    put("customer", [(n, n) for n in range(10)], "c_custkey bigint, c_nationkey bigint")
    put("supplier", [(n, n) for n in range(10)], "s_suppkey bigint, s_nationkey bigint")
    orders = [(k * 10 + y, a, dt.date(1995 + y, 2, 1), "1-URGENT", b) for k, (a, b) in enumerate(pairs) for y in range(7)]
    put("orders", [o[:4] for o in orders], "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_orderpriority string")
    put("lineitem", [(o[0], o[4], 49.0) for o in orders], "l_orderkey bigint, l_suppkey bigint, l_quantity double")
    got = {r["rule"]: (r["n_direct"], r["n_transitive"]) for r in p_impact(spark, str(tmp_path)).collect()}
    assert got["no-asia-from-europe"] == (0, 1)  # 9 -> 8, two and three edges from the change
    e = edges(spark, [(f"n{k}", f"n{k + 1}") for k in range(9)] + [("n9", "n0")])
    assert {r["end"]: r["distance"] for r in traversal.reachability(e, spark.createDataFrame([("c", "n0")], "context string, start string")).collect()} == {f"n{k}": k for k in range(1, 10)}


# -- evolution, bridges -------------------------------------------------------------------------
def test_fraction_delta_is_exact(spark):
    r = evolution.fraction_delta(spark.createDataFrame([(1, 3, 1, 2), (0, 5, 0, 7), (2, 4, 1, 2)], "ln bigint, ld bigint, rn bigint, rd bigint")).select("delta_n", "delta_d").collect()
    assert [tuple(x) for x in r] == [(1, 6), (0, 1), (0, 1)]


def test_absence_on_an_open_side_is_unknown(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "x")], "k int, v string")
    assert {r["delta"] for r in evolution.delta(a, b, ["k"], ["v"], closed=False).collect()} == {"UNKNOWN"}
    assert {r["delta"] for r in evolution.delta(a, b, ["k"], ["v"]).collect()} == {"ADDED", "REMOVED"}


def test_flatten_document(spark):
    text = "# c\nserver:\n  port: 80\n  hosts:\n    - a\n    - b\nname: x # y\n"
    assert evolution.flatten_document(text) == [("server.port", "80"), ("server.hosts.[0]", "a"), ("server.hosts.[1]", "b"), ("name", "x")]
    assert evolution.flatten_document("a.b=1\nc=2: 3\n") == [("a.b", "1"), ("c", "2: 3")]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert evolution.flatten_documents(df, "k", "t").count() == 4


def test_uri_patterns(spark):
    req = spark.createDataFrame([("/a/1/b",), ("/a//b",), ("/x/y",), ("/a/../b",), (None,), ("/z%2fq",)], "request string")
    routes = spark.createDataFrame([("/a/{id}/b",), ("/{k}/y",), ("/a/:id/{z}",), ("/x/y",)], "route string")
    assert {tuple(r) for r in bridges.uri_join(req, routes).collect()} == {("/a/1/b", "/a/{id}/b"), ("/a/1/b", "/a/:id/{z}"), ("/x/y", "/{k}/y"), ("/x/y", "/x/y")}


def test_binding_states(spark):
    rows = [("a", "EXACT", False), ("a", "EXACT", False), ("b", "UNCERTAIN", False), ("c", "EXACT", True), ("d", "EXACT", False), ("e", "OPEN", False), ("f", "EXACT", False), ("f", "OPEN", False), ("g", "REOPENED", None), ("h", "INFEASIBLE", None)]
    got = dict(tuple(r) for r in bridges.states(spark.createDataFrame(rows, "requirement string, fit string, unrouted boolean")).collect())
    assert got == {"a": "AMBIGUOUS", "b": "CANDIDATE", "c": "CONTRACT_ONLY", "d": "BOUND", "e": "UNRESOLVED", "f": "CANDIDATE", "g": "REOPENED", "h": "INFEASIBLE"}


def test_holds_spread_along_the_whole_schedule(spark):
    state = {"a": "OPEN", "x": "SATISFIED", "y": "SATISFIED", "z": "NOT_APPLICABLE"} | {f"m{k}": "SATISFIED" for k in range(12)}
    needs = [("m0", "a"), *[(f"m{k}", f"m{k - 1}") for k in range(1, 12)], ("x", "y"), ("y", "x"), ("y", "z"), ("z", "unknown")]
    got = bridges.prerequisites(spark.createDataFrame(list(state.items()), "id string, state string"), spark.createDataFrame(needs, "id string, needed string")).collect()
    assert {r["id"]: (r["state"], r["blocked"]) for r in got} == {n: ("PENDING", True) if n[0] == "m" else (s, False) for n, s in state.items()}


def test_expressions(spark):
    row = spark.createDataFrame([("8", "true", None, "x y")], "property_a string, property_b string, property_c_d string, property_e string")
    cases = {
        "${a} + 2 == 10": True, "${b} && !(1 > 2)": True, "${c.d}": None, "${c.d:7} * 2 == 14": True, "${c.d:${a}} == '8'": True, "${c.d:x${a}y${c.d:z}} == 'x8yz'": True, "'${c.d:p${c.d}}' == 'p'": None, "'v ${e}' == \"v x y\"": True, "${c.d} == 'q' or true": True, "${c.d} == 'q' and true": None,
        "1 < 2 ? 'a' == 'a' : false": True, "${c.d:} ?: 'z'": "z", "not ${b} or ${a} ge 9": False, "5 % 3 == 2 and -1 lt 0": True, "'it''s' == \"it's\"": True, "1 == 'a'": False, "#{ 10 / 4 == 2.5 }": True, "${a} / 0 > 1": None}
    got = row.select(*[expressions.compile_expression(x).alias(f"x{k}") for k, x in enumerate(cases)]).first()
    assert list(got) == list(cases.values())
    for bad in ("", "1 +", "(1", "T(java.lang.Runtime)", "@bean", "foo", "'a", "${a", "1 2", "'a' * 2", "a.b()", "(" * 80 + "1" + ")" * 80, "x" * 5000):
        with pytest.raises(expressions.ExpressionError):
            expressions.compile_expression(bad)
    assert expressions.property_keys("${a.b:${c}} + ${d-e}") == {"a.b", "c", "d-e"}


def test_admissions(spark):
    e = [("q", 1, "submit", "a", 6, 0), ("q", 2, "submit", "b", 6, 0), ("q", 3, "submit", "c", 2, 0), ("q", 4, "submit", "d", 2, 0), ("q", 5, "submit", "e", 1, 0), ("q", 6, "release", "a", 0, 0), ("q", 7, "submit", "f", 1, 9), ("z", 1, "submit", "x", 10, 0), ("z", 2, "submit", "y", 11, 0)]
    df = spark.createDataFrame(e, "queue string, sequence bigint, kind string, ticket string, size int, priority int")
    got = {r["ticket"]: (r["admitted_at"], r["bypasses"]) for r in bridges.admissions(df, 10, 2).collect()}
    # b does not fit, c and d pass it, then it blocks e until a is released
    assert got == {"a": (1, 0), "c": (3, 0), "d": (4, 0), "b": (6, 2), "x": (1, 0)}


# -- sources ---------------------------------------------------------------------------------------
def graph(spark):
    c = spark.createDataFrame([("c1", "s", None, "e")], CONTEXT)
    n = spark.createDataFrame([("type:a", "c1", "TYPE", ["e1"]), ("type:a", "c1", "TYPE", ["e1"]), ("type:b", "c1", "TYPE", []), ("type:z", "c9", "TYPE", ["e"])], NODE)
    e = spark.createDataFrame([
        ("edge:1", "c1", "java.calls", "type:a", ("RESOLVED", ["type:b"], None), ["e"], None), ("edge:2", "c1", "java.calls", "type:q", ("RESOLVED", ["type:b", "type:a"], None), ["e"], None),
        ("edge:3", "c1", "java.calls", "type:a", ("UNRESOLVED", [], "x"), ["e"], None)], EDGE)
    return Graph(c, n, e)


def test_integrity_rules(spark):
    got = {(r["rule"], r["identity"]) for r in graph(spark).violations().collect()}
    assert got == {("unknown-context", "type:z"), ("dangling-source", "edge:2"), ("target-shape", "edge:2"), ("node-without-evidence", "type:b")}


def test_graph_round_trips(spark, tmp_path):
    g = graph(spark)
    docs.save_graph_json(g, str(tmp_path / "json"))
    back = docs.load_graph_json(spark, str(tmp_path / "json"))
    assert sorted(map(str, back.edges.collect())) == sorted(map(str, g.edges.collect()))
    docs.save_graph(g, str(tmp_path / "pq"))
    again = Graph.load(spark, str(tmp_path / "pq"))
    assert again.nodes.count() == 3 and again.in_context("c1").nodes.count() == 2
    rows = spark.createDataFrame([("K", "b", "s", {"x": "1"}), ("K", "a", "s", {})], "kind string, key string, scope string, fields map<string,string>")
    docs.write_table(rows, str(tmp_path / "t"))
    assert [r["key"] for r in docs.scan_table(spark, str(tmp_path / "t")).collect()] == ["a", "b"]
    assert [r["key"] for r in docs.scan_table(spark, str(tmp_path / "t"), after="a", size=5).collect()] == ["b"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/A.java", "class A {}")
        z.writestr("../evil", "x")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    got = {(r["entry"], r["status"]) for r in docs.read_archives(spark, str(tmp_path)).collect()}
    assert got == {("src/A.java", "READ"), ("../evil", "UNSAFE_NAME"), (None, "BAD_ARCHIVE")}


def test_openapi_and_decoding(spark):
    df = spark.createDataFrame([("k", '{"paths": {"/a": {"get": {"operationId": "x"}, "parameters": {}}, "/b": {"POST": {}}}}'), ("n", None), ("m", "{")], "k string, body string")
    assert {tuple(r)[1:] for r in docs.openapi_operations(df, "k", "body").collect()} == {("/a", "get", "x"), ("/b", "post", None)}
    raw = spark.createDataFrame([(b"\xef\xbb\xbfa\r\nb\n",), ("a\n".encode("utf-16-be"),)], "raw binary")
    c = docs.decode_text(F.col("raw"))
    rows = raw.select(*[v.alias(k) for k, v in c.items()]).collect()
    assert rows[0]["text"] == "a\r\nb\n" and (rows[0]["n_crlf"], rows[0]["n_lf"]) == (1, 1)


def test_build_files(spark):
    pom = "<project><groupId>g</groupId><artifactId>a</artifactId><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId><version>1</version></dependency><dependency><groupId>z</groupId><artifactId>w</artifactId><scope>test</scope></dependency></dependencies></project>"
    toml = '[versions]\nv = "2"\n[libraries]\na = "g:n:1"\nb = { module = "g:m", version.ref = "v" }\nc = { group = "q", name = "r" }\n'
    df = spark.createDataFrame([(1, pom), (2, None), (3, "no xml"), (4, toml)], "k int, t string")
    got = {tuple(r)[1:] for r in extract.maven_dependencies(df, "k", "t").collect()}
    assert got == {("a", "x:y", "1", "compile"), ("a", "z:w", None, "test")}
    assert {tuple(r) for r in extract.version_catalog(df, "k", "t").collect()} == {(4, "a", "g:n", "1"), (4, "b", "g:m", "2"), (4, "c", "q:r", None)}


def test_cursor_is_bound_to_its_query(spark):
    row = spark.range(1).select(scalars.cursor(F.lit("q1"), F.lit("id?7~")).alias("c")).withColumn("own", scalars.cursor_valid(F.col("c"), F.lit("q1"))).withColumn("foreign", scalars.cursor_valid(F.col("c"), F.lit("q2"))).withColumn(
        "garbled", scalars.cursor_valid(F.lit("%%%"), F.lit("q1"))).first()
    assert row["own"] and not row["foreign"] and not row["garbled"]


# -- streams ------------------------------------------------------------------------------------------
def run_to_end(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_fence_stream(spark, tmp_path):
    for k, rows in enumerate([[("a", 1), ("a", 3), ("b", 2)], [("a", 2), ("a", 4), ("b", 2)]]):
        spark.createDataFrame(rows, "id string, revision bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = spark.readStream.schema("id string, revision bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_to_end(events.fenced(s), "fences")
    got = sorted(tuple(r) for r in spark.sql("select * from fences").collect())
    assert got == [("a", 1, "ACCEPTED"), ("a", 2, "REJECTED"), ("a", 3, "ACCEPTED"), ("a", 4, "ACCEPTED"), ("b", 2, "ACCEPTED"), ("b", 2, "REJECTED")]


def test_windowed_stream_and_journal(spark, data, tmp_path):
    import shutil

    (tmp_path / "ev").mkdir()
    shutil.copy(f"{data}/events.parquet", tmp_path / "ev/1.parquet")
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = events.read(spark, str(tmp_path / "ev"), schema)
    run_to_end(events.windowed(stream), "hours", "complete")
    total = spark.read.parquet(f"{data}/events.parquet").count()
    assert spark.sql("select sum(n) from hours").first()[0] == total
    q = events.journal(events.deduplicated(events.read(spark, str(tmp_path / "ev"), schema)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == total


def test_llm_is_optional():
    """Nothing outside the subpackage imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "orrery"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s+\S*llm", p.read_text(), re.M), p


def test_bindings_without_pairs(spark):
    """The folded registry gives what the cascade over all pairs gives."""
    r = random.Random(11)
    maybe = lambda: r.choice([True, True, False, None])
    beans = [(k, r.randrange(4), r.choice(["a", "b", None]), maybe(), maybe(), r.random() < 0.2, r.random() < 0.3, f"n{r.randrange(9)}", r.choice([None, 1, 2, 3])) for k in range(40)]
    sites = [(k, r.randrange(5), r.choice(["a", "b", "c", None]), r.random() < 0.5, f"n{r.randrange(9)}") for k in range(120)]
    b = spark.createDataFrame(beans, 'bean int, type int, qualifier string, autowire boolean, by_default boolean, primary boolean, fallback boolean, bean_name string, priority int')
    s = spark.createDataFrame(sites, "site int, type int, wanted string, optional boolean, site_name string")
    pairs = bridges.candidates(s, b)
    want = {x["site"]: tuple(x) for x in bridges.select_bindings(pairs).collect()}
    got = {x["site"]: tuple(x) for x in bridges.bindings(s, b).collect()}
    assert {k: got[k] for k in want} == want and len(got) == len(sites)
    assert all(x[1] == 0 and x[2] in ("ABSENT_OPTIONAL", "UNSATISFIED") for k, x in got.items() if k not in want)
    n = {x["type"]: tuple(x) for x in bridges.inventory(s, b).collect()}
    count = pairs.groupBy("type").agg(F.count_distinct("site").alias("a"), F.count_distinct(F.when(F.col("eligible"), F.col("bean"))).alias("b"), F.count_if("eligible").alias("c"))
    assert n == {x["type"]: tuple(x) for x in count.collect()}
    assert bridges.bindings(s.limit(0), b).count() == 0 and bridges.bindings(s, b.limit(0)).count() == len(sites)


def test_search_forms(spark):
    from orrery.operators.search import search

    e = spark.createDataFrame([("x1", "Alpha"), ("x2", "alpha"), ("x3", "Alphabet"), ("alpha", "zed"), ("x5", None), ("x6", ""), (None, "alpha"), ("x1", "Alpha")], "identity string, name string")
    t = spark.createDataFrame([("alpha",), ("AL",), ("",), (None,), ("nope",)], "term string")
    got = {(x["term"], x["place"]): (x["identity"], x["form"]) for x in search(e, t, 3).collect()}
    assert got == {("alpha", 1): ("alpha", 1), ("alpha", 2): ("x2", 2), ("alpha", 3): ("x1", 3), ("AL", 1): ("x1", 4), ("AL", 2): ("x2", 4), ("AL", 3): ("x3", 4)}
    assert search(e.limit(0), t, 3).count() == 0


DECLARED = """schema: architecture-policy:v1
id: example.boundaries
version: "1"
rules:
  - id: web.persistence
    version: "1"
    kind: FORBIDDEN_DEPENDENCY
    severity: ERROR
    scope: TYPE
    relationships: [graph.depends-on]
    from: {packages: [com.example.web.**]}
    to: {packages: [com.example.persistence.**]}
"""


def test_policy_document():
    p = policy.compile_document(DECLARED)
    (r,) = p.rules
    assert (p.id, p.version, r.id, r.kind, r.scope, r.relationships) == ("example.boundaries", "1", "web.persistence", "FORBIDDEN", "TYPE", ("graph.depends-on",))
    assert r.source.packages == ("com.example.web.**",) and policy.compile_document("---\n" + DECLARED) == p
    head = DECLARED.split("    from:")[0]
    layered = head.replace("FORBIDDEN_DEPENDENCY", "LAYER_BOUNDARY") + "    layers: [{name: a, select: {modules: [x]}}, {name: b, select: {modules: [y]}}]\n    allowed: [{from: a, to: [b]}, {from: b, to: []}]\n"
    assert policy.compile_document(layered).rules[0].allowed == (("a", ("b",)), ("b", ()))
    assert policy.compile_document(head.replace("FORBIDDEN_DEPENDENCY", "ACYCLIC") + "    within: {names: ['*']}\n").rules[0].target.names == ("*",)


BROKEN = {
    "EMPTY_DOCUMENT": ["", "---\n", "# only\n"], "UNKNOWN_FIELD": [DECLARED + "unknown: secret\n", DECLARED.replace("    to:", "    within:"), DECLARED.replace("to: {packages", "to: {package")],
    "UNSUPPORTED_SCHEMA": [DECLARED.replace("policy:v1", "policy:v2")], "UNSUPPORTED_YAML_TYPE": [DECLARED.replace('version: "1"', "version: 1"), DECLARED.replace("from: {packages: [com.example.web.**]}", "from: !!x {}"), DECLARED.replace("severity: ERROR", "severity:")],
    "UNKNOWN_ENUM": [DECLARED.replace("ERROR", "BANANA"), DECLARED.replace("FORBIDDEN_DEPENDENCY", "EXECUTE"), DECLARED.replace("scope: TYPE", "scope: ENTITY")],
    "INVALID_RULE": [DECLARED.replace("graph.depends-on", "graph.contains"), DECLARED.replace("{packages: [com.example.web.**]}", "{}"), DECLARED.replace("com.example.web.**", "com.*.web")],
    "DUPLICATE_KEY": [DECLARED.replace("id: example.boundaries", "id: a\nid: b"), DECLARED.replace("{packages: [com.example.web.**]}", "{names: [a], names: [b]}")], "SINGLE_DOCUMENT_REQUIRED": [DECLARED + "---\nsecond: document\n"],
    "YAML_ANCHOR_UNSUPPORTED": [DECLARED.replace("from: {", "from: &x {"), DECLARED.replace("to: {packages: [com.example.persistence.**]}", "to: *x")], "MISSING_FIELD": [DECLARED.replace("    severity: ERROR\n", ""), DECLARED.replace("id: example.boundaries\n", "")],
    "INVALID_STRING_LIST": [DECLARED.replace("[graph.depends-on]", "[]")], "DUPLICATE_VALUE": [DECLARED.replace("[graph.depends-on]", "[a, a]")], "EXPECTED_SEQUENCE": [DECLARED.replace("[graph.depends-on]", "graph.depends-on")],
    "DUPLICATE_RULE_ID": [DECLARED + DECLARED.split("rules:\n")[1]], "MALFORMED_YAML": [DECLARED.replace("[graph.depends-on]", "[graph.depends-on"), DECLARED + "  stray\n"],
}


@pytest.mark.parametrize("code,text", [(c, t) for c, ts in BROKEN.items() for t in ts])
def test_policy_document_problems(code, text):
    with pytest.raises(policy.PolicyError) as e:
        policy.compile_document(text)
    assert e.value.code == code and e.value.line >= 1


def test_result_store_goes_on_and_keeps_its_owner(spark, tmp_path):
    from orrery.sources.results import ResultStore

    folder = str(tmp_path / "store")
    store, made = ResultStore(spark, folder, "a"), []
    store.section("one", lambda: made.append(1) or spark.range(3))
    with pytest.raises(RuntimeError):
        store.section("two", lambda: (_ for _ in ()).throw(RuntimeError("lost")))
    again = ResultStore(spark, folder, "a")
    assert again.sections() == ["one"]
    assert again.section("one", lambda: made.append(1) or spark.range(9)).count() == 3 and again.section("two", lambda: made.append(2) or spark.range(2)).count() == 2
    assert made == [1, 2] and again.sections() == ["one", "two"]
    with pytest.raises(ValueError):
        ResultStore(spark, folder, "b")


def test_configuration_order_and_pages(spark):
    from orrery.operators import answers

    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("l", "l"), ("a", "c")])
    n = spark.createDataFrame([("c", k) for k in "abcxyzlq"], "context string, node string")
    got = {r["node"]: (r["rank"], r["status"]) for r in answers.ordered(e, n).collect()}
    assert got == {"a": (0, "ORDERED"), "b": (1, "ORDERED"), "c": (2, "ORDERED"), "q": (0, "ORDERED"), "x": (None, "CYCLE"), "y": (None, "CYCLE"), "l": (None, "CYCLE"), "z": (None, "HELD")}
    rows = spark.createDataFrame([("g", k) for k in range(7)] + [("h", 1)], "g string, k int")
    pages = answers.paged(rows, "g", "k", 3)
    assert {(r["g"], r["page"], r["n"], r["sound"]) for r in answers.page_census(pages, "g", "k", 3).collect()} == {("g", 0, 3, True), ("g", 1, 3, True), ("g", 2, 1, True), ("h", 0, 1, True)}
    assert [r["sound"] for r in answers.page_census(pages.where("k <> 1 and g = 'g' and page = 0"), "g", "k", 3).collect()] == [False]
    assert answers.paged(rows.limit(0), "g", "k", 3).count() == 0


def test_outline_skips_comments_and_literals(spark):
    rows = [(1, 'import a.b;\n// import x.y;\n/* class No { */ class A { String s = "class B {"; @Deprecated void f() { g.h(); } class In { } }', "A.java"), (2, 'import os\n# import no\ndef f():\n    from x.y import z\n    class K: pass\n    """\n    def no(): pass\n    """\n    os.walk(1)\n', "b.PY"),
            (3, "const a = require('./m'); // require('no')\nexports.f = function g() {}\n", "c.cjs"), (4, '#include <a.h>\n#  include "b.h"\n#define X 1\nstruct S { int a; };\n/* #include <no.h> */\n', "d.h"), (5, None, "e.java"), (6, "import no;", "f.txt")]
    got = {(r["doc_id"], r["what"], r["name"]) for r in extract.outline(spark.createDataFrame(rows, "doc_id bigint, text string, path string")).collect()}
    assert got == {(1, "import", "a.b"), (1, "type", "A"), (1, "type", "In"), (1, "annotation", "Deprecated"), (1, "call", "h"), (2, "import", "os"), (2, "import", "x.y"), (2, "function", "f"), (2, "type", "K"), (2, "call", "walk"),
                   (3, "import", "./m"), (3, "function", "g"), (3, "export", "f"), (4, "import", "a.h"), (4, "import", "b.h"), (4, "macro", "X"), (4, "type", "S")}
