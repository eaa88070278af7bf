import random

import pytest

from orrery.operators import hierarchy as H

SCHEMA = "plan string, id string, root string, related_roots array<string>, dependencies array<string>, extra int"


def brute(rows):
    """Parents, circles and depths by walking."""
    ids = {r[1] for r in rows if r[1] is not None}
    parent, deps = {}, {i: set() for i in ids}
    for _, i, root, related, needs, _ in rows:
        if i is None:
            continue
        if root in ids:
            parent[i] = min(parent.get(i, root), root)
        for c in related or []:
            if c in ids:
                parent[c] = min(parent.get(c, i), i)
        deps[i] |= {x for x in needs or [] if x in ids}
    circle, out = set(), {}
    for i in ids:
        x, seen = parent.get(i), []
        while x is not None and x not in seen and x != i:
            seen.append(x)
            x = parent.get(x)
        if x == i:
            circle.add(i)
        out[i] = (seen[-1] if seen else i, len(seen)) if x is None else None
    dependent = set()
    for i in ids:
        front, reached = [i], set()
        while front:
            v = front.pop()
            for w in deps[v]:
                if w not in reached:
                    reached.add(w)
                    front.append(w)
        if i in reached:
            dependent.add(i)
    below = {i: 0 for i in ids}
    for i, t in out.items():
        if t is not None:
            x = parent.get(i)
            while x is not None:
                below[x] += 1
                x = parent.get(x)
    return parent, circle, dependent, out, below


def sample(seed, n=40):
    r = random.Random(seed)
    rows = []
    for p in range(3):
        ids = [f"m{p}-{k}" for k in range(n // 3)]
        for k, i in enumerate(ids):
            style = r.random()
            root = ids[r.randrange(max(1, k))] if k and style < 0.7 else r.choice([None, "nowhere", r.choice(ids) if style > 0.95 else None])
            rows.append((f"plan{p}", i, root, None, [r.choice(ids + ["gone", None]) for _ in range(r.randrange(3))] or r.choice([None, []]), 1))
        rows.append(rows[-1])
    return rows


def check(spark, rows, weight):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in H.hierarchy(df, weight).collect()}
    parent, circle, dependent, out, below = brute(rows)
    assert set(got) == set(out)
    for i, r in got.items():
        assert r["in_circle"] == (i in circle), i
        assert r["in_dependency_circle"] == (i in dependent), i
        if out[i] is None:
            assert r["top"] is None and r["stray"] == (i not in circle)
        else:
            assert (r["top"], r["depth"]) == out[i]
            assert r["n_below"] == below[i] == r["last"] - r["first"]
    placed = [r for r in got.values() if r["first"] is not None]
    assert len({(r["plan"], r["first"]) for r in placed}) == len(placed)
    for r in placed:
        if r["parent"] is not None:
            p = got[r["parent"]]
            assert p["first"] < r["first"] and r["last"] <= p["last"]


@pytest.mark.parametrize("seed", [1, 2])
def test_light(spark, seed):
    check(spark, sample(seed), H.TASK_WEIGHT)


def test_large_route_equals_brute_force(spark):
    check(spark, sample(3, 30), 0)


def test_large_route_finishes_small_rests_in_a_task(spark):
    check(spark, sample(5, 45), 14)


def test_large_route_with_two_circles_and_bridge(spark):
    rows = [("p", "a", None, None, ["b"], 0), ("p", "b", None, None, ["a", "x"], 0), ("p", "x", None, None, ["c"], 0), ("p", "c", None, None, ["d"], 0),
            ("p", "d", "d", None, ["c", "e"], 0), ("p", "e", "d", None, None, 0)]
    check(spark, rows, 0)


def test_edges_of_input(spark):
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("p", "a", "a", None, ["a"], 0), ("p", None, "a", ["a"], None, 0), (None, "b", None, [None, "zz"], [None], 0)]
    got = {(r["link_kind"], r["id"]) for r in H.circles(H.hierarchy(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {("root", "a"), ("dependencies", "a")}


def test_deep_chain_and_paths(spark):
    n = 3000
    rows = [("p", f"{k:05d}", f"{k - 1:05d}" if k else None, None, None, 0) for k in range(n)]
    tree = H.hierarchy(spark.createDataFrame(rows, SCHEMA))
    last = tree.where("id = '02999'").first()
    assert last["depth"] == n - 1 and last["top"] == "00000"
    few = H.hierarchy(spark.createDataFrame(rows[:6], SCHEMA))
    assert {r["path"] for r in H.paths(few).collect()} >= {"00000/00001/00002", "00000"}
    assert H.descendants(few).count() == 15


def test_long_chains_of_dependencies_take_few_rounds(spark, monkeypatch):
    """A chain, a closed chain between two heads and a ring of their own, all
    beyond the weight of a task: nothing is peeled link by link."""
    n = 1000
    edges = [(f"c{k:05d}", f"c{k + 1:05d}") for k in range(n)] + [(f"r{k:05d}", f"r{(k + 1) % n:05d}") for k in range(n)]
    edges += [("h", "a00000"), ("h", "z"), ("z", "h"), ("z", "y")] + [(f"a{k:05d}", f"a{k + 1:05d}") for k in range(n)] + [(f"a{n:05d}", "z")]
    rounds = []
    kept = H.checkpointed
    monkeypatch.setattr(H, "checkpointed", lambda df: rounds.append(1) or kept(df))
    got = {r["id"] for r in H._circles_of_edges(spark.createDataFrame(edges, "id string, to string"), 100).collect()}
    assert got == {f"r{k:05d}" for k in range(n)} | {f"a{k:05d}" for k in range(n + 1)} | {"h", "z"}
    assert len(rounds) < 40
