"""Problem 2: parent-child links to full hierarchies, and circles of links.

Subtree sizes are computed upward, sibling preorder ranges are allocated
downward by prefix sums, and the resulting nested-set ranges answer ancestors
and descendants.  What the upward pass cannot process reveals the circles.

Plans whose links fit the bound are packed into buckets of bounded weight and
each bucket is done by one task on index arrays (``_bucket``).  Larger plans
take the same two passes as joins by pointer doubling, in a number of rounds
logarithmic in the depth (``_large``); no task ever holds such a plan.

Defined results: repeated rows and entries count once; null ids and entries
are ignored; ids without a row lead nowhere, so a module whose parent has none
is a top; a module naming itself is a circle; modules that lead into a circle
of parents have neither top, depth nor range (they are marked ``stray``); a
module with several parents (contradicting links) keeps the least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, discard, small
from .traversal import strong_components

#: Weight (rows and array entries) that one task takes: some 0.3 GB of ids.
TASK_WEIGHT = 2_000_000
#: Positions of one chunk of the nested-set line in range joins.
CHUNK = 256
#: Buckets that the children of one parent are spread over.
SIBLING_BUCKETS = 64

SCHEMA = "plan string, id string, parent string, top string, depth int, first bigint, last bigint, n_below bigint, in_circle boolean, stray boolean, in_dependency_circle boolean"
ROWS = "id string, root string, related_roots array<string>, dependencies array<string>"


# -- one bucket of plans, on index arrays -----------------------------------------
def _entries(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each entry, entries) of a list column."""
    c = column.combine_chunks()
    return pc.list_parent_indices(c).to_numpy(zero_copy_only=False), pc.list_flatten(c)


def _index(values, ids: pa.Array) -> np.ndarray:
    """Positions in ``ids``; -1 for null and unknown."""
    return pc.fill_null(pc.index_in(values, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def peel(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Upward pass: (subtree sizes, processed?, waves from the leaves on)."""
    n = len(parent)
    size = np.ones(n, np.int64)
    linked = parent >= 0
    waiting = np.bincount(parent[linked], minlength=n)
    done = np.zeros(n, bool)
    wave = np.flatnonzero(waiting == 0)
    waves = []
    while len(wave):
        waves.append(wave)
        done[wave] = True
        up = wave[linked[wave]]
        p = parent[up]
        np.add.at(size, p, size[up])
        np.subtract.at(waiting, p, 1)
        p = np.unique(p)
        wave = p[(waiting[p] == 0) & ~done[p]]
    return size, done, waves


def ranges(parent: np.ndarray, size: np.ndarray, done: np.ndarray, waves: list[np.ndarray], group: np.ndarray):
    """Downward pass: (first, last, depth, top); 0 / -1 where there is none.

    ``group`` keeps the tops of one plan side by side."""
    n = len(parent)
    first, depth, top = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    # exclusive prefix sums of sizes among siblings, in order of the index
    key = np.where(parent >= 0, parent, n + group)
    order = np.lexsort((np.arange(n), key))
    usable = done[order]
    s = np.where(usable, size[order], 0)
    total = np.cumsum(s) - s
    k = key[order]
    start = np.concatenate([[True], k[1:] != k[:-1]]) if n else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(start, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    before = np.zeros(n, np.int64)
    before[order] = total - total[base] if n else 0
    for wave in reversed(waves):
        roots = wave[parent[wave] < 0]
        first[roots], depth[roots], top[roots] = before[roots] + 1, 0, roots
        inner = wave[parent[wave] >= 0]
        inner = inner[top[parent[inner]] >= 0]
        p = parent[inner]
        first[inner] = first[p] + 1 + before[inner]
        depth[inner] = depth[p] + 1
        top[inner] = top[p]
    return first, first + size - 1, depth, top


def on_circles(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nodes on a directed circle of the edges a -> b.

    Nodes without a way in or out are peeled off; in what is left, strongly
    connected components are found iteratively."""
    out = np.zeros(n, bool)
    out[a[a == b]] = True
    keep = a != b
    a, b = a[keep], b[keep]
    while len(a):
        into, outof = np.bincount(b, minlength=n) > 0, np.bincount(a, minlength=n) > 0
        live = into & outof
        keep = live[a] & live[b]
        if keep.all():
            break
        a, b = a[keep], b[keep]
    if not len(a):
        return out
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    nodes = np.unique(a)
    at = dict(zip(nodes.tolist(), np.searchsorted(a, nodes, side="left").tolist(), strict=True))
    end = dict(zip(nodes.tolist(), np.searchsorted(a, nodes, side="right").tolist(), strict=True))
    to = b.tolist()
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    inside: set[int] = set()
    for root in nodes.tolist():
        if root in index:
            continue
        work = [root]
        index[root] = low[root] = len(index)
        held.append(root)
        inside.add(root)
        place = {root: at[root]}
        while work:
            v = work[-1]
            k = place[v]
            if k < end[v]:
                place[v] = k + 1
                w = to[k]
                if w not in index:
                    index[w] = low[w] = len(index)
                    held.append(w)
                    inside.add(w)
                    place[w] = at[w]
                    work.append(w)
                elif w in inside:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1]] = min(low[work[-1]], low[v])
            if low[v] == index[v]:
                part = []
                while True:
                    w = held.pop()
                    inside.discard(w)
                    part.append(w)
                    if w == v:
                        break
                if len(part) > 1:
                    out[part] = True
    return out


def _bucket(t: pa.Table) -> pa.Table:
    t = t.filter(pc.is_valid(t.column("id")))
    ids = pc.unique(t.column("id"))
    ids = ids.take(pc.sort_indices(ids))
    n = len(ids)
    row = _index(t.column("id").combine_chunks(), ids)
    plan_names = pc.unique(t.column("plan"))
    plan_of_row = pc.index_in(t.column("plan"), value_set=plan_names, skip_nulls=False).to_numpy().astype(np.int64)
    plan = np.zeros(n, np.int64)
    plan[row] = plan_of_row
    parent = np.full(n, n, np.int64)
    stated = _index(t.column("root").combine_chunks(), ids)
    np.minimum.at(parent, row[stated >= 0], stated[stated >= 0])
    at, entries = _entries(t.column("related_roots"))
    child = _index(entries, ids)
    np.minimum.at(parent, child[child >= 0], row[at[child >= 0]])
    parent[parent == n] = -1
    size, done, waves = peel(parent)
    first, last, depth, top = ranges(parent, size, done, waves, plan)
    at, entries = _entries(t.column("dependencies"))
    to = _index(entries, ids)
    a, b = row[at[to >= 0]], to[to >= 0]
    circles = on_circles(n, a, b)
    none = top < 0
    return pa.table([
        plan_names.take(pa.array(plan)) if n else pa.array([], pa.string()), ids,
        ids.take(pa.array(parent, mask=parent < 0)), ids.take(pa.array(top, mask=none)),
        pa.array(depth.astype(np.int32), mask=none), pa.array(first, mask=none), pa.array(last, mask=none),
        pa.array(size - 1, mask=none), pa.array(~done), pa.array(none & done), pa.array(circles),
    ], names=["plan", "id", "parent", "top", "depth", "first", "last", "n_below", "in_circle", "stray", "in_dependency_circle"])


# -- large plans, as joins ---------------------------------------------------------
def _links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their parent, dependency edges), both distinct."""
    nodes = rows.select("plan", "id").where("id is not null").distinct()
    stated = rows.select("id", F.col("root").alias("parent"))
    inverse = rows.select(F.explode("related_roots").alias("id"), F.col("id").alias("parent"))
    known = nodes.select(F.col("id").alias("parent"))
    parents = stated.unionByName(inverse).where("id is not null and parent is not null").join(known, "parent", "left_semi").groupBy("id").agg(F.min("parent").alias("parent"))
    edges = rows.select("id", F.explode("dependencies").alias("to")).where("id is not null and to is not null").distinct()
    edges = edges.join(nodes.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to")
    return checkpointed(nodes.join(parents, "id", "left")), checkpointed(edges)


def _circle_of_parents(nodes: DataFrame) -> DataFrame:
    """Nodes on circles: the image of ever longer jumps shrinks to them."""
    jump = checkpointed(nodes.where("parent is not null").select("id", F.col("parent").alias("to")))
    image = jump.select(F.col("to").alias("id")).distinct()
    count = image.count()
    while True:
        jump = checkpointed(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"))
        image = checkpointed(jump.select(F.col("to").alias("id")).distinct())
        n = image.count()
        if n == count or n == 0:
            return image
        count = n


def _large(rows: DataFrame, task_weight: int) -> DataFrame:
    nodes, edges = _links(rows)
    circle = _circle_of_parents(nodes)
    # upward and downward passes on the forest without the circles
    open_ = nodes.join(circle, "id", "left_anti")
    state = checkpointed(open_.select("plan", "id", "parent", F.when(F.col("parent").isNotNull(), F.col("parent")).alias("jump"), F.lit(1).cast("bigint").alias("size"),
                                      F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("bigint").alias("depth")))
    stop = circle.select(F.col("id").alias("jump"), F.lit(True).alias("stuck"))
    state = checkpointed(state.join(stop, "jump", "left").withColumn("stuck", F.coalesce("stuck", F.lit(False))))
    while state.where("jump is not null and not stuck").limit(1).count():
        # sizes: what lies below within the reach, then within twice the reach
        gain = state.where("jump is not null and not stuck").groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("gain"))
        far = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"), F.col("stuck").alias("next_stuck"))
        state = checkpointed(
            state.join(gain, "id", "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("gain")
            .join(far, "jump", "left").select(
                "plan", "id", "parent", "size", (F.col("depth") + F.when(~F.col("stuck"), F.coalesce("more", F.lit(0))).otherwise(0)).alias("depth"),
                F.when(F.col("stuck"), F.col("jump")).otherwise(F.col("next")).alias("jump"),
                (F.col("stuck") | F.coalesce("next_stuck", F.lit(False))).alias("stuck")))
    # downward: prefix sums among siblings in two levels, summed along the path
    trees = state.where("not stuck").select("plan", "id", "parent", "size", "depth")
    home = F.coalesce(F.col("parent"), F.concat(F.lit("\0"), F.coalesce("plan", F.lit(""))))
    trees = trees.withColumn("home", home).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS)))
    inner = Window.partitionBy("home", "bucket").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("home").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = trees.groupBy("home", "bucket").agg(F.sum("size").alias("m")).select("home", "bucket", F.coalesce(F.sum("m").over(outer), F.lit(0)).alias("offset"))
    placed = trees.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["home", "bucket"])
    walk = checkpointed(placed.select("plan", "id", "parent", "size", "depth", F.col("parent").alias("jump"), F.col("id").alias("top"), (F.col("before") + F.col("offset") + 1).alias("first")))
    while walk.where("jump is not null").limit(1).count():
        far = walk.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("first").alias("more"), F.col("top").alias("far_top"))
        walk = checkpointed(walk.join(far, "jump", "left").select(
            "plan", "id", "parent", "size", "depth", F.col("next").alias("jump"), F.coalesce("far_top", "top").alias("top"), (F.col("first") + F.coalesce("more", F.lit(0))).alias("first")))
    dependent = _circles_of_edges(edges, task_weight).withColumn("in_dependency_circle", F.lit(True))
    tree = walk.select("id", "top", F.col("depth").cast("int").alias("depth"), "first", (F.col("first") + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("n_below"))
    marked = circle.withColumn("in_circle", F.lit(True))
    return nodes.join(tree, "id", "left").join(marked, "id", "left").join(dependent, "id", "left").select(
        "plan", "id", "parent", "top", "depth", "first", "last", "n_below", F.coalesce("in_circle", F.lit(False)).alias("in_circle"),
        (F.col("top").isNull() & F.col("in_circle").isNull()).alias("stray"), F.coalesce("in_dependency_circle", F.lit(False)).alias("in_dependency_circle"))


def _rest(t: pa.Table) -> pa.Table:
    ids = pc.unique(pa.chunked_array([*t.column("id").chunks, *t.column("to").chunks], pa.string()))
    label = strong_components(len(ids), _index(t.column("id"), ids), _index(t.column("to"), ids))
    size = np.bincount(label, minlength=len(ids))
    hit = np.flatnonzero(size[label] > 1)
    return pa.table([ids.take(pa.array(hit)), ids.take(pa.array(label[hit]))], names=["id", "component"])


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges between the ends of chains, (id, head, tail) of the nodes inside
    chains, ids on rings that nothing leads into).

    A node with one way in and one way out is inside a chain.  Both ways are
    doubled, so rounds are logarithmic in the longest chain; what has no end
    after as many rounds as the nodes inside allow is a ring."""
    ways = edges.groupBy("id").agg(F.count("*").alias("n"), F.min("to").alias("ahead")).where("n = 1").drop("n").join(
        edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("behind")).where("n = 1").drop("n"), "id")
    ways = checkpointed(ways)
    inside = ways.select("id")

    def open_(side: str) -> DataFrame:
        return inside.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_open"))

    way = checkpointed(ways.join(open_("ahead"), "ahead", "left").join(open_("behind"), "behind", "left").na.fill(False, ["ahead_open", "behind_open"]))
    n = ways.count()
    for _ in range(n.bit_length() + 1):
        if not way.where("ahead_open or behind_open").limit(1).count():
            break
        new = way
        for side in ("ahead", "behind"):
            far = way.select(F.col("id").alias(side), F.col(side).alias("_to"), F.col(f"{side}_open").alias("_open"))
            new = new.join(far, side, "left").withColumns({
                side: F.when(F.col(f"{side}_open"), F.col("_to")).otherwise(F.col(side)), f"{side}_open": F.col(f"{side}_open") & F.coalesce("_open", F.lit(False))}).drop("_to", "_open")
        old, way = way, checkpointed(new)
        discard(old)
    rings = way.where("ahead_open").select("id")
    chains = way.where("not ahead_open").select("id", F.col("behind").alias("head"), F.col("ahead").alias("tail"))
    plain = edges.join(inside, "id", "left_anti").join(inside.select(F.col("id").alias("to")), "to", "left_anti").select("id", "to")
    return checkpointed(plain.unionByName(chains.select(F.col("head").alias("id"), F.col("tail").alias("to"))).distinct()), chains, rings


def _circles_of_edges(edges: DataFrame, task_weight: int) -> DataFrame:
    """Nodes on directed circles.  Chains are drawn together to single edges
    first, so what follows takes no round for each of their links."""
    loops = edges.where("id = to").select("id").distinct()
    live = checkpointed(edges.where("id <> to"))
    if live.count() <= task_weight:
        return checkpointed(loops.union(_in_task(live).select("id")).distinct())
    short, chains, rings = _contracted(live)
    found = checkpointed(_components_of_edges(short.where("id <> to"), task_weight))
    closed = chains.where("head = tail")
    head, tail = (found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component")) for c in ("head", "tail"))
    between = chains.join(head, "head").join(tail, "tail").where("head_component = tail_component").select("id")
    return checkpointed(loops.union(found.select("id")).union(rings).union(closed.select("id")).union(closed.select("head")).union(between).distinct())


def _in_task(edges: DataFrame) -> DataFrame:
    return edges.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _rest(t), "id string, component string")


def _components_of_edges(edges: DataFrame, task_weight: int) -> DataFrame:
    """(id, component) of the nodes on circles.  Peel off what has no way in or
    out, until the edges left fit one task.  If peeling ends before that: spread
    the greatest id forward, and from each node that kept its own id spread
    backward among equals - that is its component - and start again without it."""
    live = checkpointed(edges)
    found = live.limit(0).select("id", F.col("to").alias("component"))
    while True:
        n = live.count()
        while n:
            if n <= task_weight:
                return found.union(_in_task(live))
            live = checkpointed(live.join(live.select(F.col("to").alias("id")).distinct(), "id", "left_semi").join(
                live.select(F.col("id").alias("to")).distinct(), "to", "left_semi").select("id", "to"))
            m = live.count()
            if m == n:
                break
            n = m
        if not n:
            return found
        color = checkpointed(live.select("id").union(live.select("to")).distinct().withColumn("color", F.col("id")))
        while True:
            push = live.join(color, "id").groupBy(F.col("to").alias("id")).agg(F.max("color").alias("push"))
            new = checkpointed(color.join(push, "id", "left").select("id", F.greatest("color", "push").alias("color"), (F.coalesce("push", "color") > F.col("color")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            color = new.drop("moved")
            if not moved:
                break
        same = checkpointed(live.join(color, "id").join(color.select(F.col("id").alias("to"), F.col("color").alias("to_color")), "to").where("color = to_color").select("id", "to"))
        part = checkpointed(color.where("id = color").select("id"))
        frontier = part
        while frontier.limit(1).count():
            frontier = checkpointed(same.join(frontier.select(F.col("id").alias("to")), "to", "left_semi").select("id").distinct().join(part, "id", "left_anti"))
            part = checkpointed(part.union(frontier))
        # a component of one node is no circle: no edge of equal color reaches it
        size = part.join(color, "id").groupBy("color").agg(F.count("*").alias("n"))
        found = checkpointed(found.union(part.join(color, "id").join(size.where("n > 1"), "color", "left_semi").select("id", "color")))
        live = checkpointed(live.join(part, "id", "left_anti").join(part.select(F.col("id").alias("to")), "to", "left_anti"))


# -- the operator ------------------------------------------------------------------
def hierarchy(modules: DataFrame, task_weight: int = TASK_WEIGHT) -> DataFrame:
    """One row per module: parent, top, depth, nested-set range, number of
    modules below, and whether it is on a circle of parents or dependencies."""
    rows = modules.select("plan", "id", "root", "related_roots", "dependencies")
    weight = 1 + F.coalesce(F.size("related_roots"), F.lit(0)) + F.coalesce(F.size("dependencies"), F.lit(0))
    weights = checkpointed(rows.groupBy("plan").agg(F.sum(F.greatest(weight, F.lit(1))).alias("weight")))
    heavy = F.col("weight") > task_weight
    n_heavy, total = weights.agg(F.count_if(heavy), F.coalesce(F.sum(F.when(~heavy, F.col("weight"))), F.lit(0))).first()
    light = rows
    if n_heavy:
        names = small(weights.where(heavy).select("plan"), n_heavy)
        same = rows["plan"].eqNullSafe(names["plan"])
        light = rows.join(names, same, "left_anti")
    # small buckets cost nothing, so there are at least as many as cores
    buckets = max(2 * modules.sparkSession.sparkContext.defaultParallelism, -(-total // max(1, task_weight)) * 4)
    done = light.withColumn("bucket", F.pmod(F.xxhash64("plan"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        lambda t: _bucket(t), SCHEMA)
    return done.unionByName(_large(rows.join(names, same, "left_semi"), task_weight)) if n_heavy else done


def circles(tree: DataFrame) -> DataFrame:
    """(link_kind, id) of every module on a circle."""
    kinds = F.array_compact(F.array(F.when(F.col("in_circle"), F.lit("root")), F.when(F.col("in_dependency_circle"), F.lit("dependencies"))))
    return tree.where("in_circle or in_dependency_circle").select(F.explode(kinds).alias("link_kind"), "id")


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, id, distance): all modules below each module.

    A range join on the nested-set line, made an equi-join on chunks of it."""
    placed = tree.where("first is not null").select("plan", "id", "depth", "first", "last")
    # only modules that have something below take part on the ancestors' side
    a = placed.where("last > first").withColumn("chunk", F.explode(F.sequence(F.floor((F.col("first") + 1) / CHUNK), F.floor(F.col("last") / CHUNK)))).alias("a")
    d = placed.withColumn("chunk", F.floor(F.col("first") / CHUNK)).alias("d")
    on = F.col("a.plan").eqNullSafe(F.col("d.plan")) & (F.col("a.chunk") == F.col("d.chunk")) & (F.col("d.first") > F.col("a.first")) & (F.col("d.first") <= F.col("a.last"))
    return a.join(d, on).select(F.col("a.id").alias("ancestor"), F.col("d.id").alias("id"), (F.col("d.depth") - F.col("a.depth")).alias("distance"))


def paths(tree: DataFrame, separator: str = "/") -> DataFrame:
    """(id, top, depth, path): the ids from the top down to the module.

    Ways to the top are doubled: each round puts the way of the module reached
    so far in front, so rounds are logarithmic in the depth and no ancestor is
    ever a row of its own."""
    placed = tree.where("first is not null")
    way = checkpointed(placed.select("id", "top", "depth", F.col("parent").alias("jump"), F.col("id").alias("path")))
    while way.where("jump is not null").limit(1).count():
        far = way.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("above"))
        old, way = way, checkpointed(way.join(far, "jump", "left").select(
            "id", "top", "depth", F.col("next").alias("jump"), F.when(F.col("above").isNotNull(), F.concat("above", F.lit(separator), "path")).otherwise(F.col("path")).alias("path")))
        discard(old)
    return way.select("id", "top", "depth", "path")
