"""Bounded traversal of logical edges (context, source, target).

Every operator works on all contexts at once and keeps them apart by joining
on the context too.  Depth counts vertices: a path of depth d has d of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Vertices of an enumerated path, edges of an enumerated circle: a fixed value
#: of the queries; what is longer is not asked for.
DEPTH = 20
#: Edges of one context that one task takes in component labelling.
TASK_EDGES = 1_000_000


def flip(edges: DataFrame) -> DataFrame:
    """Incoming direction: endpoints swapped."""
    return edges.select("context", F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("context", "source", "target")])


def _step(edges: DataFrame) -> DataFrame:
    return edges.select("context", F.col("source").alias("at"), F.col("target").alias("to"))


def _kept(df: DataFrame) -> DataFrame | None:
    """The rows of a round, or None if there are none."""
    out = checkpointed(df)
    return out if out.limit(1).count() else None


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(context, start, end, path, n): all simple paths up to ``depth`` vertices;
    rounds end when no path can be prolonged."""
    hop = checkpointed(_step(edges).where("at <> to").distinct())
    level = starts.select("context", F.col("start").alias("start"), F.array("start").alias("path"), F.col("start").alias("at"))
    out = None
    for n in range(2, depth + 1):
        level = _kept(level.join(hop, ["context", "at"]).where(~F.array_contains("path", F.col("to"))).select(
            "context", "start", F.array_append("path", F.col("to")).alias("path"), F.col("to").alias("at")))
        part = (level or hop.limit(0).select("context", F.col("at").alias("start"), F.array("at").alias("path"), "at")).select(
            "context", "start", F.col("at").alias("end"), "path", F.lit(n).alias("n"))
        out = part if out is None else out.unionByName(part)
        if level is None:
            break
    return out


#: Starts of one pass over the edges, a bit for each (ten bits of a pair).
START_CHUNK = 1024
#: Bytes of bits of one pass, edges times starts; below 64 starts none is narrower.
PASS_BYTES = 64_000_000
#: Pairs of a start and an end, and ends, from which a row is handed on.
ROW_PAIRS, ROW_ENDS = 65_536, 8_192
#: Edges times starts below which the starts of a context are not cut.
LEAST_WORK = 2_000_000


def _numbered_graph(work: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of one context as pairs of numbers, once for each chunk of its
        starts; a row without ``to`` is a start."""
        kept = [b.select(["at", "to"]) if k else b for k, b in enumerate(batches)]
        context = kept[0].column("context").slice(0, 1)
        t = pa.Table.from_batches([kept[0].select(["at", "to"]), *kept[1:]])
        del kept
        hops, starts = t.filter(pc.is_valid(t.column("to"))), t.filter(pc.is_null(t.column("to"))).column("at")
        del t
        ids = pc.unique(pa.chunked_array([*hops.column("at").chunks, *hops.column("to").chunks], pa.string()))
        ids = ids.take(pc.sort_indices(ids))
        a, b = (pc.index_in(hops.column(c), value_set=ids).to_numpy().astype(np.int32) for c in ("at", "to"))
        order = np.argsort(b, kind="stable")
        a, b = a[order].tobytes(), b[order].tobytes()
        own = np.unique(pc.fill_null(pc.index_in(starts, value_set=ids), -1).to_numpy())
        own = own[own >= 0].astype(np.int32)
        for k, part in enumerate(np.array_split(own, min(-(-len(own) // 64), -(-len(own) * hops.num_rows // work)))) if len(own) else ():
            yield pa.RecordBatch.from_arrays([
                context, pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in (a, b, part.tobytes()))],
                names=["context", "chunk", "ids", "a", "b", "own"])

    return run


def _levels(n: int, a: np.ndarray, b: np.ndarray, part: np.ndarray, depth: int | None):
    """(distance, nodes, bits) level by level from the starts in ``part`` at
    once: a node has a bit for each start, an edge hands on the bits that are
    new.  Edges are in the order of ``b``."""
    at = np.arange(len(part))
    seen = np.zeros((n, -(-len(part) // 64)), np.uint64)
    seen[part, at // 64] = np.left_shift(np.uint64(1), (at % 64).astype(np.uint64))
    fresh, d = seen.copy(), 1
    while depth is None or d < depth:
        live = np.flatnonzero(fresh.any(1)[a])
        if not len(live):
            return
        to = b[live]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        to = to[cut]
        new = np.bitwise_or.reduceat(fresh[a[live]], cut, axis=0) & ~seen[to]
        keep = new.any(1)
        to, new = to[keep], new[keep]
        seen[to] |= new
        fresh.fill(0)
        fresh[to] = new
        yield d, to, new
        d += 1


def _reach(depth: int | None, width: int):
    def row(context, starts, ids, ends, distances, pairs):
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([
            context, one(starts), one(ids.take(pa.array(np.concatenate(ends)))), one(pa.array(np.concatenate(distances))), one(pa.array(np.concatenate(pairs)))],
            names=["context", "starts", "ends", "distances", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the starts of each chunk reach, handed on while it is found: a
        row has some ends, and of each pair the place of its end and start."""
        for batch in batches:
            for i in range(batch.num_rows):
                context, ids = batch.column("context").slice(i, 1), batch.column("ids")[i].values
                a, b, own = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("a", "b", "own"))
                step = min(width, 64 * max(1, PASS_BYTES // (8 * (len(a) + 4 * len(ids)))))
                for k in range(0, len(own), step):
                    part = own[k : k + step]
                    starts, ends, distances, pairs, m, n = ids.take(pa.array(part)), [], [], [], 0, 0
                    for d, to, new in _levels(len(ids), a, b, part, depth):
                        for at in range(0, len(to), 512):
                            end, start = np.nonzero(np.unpackbits(new[at : at + 512].view(np.uint8), axis=1, bitorder="little"))
                            pairs.append(((end + n) << 10 | start).astype(np.int32))
                            ends.append(to[at : at + 512])
                            distances.append(np.full(len(ends[-1]), d, np.int32))
                            m, n = m + len(end), n + len(ends[-1])
                            if m >= ROW_PAIRS or n >= ROW_ENDS:
                                yield row(context, starts, ids, ends, distances, pairs)
                                ends, distances, pairs, m, n = [], [], [], 0, 0
                    if n:
                        yield row(context, starts, ids, ends, distances, pairs)

    return run


def reachability(edges: DataFrame, starts: DataFrame, depth: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(context, start, end, distance): nearest distance in edges from every
    start; ``depth`` in vertices, None as far as edges lead.

    Starts are a table: what is asked for, not all nodes.  Edges of one context
    are numbered, its starts are cut into chunks of like work, and a task
    follows a chunk along all edges of the context.  It holds bits only: pairs
    go to Spark as numbers while they are found and become rows there.  A
    context beyond ``task_edges`` is followed by joins instead."""
    kind = dict(edges.dtypes)["source"]
    hop = checkpointed(_step(edges).where("at <> to").select(F.col("context").cast("string").alias("context"), F.col("at").cast("string").alias("at"), F.col("to").cast("string").alias("to")).distinct())
    starts = checkpointed(starts.select(F.col("context").cast("string").alias("context"), F.col("start").cast("string").alias("start")).distinct())
    sizes = checkpointed(hop.groupBy("context").agg(F.count("*").alias("m")).join(starts.groupBy("context").agg(F.count("*").alias("k")), "context"))
    few = F.col("m") <= task_edges
    contexts, n_heavy, work = sizes.agg(F.count("*"), F.count_if(~few), F.coalesce(F.sum(F.when(few, F.col("m") * F.col("k"))), F.lit(0))).first()
    cores = edges.sparkSession.sparkContext.defaultParallelism
    chunk = max(LEAST_WORK, work // (6 * cores))
    rows = hop.unionByName(starts.select("context", F.col("start").alias("at"), F.lit(None).cast("string").alias("to"))).join(sizes.where(few).select("context"), "context", "left_semi")
    graphs = rows.groupBy("context").applyInArrow(_numbered_graph(chunk), "context string, chunk int, ids array<string>, a binary, b binary, own binary")
    found = graphs.repartition(max(1, min(8 * cores, 2 * (contexts + work // chunk))), "context", "chunk").mapInArrow(
        _reach(depth, START_CHUNK), "context string, starts array<string>, ends array<string>, distances array<int>, pairs array<int>")
    pair = F.col("pair")
    out = found.select("context", "starts", "ends", "distances", F.explode("pairs").alias("pair")).select(
        "context", F.get("starts", pair.bitwiseAND(1023)).alias("start"), F.get("ends", F.shiftright(pair, 10)).alias("end"), F.get("distances", F.shiftright(pair, 10)).alias("distance"))
    if n_heavy:
        heavy = sizes.where(~few).select("context")
        out = out.unionByName(_reach_by_joins(hop.join(heavy, "context", "left_semi"), starts.join(heavy, "context", "left_semi"), depth))
    return out if kind == "string" else out.withColumns({c: F.col(c).cast(kind) for c in ("start", "end")})


def _reach_by_joins(hop: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """The same by joins of distinct frontiers, a round for each level."""
    hop, d = checkpointed(hop), 1
    seen = frontier = checkpointed(starts.select("context", "start", F.col("start").alias("end"), F.lit(0).alias("distance")))
    while depth is None or d < depth:
        frontier = _kept(frontier.select("context", "start", F.col("end").alias("at")).join(hop, ["context", "at"]).select("context", "start", F.col("to").alias("end")).distinct().join(
            seen.select("context", "start", "end"), ["context", "start", "end"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier is None:
            break
        seen, d = seen.unionByName(frontier), d + 1
        if d % 8 == 0:  # keep plans short
            seen = checkpointed(seen)
    return seen.where("distance > 0")


def shortest(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(context, start, end, n, path): the first shortest path from every start
    to every node it reaches; only one path to a node is ever held."""
    hop = checkpointed(_step(edges).where("at <> to").distinct())
    level = starts.select("context", "start", F.col("start").alias("at"), F.array("start").alias("path")).distinct()
    seen, out, n = level.select("context", "start", "at"), None, 1
    while True:
        n += 1
        level = _kept(level.join(hop, ["context", "at"]).select("context", "start", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path")).join(
            seen, ["context", "start", "at"], "left_anti").groupBy("context", "start", "at").agg(F.min("path").alias("path")))
        part = (level or hop.limit(0).select("context", F.col("at").alias("start"), "at", F.array("at").alias("path"))).select("context", "start", F.col("at").alias("end"), F.lit(n).alias("n"), "path")
        out = part if out is None else out.unionByName(part)
        if level is None:
            return out
        seen = seen.unionByName(level.select("context", "start", "at"))
        if n % 8 == 0:  # keep plans short
            seen, out = checkpointed(seen), checkpointed(out)


def cycles(edges: DataFrame, length: int = DEPTH) -> DataFrame:
    """(context, path, n): each simple directed circle of up to ``length``
    edges once, its least vertex first; only vertices of cyclic components
    take part, and rounds end when no way is open."""
    hop = _step(edges).distinct()
    inside = components(edges).where("cyclic").select("context", "node", "component")
    hop = hop.join(inside.select("context", F.col("node").alias("at"), "component"), ["context", "at"]).join(
        inside.select("context", F.col("node").alias("to"), F.col("component").alias("c2")), ["context", "to"]).where("component = c2").select("context", "at", "to")
    hop = checkpointed(hop)
    level = hop.where("to >= at").select("context", F.array("at").alias("path"), F.col("to").alias("at"))
    out = None
    for n in range(length):
        closed = level.where(F.col("at") == F.col("path")[0]).select("context", "path", F.size("path").alias("n"))
        out = closed if out is None else out.unionByName(closed)
        if n + 1 == length:
            break
        level = _kept(level.where((F.col("at") > F.col("path")[0]) & ~F.array_contains("path", F.col("at"))).join(hop, ["context", "at"]).where(F.col("to") >= F.col("path")[0]).select(
            "context", F.array_append("path", F.col("at")).alias("path"), F.col("to").alias("at")))
        if level is None:
            break
    return out


def _numbered(t: pa.Table) -> tuple:
    """(contexts, ids, width, nodes, a, b): edges of one bucket as places in
    ``nodes``, each of which is context * width + id."""
    names = {}
    context = pc.unique(t.column("context"))
    c = pc.index_in(t.column("context"), value_set=context, skip_nulls=False).to_numpy().astype(np.int64)
    for side in ("source", "target"):
        names[side] = t.column(side)
    ids = pc.unique(pa.chunked_array([*names["source"].chunks, *names["target"].chunks], pa.string()))
    ids = ids.take(pc.sort_indices(ids))
    width = len(ids)
    a = c * width + pc.index_in(names["source"], value_set=ids).to_numpy().astype(np.int64)
    b = c * width + pc.index_in(names["target"], value_set=ids).to_numpy().astype(np.int64)
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    return context, ids, width, nodes, inverse[: len(a)], inverse[len(a) :]


def _label(t: pa.Table) -> pa.Table:
    """Strongly connected components of all contexts of one bucket."""
    context, ids, width, nodes, a, b = _numbered(t)
    n = len(nodes)
    label = strong_components(n, a, b)
    loops = np.zeros(n, bool)
    loops[a[a == b]] = True
    size = np.bincount(label, minlength=n)
    return pa.table([
        context.take(pa.array(nodes // width)), ids.take(pa.array(nodes % width)), ids.take(pa.array(nodes[label] % width)),
        pa.array(size[label].astype(np.int64)), pa.array((size[label] > 1) | loops),
    ], names=["context", "node", "component", "size", "cyclic"])


def strong_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of every node (iterative depth-first)."""
    order = np.argsort(a, kind="stable")
    to = b[order].tolist()
    start = np.searchsorted(a[order], np.arange(n + 1)).tolist()
    index, low = [-1] * n, [0] * n
    label = np.arange(n)
    held: list[int] = []
    inside = bytearray(n)
    count = 0
    place = start[:]
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [root]
        index[root] = low[root] = count
        count += 1
        held.append(root)
        inside[root] = 1
        while work:
            v = work[-1]
            if place[v] < start[v + 1]:
                w = to[place[v]]
                place[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    held.append(w)
                    inside[w] = 1
                    work.append(w)
                elif inside[w]:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1]] = min(low[work[-1]], low[v])
            if low[v] == index[v]:
                part = []
                while True:
                    w = held.pop()
                    inside[w] = 0
                    part.append(w)
                    if w == v:
                        break
                label[part] = min(part)
    return label


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(context, node, component, size, cyclic): strongly connected
    components, named by their least member; singletons included.

    Contexts are packed into buckets of bounded weight; a context beyond the
    bound is labelled by joins instead (``_spread``)."""
    e = edges.select("context", "source", "target").distinct()
    weights = e.groupBy("context").agg(F.count("*").alias("m"))
    n_heavy, total = weights.agg(F.count_if(F.col("m") > task_edges), F.coalesce(F.sum(F.when(F.col("m") <= task_edges, F.col("m"))), F.lit(0))).first()
    buckets = max(1, -(-total // max(1, task_edges)) * 4)
    light = e
    if n_heavy:
        heavy = weights.where(F.col("m") > task_edges).select("context")
        light = e.join(heavy, "context", "left_anti")
    schema = "context string, node string, component string, size bigint, cyclic boolean"
    out = light.withColumn("bucket", F.pmod(F.xxhash64("context"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda t: _label(t), schema)
    return out.unionByName(_spread(e.join(heavy, "context", "left_semi"))) if n_heavy else out


def _spread(edges: DataFrame) -> DataFrame:
    """Component labels of large contexts: the least id is spread forward and
    backward along edges whose ends still share both labels, until nothing
    moves; ends with different labels are cut, and the rest starts again."""
    nodes = checkpointed(edges.select("context", F.col("source").alias("node")).union(edges.select("context", F.col("target"))).distinct())
    loops = edges.where("source = target").select("context", F.col("source").alias("node")).distinct().withColumn("loop", F.lit(True))
    live = checkpointed(edges.where("source <> target"))
    while True:
        labels = {}
        for side, a, b in (("ahead", "source", "target"), ("behind", "target", "source")):
            label = nodes.withColumn("label", F.col("node"))
            while True:
                push = live.join(label.select("context", F.col("node").alias(a), "label"), ["context", a]).groupBy("context", F.col(b).alias("node")).agg(F.min("label").alias("push"))
                new = checkpointed(label.join(push, ["context", "node"], "left").select("context", "node", F.least("label", "push").alias("label"), (F.coalesce("push", "label") < F.col("label")).alias("moved")))
                moved = new.where("moved").limit(1).count()
                label = new.drop("moved")
                if not moved:
                    break
            labels[side] = label.withColumnRenamed("label", side)
        both = checkpointed(labels["ahead"].join(labels["behind"], ["context", "node"]))
        ends = live.join(both.select("context", F.col("node").alias("source"), F.col("ahead").alias("a1"), F.col("behind").alias("b1")), ["context", "source"]).join(
            both.select("context", F.col("node").alias("target"), F.col("ahead").alias("a2"), F.col("behind").alias("b2")), ["context", "target"])
        before = live.count()
        live = checkpointed(ends.where("a1 = a2 and b1 = b2").select("context", "source", "target"))
        if live.count() == before:
            break
    named = both.select("context", "node", F.col("ahead").alias("component"))
    sizes = named.groupBy("context", "component").agg(F.count("*").alias("size"))
    return named.join(sizes, ["context", "component"]).join(loops, ["context", "node"], "left").select(
        "context", "node", "component", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def _ranks(t: pa.Table) -> pa.Table:
    """Ranks of all contexts of one bucket, peeled from the starts."""
    context, ids, width, nodes, a, b = _numbered(t)
    order = np.argsort(a, kind="stable")
    to, place = b[order], np.searchsorted(a[order], np.arange(len(nodes) + 1))
    open_, rank, at = np.bincount(b, minlength=len(nodes)), np.full(len(nodes), -1), 0
    ready = np.flatnonzero(open_ == 0)
    while len(ready):
        rank[ready] = at
        size = place[ready + 1] - place[ready]
        out = to[np.repeat(place[ready] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        hit, n = np.unique(out, return_counts=True)
        open_[hit] -= n
        ready, at = hit[open_[hit] == 0], at + 1
    done = np.flatnonzero(rank >= 0)
    return pa.table([context.take(pa.array(nodes[done] // width)), ids.take(pa.array(nodes[done] % width)), pa.array(rank[done].astype(np.int32))], names=["context", "node", "rank"])


def schedule(edges: DataFrame, depth: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(context, node, rank): longest way from a start, for the nodes that no
    circle holds up; the order in which work can be done.  ``depth`` in ranks,
    None until nothing is ready.

    Contexts are packed into buckets as in ``components``; a context beyond the
    bound is peeled by joins instead."""
    e = checkpointed(edges.where("source <> target").select("context", "source", "target").distinct())
    weights = e.groupBy("context").agg(F.count("*").alias("m"))
    n_heavy, total = weights.agg(F.count_if(F.col("m") > task_edges), F.coalesce(F.sum(F.when(F.col("m") <= task_edges, F.col("m"))), F.lit(0))).first()
    buckets = max(1, -(-total // max(1, task_edges)) * 4)
    light = e
    if n_heavy:
        heavy = weights.where(F.col("m") > task_edges).select("context")
        light = e.join(heavy, "context", "left_anti")
    out = light.withColumn("bucket", F.pmod(F.xxhash64("context"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda t: _ranks(t), "context string, node string, rank int")
    out = out if depth is None else out.where(F.col("rank") < depth)
    return out.unionByName(_peel(e.join(heavy, "context", "left_semi"), depth)) if n_heavy else out


def _peel(edges: DataFrame, depth: int | None) -> DataFrame:
    """Ranks of large contexts, one round of joins each."""
    hop = checkpointed(_step(edges).where("at <> to").distinct())
    nodes = hop.select("context", F.col("at").alias("node")).union(hop.select("context", F.col("to"))).distinct()
    waiting, rank, out = hop, 0, None
    while depth is None or rank < depth:
        blocked = waiting.select("context", F.col("to").alias("node")).distinct()
        ready = checkpointed(nodes.join(blocked, ["context", "node"], "left_anti").withColumn("rank", F.lit(rank)))
        if not ready.limit(1).count():
            break
        out = ready if out is None else out.unionByName(ready)
        nodes = checkpointed(nodes.join(ready, ["context", "node"], "left_anti"))
        waiting = checkpointed(waiting.join(ready.select("context", F.col("node").alias("at")), ["context", "at"], "left_anti"))
        rank += 1
        if rank % 8 == 0:  # keep plans short
            out = checkpointed(out)
    return out if out is not None else nodes.withColumn("rank", F.lit(0)).limit(0)


def climb(parents: DataFrame, levels: int) -> DataFrame:
    """(context, tip, owner, steps): first ``found`` parent on the way up from
    every tip; ``parents`` is (context, tip, up, found) with one parent each and
    ``levels`` counts the tip.  Ways are doubled, so rounds are logarithmic; a
    way that ends or runs in a circle has no owner."""
    way = checkpointed(parents.select("context", "tip", "up", "found", F.lit(1).alias("steps")))
    reach = 1
    while reach < levels and way.where("not found").limit(1).count():
        more = way.select("context", F.col("tip").alias("up"), F.col("up").alias("next"), F.col("found").alias("hit"), F.col("steps").alias("more"))
        on = way.where("not found").join(more, ["context", "up"]).select("context", "tip", F.col("next").alias("up"), F.col("hit").alias("found"), (F.col("steps") + F.col("more")).alias("steps"))
        way, reach = checkpointed(way.where("found").unionByName(on)), 2 * reach
    return way.where(F.col("found") & (F.col("steps") < levels)).select("context", "tip", F.col("up").alias("owner"), "steps")


def heads(edges: DataFrame) -> DataFrame:
    """(context, node): least vertices of simple circles of any length, loops
    included.

    A vertex heads a circle if it lies on one among itself and the greater
    vertices of its component; circles are not enumerated."""
    hop = edges.select("context", "source", "target").distinct()
    inside = components(hop.select(F.to_json(F.struct("context")).alias("context"), F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))).where("cyclic")
    ends = [inside.select("context", F.col("node").alias(f"{side}_node"), F.col("component").alias(f"{side}_component")) for side in ("source", "target")]
    hop = hop.select(F.col("context").alias("of"), "source", "target", F.to_json(F.struct("context")).alias("context"), F.col("source").cast("string").alias("source_node"), F.col("target").cast("string").alias("target_node"))
    hop = checkpointed(hop.join(ends[0], ["context", "source_node"]).join(ends[1], ["context", "target_node"]).where("source_component = target_component"))
    start = hop.select("context", "of", F.col("source").alias("head"), F.col("source_component").alias("c")).distinct()
    above = start.join(hop.select("context", "source", "target", "source_node", "target_node", F.col("source_component").alias("c")), ["context", "c"]).where("source >= head and target >= head")
    above = checkpointed(above.select("of", "head", F.to_json(F.struct("context", "head")).alias("context"), F.col("source_node").alias("source"), F.col("target_node").alias("target")))
    on = components(above).where("cyclic").select("context", "node")
    return above.select("context", "of", "head", F.col("head").cast("string").alias("node")).distinct().join(on, ["context", "node"], "left_semi").select(F.col("of").alias("context"), F.col("head").alias("node"))


def neighbourhood(edges: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """One hop from every start, id-ordered, at most ``size`` each (a feature)."""
    w = Window.partitionBy("context", "source").orderBy("target")
    hop = edges.join(starts.select("context", F.col("start").alias("source")), ["context", "source"], "left_semi").select("context", "source", "target").distinct()
    return hop.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)
