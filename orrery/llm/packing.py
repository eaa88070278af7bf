"""Problem 7: filling containers of fixed capacity with whole documents.

Large-item matching.  Pieces above one third of the capacity pair at most
twice per container: they are matched greedily, the largest with the largest
that still fits.  All smaller pieces then go, largest first, to the container
with the tightest gap that takes them.

The plan needs only how many pieces of each size there are.  Sizes are
integers up to the capacity, so that histogram has at most ``capacity`` rows
whatever the corpus; containers filled alike are planned as one group with a
multiplicity.  Documents are then mapped to the planned places by their rank
among the pieces of their size.  Ranks are counted in two levels (hash bucket,
then bucket offsets), so that a size which a third of all documents share is
no hot task.

Defined results: documents without tokens take no room (no row); a document
longer than a container is cut into full containers of its own and one rest
piece, numbered from 0; shorter ones are piece 0; ties are broken by a hash
of the id.  Repeated rows are packed once each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

CAPACITY = 2048
#: Pieces that one task ranks within a size.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Group:
    """``times`` containers that all hold the same sizes: ((size, how many), ...)."""

    times: int
    items: tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Groups of alike containers for ``{size: count}``; sizes in 1..capacity."""
    left = {s: n for s, n in histogram.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    #: gap -> [(times, items), ...]; ``gaps`` holds the keys in order
    open_: dict[int, list[tuple[int, tuple]]] = {}
    gaps: list[int] = []

    def put(gap: int, times: int, items: tuple) -> None:
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((times, items))

    def take(k: int) -> list[tuple[int, tuple]]:
        return open_.pop(gaps.pop(k))

    waiting = large[:]
    while waiting:
        s = waiting[-1]
        n = left[s]
        # the largest partner that fits, at most s itself
        k = bisect_left(waiting, capacity - s + 1) - 1
        if k < 0:
            put(capacity - s, n, ((s, 1),))
            waiting.pop()
            continue
        t = waiting[k]
        if t == s:
            if n >= 2:
                put(capacity - 2 * s, n // 2, ((s, 2),))
            left[s] = n % 2
            if left[s] and k > 0:
                # the odd one looks for a smaller partner
                t = waiting[k - 1]
                put(capacity - s - t, 1, ((s, 1), (t, 1)))
                left[t] -= 1
                left[s] = 0
                if not left[t]:
                    waiting.pop(k - 1)
            elif left[s]:
                put(capacity - s, 1, ((s, 1),))
                left[s] = 0
            waiting.pop()
            continue
        m = min(n, left[t])
        put(capacity - s - t, m, ((s, 1), (t, 1)))
        left[s] -= m
        left[t] -= m
        if not left[t]:
            waiting.pop(k)
        if not left[s]:
            waiting.pop()
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(gaps, s)
            if k == len(gaps):  # no gap takes it: new containers
                each = capacity // s
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * s, full, ((s, each),))
                if rest:
                    put(capacity - rest * s, 1, ((s, rest),))
                break
            gap = gaps[k]
            each = gap // s
            for times, items in take(k):
                full = min(times, n // each)
                if full:
                    put(gap - each * s, full, (*items, (s, each)))
                    n -= full * each
                rest = times - full
                if rest and n:  # fewer than ``each`` are left for one of them
                    put(gap - n * s, 1, (*items, (s, n)))
                    n = 0
                    rest -= 1
                if rest:
                    put(gap, rest, items)
    return [Group(t, i) for g in sorted(open_) for t, i in open_[g]]


def places(groups: list[Group]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, first container, pieces per container)."""
    used: dict[int, int] = {}
    container, out = 0, []
    for g in groups:
        for size, each in g.items:
            a = used.get(size, 0)
            used[size] = a + each * g.times
            out.append((size, a, used[size], container, each))
        container += g.times
    return out


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, n_tokens) of documents with (doc_id, n_tokens)."""
    n = F.col("n_tokens")
    last = F.ceil(n / F.lit(capacity)).cast("int") - 1
    return sizes.where(n > 0).select(
        "doc_id", n, F.explode(F.sequence(F.lit(0), last)).alias("piece_no"),
    ).select("doc_id", "piece_no", F.least(F.lit(capacity).cast("bigint"), n - F.col("piece_no").cast("bigint") * capacity).alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(container_no, doc_id, piece_no, n_tokens) for (doc_id, n_tokens).

    ``sizes`` is read twice; it is checkpointed here, since computing it is
    usually dear (tokenizing)."""
    spark = sizes.sparkSession
    sizes = checkpointed(sizes.where(F.col("n_tokens") > 0))
    parts = pieces(sizes, capacity)
    # at most ``capacity`` rows come to the driver
    histogram = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    found = places(plan(histogram, capacity))
    total = sum(histogram.values())
    buckets = max(1, -(-total // bucket_rows))
    salted = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no")
    ranked = salted.withColumn("rank", F.row_number().over(inner) - 1)
    if buckets > 1:
        offsets = salted.groupBy("n_tokens", "bucket").agg(F.count("*").alias("m")).withColumn(
            "offset", F.sum("m").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        ranked = ranked.join(offsets.select("n_tokens", "bucket", F.coalesce("offset", F.lit(0)).alias("offset")), ["n_tokens", "bucket"]).withColumn(
            "rank", F.col("rank") + F.col("offset"))
    # the places of each size as one sorted array: at most ``capacity`` rows,
    # and no more groups than a small multiple of it, so a broadcast is safe
    by_size: dict[int, list] = {}
    for size, a, b, c, k in found:
        by_size.setdefault(size, []).append((a, b, c, k))
    lookup = spark.createDataFrame(
        [(s, x) for s, x in by_size.items()],
        "n_tokens bigint, places array<struct<a:bigint,b:bigint,c:bigint,k:bigint>>")
    hit = F.filter("places", lambda p: (F.col("rank") >= p["a"]) & (F.col("rank") < p["b"]))[0]
    return ranked.join(F.broadcast(lookup), "n_tokens").withColumn("p", hit).select(
        (F.col("p.c") + F.floor((F.col("rank") - F.col("p.a")) / F.col("p.k"))).cast("bigint").alias("container_no"),
        "doc_id", "piece_no", F.col("n_tokens").cast("bigint").alias("n_tokens"))


def fill_rate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, least possible containers, free share."""
    return packed.agg(
        F.max("container_no").alias("last"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"),
    ).select(
        (F.coalesce("last", F.lit(-1)) + 1).alias("n_containers"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_pieces",
        F.ceil(F.coalesce("n_tokens", F.lit(0)) / F.lit(capacity)).alias("least_containers"),
        (1 - F.try_divide(F.col("n_tokens"), (F.col("last") + 1) * capacity)).alias("free_share"))
