"""Problem 3: what changed between consecutive full snapshots.

Keys are mapped to persistent ordinals, kept in a dictionary (``OrdinalIndex``)
that is written with every set of deltas; in each chunk of the key space the
presence of the keys in a snapshot is a compressed bitmap over ordinals,
AND-NOT of consecutive bitmaps gives additions and removals, and vectors of
value fingerprints aligned by ordinal show changes among the common keys.

Rows go to the chunk of their key by hash.  A chunk holds a bounded number of
rows (``CHUNK_ROWS`` on average over keys of all series), so neither a large
series nor a third of all rows in one series makes a hot task.  Repeated rows
are folded before the shuffle, batch by batch, and the distinct values of one
key before they come to its chunk.

Defined results: exact repeats count once; a key delivered with several
values in one snapshot is compared by the set of them; null values and values
that are no JSON equal only themselves (byte for byte); null keys are a key of
their own; numbers are compared by value; snapshots that are not listed, and
the first of each series, give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small

#: Rows of one chunk, on average.
CHUNK_ROWS = 100_000
CONTAINER = 1 << 16
SPARSE = 4096


class Bitmap:
    """Set of ordinals: per container of 65,536 a sorted array while sparse,
    packed bits when dense."""

    def __init__(self, ordinals: np.ndarray | None = None):
        self.containers: dict[int, np.ndarray] = {}
        if ordinals is not None and len(ordinals):
            o = np.unique(ordinals)
            high = o // CONTAINER
            for h in np.unique(high).tolist():
                self._put(h, (o[high == h] % CONTAINER).astype(np.uint16))

    def _put(self, h: int, low: np.ndarray) -> None:
        if len(low) == 0:
            return
        if len(low) <= SPARSE:
            self.containers[h] = low
        else:
            bits = np.zeros(CONTAINER, bool)
            bits[low] = True
            self.containers[h] = np.packbits(bits)

    @staticmethod
    def _dense(c: np.ndarray) -> np.ndarray:
        if c.dtype == np.uint8:
            return c
        bits = np.zeros(CONTAINER, bool)
        bits[c] = True
        return np.packbits(bits)

    def _combine(self, other: Bitmap, keep: bool) -> Bitmap:
        out = Bitmap()
        for h, c in self.containers.items():
            d = other.containers.get(h)
            if d is None:
                if not keep:
                    out.containers[h] = c
            elif c.dtype == np.uint16:  # sparse: probe
                hit = np.isin(c, d) if d.dtype == np.uint16 else (np.unpackbits(d)[c] > 0)
                out._put(h, c[hit == keep])
            else:
                e = self._dense(d)
                out._put(h, np.flatnonzero(np.unpackbits(c & e if keep else c & ~e)).astype(np.uint16))
        return out

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._combine(other, False)

    def and_(self, other: Bitmap) -> Bitmap:
        return self._combine(other, True)

    def ordinals(self) -> np.ndarray:
        parts = [h * CONTAINER + (c.astype(np.int64) if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c))) for h, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.unpackbits(c).sum()) for c in self.containers.values())


# -- fingerprints of values ------------------------------------------------------
def _number(x: str):
    d = Decimal(x)
    if not d.is_finite():
        raise ValueError(x)
    sign, digits, exponent = d.normalize().as_tuple() if len(d.as_tuple().digits) <= 28 else _stripped(d)
    return {"\0n": f"{sign}:{''.join(map(str, digits))}e{exponent}"} if any(digits) else 0


def _stripped(d: Decimal):
    """Trailing zeros off, without rounding to the context's precision."""
    sign, digits, exponent = d.as_tuple()
    text = "".join(map(str, digits))
    bare = text.rstrip("0") or "0"
    return sign, tuple(map(int, bare)), exponent + len(text) - len(bare)


def _float(x: str):
    d = Decimal(x)
    return int(d) if d == d.to_integral_value() and abs(d.adjusted()) < 30 else _number(x)


def _refuse(x: str):
    raise ValueError(x)


def canonical(text: bytes | str | None) -> bytes:
    """Equal bytes for equal JSON values; other contents stand for themselves."""
    if text is None:
        return b"\x00null"
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    try:
        value = json.loads(raw.decode("utf-8"), parse_float=_float, parse_constant=_refuse)
        return b"\x01" + json.dumps(value, sort_keys=True, separators=(",", ":")).encode()
    except (ValueError, RecursionError, ArithmeticError):
        return b"\x02" + raw


def fingerprint_rows(rows: DataFrame, value: str, *also: str) -> DataFrame:
    """Replace ``value`` (JSON) and the further columns by two 64-bit
    fingerprints ``fa``, ``fb``; repeats within a batch are dropped."""
    rest = [c for c in rows.columns if c != value and c not in also]
    fields = [f"`{n}` {t}" for n, t in rows.dtypes if n in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            values = batch.column(value).to_pylist()
            extra = list(zip(*(batch.column(c).to_pylist() for c in also), strict=True)) if also else [()] * len(values)
            if len(memo) > 100_000:
                memo.clear()
            pairs = []
            for v, e in zip(values, extra, strict=True):
                k = (v, e)
                p = memo.get(k)
                if p is None:
                    h = hashlib.blake2b(canonical(v) + b"\0" + json.dumps(e).encode(), digest_size=16).digest()
                    p = memo[k] = (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True))
                pairs.append(p)
            t = pa.table([*(batch.column(c) for c in rest), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=[*rest, "fa", "fb"])
            yield from t.group_by(t.column_names).aggregate([]).combine_chunks().to_batches()

    return rows.mapInArrow(run, ", ".join([*fields, "fa bigint", "fb bigint"]))


# -- the comparison --------------------------------------------------------------
INDEXED = "series string, k string, position int, delta string, ordinal bigint, fa bigint, fb bigint"


def ordinals_of(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the chunk's keys in the order of their ordinals, the ordinals, each
    row's place among them).

    Rows that bring an ordinal are the chunk's dictionary: those ordinals stay,
    and new keys are appended behind the last one in the order in which they
    first occur."""
    names = {c: pc.unique(t.column(c)) for c in ("series", "k")}

    def codes(c: str) -> np.ndarray:
        return pc.index_in(t.column(c), value_set=names[c], skip_nulls=False).to_numpy().astype(np.int64)

    key, place = np.unique(codes("series") * len(names["k"]) + codes("k"), return_inverse=True)
    n = len(key)
    stated = pc.fill_null(t.column("ordinal"), -1).to_numpy()
    position = pc.fill_null(t.column("position"), 0).to_numpy()
    ordinal, since = np.full(n, -1, np.int64), np.full(n, np.iinfo(np.int32).max, np.int64)
    np.maximum.at(ordinal, place, stated)
    np.minimum.at(since, place, position)
    row = np.zeros(n, np.int64)
    row[place] = np.arange(len(place))
    keys = t.select(["series", "k"]).take(pa.array(row))
    new = np.flatnonzero(ordinal < 0)
    if len(new):
        order = pc.sort_indices(keys.take(pa.array(new)).append_column("since", pa.array(since[new])), [("since", "ascending"), ("series", "ascending"), ("k", "ascending")]).to_numpy()
        ordinal[new[order]] = ordinal.max() + 1 + np.arange(len(new))
    by = np.argsort(ordinal)
    back = np.empty(n, np.int64)
    back[by] = np.arange(n)
    return keys.take(pa.array(by)), ordinal[by], back[place]


def _chunk(t: pa.Table) -> pa.Table:
    """Deltas of all series in one chunk of the key space, and the chunk's
    dictionary with the last value of each key.

    Positions are gone through in order; only the bitmap and the values of one
    position and of the one before it are held besides the rows."""
    keys, ordinal, place = ordinals_of(t)
    n = len(ordinal)
    position = t.column("position").to_numpy()
    known = t.column("ordinal").is_valid().to_numpy()
    # what was processed before is not processed again
    reached = np.full(n, np.iinfo(np.int32).min, np.int64)
    reached[place[known]] = position[known]
    live = known | (position > reached[place])
    order = np.flatnonzero(live)
    order = order[np.lexsort((place[order], position[order]))]
    at, when = place[order], position[order].astype(np.int64)
    values = np.stack([t.column("fa").to_numpy()[order], t.column("fb").to_numpy()[order]], 1)
    first = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(when) != 0)]) if len(at) else np.zeros(0, bool)
    cut = np.flatnonzero(first)
    # several distinct values of a key in one snapshot are summed up
    values = np.add.reduceat(values, cut, axis=0) if len(cut) else values
    at, when = at[cut], when[cut]
    out: list[tuple[np.ndarray, int, str]] = []

    def snapshot(p: int) -> tuple[Bitmap, np.ndarray, np.ndarray]:
        a, b = np.searchsorted(when, [p, p + 1])
        return Bitmap(ordinal[at[a:b]]), ordinal[at[a:b]], values[a:b]

    held: tuple[int, tuple] = (-2, (Bitmap(), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)))
    for p in sorted({q for x in np.unique(when).tolist() for q in (x, x + 1)}):
        before = held[1] if held[0] == p - 1 else snapshot(p - 1)
        now = snapshot(p)
        out.append((now[0].and_not(before[0]).ordinals(), p, "added"))
        out.append((before[0].and_not(now[0]).ordinals(), p, "removed"))
        both = now[0].and_(before[0]).ordinals()
        moved = (now[2][np.searchsorted(now[1], both)] != before[2][np.searchsorted(before[1], both)]).any(1)
        out.append((both[moved], p, "changed"))
        held = (p, now)
    found = np.searchsorted(ordinal, np.concatenate([o for o, _, _ in out])) if out else np.zeros(0, np.int64)
    m = len(found)
    last = np.zeros(n, np.int64)
    last[at] = np.arange(len(at))  # rows are in the order of positions
    both = keys.take(pa.array(np.concatenate([found, np.arange(n)])))
    none = pa.nulls(m, pa.int64())
    return pa.table([
        both.column("series"), both.column("k"),
        pa.array(np.concatenate([*(np.full(len(o), p, np.int32) for o, p, _ in out), when[last].astype(np.int32)])),
        pa.array([d for o, _, d in out for _ in range(len(o))] + [None] * n, pa.string()),
        pa.chunked_array([none, pa.array(ordinal)]), pa.chunked_array([none, pa.array(values[last, 0])]), pa.chunked_array([none, pa.array(values[last, 1])]),
    ], names=["series", "k", "position", "delta", "ordinal", "fa", "fb"])


def _pieces(rows: DataFrame, chunks: int) -> DataFrame:
    """Distinct values of a key in a snapshot, summed up batch by batch: a key
    with any number of values brings few rows to its chunk."""
    columns = ["series", "k", "position"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.table(batch).group_by(columns).aggregate([("fa", "sum"), ("fb", "sum")])
            yield from t.select([*columns, "fa_sum", "fb_sum"]).rename_columns([*columns, "fa", "fb"]).combine_chunks().to_batches()

    distinct = rows.select(*columns, "fa", "fb").distinct().mapInArrow(run, "series string, k string, position int, fa bigint, fb bigint")
    return distinct.withColumn("ordinal", F.lit(None).cast("bigint")).withColumn("chunk", _place(chunks))


def _place(chunks: int):
    return F.pmod(F.xxhash64("series", "k"), F.lit(chunks))


class OrdinalIndex:
    """Persistent ordinals of keys in a folder, and deltas of what is added.

    ``version=N`` holds the deltas found by the N-th call of ``advance`` and the
    dictionary after it: (series, k, ordinal) with the position and fingerprint
    of the key's last occurrence.  A key keeps its ordinal for good; it names the
    key in the bitmaps of every later call, which therefore needs the new
    snapshots only.  A version counts when its job has written ``_SUCCESS``.

    Chunks of the key space hold ``CHUNK_ROWS`` rows on average; their number
    is a power of two and grows with the dictionary: a chunk that is split
    hands its ordinals to both halves, where they stay unique."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path
        self.path, self.fs = path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self.path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.folder))]
        return sorted(n for n in (int(x[8:]) for x in names if x.startswith("version=") and x[8:].isdigit()) if self.fs.exists(self.path(f"{self.folder}/version={n}/_SUCCESS")))

    def _table(self, version: int) -> DataFrame:
        return self.spark.read.schema(INDEXED + ", tab string, chunks int").parquet(f"{self.folder}/version={version}")

    def dictionary(self) -> DataFrame | None:
        """(series, k, position, ordinal, fa, fb, chunks) after the last call."""
        held = self.versions()
        return self._table(held[-1]).where("tab = 'key'").drop("tab", "delta") if held else None

    def deltas(self, version: int | None = None) -> DataFrame:
        """(series, position, k, delta) found by a call, by default the last."""
        return self._table(self.versions()[-1] if version is None else version).where("tab = 'delta'").select("series", "position", "k", "delta")

    def advance(self, rows: DataFrame, n_rows: int) -> DataFrame:
        """Take in snapshots (series, position, k, fa, fb) and return the deltas
        of positions against the ones before; positions of earlier calls mean
        nothing in them, so they are joined with the new snapshots.  ``n_rows``,
        the size of the input, sets the number of chunks together with the
        dictionary's size."""
        held, known = self.versions(), self.dictionary()
        least, n_known = (1, 0) if known is None else known.agg(F.coalesce(F.max("chunks"), F.lit(1)), F.count("*")).first()
        chunks = max(least, 1 << max(0, (max(1, -(-(n_rows + n_known) // CHUNK_ROWS)) - 1).bit_length()))
        placed = _pieces(rows, chunks)
        if known is not None:
            placed = placed.unionByName(known.drop("chunks").withColumn("chunk", _place(chunks)))
        version = held[-1] + 1 if held else 0
        found = placed.groupBy("chunk").applyInArrow(lambda t: _chunk(t), INDEXED)
        tab = F.when(F.col("delta").isNull(), "key").otherwise("delta")
        found.withColumn("chunks", F.lit(chunks)).withColumn("tab", tab).write.mode("overwrite").partitionBy("tab").parquet(f"{self.folder}/version={version}")
        return self.deltas(version)


def sealed(seals: DataFrame) -> DataFrame:
    """(series, revision, position): the revisions of each repository in order."""
    order = Window.partitionBy("repository").orderBy("sealed_at", "revision")
    return seals.select("repository", "revision", "sealed_at").distinct().select(
        F.col("repository").alias("series"), "revision", (F.row_number().over(order) - 1).alias("position"))


def inventory_deltas(inventory: DataFrame, seals: DataFrame, index: OrdinalIndex) -> DataFrame:
    """Each sealed revision against the one sealed before it in its repository."""
    n_seals = seals.count()
    ranked = sealed(seals)
    rows = inventory.select("revision", "k", F.col("v").cast("binary").alias("v"), "kind", "status").join(small(ranked, n_seals), "revision").drop("revision")
    listed = ranked.where("position > 0").withColumnRenamed("revision", "snapshot")
    found = index.advance(fingerprint_rows(rows, "v", "kind", "status"), inventory.count())
    return found.join(small(listed, n_seals), ["series", "position"]).select("snapshot", "k", "delta")


def comparison_deltas(comparison_rows: DataFrame, index: OrdinalIndex) -> DataFrame:
    """Right against left of each comparison's section, where both have rows."""
    side = F.regexp_extract("space", r"^(.*)/(left|right)$", 2)
    rows = comparison_rows.select(
        F.regexp_extract("space", r"^(.*)/(left|right)$", 1).alias("series"),
        F.when(side == "right", 1).when(side == "left", 0).alias("position"), "k", "payload").where("position is not null")
    sides = rows.groupBy("series").agg(F.max("position").alias("position"), F.min("position").alias("least")).where("position = 1 and least = 0").select(
        "series", "position", F.concat("series", F.lit("/right")).alias("snapshot"))
    found = index.advance(fingerprint_rows(rows, "payload"), comparison_rows.count())
    return found.join(sides, ["series", "position"]).select("snapshot", "k", "delta")
