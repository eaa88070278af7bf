"""Left/right comparison of two snapshots, section by section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_total


def align(left: DataFrame, right: DataFrame, key: str, readable: str | None = None) -> DataFrame:
    """Contexts of both sides by logical key: MATCHED, LEFT_ONLY, RIGHT_ONLY,
    AMBIGUOUS (several on a side), UNAVAILABLE (a side cannot be read)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        ok = F.lit(True) if readable is None else F.coalesce(F.col(readable), F.lit(False))
        return df.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.min(ok.cast("int")).alias(f"ok_{name}"))

    j = side(left, "left").join(side(right, "right"), key, "full").na.fill(0, ["n_left", "n_right"])
    state = (
        F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "AMBIGUOUS").when((F.coalesce("ok_left", F.lit(1)) == 0) | (F.coalesce("ok_right", F.lit(1)) == 0), "UNAVAILABLE")
        .when(F.col("n_right") == 0, "LEFT_ONLY").when(F.col("n_left") == 0, "RIGHT_ONLY").otherwise("MATCHED"))
    return j.select(key, "n_left", "n_right", state.alias("alignment"))


def compatibility(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Drift of each aligned pair: the fields that differ (null-safe)."""
    drift = F.array_compact(F.array(*[F.when(~F.col(f"left_{f}").eqNullSafe(F.col(f"right_{f}")), F.lit(f.upper() + "_DRIFT")) for f in fields]))
    unknown = reduce(lambda a, b: a | b, [F.col(f"left_{f}").isNull() & F.col(f"right_{f}").isNotNull() | F.col(f"left_{f}").isNotNull() & F.col(f"right_{f}").isNull() for f in fields])
    return pairs.withColumn("drift", drift).withColumn("verdict", F.when(F.size("drift") == 0, "COMPARABLE").when(unknown, "UNKNOWN").when(F.array_contains("drift", "SCHEMA_DRIFT"), "INCOMPATIBLE").otherwise("QUALIFIED"))


def delta(left: DataFrame, right: DataFrame, keys: list[str], shape: list[str], support: list[str] = (), closed: bool = True) -> DataFrame:
    """One row per key: ADDED, REMOVED, CHANGED (shape), SUPPORT_CHANGED with
    its axes, or UNCHANGED.  Absence counts only on closed sides, else UNKNOWN.

    One full outer join; both sides are reduced to their keys beforehand."""
    a = left.select(*keys, F.lit(True).alias("l"), *[F.col(c).alias(f"l_{c}") for c in (*shape, *support)])
    b = right.select(*keys, F.lit(True).alias("r"), *[F.col(c).alias(f"r_{c}") for c in (*shape, *support)])
    j = a.join(b, keys, "full")

    def differs(columns) -> Column:
        parts = [~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in columns]
        return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)

    gone, new = ("REMOVED", "ADDED") if closed else ("UNKNOWN", "UNKNOWN")
    state = F.when(F.col("l").isNull(), new).when(F.col("r").isNull(), gone).when(differs(shape), "CHANGED").when(differs(support), "SUPPORT_CHANGED").otherwise("UNCHANGED")
    axes = F.concat_ws(",", *[F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in support]) if support else F.lit("")
    return j.select(*keys, state.alias("delta"), axes.alias("axes"))


def fraction_delta(pairs: DataFrame) -> DataFrame:
    """Exact difference of fractions (ln/ld, rn/rd): reduced by the gcd, and the
    change in percent of the left value.

    The gcd is Euclid's on whole columns, folded over a fixed number of steps
    (a 38-digit decimal needs fewer than 190)."""
    ln, ld, rn, rd = (F.col(c).cast("decimal(19,0)") for c in ("ln", "ld", "rn", "rd"))
    n = (rn * ld - ln * rd).cast("decimal(38,0)")
    d = (ld * rd).cast("decimal(38,0)")
    pair = F.struct(F.abs(n).alias("a"), F.abs(d).alias("b"))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(190)), pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(
        F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % s["b"]).otherwise(F.lit(0)).cast("decimal(38,0)").alias("b"))), lambda s: s["a"])
    out = pairs.withColumn("n", n).withColumn("d", d).withColumn("g", F.greatest(g, F.lit(1).cast("decimal(38,0)")))
    return out.withColumn("delta_n", (F.col("n") / F.col("g")).cast("bigint")).withColumn("delta_d", (F.col("d") / F.col("g")).cast("bigint")).withColumn(
        "percent", F.round(F.try_divide(F.lit(100.0) * F.col("n").cast("double") / F.col("rd").cast("double"), F.col("ln").cast("double")), 6)).drop("n", "d", "g")


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Scores of both sides: PAIRED with their difference, LEFT_ONLY, RIGHT_ONLY,
    APPLICABILITY_CHANGED when just one side has a value."""
    j = left.select(key, F.lit(1).alias("l"), F.col(value).alias("before")).join(right.select(key, F.lit(1).alias("r"), F.col(value).alias("after")), key, "full")
    state = F.when(F.col("r").isNull(), "LEFT_ONLY").when(F.col("l").isNull(), "RIGHT_ONLY").when(F.col("before").isNull() != F.col("after").isNull(), "APPLICABILITY_CHANGED").otherwise("PAIRED")
    return j.select(key, "before", "after", (F.col("after") - F.col("before")).alias("difference"), state.alias("state"))


def census(rows: DataFrame, section: str, columns: list[str]) -> DataFrame:
    """Row count of each section, a digest of its rows as a set and one of their
    order by ``columns``: sums of row hashes, plain and weighted by place.  Places
    are counted in two levels, so no section is gathered in one task."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *columns)), 1, 12), 16, 10).cast("decimal(38,0)")
    placed = running_total(rows.withColumn("h", h).withColumn("order", F.struct(*columns)).withColumn("one", F.lit(1)), section, "order", "one", "place")
    return placed.groupBy(section).agg(
        F.count("*").alias("n_rows"), (F.sum("h") % 1_000_000_007).cast("bigint").alias("digest"),
        (F.sum(F.col("h") % 1_000_003 * (F.col("place") % 1_000_003)) % 1_000_000_007).cast("bigint").alias("ordered_digest"))


def flatten_document(text: str) -> list[tuple[str, str]]:
    """Indented ``key: value`` and ``- item`` lines, or dotted properties, as
    (path, value) pairs in order; comments and blank lines are dropped."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[int, str]] = []
    counters: dict[str, int] = {}
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        bare = line.strip()
        if not bare or bare.startswith("#") or bare in ("---", "..."):
            continue
        indent = len(line) - len(line.lstrip())
        if "=" in bare and ":" not in bare.split("=", 1)[0] and not stack and not indent:
            k, v = bare.split("=", 1)
            out.append((k.strip(), v.strip()))
            continue
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if bare.startswith("- "):
            base = ".".join(s for _, s in stack)
            k = counters.get(base, 0)
            counters[base] = k + 1
            item = bare[2:]
            stack.append((indent, f"[{k}]"))
            if ": " in item or item.endswith(":"):
                bare, indent = item, indent + 2
            else:
                out.append((".".join(s for _, s in stack), item))
                continue
        key, _, value = bare.partition(":")
        stack.append((indent, key.strip()))
        if value.strip():
            out.append((".".join(s for _, s in stack), value.strip()))
    return out


def flatten_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of every setting of every document."""
    import pyarrow as pa

    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            keys, paths, values = [], [], []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                for p, v in flatten_document(t or ""):
                    keys.append(k)
                    paths.append(p)
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[key, "path", "value"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, path string, value string")
