"""Truth regions: facts that are true, false or unknown per world.

A region is a set of rows (key..., world, truth) with a nullable boolean.  In
a closed region a world without a row is false; in an open one it is unknown.
Kleene logic is Spark's own; over groups it is min / max of the ranks
false 0 < unknown 1 < true 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No more worlds than this are ever enumerated.
MAX_WORLDS = 4096


def rank(truth: Column) -> Column:
    return F.when(truth, 2).when(~truth, 0).otherwise(1)


def truth_of(r: Column) -> Column:
    return F.when(r == 2, True).when(r == 0, False)


def fold(rows: DataFrame, keys: list[str], every: bool) -> DataFrame:
    """AND (every) or OR of several rows of one key and world."""
    agg = F.min if every else F.max
    return rows.groupBy(*keys, "world").agg(agg(rank(F.col("truth"))).alias("r")).select(*keys, "world", truth_of(F.col("r")).alias("truth"))


def measure(rows: DataFrame, keys: list[str], n_worlds: int, closed: bool = True) -> DataFrame:
    """Per key: worlds known true, known false, unknown; witness = least true world."""
    m = rows.groupBy(*keys).agg(
        F.count_if("truth").alias("n_true"), F.count_if(~F.col("truth")).alias("n_false"), F.count_if(F.col("truth").isNull()).alias("n_unknown"),
        F.min(F.when(F.col("truth"), F.col("world"))).alias("witness"))
    absent = F.lit(n_worlds) - F.col("n_true") - F.col("n_false") - F.col("n_unknown")
    return m.withColumn("n_false" if closed else "n_unknown", F.col("n_false" if closed else "n_unknown") + absent)


def classify(m: DataFrame) -> DataFrame:
    """MUST / MAY / NEVER, and UNKNOWN as soon as one world is unknown."""
    return m.withColumn("quantifier", F.when(F.col("n_unknown") > 0, "UNKNOWN").when(F.col("n_false") == 0, "MUST").when(F.col("n_true") == 0, "NEVER").otherwise("MAY"))


def classify_open(m: DataFrame) -> DataFrame:
    """The other rule: some true and some false is MAY, unknown worlds or not."""
    t, f, u = F.col("n_true") > 0, F.col("n_false") > 0, F.col("n_unknown") > 0
    return m.withColumn("quantifier", F.when(t & f, "MAY").when(u, "UNKNOWN").when(t, "MUST").otherwise("NEVER"))


def check(m: DataFrame, closed: bool = True) -> DataFrame:
    """SAT with a witness; UNSAT only if closed and nothing is possible."""
    possible = F.col("n_unknown") > 0
    return m.withColumn("verdict", F.when(F.col("n_true") > 0, "SAT").when(possible | F.lit(not closed), "UNKNOWN").otherwise("UNSAT"))


def negate(rows: DataFrame, keys: list[str], worlds: list[str], closed: bool = True) -> DataFrame:
    """Complement over the universe (a bounded list of worlds).

    Missing worlds are filled from a map per key, not by a join."""
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("world", rank(F.col("truth")).alias("r")))).alias("m"))
    filled = held.select(*keys, "m", F.explode(F.array(*map(F.lit, worlds))).alias("world"))
    r = F.coalesce(F.col("m")[F.col("world")], F.lit(0 if closed else 1))
    return filled.select(*keys, "world", truth_of(2 - r).alias("truth"))


def condition(rows: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """OR of AND terms over keys: ``terms`` (condition, term, key).  A world in
    which a key has no row is false for it."""
    size = terms.groupBy("condition", "term").agg(F.count_distinct(key).alias("size"))
    hit = rows.join(terms.join(size, ["condition", "term"]), key).groupBy("condition", "term", "size", "world").agg(
        F.min(rank(F.col("truth"))).alias("r"), F.count_distinct(key).alias("n"))
    within = hit.select("condition", "world", F.when(F.col("n") < F.col("size"), 0).otherwise(F.col("r")).alias("r"))
    return within.groupBy("condition", "world").agg(F.max("r").alias("r")).select("condition", "world", truth_of(F.col("r")).alias("truth"))


def delta(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and world: what became of the fact from left to right."""
    a = left.select(*keys, "world", F.lit(True).alias("in_left"), F.col("truth").alias("before"))
    b = right.select(*keys, "world", F.lit(True).alias("in_right"), F.col("truth").alias("after"))
    j = a.join(b, [*keys, "world"], "full")
    state = (
        F.when(F.col("in_left").isNull(), "RIGHT_ONLY").when(F.col("in_right").isNull(), "LEFT_ONLY")
        .when(F.col("before").isNull() | F.col("after").isNull(), "UNCERTAIN")
        .when(F.col("before") & F.col("after"), "PERSISTED").when(F.col("before"), "RESOLVED").when(F.col("after"), "INTRODUCED").otherwise("CLEAN"))
    return j.select(*keys, "world", state.alias("transition"))


def project(classified: DataFrame, mode: str) -> DataFrame:
    """Projection modes of classified edges."""
    q = F.col("quantifier")
    keep = {"MUST": q == "MUST", "MAY": q == "MAY", "MAY_AND_MUST": q.isin("MAY", "MUST"), "BOUNDED_UNION": q != "NEVER", "UNKNOWN_OVERLAY": q == "UNKNOWN", "REALIZED": F.col("n_true") > 0}
    return classified.where(keep[mode])


# -- finite domains -------------------------------------------------------------
def worlds(spark: SparkSession, domain: dict[str, list], limit: int = MAX_WORLDS) -> tuple[DataFrame | None, int]:
    """All assignments of finite dimensions, by mixed-radix decoding of a range
    (no cross join).  Over the limit: (None, limit + 1) - nothing enumerated."""
    size = reduce(lambda a, b: a * len(b), domain.values(), 1)
    if size > min(limit, MAX_WORLDS):
        return None, min(limit, MAX_WORLDS) + 1
    columns, radix = [F.col("id").alias("world")], 1
    for name, values in domain.items():
        digit = F.floor(F.col("id") / radix) % len(values)
        columns.append(F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int")).alias(name))
        radix *= len(values)
    return spark.range(size).select(*columns), size


def evaluate(ir: tuple) -> Column:
    """Kleene expression of a condition over world columns.

    CONSTANT b | ALL .. | ANY .. | NOT c | PROFILE name | PROPERTY name having
    match_if_missing | WEB_MODE mode | OPAQUE.  A null property is missing, the
    value '?' is not decidable."""
    op, *args = ir
    if op == "CONSTANT":
        return F.lit(args[0]).cast("boolean")
    if op in ("ALL", "ANY"):
        parts = [evaluate(a) for a in args] or [F.lit(op == "ALL")]
        return reduce(lambda a, b: a & b if op == "ALL" else a | b, parts)
    if op == "NOT":
        return ~evaluate(args[0])
    if op == "PROFILE":
        return F.col(f"profile_{args[0]}")
    if op == "WEB_MODE":
        return F.lower(F.col("web_mode")) == args[0].lower()
    if op == "PROPERTY":
        name, having, if_missing = args
        v = F.col(f"property_{name}")
        exact = F.lower(v) != "false" if not having else F.lower(v) == having.lower()
        return F.when(v.isNull(), F.lit(if_missing)).when(v == "?", F.lit(None).cast("boolean")).otherwise(exact)
    if op in ("OPAQUE", "BEAN_STATE"):
        return F.lit(None).cast("boolean")
    raise ValueError(op)


def profile_expression(text: str) -> tuple:
    """``a & !(b | c)`` to condition form; & and | may not mix unbracketed."""
    import re

    tokens = re.findall(r"\s*([!&|()]|[^\s!&|()]+)", text)
    pos = 0

    def take() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("unexpected end of profile expression")
        pos += 1
        return tokens[pos - 1]

    def unary() -> tuple:
        t = take()
        if t == "!":
            return ("NOT", unary())
        if t == "(":
            x = expression()
            if take() != ")":
                raise ValueError("unbalanced profile expression")
            return x
        if t in "&|)":
            raise ValueError(f"unexpected {t}")
        return ("PROFILE", t)

    def expression() -> tuple:
        parts, op = [unary()], None
        while pos < len(tokens) and tokens[pos] in "&|":
            t = take()
            if op not in (None, t):
                raise ValueError("& and | mixed without brackets")
            op = t
            parts.append(unary())
        return parts[0] if op is None else ("ALL" if op == "&" else "ANY", *parts)

    out = expression()
    if pos < len(tokens):
        raise ValueError("trailing tokens in profile expression")
    return out


# -- Boolean satisfiability -------------------------------------------------------
def satisfiable(formula: tuple, max_steps: int = 1_000_000) -> dict[str, bool] | None | str:
    """A model of a symbolic formula, None if there is none, 'UNKNOWN' when the
    step budget ends.  ('var', x) | ('not', f) | ('and', ..) | ('or', ..) |
    ('const', b); each shared subformula gets one definition (Tseitin), then
    unit propagation and splitting."""
    ids: dict = {}
    clauses: list[frozenset[int]] = []
    names: dict[int, str] = {}

    def literal(f: tuple) -> int:
        if f in ids:
            return ids[f]
        op = f[0]
        if op == "not":
            return -literal(f[1])
        n = len(ids) + 1
        ids[f] = n
        if op == "var":
            names[n] = f[1]
        elif op == "const":
            clauses.append(frozenset([n if f[1] else -n]))
        else:
            parts = [literal(x) for x in f[1:]]
            sign = 1 if op == "and" else -1
            clauses.extend(frozenset([-sign * n, sign * p]) for p in parts)
            clauses.append(frozenset([sign * n, *(-sign * p for p in parts)]))
        return n

    root = literal(formula)
    clauses.append(frozenset([root]))
    steps = 0

    def assign(cs: list[frozenset[int]], x: int) -> list[frozenset[int]] | None:
        out = []
        for c in cs:
            if x in c:
                continue
            if -x in c:
                c = c - {-x}
                if not c:
                    return None
            out.append(c)
        return out

    stack: list[tuple[list[frozenset[int]], dict[int, bool]]] = [(clauses, {})]
    while stack:
        cs, model = stack.pop()
        conflict = False
        while True:
            steps += 1
            if steps > max_steps:
                return "UNKNOWN"
            unit = next((c for c in cs if len(c) == 1), None)
            if unit is None:
                break
            (x,) = unit
            model = {**model, abs(x): x > 0}
            cs = assign(cs, x)
            if cs is None:
                conflict = True
                break
        if conflict:
            continue
        if not cs:
            return {names[v]: model.get(v, False) for v in names}
        x = abs(min(min(cs, key=len), key=abs))
        for choice in (-x, x):
            branch = assign(cs, choice)
            if branch is not None:
                stack.append((branch, {**model, x: choice > 0}))
    return None


def implies(a: tuple, b: tuple, max_steps: int = 1_000_000) -> bool | None:
    """Does ``b`` hold wherever ``a`` does?  None when the step budget ends."""
    model = satisfiable(("and", a, ("not", b)), max_steps)
    return None if model == "UNKNOWN" else model is None


def equivalent(a: tuple, b: tuple, max_steps: int = 1_000_000) -> bool | None:
    both = implies(a, b, max_steps), implies(b, a, max_steps)
    return False if False in both else None if None in both else True


def delta_of(a: tuple, b: tuple, max_steps: int = 1_000_000) -> str:
    """What became of a symbolic region: ABSENT, INTRODUCED, RESOLVED, PERSISTED,
    NARROWED, WIDENED or CHANGED; UNCERTAIN when a proof is not found in time."""
    here, there = satisfiable(a, max_steps), satisfiable(b, max_steps)
    if "UNKNOWN" in (here, there):
        return "UNCERTAIN"
    if here is None or there is None:
        return "ABSENT" if here is there else "INTRODUCED" if here is None else "RESOLVED"
    onward, back = implies(a, b, max_steps), implies(b, a, max_steps)
    if None in (onward, back):
        return "UNCERTAIN"
    return "PERSISTED" if onward and back else "WIDENED" if onward else "NARROWED" if back else "CHANGED"


def from_terms(terms: list[list[str]]) -> tuple:
    """OR of AND terms of literals, '!' in front of what must not hold."""
    literal = lambda x: ("not", ("var", x[1:])) if x.startswith("!") else ("var", x)
    parts = [("and", *map(literal, t)) if t else ("const", True) for t in terms]
    return ("or", *parts) if parts else ("const", False)


#: Verdicts that one task remembers.
MAX_VERDICTS = 100_000


def symbolic_delta(rows: DataFrame, keys: list[str], max_steps: int = 1_000_000) -> DataFrame:
    """(keys, verdict): ``left`` and ``right`` regions of each row, both
    array<array<string>> as in ``from_terms``, compared by proofs where the rows
    are.  A null side is unknown and makes the row UNCERTAIN."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            out = []
            for sides in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                if None in sides:
                    out.append("UNCERTAIN")
                    continue
                k = tuple(tuple(sorted({tuple(sorted(t)) for t in x})) for x in sides)
                if k not in known:
                    if len(known) >= MAX_VERDICTS:
                        known.clear()
                    known[k] = delta_of(from_terms(k[0]), from_terms(k[1]), max_steps)
                out.append(known[k])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(out, pa.string())], names=[*keys, "verdict"])

    return rows.select(*keys, "left", "right").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "verdict string"]))
