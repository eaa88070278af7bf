"""Cross-context bindings: requirements to endpoints, URIs, RPC names, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: States of a binding and of a ledger question.
STATES = ("BOUND", "CONTRACT_ONLY", "CANDIDATE", "AMBIGUOUS", "UNRESOLVED", "INFEASIBLE", "REOPENED", "NOT_APPLICABLE")
VARIABLE = r"^(\{[A-Za-z_][A-Za-z0-9_]*\}|:[A-Za-z_][A-Za-z0-9_]*)$"
UNSAFE = r"(?i)[\;]|%2f|%5c|%2e|(^|/)\.\.?(/|$)"


def compatible(requirements: DataFrame, endpoints: DataFrame, operands: list[str]) -> DataFrame:
    """Candidates of each requirement with all operands compared: EXACT,
    UNCERTAIN (one is missing); a mismatch drops the candidate."""
    r = requirements.select("requirement", "candidate", *[F.col(o).alias(f"r_{o}") for o in operands])
    e = endpoints.select(F.col("endpoint").alias("candidate"), *[F.col(o).alias(f"e_{o}") for o in operands])
    equal = F.array(*[F.col(f"r_{o}") == F.col(f"e_{o}") for o in operands])
    j = r.join(e, "candidate").withColumn("equal", equal)
    return j.where(~F.exists("equal", lambda x: ~x)).select("requirement", "candidate", F.when(F.exists("equal", lambda x: x.isNull()), "UNCERTAIN").otherwise("EXACT").alias("fit"))


def states(candidates: DataFrame) -> DataFrame:
    """Binding state of each requirement by the decision order: several exact ->
    AMBIGUOUS; uncertain, or exact beside an open one -> CANDIDATE; one exact ->
    CONTRACT_ONLY or BOUND; else REOPENED, INFEASIBLE, UNRESOLVED."""
    c = candidates.groupBy("requirement").agg(*[F.count_if(F.col("fit") == f).alias(f.lower()) for f in ("EXACT", "UNCERTAIN", "OPEN", "REOPENED", "INFEASIBLE")], F.max(F.coalesce(F.col("unrouted"), F.lit(False))).alias("unrouted"))
    state = (
        F.when(F.col("exact") > 1, "AMBIGUOUS").when((F.col("uncertain") > 0) | (F.col("exact") == 1) & (F.col("open") + F.col("reopened") > 0), "CANDIDATE")
        .when((F.col("exact") == 1) & F.col("unrouted"), "CONTRACT_ONLY").when(F.col("exact") == 1, "BOUND")
        .when(F.col("reopened") > 0, "REOPENED").when(F.col("infeasible") > 0, "INFEASIBLE").otherwise("UNRESOLVED"))
    return c.select("requirement", state.alias("state"))


def counts(stated: DataFrame) -> DataFrame:
    """Requirements by state, with explicit zeros."""
    domain = stated.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return domain.join(stated.groupBy("state").agg(F.count("*").alias("n")), "state", "left").na.fill(0, ["n"])


def uri_join(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, route): literal paths against segment templates.

    Equi-joined on the number of segments and the first one; routes whose
    first segment is a variable join on the number alone.  Never a nested loop."""
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.where(~F.col(name).rlike(UNSAFE) & F.col(name).startswith("/")).select(name, F.split(name, "/").alias(f"{name}_parts")).distinct()

    variable = lambda x: x.rlike(VARIABLE)
    a = parts(requests, "request").withColumn("n", F.size("request_parts")).withColumn("first", F.element_at("request_parts", 2))
    b = parts(routes, "route").withColumn("n", F.size("route_parts")).withColumn("first", F.element_at("route_parts", 2))
    fits = F.forall(F.zip_with("request_parts", "route_parts", lambda x, y: F.when(variable(y), x != "").otherwise(x == y)), lambda x: x)
    literal = a.join(b.where(~variable(F.col("first"))), ["n", "first"]).where(fits)
    wild = a.drop("first").join(b.where(variable(F.col("first"))).drop("first"), "n").where(fits)
    return literal.select("request", "route").unionByName(wild.select("request", "route"))


def prefix_join(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the deepest root that contains each file.

    A file is expanded to its own ancestors (as many as its depth), which turns
    the prefix condition into an equi-join on (scope, root)."""
    s = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda k: F.array_join(F.slice(s, F.lit(1), k), "/"))
    spread = files.where(F.size(s) > 1).select("scope", "path", F.explode(up).alias("root"))
    hit = spread.join(roots.select("scope", "root").distinct(), ["scope", "root"])
    return hit.groupBy("scope", "path").agg(F.max_by("root", F.length("root")).alias("root"))


def rpc_join(calls: DataFrame, handlers: DataFrame, spellings: Column) -> DataFrame:
    """(call, handler): names equal in any of the handler's spellings."""
    spread = handlers.withColumn("name", F.explode(spellings))
    return calls.join(spread, "name").select("call", "handler").distinct()


def ledger(answers: DataFrame, question: list[str], answer: str, at: str) -> DataFrame:
    """State of each question, whatever order answers came in: CONFLICTED when
    they differ, SATISFIED when one repeats, NARROWED while some are empty,
    PENDING without any."""
    g = answers.groupBy(*question).agg(F.count_distinct(answer).alias("n_answers"), F.count("*").alias("n_attempts"), F.count_if(F.col(answer).isNull()).alias("n_empty"), F.max(at).alias("last_at"))
    state = F.when(F.col("n_answers") > 1, "CONFLICTED").when(F.col("n_answers") == 0, "PENDING").when(F.col("n_empty") > 0, "NARROWED").otherwise("SATISFIED")
    return g.withColumn("state", state)


def reconcile(census: DataFrame, emissions: DataFrame, key: list[str]) -> DataFrame:
    """Census rows with their emissions: EMITTED, OMITTED, and FOREIGN for an
    emission outside the census."""
    c = census.select(*key, F.lit(True).alias("known")).distinct()
    e = emissions.select(*key).groupBy(*key).agg(F.count("*").alias("n_emitted"))
    j = c.join(e, key, "full")
    return j.select(*key, F.coalesce("n_emitted", F.lit(0)).alias("n_emitted"), F.when(F.col("known").isNull(), "FOREIGN").when(F.col("n_emitted").isNull(), "OMITTED").otherwise("EMITTED").alias("status"))


def prerequisites(modules: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, state, blocked): an id whose prerequisites are not all satisfied is
    held back as PENDING; holds spread along the needs until none is new."""
    needs = checkpointed(needs.select("id", "needed").distinct())
    frontier = modules.where("state not in ('SATISFIED', 'NOT_APPLICABLE')").select("id").distinct()
    held, rounds = frontier.limit(0), 0
    while True:
        more = needs.join(frontier.select(F.col("id").alias("needed")), "needed", "left_semi").select("id").distinct()
        frontier = checkpointed(more.join(held, "id", "left_anti"))
        if not frontier.limit(1).count():
            break
        held, rounds = held.union(frontier), rounds + 1
        if rounds % 8 == 0:  # keep plans short
            held = checkpointed(held)
    held = held.withColumn("held", F.lit(True))
    return modules.join(held, "id", "left").select("id", F.when(F.col("held"), "PENDING").otherwise(F.col("state")).alias("state"), F.coalesce("held", F.lit(False)).alias("blocked"))


def candidates(sites: DataFrame, beans: DataFrame) -> DataFrame:
    """Injection candidates by exposed type with their eligibility: autowire
    flag, and the qualifier if the site has one, else the default flag.  A row
    for every pair: for the sites asked for; ``bindings`` needs no pairs."""
    j = sites.join(beans, "type")
    fits = F.when(F.col("wanted").isNotNull(), F.col("qualifier") == F.col("wanted")).otherwise(F.col("by_default"))
    return j.withColumn("eligible", F.col("autowire") & fits)


def registered(beans: DataFrame) -> DataFrame:
    """(type, asked, ...): what the selection cascade needs to know about the
    beans of each type that answer a qualifier or, with ``asked`` null, the lack
    of one.  Two rows at most for a bean, folded before they are moved."""
    sure = F.coalesce(F.col("autowire"), F.lit(False))
    open_ = F.coalesce(F.col("autowire"), F.lit(True))
    named = beans.where(F.col("qualifier").isNotNull() & open_).select("*", F.col("qualifier").alias("asked"), F.when(sure, True).alias("eligible"))
    default = beans.where(open_ & F.coalesce(F.col("by_default"), F.lit(True))).select(
        "*", F.lit(None).cast("string").alias("asked"), F.when(sure & F.coalesce(F.col("by_default"), F.lit(False)), True).alias("eligible"))
    both = named.unionByName(default)
    e = F.coalesce(F.col("eligible"), F.lit(False))

    def most(where) -> F.Column:
        return F.max(F.when(where, F.col("bean")))

    g = both.groupBy("type", "asked").agg(
        F.count_if(F.col("eligible").isNull()).alias("n_open"), F.count_if(e).alias("n"), most(e).alias("any_bean"),
        F.count_if(e & F.col("primary")).alias("n_primary"), most(e & F.col("primary")).alias("primary_bean"),
        F.count_if(e & ~F.col("fallback")).alias("n_regular"), most(e & ~F.col("fallback")).alias("regular_bean"))
    by_priority = both.where(e & F.col("priority").isNotNull()).groupBy("type", "asked", "priority").agg(F.count("*").alias("m"), F.max("bean").alias("b"))
    least = by_priority.groupBy("type", "asked").agg(F.min(F.struct("priority", "m", "b")).alias("x")).select("type", "asked", F.col("x.m").alias("n_least"), F.col("x.b").alias("least_bean"))
    same = g["type"].eqNullSafe(least["type"]) & g["asked"].eqNullSafe(least["asked"])
    return g.join(least, same, "left").select(g["*"], "n_least", "least_bean")


def bindings(sites: DataFrame, beans: DataFrame) -> DataFrame:
    """(site, n, state, bean): ``select_bindings`` without the pairs.

    Sites are joined with the folded registry by (type, qualifier) and, for the
    dependency name, with the beans folded by name; rows stay linear in sites
    and beans.  Beans without a known qualifier are open for every qualifier of
    their type."""
    reg = registered(beans)
    unknown = beans.where(F.col("qualifier").isNull() & F.coalesce(F.col("autowire"), F.lit(True))).groupBy("type").agg(F.count("*").alias("n_unqualified"))
    e = F.coalesce(F.col("autowire"), F.lit(False))
    named = beans.where(e & F.col("qualifier").isNotNull()).select("type", F.col("qualifier").alias("asked"), F.col("bean_name").alias("site_name"), "bean").unionByName(
        beans.where(e & F.col("by_default")).select("type", F.lit(None).cast("string").alias("asked"), F.col("bean_name").alias("site_name"), "bean"))
    named = named.groupBy("type", "asked", "site_name").agg(F.max("bean").alias("named_bean"))
    s = sites.select("site", "type", F.col("wanted").alias("asked"), "optional", "site_name").alias("s")
    r, m = reg.withColumn("known", F.lit(True)).alias("r"), named.alias("m")
    j = s.join(r, (F.col("s.type") == F.col("r.type")) & F.col("s.asked").eqNullSafe(F.col("r.asked")), "left")
    j = j.join(m, (F.col("s.type") == F.col("m.type")) & F.col("s.asked").eqNullSafe(F.col("m.asked")) & (F.col("s.site_name") == F.col("m.site_name")), "left")
    j = j.join(unknown.alias("u"), F.col("s.type") == F.col("u.type"), "left")
    open_ = F.coalesce(F.col("n_open"), F.lit(0)) + F.when(F.col("s.asked").isNotNull(), F.coalesce(F.col("n_unqualified"), F.lit(0))).otherwise(0)
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "n_primary", "n_regular", "n_least")}
    return cascade(j.select("s.site", open_.alias("n_unknown"), "optional", *zero.values(), "any_bean", "primary_bean", "regular_bean", "least_bean", "named_bean"))


def inventory(sites: DataFrame, beans: DataFrame) -> DataFrame:
    """(type, n_sites, n_beans, n_pairs) of the types that have both: sites,
    beans eligible for any of them, and eligible pairs, which are counted as
    products and never made."""
    asked = sites.groupBy("type", F.col("wanted").alias("asked")).agg(F.count_distinct("site").alias("k"))
    reg = registered(beans).select(F.col("type").alias("t"), F.col("asked").alias("a"), "n")
    pairs = asked.join(reg, (F.col("type") == F.col("t")) & F.col("asked").eqNullSafe(F.col("a"))).groupBy("type").agg(F.sum(F.col("k") * F.col("n")).alias("n_pairs"))
    sure = beans.where(F.coalesce(F.col("autowire"), F.lit(False)))
    keys = sure.where("qualifier is not null").select("type", "bean", F.col("qualifier").alias("asked")).unionByName(sure.where("by_default").select("type", "bean", F.lit(None).cast("string").alias("asked")))
    want = asked.select(F.col("type").alias("t"), F.col("asked").alias("a"))
    hit = keys.join(want, (F.col("type") == F.col("t")) & F.col("asked").eqNullSafe(F.col("a")), "left_semi").groupBy("type").agg(F.count_distinct("bean").alias("n_beans"))
    both = asked.groupBy("type").agg(F.sum("k").alias("n_sites")).join(beans.select("type").distinct(), "type", "left_semi")
    return both.join(hit, "type", "left").join(pairs, "type", "left").na.fill(0, ["n_beans", "n_pairs"])


def select_bindings(eligible: DataFrame) -> DataFrame:
    """Selection cascade of each site: unique, single primary (several are
    AMBIGUOUS), single non-fallback, dependency name, lowest priority number
    (ties are AMBIGUOUS), else AMBIGUOUS; none is ABSENT_OPTIONAL or UNSATISFIED.
    An unknown candidate makes the site UNKNOWN."""
    e = F.coalesce(F.col("eligible"), F.lit(False))
    g = eligible.groupBy("site").agg(
        F.count_if(F.col("eligible").isNull()).alias("n_unknown"), F.count_if(e).alias("n"), F.max(F.when(e, F.col("bean"))).alias("any_bean"),
        F.count_if(e & F.col("primary")).alias("n_primary"), F.max(F.when(e & F.col("primary"), F.col("bean"))).alias("primary_bean"),
        F.count_if(e & ~F.col("fallback")).alias("n_regular"), F.max(F.when(e & ~F.col("fallback"), F.col("bean"))).alias("regular_bean"),
        F.max(F.when(e & (F.col("bean_name") == F.col("site_name")), F.col("bean"))).alias("named_bean"),
        F.min(F.when(e, F.col("priority"))).alias("least"), F.max("optional").alias("optional"))
    lead = eligible.where("eligible").join(g.select("site", "least"), "site").where("priority = least").groupBy("site").agg(F.count("*").alias("n_least"), F.max("bean").alias("least_bean"))
    return cascade(g.join(lead, "site", "left"))


def cascade(j: DataFrame) -> DataFrame:
    """The state and bean of each site by its counts and extremes."""
    state = (
        F.when(F.col("n_unknown") > 0, "UNKNOWN").when((F.col("n") == 0) & F.col("optional"), "ABSENT_OPTIONAL").when(F.col("n") == 0, "UNSATISFIED")
        .when(F.col("n") == 1, "SELECTED").when(F.col("n_primary") > 1, "AMBIGUOUS").when(F.col("n_primary") == 1, "SELECTED").when(F.col("n_regular") == 1, "SELECTED")
        .when(F.col("named_bean").isNotNull(), "SELECTED").when(F.col("n_least") == 1, "SELECTED").otherwise("AMBIGUOUS"))
    bean = (
        F.when(F.col("n") == 1, F.col("any_bean")).when(F.col("n_primary") == 1, F.col("primary_bean")).when(F.col("n_regular") == 1, F.col("regular_bean"))
        .when(F.col("named_bean").isNotNull(), F.col("named_bean")).when(F.col("n_least") == 1, F.col("least_bean")))
    return j.select("site", "n", state.alias("state"), F.when(state == "SELECTED", bean).alias("bean"))


def _first(steps: DataFrame, group: str, order: str, step: str, where: Column) -> DataFrame:
    """Steps with the place of the first step of their group that meets ``where``.

    An aggregate (combined before the shuffle) joined back, not a window: a
    group with a third of all steps is split by the skew join, never sorted
    in one task."""
    first = steps.where(where).groupBy(group).agg(F.min(F.struct(order, step)).alias("first"))
    return steps.join(first, group, "left")


def registration(steps: DataFrame, group: str, order: str, step: str, verdict: str) -> DataFrame:
    """Ordered registration fold: a false condition skips its step, the first
    unknown one raises a barrier behind which every step is UNKNOWN.

    Only the place of the first unknown step matters, so nothing is folded."""
    rows = _first(steps, group, order, step, F.col(verdict).isNull())
    barrier = F.coalesce(F.struct(order, step) >= F.col("first"), F.lit(False))
    state = F.when(barrier, "UNKNOWN").when(F.col(verdict), "ACCEPTED").otherwise("SKIPPED")
    return rows.select(group, order, step, state.alias("state"))


def bean_conditions(selectors: DataFrame) -> DataFrame:
    """PRESENT, MISSING and SINGLE_CANDIDATE of each selector over a closed
    registry: (condition, definite, possible, primary) per matching bean."""
    g = selectors.groupBy("condition").agg(F.count_if("definite").alias("sure"), F.count_if("possible").alias("maybe"), F.count_if(F.col("definite") & F.col("primary")).alias("primaries"), F.count_if(F.col("possible") & F.col("primary")).alias("maybe_primary"))
    present = F.when(F.col("sure") > 0, True).when(F.col("maybe") == 0, False)
    single = (
        F.when(F.col("maybe") == 0, False).when((F.col("sure") == 1) & (F.col("maybe") == 1), True).when(F.col("primaries") > 1, False)
        .when((F.col("primaries") == 1) & (F.col("maybe_primary") == 1), True).when(F.col("maybe_primary") > 0, F.lit(None).cast("boolean")).when(F.col("sure") > 1, False))
    return g.select("condition", present.alias("present"), (~present).alias("missing"), single.alias("single_candidate"))


def discovery(steps: DataFrame, group: str, order: str, step: str, verdict: str, error: str) -> DataFrame:
    """Discovery fold: DISCOVERED, SKIPPED, UNKNOWN; an error ends the group, and
    what is behind it is NOT_REACHED."""
    rows = _first(steps, group, order, step, F.col(error))
    stopped = F.coalesce(F.struct(order, step) > F.col("first"), F.lit(False))
    state = F.when(stopped, "NOT_REACHED").when(F.col(error), "ERROR").when(F.col(verdict).isNull(), "UNKNOWN").when(F.col(verdict), "DISCOVERED").otherwise("SKIPPED")
    return rows.select(group, order, step, state.alias("state"))


def admissions(events: DataFrame, capacity: int, max_bypasses: int) -> DataFrame:
    """(queue, ticket, admitted_at, bypasses): admission under a capacity.

    ``events``: (queue, sequence, kind, ticket, size, priority) with kind submit
    or release.  After each event the waiting tickets are tried in order of
    priority and arrival; one that does not fit is bypassed, and once it was
    bypassed ``max_bypasses`` times nobody may pass it any more.  A queue is
    sequential by nature: its events are sorted within a partition and read as
    a stream, and only the waiting and active tickets are held."""
    import pandas as pd

    def run(frames):
        queue, waiting, active, free = None, [], {}, capacity
        for frame in frames:
            out = []
            for q, sequence, kind, ticket, size, priority in frame.itertuples(index=False):
                if q != queue:
                    queue, waiting, active, free = q, [], {}, capacity
                if kind == "release":
                    free += active.pop(ticket, 0)
                else:
                    waiting.append([-priority, sequence, ticket, size, 0])
                    waiting.sort(key=lambda x: x[:2])
                kept, blocked = [], False
                for entry in waiting:
                    if not blocked and entry[3] <= free:
                        free -= entry[3]
                        active[entry[2]] = entry[3]
                        out.append((q, entry[2], sequence, entry[4]))
                        for k in kept:
                            k[4] += 1
                    else:
                        blocked = blocked or entry[4] >= max_bypasses
                        kept.append(entry)
                waiting = kept
            yield pd.DataFrame(out, columns=["queue", "ticket", "admitted_at", "bypasses"])

    rows = events.select("queue", "sequence", "kind", "ticket", "size", "priority").repartition("queue").sortWithinPartitions("queue", "sequence")
    return rows.mapInPandas(run, "queue string, ticket string, admitted_at bigint, bypasses int")
