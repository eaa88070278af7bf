"""Problem 4: processing only new or changed records, exactly once.

What has been processed is kept as disjoint intervals of journal numbers.  A
run subtracts them from the ranges available to it; the gaps that remain, late
commits into old ranges included, are what it processes, and the merged
intervals are committed together with its output.  A run that fails commits
neither, so the next one finds the same gaps.

``replay`` evaluates that for a whole history of runs: the number line is cut
into blocks of fixed width (a block holds at most so many distinct numbers),
and every block goes through the runs in order.  Each run sees everything that
was loaded before it started, not only what is new: that the records of
earlier runs are not taken again is the work of the subtraction alone.  A
version of a record goes by the number of its first delivery; the numbers of
its further deliveries are covered like all others.  Of the records in a run's
gaps the highest revision of each job is processed; the check that follows
drops versions overtaken by one processed before.  ``Ledger`` is the same for
one run at a time, over a folder.

Defined results: records without id, revision or load time are never
processed; a record without journal number is processed by the first run that
sees it; the earliest of several deliveries of a number counts; a version
whose number was used up by another version is taken by the first run that
sees it; runs without a start are ignored; runs that start together are taken
in order of their id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small

#: Journal numbers of one block of the number line, in steps.
BLOCK = 100_000
#: Successful runs that a replay takes; their start times come to the driver.
MAX_RUNS = 1_000_000


# -- intervals -------------------------------------------------------------------
def collapse(numbers: np.ndarray, step: int = 1) -> np.ndarray:
    """Sorted distinct numbers as disjoint [low, high] rows; only neighbours
    exactly one step apart share an interval, so nothing is covered that is
    not there (a late commit may still fall between)."""
    n = np.unique(numbers)
    if not len(n):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero((np.diff(n) != step) | (n[:-1] % step != 0))
    return np.stack([n[np.concatenate([[0], cut + 1])], n[np.concatenate([cut, [len(n) - 1]])]], 1)


def merge(a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
    """Union of two sets of disjoint intervals."""
    both = np.concatenate([a, b])
    if not len(both):
        return both
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    new = np.concatenate([[True], (both[1:, 0] > reach[:-1] + step) | ((both[1:, 0] > reach[:-1]) & ((both[1:, 0] - reach[:-1] != step) | (both[1:, 0] % step != 0)))])
    starts = np.flatnonzero(new)
    return np.stack([both[starts, 0], reach[np.concatenate([starts[1:] - 1, [len(both) - 1]])]], 1)


def subtract(a: np.ndarray, b: np.ndarray, step: int = 1) -> np.ndarray:
    """Parts of the disjoint intervals ``a`` outside the intervals ``b``."""
    if not len(a) or not len(b):
        return a
    ends_a, ends_b = a[:, 1] + step, b[:, 1] + step
    edges = np.unique(np.concatenate([a[:, 0], ends_a, b[:, 0], ends_b]))
    inside = np.searchsorted(a[:, 0], edges, side="right") > np.searchsorted(ends_a, edges, side="right")
    taken = np.searchsorted(b[:, 0], edges, side="right") > np.searchsorted(ends_b, edges, side="right")
    keep = inside & ~taken
    # pieces that touch are one interval, unless ``a`` itself is cut there
    cut = np.isin(edges, a[:, 0])
    first = keep & (~np.concatenate([[False], keep[:-1]]) | cut)
    last = keep & (~np.concatenate([keep[1:], [False]]) | np.concatenate([cut[1:], [False]]))
    ends = np.concatenate([edges[1:], edges[-1:]])
    return np.stack([edges[first], ends[last] - step], 1)


def covered(numbers: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    if not len(intervals):
        return np.zeros(len(numbers), bool)
    k = np.searchsorted(intervals[:, 0], numbers, side="right") - 1
    return (k >= 0) & (numbers <= intervals[np.maximum(k, 0), 1])


# -- replay ----------------------------------------------------------------------
def complete_runs(runs: DataFrame) -> list[tuple[int, object]]:
    rows = runs.where((F.upper("state") == "COMPLETE") & F.col("started_at").isNotNull()).select("run_id", "started_at").distinct().orderBy("started_at", "run_id").limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs")
    return [(r[0], r[1]) for r in rows]


def first_seen(jobs: DataFrame, runs: list[tuple[int, object]]) -> DataFrame:
    """(id, revision, sequence, run_no): the first run that sees each row."""
    starts = pa.array([s for _, s in runs], pa.timestamp("us"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = starts.cast(pa.int64()).to_numpy()
        for batch in batches:
            loaded = batch.column("loaded_at").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
            no = np.searchsorted(bounds, loaded, side="left")
            t = pa.table([batch.column("id"), batch.column("revision"), batch.column("sequence"), pa.array(no.astype(np.int32))], names=["id", "revision", "sequence", "run_no"])
            t = t.filter(pa.array(no < len(bounds)))
            yield from t.group_by(t.column_names).aggregate([]).combine_chunks().to_batches()

    seen = jobs.select("id", "revision", "sequence", F.col("loaded_at").cast("timestamp").alias("loaded_at")).where(
        "id is not null and revision is not null and loaded_at is not null")
    return seen.mapInArrow(run, "id string, revision bigint, sequence bigint, run_no int")


def _grid(sequence: np.ndarray, step: int) -> list[tuple[np.ndarray, int]]:
    """Places of the numbers on the grid with its step, and of those off it,
    which have intervals of step 1 of their own."""
    off = sequence % step != 0
    return [(np.flatnonzero(~off), step), (np.flatnonzero(off), 1)]


def _within(numbers: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    """Places of the sorted ``numbers`` that lie in the intervals."""
    low, high = np.searchsorted(numbers, intervals[:, 0]), np.searchsorted(numbers, intervals[:, 1], side="right")
    n = high - low
    ends = np.cumsum(n)
    return np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


REPLAYED = "id string, revision bigint, run_no int, low bigint, high bigint"


def _block(step: int):
    def run(t: pa.Table) -> pa.Table:
        """One block of the number line, run by run: what is available minus
        what is processed are the gaps; the gaps select the versions.

        Rows with an id are versions, the others the block's numbers with the
        first run that sees each."""
        version = t.column("id").is_valid().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, bool)
        sequence, no = t.column("sequence").to_numpy(), t.column("run_no").to_numpy()
        at, by, gaps_of = [], [], []
        for places, width in _grid(sequence, step):
            own = places[~version[places]]
            records = places[version[places]]
            records = records[np.argsort(sequence[records], kind="stable")]
            available = processed = np.zeros((0, 2), np.int64)
            for r in np.unique(no[own]).tolist():
                available = merge(available, collapse(sequence[own[no[own] == r]], width), width)
                gaps = subtract(available, processed, width)
                processed = merge(processed, gaps, width)
                found = records[_within(sequence[records], gaps)]
                found = found[no[found] <= r]
                at.append(found)
                by.append(np.full(len(found), r, np.int32))
                gaps_of.append((np.full(len(gaps), r, np.int32), gaps))
            # versions whose number another version had used up before
            order = own[np.argsort(sequence[own], kind="stable")]
            k = np.minimum(np.searchsorted(sequence[order], sequence[records]), max(0, len(order) - 1))
            late = records[no[order[k]] < no[records]] if len(order) else records
            at.append(late)
            by.append(no[late])
        rows, run_no = np.concatenate(at), np.concatenate(by).astype(np.int32)
        runs = np.concatenate([r for r, _ in gaps_of]) if gaps_of else np.zeros(0, np.int32)
        gaps = np.concatenate([g for _, g in gaps_of]) if gaps_of else np.zeros((0, 2), np.int64)
        taken, n, m = t.take(pa.array(rows)), len(rows), len(runs)
        return pa.table([
            pa.chunked_array([*taken.column("id").chunks, pa.nulls(m, pa.string())], pa.string()),
            pa.chunked_array([*taken.column("revision").chunks, pa.nulls(m, pa.int64())], pa.int64()),
            pa.array(np.concatenate([run_no, runs])),
            pa.chunked_array([pa.nulls(n, pa.int64()), pa.array(gaps[:, 0])]), pa.chunked_array([pa.nulls(n, pa.int64()), pa.array(gaps[:, 1])]),
        ], names=["id", "revision", "run_no", "low", "high"])

    return run


def _islands(step: int):
    def run(t: pa.Table) -> pa.Table:
        """Committed intervals and newly processed numbers of a block, merged."""
        low, high = t.column("low").to_numpy(), t.column("high").to_numpy()
        parts = []
        for places, width in _grid(low, step):
            alone = low[places] == high[places]
            old = np.stack([low[places][~alone], high[places][~alone]], 1)
            parts.append(merge(old[np.argsort(old[:, 0])], collapse(low[places][alone], width), width))
        out = np.concatenate(parts)
        return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["low", "high"])

    return run


def numbers_of(seen: DataFrame) -> DataFrame:
    """Each journal number with the first run that sees it."""
    return seen.where("sequence is not null").groupBy("sequence").agg(F.min("run_no").alias("run_no"))


def versions_of(seen: DataFrame) -> DataFrame:
    """Each version with the first run that sees it and the number it came
    under then; a number goes before none."""
    first = F.min(F.struct("run_no", F.col("sequence").isNull().alias("loose"), "sequence"))
    return seen.groupBy("id", "revision").agg(first.alias("f")).select("id", "revision", "f.sequence", "f.run_no")


def _replayed(seen: DataFrame, versions: DataFrame | None, step: int) -> DataFrame:
    rows = numbers_of(seen).select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("revision"), "sequence", "run_no")
    if versions is not None:
        rows = rows.unionByName(versions.where("sequence is not null"))
    block = F.floor(F.col("sequence") / F.lit(BLOCK * step))
    return rows.withColumn("block", block).groupBy("block").applyInArrow(_block(step), REPLAYED)


def _named(rows: DataFrame, done: list[tuple[int, object]]) -> DataFrame:
    """Run numbers back to run ids."""
    names = rows.sparkSession.createDataFrame([(k, r) for k, (r, _) in enumerate(done)], "run_no int, run_id bigint")
    return rows.join(small(names, len(done)), "run_no").drop("run_no")


def replay(jobs: DataFrame, runs: DataFrame, step: int = 1) -> DataFrame:
    """(run_id, id, revision): what each successful run had to process."""
    done = complete_runs(runs)
    if not done:
        return jobs.sparkSession.createDataFrame([], "run_id bigint, id string, revision bigint")
    seen = first_seen(jobs, done)
    versions = versions_of(seen)
    taken = _replayed(seen, versions, step).where("id is not null").select("id", "revision", "run_no")
    loose = versions.where("sequence is null").select("id", "revision", "run_no")
    # at most one row per job and run is left before jobs are brought together
    best = taken.unionByName(loose).groupBy("id", "run_no").agg(F.max("revision").alias("revision"))
    before = Window.partitionBy("id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    overtaken = F.col("revision") < F.max("revision").over(before)
    fresh = best.withColumn("overtaken", F.coalesce(overtaken, F.lit(False))).where("not overtaken").drop("overtaken")
    return _named(fresh, done).select("run_id", "id", "revision")


def processed_intervals(jobs: DataFrame, runs: DataFrame, step: int = 1) -> DataFrame:
    """(run_id, low, high): the gaps each successful run closed."""
    done = complete_runs(runs)
    if not done:
        return jobs.sparkSession.createDataFrame([], "run_id bigint, low bigint, high bigint")
    gaps = _replayed(first_seen(jobs, done), None, step).where("low is not null").select("run_no", "low", "high")
    return _named(gaps, done).select("run_id", "low", "high")


# -- one run at a time -----------------------------------------------------------
class Ledger:
    """Processed intervals of a folder, committed with each run's output.

    A run first writes the rows of its gaps to ``taken/run=N``: output and
    intervals both come from there, so a record that arrives meanwhile is in
    both or in neither.  ``out/run=N`` is the output, ``intervals/run=N`` the
    merged intervals of all runs so far, ``loose/run=N`` digests of rows without
    a journal number.  The run counts only when ``commits/N`` appears, which is
    created by one atomic rename.  Whatever a failed run left is ignored and
    overwritten; the intervals before the last commit are removed."""

    def __init__(self, spark: SparkSession, folder: str, step: int = 1):
        self.spark, self.folder, self.step = spark, folder, step
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Committed runs in the order of their commits."""
        p = self.path(f"{self.folder}/commits")
        if not self.fs.exists(p):
            return []
        found = [f.getPath().getName().split("-") for f in self.fs.listStatus(p)]
        return [int(n) for _, n in sorted((int(k), n) for k, n in (x for x in found if len(x) == 2 and x[0].isdigit()))]

    def _read(self, kind: str, runs: list[int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/{kind}/run={n}" for n in runs]) if runs else None

    def intervals(self) -> DataFrame | None:
        """The merged intervals of all committed runs (low, high)."""
        return self._read("intervals", self.committed()[-1:])

    def pending(self, journal: DataFrame) -> DataFrame:
        """Rows of ``journal`` in the gaps of the committed intervals, and rows
        without a number that no committed run has taken.

        The join is on blocks of the number line, so it is an equi-join."""
        width = BLOCK * self.step
        rows = journal.where("sequence is not null").withColumn("block", F.floor(F.col("sequence") / F.lit(width)))
        loose = journal.where("sequence is null").withColumn("_digest", _digest(journal))
        done, had = self.intervals(), self._read("loose", self.committed())
        if done is None:
            return rows.drop("block").unionByName(loose.drop("_digest"))
        blocks = done.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
        # an interval of more than one number holds those on the grid only
        on_grid = (F.col("j.sequence") - F.col("d.low")) % self.step == 0
        off_grid = (F.col("d.low") % self.step != 0)
        hit = (F.col("j.block") == F.col("d.block")) & F.col("j.sequence").between(F.col("d.low"), F.col("d.high")) & (
            on_grid | (off_grid & (F.col("j.sequence") % self.step != 0)))
        gaps = rows.alias("j").join(blocks.alias("d"), hit, "left_anti").drop("block")
        return gaps.unionByName(loose.join(had, "_digest", "left_anti").drop("_digest"))

    def output(self) -> DataFrame | None:
        return self._read("out", self.committed())

    def run(self, run_no: int, journal: DataFrame, process=lambda df: df) -> None:
        """Process the gaps of one run and commit intervals with the output."""
        before = self.committed()
        if run_no in before:
            return
        where = f"{self.folder}/taken/run={run_no}"
        self.pending(journal).write.mode("overwrite").parquet(where)
        taken = self.spark.read.schema(journal.schema).parquet(where)
        process(taken).write.mode("overwrite").parquet(f"{self.folder}/out/run={run_no}")
        new = taken.where("sequence is not null").select(F.col("sequence").alias("low"), F.col("sequence").alias("high")).distinct()
        done = self.intervals()
        state = (new if done is None else new.unionByName(done)).withColumn("block", F.floor(F.col("low") / F.lit(BLOCK * self.step)))
        state.groupBy("block").applyInArrow(_islands(self.step), "low bigint, high bigint").write.mode("overwrite").parquet(f"{self.folder}/intervals/run={run_no}")
        taken.where("sequence is null").select(_digest(taken).alias("_digest")).distinct().write.mode("overwrite").parquet(f"{self.folder}/loose/run={run_no}")
        self.fs.mkdirs(self.path(f"{self.folder}/commits"))
        tmp, final = self.path(f"{self.folder}/commits/_{run_no}"), self.path(f"{self.folder}/commits/{len(before)}-{run_no}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps({"run": run_no}).encode()))
        out.close()
        if not self.fs.rename(tmp, final):
            raise RuntimeError(f"run {run_no} could not be committed")
        for n in before[-1:]:
            self.fs.delete(self.path(f"{self.folder}/intervals/run={n}"), True)
        self.fs.delete(self.path(where), True)


def _digest(rows: DataFrame):
    """Digest of a whole row."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
