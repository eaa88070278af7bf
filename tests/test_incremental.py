import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from orrery.operators import incremental as I

NUMBERS = st.sets(st.integers(0, 60), max_size=40)


def spread(x, step=1):
    return {n for a, b in x.tolist() for n in range(a, b + 1, step)}


@given(NUMBERS, NUMBERS)
def test_interval_algebra(a, b):
    x, y = (I.collapse(np.array(sorted(s), np.int64)) for s in (a, b))
    assert spread(x) == a and spread(I.merge(x, y)) == a | b and spread(I.subtract(x, y)) == a - b
    m = I.merge(x, y)
    assert all(m[k + 1, 0] > m[k, 1] + 1 for k in range(len(m) - 1))
    n = np.array(sorted(a | b), np.int64)
    assert set(n[I.covered(n, y)].tolist()) == b


def test_steps_and_numbers_off_the_grid():
    x = I.collapse(np.array([100, 200, 250, 300, 500]), 100)
    assert x.tolist() == [[100, 200], [250, 250], [300, 300], [500, 500]]
    assert I.collapse(np.zeros(0, np.int64)).shape == (0, 2)


T0 = dt.datetime(2031, 3, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def brute(jobs, runs):
    done = sorted([(s, i) for i, s, state in runs if state.upper() == "COMPLETE" and s is not None])
    out, had = set(), {}
    for s, i in done:
        now = {}
        for j, rev, _, loaded in jobs:
            if None not in (j, rev, loaded) and at(loaded) <= at(s):
                now[j] = max(now.get(j, rev), rev)
        out |= {(i, j, rev) for j, rev in now.items() if j not in had or rev > had[j]}
        had = now
    return out


@pytest.mark.parametrize("seed", range(2))
def test_replay(spark, seed, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 7)
    r = random.Random(seed)
    jobs = [(f"j{r.randrange(6)}" if r.random() > 0.05 else None, r.randrange(1, 6), r.choice([None, 100 * r.randrange(40), 100 * r.randrange(40), 155]), r.choice([None, *range(20)])) for _ in range(120)]
    jobs += jobs[:10]
    runs = [(k, r.randrange(20), r.choice(["COMPLETE", "FAILED", "complete", "RUNNING"])) for k in range(12)] + [(99, None, "COMPLETE")]
    j = spark.createDataFrame([(a, b, c, at(d), "x") for a, b, c, d in jobs], "id string, revision bigint, sequence bigint, loaded_at timestamp, state string")
    u = spark.createDataFrame([(a, at(b), c) for a, b, c in runs], "run_id bigint, started_at timestamp, state string")
    got = [tuple(x) for x in I.replay(j, u, 100).collect()]
    # runs that start together: the earlier one takes all
    assert len(got) == len(set(got))
    assert set(got) == brute(jobs, runs)


def test_numbers_off_the_grid_are_processed(spark):
    late_between = [("a", 1, 100, 1), ("b", 1, 200, 1), ("c", 1, 150, 3)]
    around = [("a", 1, 150, 1), ("b", 1, 100, 3), ("c", 1, 200, 3)]
    runs = [(1, 2, "COMPLETE"), (2, 4, "COMPLETE")]
    u = spark.createDataFrame([(a, at(b), c) for a, b, c in runs], "run_id bigint, started_at timestamp, state string")
    for jobs in (late_between, around):
        j = spark.createDataFrame([(a, b, c, at(d)) for a, b, c, d in jobs], "id string, revision bigint, sequence bigint, loaded_at timestamp")
        got = [tuple(x) for x in I.replay(j, u, 100).collect()]
        assert len(got) == len(set(got)) == 3 and set(got) == brute(jobs, runs)


@given(st.dictionaries(st.integers(-8, 12).map(lambda n: 5 * n), st.integers(0, 2), min_size=1))
def test_blocks_lose_no_number(runs):
    n = len(runs)
    t = pa.table([pa.array([f"j{k}" for k in runs] + [None] * n), pa.array([1] * n + [None] * n, pa.int64()), pa.array(2 * list(runs), pa.int64()), pa.array(2 * list(runs.values()), pa.int32())], names=["id", "revision", "sequence", "run_no"])
    for step in (1, 10):
        rows = I._block(step)(t).to_pylist()
        assert sorted((r["id"], r["run_no"]) for r in rows if r["id"]) == sorted((f"j{k}", r) for k, r in runs.items())
        width = {True: step, False: 1}
        assert {(k, r["run_no"]) for r in rows if r["id"] is None for k in range(r["low"], r["high"] + 1, width[r["low"] % step == 0])} == set(runs.items())


def test_the_subtraction_decides(spark, monkeypatch):
    """Without it every run takes all again that it can see."""
    jobs = [("a", 1, 100, 1), ("b", 1, 200, 1), ("a", 2, 300, 3), ("b", 1, 200, 3), ("c", 1, 150, 3), ("b", 1, 500, 5)]
    j = spark.createDataFrame([(a, b, c, at(d)) for a, b, c, d in jobs], "id string, revision bigint, sequence bigint, loaded_at timestamp")
    u = spark.createDataFrame([(k, at(2 * k), "COMPLETE") for k in (1, 2, 3)], "run_id bigint, started_at timestamp, state string")

    def off(step):
        def run(t):
            from orrery.operators import incremental as W

            kept, W.subtract = W.subtract, lambda a, b, step=1: a
            try:
                return W._block(step)(t)
            finally:
                W.subtract = kept

        return run

    right = {tuple(x) for x in I.replay(j, u, 100).collect()}
    assert right == {(1, "a", 1), (1, "b", 1), (2, "a", 2), (2, "c", 1)}
    monkeypatch.setattr(I, "_block", off)
    assert {tuple(x) for x in I.replay(j, u, 100).collect()} == right | {(2, "b", 1), (3, "a", 2), (3, "b", 1)}


def test_replay_of_nothing(spark):
    j = spark.createDataFrame([], "id string, revision bigint, sequence bigint, loaded_at timestamp")
    u = spark.createDataFrame([], "run_id bigint, started_at timestamp, state string")
    assert I.replay(j, u).count() == 0 and I.processed_intervals(j, u).count() == 0


def test_ledger_survives_failures(spark, tmp_path):
    def journal(numbers):
        return spark.createDataFrame([(n, f"r{n}") for n in numbers], "sequence bigint, body string")

    ledger = I.Ledger(spark, str(tmp_path / "ledger"))
    ledger.run(1, journal([1, 2, 3, 7]))
    with pytest.raises(RuntimeError):
        ledger.run(2, journal([1, 2, 3, 4, 7]), lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    # output written, but never committed
    journal([4]).write.parquet(str(tmp_path / "ledger/out/run=3"))
    assert ledger.committed() == [1]
    ledger.run(4, journal([1, 2, 3, 4, 5, 7, 8]))
    ledger.run(4, journal([1, 2, 3, 4, 5, 7, 8, 9]))  # committed already
    ledger.run(5, journal([1, 2, 3, 4, 5, 6, 7, 8]))  # 6 is a late commit
    rows = sorted(r["sequence"] for r in ledger.output().collect())
    assert rows == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [tuple(r) for r in ledger.intervals().collect()] == [(1, 8)]


def test_ledger_takes_output_and_intervals_from_the_same_rows(spark, tmp_path):
    """A record that arrives while a run is at work is taken by the next."""
    source = str(tmp_path / "journal")

    def add(*rows):
        spark.createDataFrame(rows, "sequence bigint, body string").coalesce(1).write.mode("append").parquet(source)

    def late(df):
        add((3, "late"))
        return df

    add((1, "a"), (2, "b"), (None, "x"), (None, "x"), (150, "y"))
    ledger = I.Ledger(spark, str(tmp_path / "ledger"), 100)
    ledger.run(2, spark.read.parquet(source), late)
    ledger.run(1, spark.read.parquet(source))
    add((None, "z"), (200, "w"))
    ledger.run(7, spark.read.parquet(source))
    ledger.run(9, spark.read.parquet(source))
    assert ledger.committed() == [2, 1, 7, 9]
    rows = sorted((r["sequence"] or 0, r["body"]) for r in ledger.output().collect())
    assert rows == [(0, "x"), (0, "x"), (0, "z"), (1, "a"), (2, "b"), (3, "late"), (150, "y"), (200, "w")]
    assert sorted(tuple(r) for r in ledger.intervals().collect()) == [(1, 3), (150, 150), (200, 200)]
    assert not (tmp_path / "ledger/intervals/run=7").exists()
