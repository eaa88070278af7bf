import json
import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.operators import snapshots as S


@given(st.sets(st.integers(0, 200_000), max_size=300), st.sets(st.integers(0, 200_000), max_size=300))
def test_bitmap_is_a_set(a, b):
    x, y = S.Bitmap(np.array(sorted(a), np.int64)), S.Bitmap(np.array(sorted(b), np.int64))
    assert set(x.and_not(y).ordinals().tolist()) == a - b
    assert set(x.and_(y).ordinals().tolist()) == a & b
    assert len(x) == len(a)


def test_dense_containers():
    a, b = np.arange(0, 60_000), np.arange(30_000, 70_000)
    x, y = S.Bitmap(a), S.Bitmap(b)
    assert x.and_not(y).ordinals().tolist() == list(range(30_000))
    assert y.and_not(x).ordinals().tolist() == list(range(60_000, 70_000))
    assert len(x.and_(y)) == 30_000


def test_canonical_json():
    same = ['{"a": 1, "b": [1, 2]}', '{"b":[1,2],"a":1.0}', '{ "\\u0061" : 10e-1 , "b":[1,2]}']
    assert len({S.canonical(x) for x in same}) == 1
    assert len({S.canonical(x) for x in ('{"a": null}', "{}", '{"a":[2,1]}', '{"a":[1,2]}', '{"a":"1"}', '{"a":1}', '{"a":true}', "nope", None, "", '{"a": 12345678901234567890.5}', '{"a": 12345678901234567890.25}')}) == 12
    assert S.canonical('{"x": 0.10}') == S.canonical('{"x": 1e-1}') and S.canonical('{"x": 0.0}') == S.canonical('{"x": -0}')


def brute(rows, listed):
    held = {}
    for s, p, k, v in rows:
        held.setdefault((s, p), {}).setdefault(k, set()).add(S.canonical(v))
    out = set()
    for s, p, name in listed:
        now, old = held.get((s, p), {}), held.get((s, p - 1), {})
        out |= {(name, k, "added") for k in now.keys() - old.keys()} | {(name, k, "removed") for k in old.keys() - now.keys()}
        out |= {(name, k, "changed") for k in now.keys() & old.keys() if now[k] != old[k]}
    return out


def test_against_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "CHUNK_ROWS", 50)
    r = random.Random(4)
    rows, listed = [], []
    for s in ("a", "b", None):
        for p in range(4):
            if p and s is not None:
                listed.append((s, p, f"{s}{p}"))
            for k in range(40):
                if r.random() < 0.7:
                    v = r.choice([None, "", "bad{", json.dumps({"x": r.randrange(2), "y": None}), json.dumps({"y": None, "x": 1})])
                    rows += [(s, p, None if k == 3 else f"k{k}", v)] * r.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "series string, position int, k string, v string")
    names = spark.createDataFrame(listed, "series string, position int, snapshot string")
    prints = S.fingerprint_rows(df, "v")

    def deltas(frame, which):
        return [tuple(x) for x in frame.join(names, ["series", "position"]).where(which).select("snapshot", "k", "delta").collect()]

    whole = S.OrdinalIndex(spark, str(tmp_path / "whole"))
    got = deltas(whole.advance(prints, len(rows)), "true")
    assert len(got) == len(set(got)) and set(got) == brute(rows, listed)
    # one snapshot after the other: each call reads new rows and the dictionary
    steps = S.OrdinalIndex(spark, str(tmp_path / "steps"))
    kept, got = {}, []
    for p in range(4):
        got += deltas(steps.advance(prints.where(f"position = {p}"), len(rows) * 2**p), f"position = {p}")
        now = {(x["series"], x["k"]): x["ordinal"] for x in steps.dictionary().collect()}
        assert kept.items() <= now.items()
        kept = now
        (chunks,) = {x["chunks"] for x in steps.dictionary().select("chunks").collect()}
        places = [tuple(x) for x in steps.dictionary().select(S._place(chunks), "ordinal").collect()]
        assert len(places) == len(set(places)) == len(kept) and chunks >= 8 * 2**p
    assert len(got) == len(set(got)) and set(got) == brute(rows, listed)
    assert kept.keys() == {(s, None if k == "k3" else k) for s, _, k, _ in rows}
    # delivered once more, nothing is new
    assert deltas(steps.advance(prints, len(rows)), "position > 3") == []
    # without the ordinals of earlier calls additions only are found
    alone = S.OrdinalIndex(spark, str(tmp_path / "alone"))
    assert {x[2] for x in deltas(alone.advance(prints.where("position = 3"), len(rows)), "position = 3")} == {"added"}


def test_a_failed_call_leaves_the_dictionary(spark, tmp_path):
    index = S.OrdinalIndex(spark, str(tmp_path / "x"))
    row = "series string, position int, k string, fa bigint, fb bigint"
    index.advance(spark.createDataFrame([("a", 0, "x", 1, 1), ("a", 0, "y", 1, 1)], row), 2)
    spark.range(1).write.parquet(str(tmp_path / "x/version=1/tab=key"))
    (tmp_path / "x/version=1/tab=key/_SUCCESS").unlink()
    got = index.advance(spark.createDataFrame([("a", 1, "y", 2, 1), ("a", 1, "z", 1, 1)], row), 2)
    assert {tuple(x) for x in got.where("position = 1").select("k", "delta").collect()} == {("x", "removed"), ("y", "changed"), ("z", "added")}
    assert index.versions() == [0, 1]


def test_a_key_with_many_values_brings_few_rows(spark):
    rows = spark.range(50_000).select(F.lit("a").alias("series"), F.lit(0).alias("position"), F.lit("hot").alias("k"), F.xxhash64("id").alias("fa"), F.xxhash64("id", F.lit(1)).alias("fb"))
    assert S._pieces(rows.union(rows), 8).count() <= 64


def test_empty(spark, tmp_path):
    inv = spark.createDataFrame([], "revision string, k string, v binary, stamp string, kind string, status string, v1key string")
    seals = spark.createDataFrame([], "revision string, repository string, selection string, digest string, sealed_at timestamp")
    assert S.inventory_deltas(inv, seals, S.OrdinalIndex(spark, str(tmp_path / "i"))).count() == 0
    one = spark.createDataFrame([("c/s/left", "a", "{}"), ("c/s/other", "a", "{}"), (None, "a", None)], "space string, k string, payload string")
    assert S.comparison_deltas(one, S.OrdinalIndex(spark, str(tmp_path / "c"))).count() == 0
