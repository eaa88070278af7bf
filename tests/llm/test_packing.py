import random

import pytest

from orrery.llm import packing as P


@pytest.mark.parametrize("seed", range(60))
def test_plan_keeps_every_piece(seed):
    r = random.Random(seed)
    cap = r.choice([1, 3, 10, 30, 100, 2048])
    h = {s: r.randrange(0, r.choice([3, 50, 1000])) for s in r.sample(range(1, cap + 1), r.randrange(1, min(cap, 300) + 1))}
    groups, got = P.plan(h, cap), {}
    for g in groups:
        assert g.times > 0 and sum(s * k for s, k in g.items) <= cap
        assert sum(k for s, k in g.items if 3 * s > cap) <= 2
        for s, k in g.items:
            got[s] = got.get(s, 0) + k * g.times
    assert got == {s: n for s, n in h.items() if n}
    used = sum(s * n for s, n in h.items())
    n = sum(g.times for g in groups)
    # never two containers that are both at most half full
    half = sum(g.times for g in groups if 2 * sum(s * k for s, k in g.items) <= cap)
    assert half <= 1 and n >= -(-used // cap)


def test_plan_size_does_not_follow_the_corpus():
    few = P.plan({s: 3 for s in range(1, 2049)}, 2048)
    many = P.plan({s: 3_000_000_007 + s for s in range(1, 2049)}, 2048)
    assert len(many) < 4 * 2048 and len(few) < 4 * 2048


def check(rows, got, cap):
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_container.setdefault(r["container_no"], []).append(r)
    assert all(sum(x["n_tokens"] for x in v) <= cap for v in by_container.values())
    assert set(by_container) == set(range(len(by_container)))
    want = {i: n for i, n in rows if n}
    assert {i: sum(x["n_tokens"] for x in v) for i, v in by_doc.items()} == want
    for i, v in by_doc.items():
        v.sort(key=lambda x: x["piece_no"])
        assert [x["piece_no"] for x in v] == list(range(-(-want[i] // cap)))
        assert all(x["n_tokens"] == cap for x in v[:-1])
    return len(by_container)


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_pack(spark, bucket_rows):
    r = random.Random(2)
    rows = [(k, r.choice([0, 1, 5, 40, 64, 100, 101, 199, 350, r.randrange(1, 100)])) for k in range(400)] + [(1000 + k, 33) for k in range(200)] + [(5000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = P.pack(df, 100, bucket_rows).collect()
    rows = rows[:-1]
    n = check(rows, got, 100)
    least = -(-sum(x for _, x in rows) // 100)
    assert least <= n <= 1.05 * least + 1
    assert len({(x["doc_id"], x["piece_no"]) for x in got}) == len(got)


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")
    assert P.pack(df).count() == 0
    row = P.fill_rate(P.pack(df)).first()
    assert row["n_containers"] == 0 and row["n_tokens"] == 0
