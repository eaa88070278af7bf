import json
import random

import numpy as np
import pyarrow as pa
import pytest

from orrery.operators import nested_json as J
from orrery.operators.json_index import JsonIndex


def refuse(name):
    raise ValueError(name)


def decode(text):
    try:
        return json.loads(text, parse_constant=refuse) if text is not None else None
    except ValueError:
        return None


def spell(value):
    return value if value is None or isinstance(value, str) else json.dumps(value)


def as_list(value):
    return value if isinstance(value, list) else []


def brute(reports, suites):
    out = set()

    def call(i, c, parent):
        if not isinstance(c, dict):
            return
        me = spell(c.get("callId"))
        t = c.get("target")
        for x in t if isinstance(t, list) else [t]:
            if isinstance(x, dict) and me is not None:
                o = x.get("originEvidence")
                for name, v in (("owner", x.get("owner")), ("kind", o.get("kind") if isinstance(o, dict) else None)):
                    if v is not None:
                        out.add(("report", i, me, parent, name, spell(v)))
        for a in as_list(c.get("arguments")):
            call(i, a, me if me is not None else parent)

    for i, text in reports:
        b = decode(text)
        if isinstance(b, dict):
            for c in as_list(b.get("calls")):
                call(i, c, "")
            for f in as_list(b.get("files")):
                if isinstance(f, dict):
                    for c in as_list(f.get("calls")):
                        call(i, c, "")
    for i, text in suites:
        b = decode(text)
        if isinstance(b, dict) and isinstance(b.get("cases"), dict):
            for n, x in b["cases"].items():
                if isinstance(x, dict) and x.get("language") is not None:
                    out.add(("suite", i, n, "", "language", spell(x["language"])))
    return out


def nest(depth):
    c = {"callId": depth, "target": {"owner": f"o{depth}"}}
    for k in range(depth - 1, 0, -1):
        c = {"callId": k, "arguments": [c, 5, "x", None], "target": [{"owner": None, "originEvidence": {"kind": "K"}}, {"owner": f"o{k}"}, 3]}
    return c


REPORTS = [
    (1, json.dumps({"calls": [nest(6), {"callId": "s", "target": None}, {"target": {"owner": "nobody"}}, 4], "files": [{"calls": [nest(2)]}, {"file": "x"}, 7], "declarations": [{"owner": "no"}]})),
    (2, None), (3, "{broken"), (4, "[1]"), (5, '{"calls": {"callId": 1}}'), (6, '{"calls": [{"callId": 1, "target": {"owner": NaN}}]}'), (7, json.dumps({"calls": [nest(60)]})),
    (8, json.dumps({"calls": [{"callId": 1, "target": {"owner": 5, "originEvidence": []}, "arguments": {"callId": 2}}]})), (9, ""),
]
SUITES = [(1, json.dumps({"cases": {"a.b": {"language": "JAVA", "files": {"x": 1}}, 'q"': {"language": None}, "c": {}, "d": 4}, "replays": [{"language": "no"}]})), (2, None), (3, '{"cases": []}')]


def frames(spark):
    r = spark.createDataFrame([(i, "repo", t, 1) for i, t in REPORTS + REPORTS[:2]], "report_id bigint, repository string, stdout string, extra int")
    return r, spark.createDataFrame(SUITES, "suite_id bigint, body string")


def test_found(spark):
    got = [tuple(x) for x in J.found(*frames(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(REPORTS, SUITES)


def test_tables_keep_links(spark):
    r, s = frames(spark)
    calls = {(x["report_id"], x["call_id"]): x for x in J.calls(r).collect()}
    assert calls[7, "60"]["parent_call_id"] == "59" and calls[1, "6"]["file_no"] is None
    assert {x["file_no"] for x in J.files(r).collect()} == {0, 1, 2}
    assert J.reports(r).count() == 4
    assert {x["case_name"] for x in J.cases(s).collect()} == {"a.b", 'q"', "c", "d"}
    assert J.targets(r).where("owner is null and kind is null").count() >= 0


def test_empty(spark):
    r, s = frames(spark)
    assert J.found(r.limit(0), s.limit(0)).count() == 0


def made(r, depth=0):
    k = r.random()
    if depth > 4 or k < 0.5:
        return r.choice([None, True, False, 0, -1, 1.5, 12345678901234567890, "", "a", 'é"\\/\b\n\t ', "calls", "😀x", "\\\\"])
    if k < 0.75:
        return [made(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["calls", "a", 'b"', "arguments", "é", ""]): made(r, depth + 1) for _ in range(r.randrange(4))}


def damaged(r, s):
    for _ in range(r.choice([0, 0, 1, 2])):
        i, j, m = r.randrange(len(s) + 1), r.randrange(len(s) + 1), r.random()
        if m < 0.3:
            s = s[:i] + s[i + 1 :]
        elif m < 0.7:
            s = s[:i] + r.choice([*'{}[]:,"\\ \n\t0-1.eEtnfu/', "\x01", "é", "nul", "true", "\\u00e9", "NaN", '"a":1,']) + s[i:]
        else:
            s = s[: min(i, j)] + s[max(i, j) :]
    return s


def rebuilt(index, v):
    kind = chr(index.kind[v])
    if kind == "[":
        return [rebuilt(index, x) for x in index.elements(np.array([v]))[1].tolist()]
    if kind == "{":
        _, values, names = index.members(np.array([v]))
        return {n: rebuilt(index, x) for n, x in zip(names.to_pylist(), values.tolist(), strict=True)}
    s = index.text(np.array([v]))[0].as_py()
    return s if kind == '"' or s is None else json.loads(s)


ODD = [None, "", " ", "\ufeff{}", "1 2", "{}{}", "[1,]", '{"a":1,}', '"', '"\\', "\\", '["\\"]', '{"a" 1}', "{1:2}", "[1 2]", '["a" "b"]', "nullx", "tru", "-", "01", "1.", "[}", "{]", "][", '{"a":1,"a":{"b":2}}', '"\\ud83d\\ude00\\u00e9"']


@pytest.mark.parametrize("seed", range(6))
def test_index_against_a_parser(seed):
    r = random.Random(seed)
    texts = [damaged(r, json.dumps(made(r), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))) for _ in range(300)] + ODD
    r.shuffle(texts)
    index = JsonIndex(pa.array(texts, pa.string()).slice(2), ("calls", "arguments"))
    for k, t in enumerate(texts[2:]):
        try:
            want = [None if t is None else json.loads(t, parse_constant=refuse)] if t is not None else []
        except ValueError:
            want = []
        assert (index.root[k] >= 0) == bool(want), t
        if want and not any("\ud800" <= c < "\ue000" for c in json.dumps(want, ensure_ascii=False)):
            assert rebuilt(index, index.root[k]) == want[0]


def test_lone_surrogates_and_depth():
    index = JsonIndex(pa.array(['"\\ud800x"', "[" * 200_000 + "]" * 200_000, "[" * 200_000]), ())
    assert index.text(index.root[:1]).to_pylist() == ["\ufffdx"] and (index.root >= 0).tolist() == [True, True, False]


def test_deep_bodies_keep_their_rows(spark):
    n = 20_000
    body = '{"calls":' + "".join(f'[{{"callId":{k},"target":{{"owner":"o"}},"arguments":' for k in range(n)) + "null" + "}]" * n + "}"
    df = spark.createDataFrame([(1, "r", body)], "report_id bigint, repository string, stdout string")
    rows = {x["call_id"]: x["parent_call_id"] for x in J.calls(df).collect()}
    assert len(rows) == n and rows["0"] == "" and all(rows[str(k)] == str(k - 1) for k in range(1, n))


def test_tables_come_from_one_pass(spark):
    r, _ = frames(spark)
    t = J.tables(r)
    for name in ("reports", "files", "calls", "targets"):
        assert sorted(map(str, t[name].collect())) == sorted(map(str, getattr(J, name)(r).collect()))


def test_the_offsets_decide():
    """Rows follow the list offsets of the index: without them nothing is reached."""
    body = json.dumps({"calls": [{"callId": 1, "target": {"owner": "a"}}, {"callId": 2, "target": [{"owner": "b"}]}]})
    index = JsonIndex(pa.array([body]), J.NAMES)
    assert [x.ids.to_pylist() for x in J.report_levels(index, pa.array([7]))] == [["1", "2"]]
    index.lists = pa.ListArray.from_arrays(pa.array(np.zeros(len(index.at) + 1, np.int32)), pa.array([], pa.int64()))
    assert list(J.report_levels(index, pa.array([7]))) == []
