"""Reference SQL of the general data problems.

JSON equality is expressed by sorting members; the data's JSON objects are two
levels deep with one list, which the SQL spells out.
"""

from __future__ import annotations

_JSON = """concat_ws('|', json_extract({c}, '$.attr.flag')::varchar, json_extract({c}, '$.attr.level')::varchar,
 coalesce(json_extract_string({c}, '$.digest'), '~'), json_extract({c}, '$.size')::varchar, json_extract({c}, '$.tags')::varchar,
 coalesce(json_type({c}, '$.lines'), 'absent'), coalesce(json_extract_string({c}, '$.lines'), '~'),
 coalesce(json_type({c}, '$.note'), 'absent'), coalesce(json_extract_string({c}, '$.note'), '~'))"""

P3 = f"""
WITH s AS (SELECT repository, revision, row_number() OVER (PARTITION BY repository ORDER BY sealed_at, revision) AS p
           FROM (SELECT DISTINCT repository, revision, sealed_at FROM seals)),
i AS (SELECT DISTINCT s.repository AS series, s.p, k, {_JSON.format(c="decode(v)")} || '|' || kind || '|' || status AS x
      FROM inventory JOIN s USING (revision)),
pairs AS (SELECT repository AS series, p, revision AS snapshot FROM s WHERE p > 1),
c AS (SELECT DISTINCT regexp_replace(space, '/(left|right)$', '') AS series,
             CASE WHEN space LIKE '%/right' THEN 2 ELSE 1 END AS p, k, {_JSON.format(c="payload")} AS x FROM comparison_rows),
cp AS (SELECT series, 2 AS p, series || '/right' AS snapshot FROM c GROUP BY series HAVING count(DISTINCT p) = 2),
r AS (SELECT * FROM i UNION ALL SELECT * FROM c),
q AS (SELECT * FROM pairs UNION ALL SELECT * FROM cp),
now AS (SELECT q.series, q.snapshot, q.p, r.k, r.x FROM q JOIN r ON r.series = q.series AND r.p = q.p),
old AS (SELECT q.series, q.snapshot, q.p, r.k, r.x FROM q JOIN r ON r.series = q.series AND r.p = q.p - 1)
SELECT coalesce(now.snapshot, old.snapshot) AS snapshot, coalesce(now.k, old.k) AS k,
       CASE WHEN old.k IS NULL THEN 'added' WHEN now.k IS NULL THEN 'removed' ELSE 'changed' END AS delta
FROM now FULL JOIN old ON now.snapshot = old.snapshot AND now.k = old.k
WHERE now.k IS NULL OR old.k IS NULL OR now.x <> old.x"""

P4 = """
WITH r AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS n
           FROM (SELECT DISTINCT run_id, started_at FROM runs WHERE upper(state) = 'COMPLETE')),
m AS (SELECT r.n, r.run_id, j.id, max(j.revision) AS revision FROM r JOIN jobs j ON j.loaded_at <= r.started_at GROUP BY ALL)
SELECT a.run_id, a.id, a.revision FROM m a LEFT JOIN m b ON b.id = a.id AND b.n = a.n - 1
WHERE b.id IS NULL OR a.revision > b.revision"""

P4_INTERVALS = """
WITH r AS (SELECT run_id, started_at FROM runs WHERE upper(state) = 'COMPLETE'),
f AS (SELECT sequence, min(loaded_at) AS t FROM jobs WHERE id IS NOT NULL AND revision IS NOT NULL GROUP BY sequence),
v AS (SELECT f.sequence, r.run_id FROM f ASOF JOIN r ON f.t <= r.started_at),
g AS (SELECT run_id, sequence, sequence - 100 * row_number() OVER (PARTITION BY run_id, sequence // 10000000 ORDER BY sequence) AS island FROM v)
SELECT run_id, min(sequence) AS low, max(sequence) AS high FROM g GROUP BY run_id, sequence // 10000000, island"""

_CALLS = """
WITH RECURSIVE b AS (SELECT DISTINCT report_id, stdout::json AS j FROM binding_reports WHERE json_valid(stdout)),
top AS (SELECT report_id, unnest(json_extract(j, '$.calls[*]')) AS c FROM b
        UNION ALL SELECT report_id, unnest(json_extract(f, '$.calls[*]')) FROM (SELECT report_id, unnest(json_extract(j, '$.files[*]')) AS f FROM b)),
t AS (SELECT report_id, c, '' AS parent FROM top
      UNION ALL SELECT report_id, unnest(json_extract(c, '$.arguments[*]')), json_extract_string(c, '$.callId') FROM t),
g AS (SELECT report_id, json_extract_string(c, '$.callId') AS item, parent,
             unnest(CASE json_type(c, '$.target') WHEN 'ARRAY' THEN json_extract(c, '$.target[*]') ELSE [json_extract(c, '$.target')] END) AS x FROM t)
"""

_NUMBERED = """
WITH RECURSIVE b AS (SELECT DISTINCT report_id, stdout::json AS j FROM binding_reports WHERE json_valid(stdout)),
fs AS (SELECT report_id, unnest(json_extract(j, '$.files[*]')) AS f, unnest(range(len(json_extract(j, '$.files[*]')))) AS file_no FROM b),
top AS (SELECT report_id, unnest(json_extract(j, '$.calls[*]')) AS c, NULL::bigint AS file_no FROM b
        UNION ALL SELECT report_id, unnest(json_extract(f, '$.calls[*]')), file_no FROM fs),
t AS (SELECT report_id, c, '' AS parent, file_no FROM top
      UNION ALL SELECT report_id, unnest(json_extract(c, '$.arguments[*]')), json_extract_string(c, '$.callId'), file_no FROM t)
"""

P5 = _CALLS + """
SELECT DISTINCT * FROM (
 SELECT 'report' AS origin, report_id AS record_id, item, parent AS parent_item, 'owner' AS field_name, json_extract_string(x, '$.owner') AS label FROM g
 UNION ALL SELECT 'report', report_id, item, parent, 'kind', json_extract_string(x, '$.originEvidence.kind') FROM g
 UNION ALL SELECT 'suite', suite_id, n, '', 'language', json_extract_string(body, '$.cases."' || n || '".language')
 FROM (SELECT suite_id, body, unnest(json_keys(body, '$.cases')) AS n FROM native_cases WHERE json_valid(body)))
WHERE label IS NOT NULL AND item IS NOT NULL"""

_TREE = """
WITH RECURSIVE n AS (SELECT DISTINCT plan, id FROM readiness_modules WHERE id IS NOT NULL),
l AS (SELECT id AS child, root AS parent FROM readiness_modules UNION SELECT unnest(related_roots), id FROM readiness_modules),
p AS (SELECT child AS id, min(parent) AS parent FROM l WHERE child IN (SELECT id FROM n) AND parent IN (SELECT id FROM n) GROUP BY child),
u AS (SELECT id, parent AS above, 1 AS steps FROM p
      UNION SELECT u.id, p.parent, u.steps + 1 FROM u JOIN p ON p.id = u.above WHERE u.steps < 3000 AND u.above <> u.id),
c AS (SELECT DISTINCT id FROM u WHERE above = id),
s AS (SELECT DISTINCT id FROM u WHERE above IN (SELECT id FROM c) UNION SELECT id FROM c),
ok AS (SELECT u.* FROM u WHERE u.id NOT IN (SELECT id FROM s))
"""

_DEPENDENT = """
WITH RECURSIVE n AS (SELECT DISTINCT id FROM readiness_modules WHERE id IS NOT NULL),
e AS (SELECT DISTINCT id AS a, t AS b FROM (SELECT id, unnest(dependencies) AS t FROM readiness_modules) WHERE id IS NOT NULL AND t IN (SELECT id FROM n)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT DISTINCT 'dependencies' AS link_kind, a AS id FROM r WHERE a = b"""

SQL = {
    "p2_found": f"SELECT * FROM ({_TREE} SELECT 'root' AS link_kind, id FROM c) UNION ALL SELECT * FROM ({_DEPENDENT})",
    "p2_hierarchy": f"""{_TREE}, pa AS (SELECT n.plan, n.id, coalesce((SELECT list(above ORDER BY steps DESC) FROM ok WHERE ok.id = n.id), []) AS anc FROM n WHERE n.id NOT IN (SELECT id FROM s)),
 pr AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY list_append(anc, id)) AS first FROM pa), be AS (SELECT above AS id, count(*) AS m FROM ok GROUP BY 1)
 SELECT n.plan, n.id, p.parent, CASE WHEN pr.id IS NOT NULL THEN coalesce(pr.anc[1], n.id) END AS top, len(pr.anc)::int AS depth, pr.first, pr.first + coalesce(be.m, 0) AS last, CASE WHEN pr.id IS NOT NULL THEN coalesce(be.m, 0) END AS n_below,
 n.id IN (SELECT id FROM c) AS in_circle, pr.id IS NULL AND n.id NOT IN (SELECT id FROM c) AS stray, n.id IN (SELECT id FROM ({_DEPENDENT})) AS in_dependency_circle
 FROM n LEFT JOIN p ON p.id = n.id LEFT JOIN pr ON pr.id = n.id LEFT JOIN be ON be.id = n.id""",
    "p2_descendants": f"{_TREE} SELECT above AS ancestor, id, steps AS distance FROM ok",
    "p2_paths": f"""{_TREE} SELECT n.id, coalesce((SELECT max_by(above, steps) FROM ok WHERE ok.id = n.id), n.id) AS top,
 coalesce((SELECT max(steps) FROM ok WHERE ok.id = n.id), 0)::int AS depth,
 coalesce((SELECT string_agg(above, '/' ORDER BY steps DESC) FROM ok WHERE ok.id = n.id) || '/', '') || n.id AS path
 FROM n WHERE n.id NOT IN (SELECT id FROM s)""",
    "p3_found": P3,
    "p3_counts": f"SELECT snapshot, delta, count(*) AS n_records FROM ({P3}) GROUP BY ALL",
    "p4_found": P4,
    "p4_intervals": P4_INTERVALS,
    "p5_found": P5,
    "p5_calls": _NUMBERED + """SELECT DISTINCT report_id, json_extract_string(c, '$.callId') AS call_id, parent AS parent_call_id, file_no::int AS file_no,
 json_extract_string(c, '$.caller') AS caller FROM t WHERE json_extract_string(c, '$.callId') IS NOT NULL""",
    "p5_targets": _NUMBERED + """, g AS (SELECT report_id, json_extract_string(c, '$.callId') AS call_id, CASE json_type(c, '$.target') WHEN 'ARRAY' THEN json_extract(c, '$.target[*]') WHEN 'OBJECT' THEN [json_extract(c, '$.target')] ELSE [] END AS xs FROM t),
 u AS (SELECT report_id, call_id, unnest(xs) AS x, unnest(range(len(xs))) AS target_no FROM g)
 SELECT DISTINCT report_id, call_id, target_no::int AS target_no, json_extract_string(x, '$.owner') AS owner, json_extract_string(x, '$.originEvidence.kind') AS kind FROM u WHERE call_id IS NOT NULL""",
    "p5_files": _NUMBERED + """SELECT DISTINCT report_id, file_no::int AS file_no, json_extract_string(f, '$.file') AS file, coalesce(json_array_length(f, '$.calls'), 0)::int AS n_calls FROM fs""",
    "p5_reports": """WITH b AS (SELECT DISTINCT report_id, repository, stdout::json AS j FROM binding_reports WHERE json_valid(stdout))
 SELECT DISTINCT report_id, repository, json_extract_string(j, '$.schema') AS report_schema, (json_extract_string(j, '$.hasErrors'))::boolean AS has_errors, coalesce(json_array_length(j, '$.diagnostics'), 0)::int AS n_diagnostics FROM b WHERE json_type(j) = 'OBJECT'""",
    "p5_cases": """SELECT DISTINCT suite_id, n AS case_name, json_extract_string(body, '$.cases."' || n || '".language') AS language,
 coalesce(len(json_keys(body, '$.cases."' || n || '".files')), 0)::int AS n_files
 FROM (SELECT suite_id, body, unnest(json_keys(body, '$.cases')) AS n FROM native_cases WHERE json_valid(body))""",
}
