"""SQL that checks those of the queries that SQL can express."""

from __future__ import annotations

from veilwork.llm import secrets

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _grams(table: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 3)) AS i FROM (SELECT {key}, {_WORDS} AS ws FROM {table}))"


OP4 = f"""WITH d AS ({_grams('documents', 'doc_id')}), b AS ({_grams('benchmark', 'item_id')}), n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, count(*) / any_value(n_shingles) AS containment, any_value(n_shingles) AS n_shingles FROM d JOIN b USING (g) JOIN n ON n.item_id = b.item_id GROUP BY doc_id, b.item_id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9
UNION ALL SELECT DISTINCT doc_id, item_id, 1.0, 1 FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS d FROM documents) JOIN (SELECT item_id, ' ' || array_to_string(ws, ' ') || ' ' AS i FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) BETWEEN 1 AND 4) ON contains(d, i)"""

_CONTROL = r"[\[<]\\*(?:/?(?:INST|SYS)\]|/?ROLE|/?s>)"
OP8 = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE 14 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

OP10 = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: int, pattern: str, value: str, keep: str) -> str:
    p = _quoted(pattern)
    return f"""SELECT doc_id, source, {kind} AS kind, s AS start, s + length(m) AS stop, {value} AS value FROM (SELECT doc_id, source, m[i] AS m, v[i] AS v, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
 FROM (SELECT doc_id, source, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {2 if kind == 0 else 0}) AS v, string_split_regex(text, {p}) AS g, unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS i FROM documents)) WHERE {keep}"""


_RE = [secrets.ASSIGN.pattern, r"AKIA[A-Z0-9]+", r"[0-9a-f]+", r"[A-Za-z0-9_-]+"]
OP2 = f"""WITH base AS ({_found(0, '(?i)' + _RE[0], 'v', 'length(v) >= 6')} UNION ALL {_found(1, _RE[1], 'm', 'length(m) >= 20')} UNION ALL {_found(2, _RE[2], 'm', 'length(m) >= 24')}),
more AS ({_found(3, _RE[3], 'm', "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")}),
al AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start < m.stop AND m.start < b.stop)),
own AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM al GROUP BY value),
j AS (SELECT a.*, repos, CASE WHEN owners >= 3 OR owners = 2 AND repos >= 5 THEN 'example' WHEN owners <= 1 AND repos <= 20 AND list_aggregate(string_split(a.value, ''), 'entropy') >= 3.0 THEN 'live' ELSE 'unclear' END AS verdict, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || stop AS span FROM al a JOIN own o ON a.value = o.value),
k AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS h, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR verdict = 'live') AS spans,
 max(repos) FILTER (kind < 3 OR verdict = 'live') AS most, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example' AND kind < 3) AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most, 0) AS most_repos FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id"""

SQL = {"op2_secrets": OP2, "op4_decontamination": OP4, "op8_chat": OP8, "op10_embeddings": OP10}
