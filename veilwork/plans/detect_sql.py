"""SQL of the detectors, for the checks: of another shape than the operators
(rows and windows instead of arrays)."""

from __future__ import annotations

from veilwork.functions.text import WHITE
from veilwork.operators import names as nm
from veilwork.operators import spans as sp


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan(source: str, key: str, text: str, pattern: str) -> str:
    """All matches with offsets: lengths of the gaps and matches before."""
    p = lit(pattern)
    return f"""(SELECT k AS {key}, t AS whole, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start, m[i] AS text
 FROM (SELECT {key} AS k, {text} AS t, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g, unnest(range(1, len(regexp_extract_all({text}, {p})) + 1)) AS i FROM {source} WHERE regexp_matches({text}, {p})))"""


def _span(key: str, kind: str) -> str:
    return f"""SELECT {key}, '{kind}' AS kind, CAST(start AS INTEGER) AS start, CAST(start + length(x) AS INTEGER) AS "end", 'high' AS confidence, CAST(NULL AS VARCHAR) AS term, x AS text"""


def detector(kind: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    if kind == "person":
        return names(source, key, text)
    if kind == "address":
        return addresses(source, key, text)
    pattern, keep, short = {
        "email": (sp.EMAIL, "true", "text"),
        "phone": (sp._white(sp.PHONE), "length(regexp_replace(text, '[^0-9]', '', 'g')) BETWEEN 8 AND 15", "text"),
        "url": (sp._white(sp.URL), "true", f"regexp_replace(text, {lit(sp.URL_END)}, '')"),
    }[kind]
    return f"{_span(key, kind)} FROM (SELECT *, {short} AS x FROM {scan(source, key, text, pattern)} WHERE {keep})"


def addresses(source: str, key: str, text: str) -> str:
    postal = nm.POSTAL.replace("(?!19[0-9]{2}|20[0-9]{2})[0-9]{4}", "(?:1[0-8][0-9]{2}|2[1-9][0-9]{2}|[03-9][0-9]{3})")
    return f"""{_span(key, 'address')} FROM (SELECT {key}, begin + length(raw) - length(regexp_replace(raw, '^[\\s,]+', '')) AS start, regexp_replace(regexp_replace(raw, '^[\\s,]+', ''), '[\\s,]+$', '') AS x FROM (
 SELECT {key}, start - length(lead) AS begin, substr(whole, CAST(start - length(lead) + 1 AS BIGINT), length(lead) + length(text) + length(after) - length(string_split_regex(after, {lit(postal)})[-1])) AS raw FROM (
 SELECT *, regexp_extract(substr(whole, start + length(text) + 1), '^[^\\n]*') AS after, regexp_extract(regexp_extract(substr(whole, 1, start), '[^\\n]*$'), {lit(nm.UNIT)}) AS lead
 FROM {scan(source, key, text, nm.STREET)} WHERE NOT contains(text, chr(10))) WHERE regexp_matches(after, {lit(postal)}))) WHERE length(x) <= 200"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def _is_name(x: str) -> str:
    t = f"regexp_replace({_strip(x)}, '[,.;:]+$', '')"
    return f"(length({t}) <= 48 AND regexp_matches({t}, {lit(nm.NAME)}) AND len(list_filter(string_split_regex({t}, '[{WHITE}–-]+'), lambda p: p <> '')) >= 2 AND NOT regexp_matches({t}, {lit(nm.NOT_NAMES)}) AND NOT regexp_matches({t}, {lit(nm.ROLES)}))"


def names(source: str, key: str, text: str) -> str:
    """From the text layer (not read by a recogniser)."""
    role = lambda x: f"(regexp_matches({x}, {lit(nm.ROLES)}) AND NOT {_is_name(x)})"
    contact = lambda x: f"(regexp_matches({x}, {lit(nm.CONTACT_LABEL)}) OR regexp_matches({x}, {lit(nm.CONTACT_VALUE)}))"
    border = lit(rf"[,|–—]|[{WHITE}]-[{WHITE}]")
    rest = f"regexp_replace(body, {lit('(?s)^.*?' + nm.SIGN_LABEL)}, '')"
    lead = lambda x: f"(length({x}) - length(regexp_replace({x}, '^[{WHITE}]+', '')))"
    return f"""{_span(key, 'person')} FROM (SELECT {key}, start + {lead('raw')} AS start, regexp_replace({_strip('raw')}, '[,.;:]+$', '') AS x FROM (
 WITH l AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS raw, generate_subscripts(string_split({text}, chr(10)), 1) AS no FROM {source}),
 o AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY {key} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, {_strip('raw')} AS body FROM l),
 n AS (SELECT *, coalesce(lag(body) OVER w, '') AS above, coalesce(lead(body) OVER w, '') AS below FROM o WHERE body <> '' WINDOW w AS (PARTITION BY {key} ORDER BY no)),
 c AS (SELECT *, CASE WHEN regexp_matches(body, {lit(nm.SIGN_LABEL)}) AND {_is_name(rest)} THEN 'label'
  WHEN {_is_name('body')} AND (regexp_matches(above, {lit(nm.SIGN_OFF)}) OR regexp_matches(above, {lit(nm.SIGN_LABEL)}) OR {role('below')} OR {contact('below')}) THEN 'line' ELSE 'pieces' END AS how FROM n),
 g AS (SELECT {key}, no, start, string_split_regex(raw, {border}) AS gs, regexp_extract_all(raw, {border}) AS ss FROM c WHERE how = 'pieces' AND regexp_matches(raw, {border})),
 p AS (SELECT {key}, no, start + coalesce(list_sum(list_transform(gs[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ss[1:i-1], lambda x: length(x))), 0) AS start, gs[i] AS raw FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS i FROM g))
 SELECT {key}, start + {lead('raw')} + length(body) - length({rest}) AS start, {rest} AS raw FROM c WHERE how = 'label'
 UNION ALL SELECT {key}, start, raw FROM c WHERE how = 'line'
 UNION ALL SELECT {key}, start, raw FROM p WHERE {_is_name('raw')} AND ({key}, no) IN (SELECT ({key}, no) FROM p WHERE {role('raw')})))"""


def term(listed: str) -> str:
    before, after = sp._edge(listed[0]), sp._edge(listed[-1])
    pattern = "(?i)" + (f"(?:^|[^{before}])" if before else "") + sp.term_body(listed)
    lead = f"CASE WHEN regexp_matches(text, '^[^{before}]') THEN 1 ELSE 0 END" if before else "0"
    tail = f"NOT regexp_matches(substr(whole, start + lead + length(text) - lead + 1, 1), '[{after}]')" if after else "true"
    return f"""SELECT doc_id, 'term' AS kind, CAST(start + lead AS INTEGER) AS start, CAST(start + length(text) AS INTEGER) AS "end", 'high' AS confidence, {lit(listed)} AS term, substr(text, 1 + lead) AS text
 FROM (SELECT *, {lead} AS lead FROM {scan("documents", "doc_id", "text", pattern)}) WHERE {tail}"""
