"""Queries of detectors, span algebra, labels and redaction over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import text as t
from veilwork.operators import labels as lab
from veilwork.operators import spans as sp
from veilwork.plans import detect_sql as sql
from veilwork.plans.common import Fixture, Registry, table
from veilwork.sources import tables as src

query = Registry()
TERMS = ("example.com", "Licensed under", "password", "mail3", "the Apache License", "Eren Thand")
OVERRIDES = Fixture("identity string, label string", (("term:password", "login word"), ("term:the apache license", "")))


_lit, scan_sql, _detector_sql, _term_sql = sql.lit, sql.scan, sql.detector, sql.term
TERMS_SQL = " UNION ALL ".join(_term_sql(x) for x in sorted(TERMS, key=lambda x: (-len(x), x)))
FOUND_SQL = " UNION ALL ".join([_detector_sql(k) for k in sp.DETECTORS] + [TERMS_SQL])
#: Greedy resolution a rank at a time: an oracle of another shape than the fold.
RESOLVE_SQL = f"""found AS ({FOUND_SQL}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start - "end", CASE confidence WHEN 'high' THEN 0 ELSE 1 END, start, coalesce(term, ''), kind) AS r FROM found),
walk AS (
 SELECT doc_id, 1 AS r, [{{'s': start, 'e': "end", 'r': r}}] AS kept FROM ranked WHERE r = 1
 UNION ALL
 SELECT w.doc_id, CAST(w.r + 1 AS INTEGER), CASE WHEN len(list_filter(w.kept, lambda k: k.s < x."end" AND x.start < k.e)) > 0 THEN w.kept ELSE list_append(w.kept, {{'s': x.start, 'e': x."end", 'r': x.r}}) END
 FROM walk w JOIN ranked x ON x.doc_id = w.doc_id AND x.r = w.r + 1),
final AS (SELECT doc_id, kept FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) = 1),
kept AS (SELECT x.* FROM ranked x JOIN final f ON x.doc_id = f.doc_id WHERE len(list_filter(f.kept, lambda k: k.r = x.r)) > 0)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.find_all(table(spark, sf_dir, "documents"), "doc_id", "text", listed=TERMS)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.resolve(found(spark, sf_dir), "doc_id")


@query(_detector_sql("email"))
def spans_email(spark, sf_dir):
    return sp.emails(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_detector_sql("phone"))
def spans_phone(spark, sf_dir):
    return sp.phones(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_detector_sql("url", "pages", "page_id", "url"))
def spans_url(spark, sf_dir):
    return sp.urls(table(spark, sf_dir, "pages"), "page_id", "url")


@query(TERMS_SQL)
def spans_terms(spark, sf_dir):
    return sp.terms(table(spark, sf_dir, "documents"), list(TERMS), "doc_id", "text")


@query(
    f"""WITH RECURSIVE {RESOLVE_SQL}
SELECT k.doc_id, k.kind, k.start, k."end", k.text, k.kind || ':' || k.start || ':' || k."end" AS id,
 coalesce((SELECT string_agg(term, ',' ORDER BY r) FROM (SELECT x.term, min(x.r) AS r FROM ranked x WHERE x.doc_id = k.doc_id AND x.kind = 'term' AND x.r > k.r AND k.start <= x.start AND x."end" <= k."end" GROUP BY x.term)), '') AS holds FROM kept k"""
)
def spans_resolved(spark, sf_dir):
    return resolved(spark, sf_dir).select("doc_id", "kind", "start", "end", "text", "id", F.array_join("holds", ",").alias("holds"))


def _redact_sql(new: str) -> str:
    return f"""WITH RECURSIVE {RESOLVE_SQL},
lagged AS (SELECT k.*, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM kept k),
joined AS (SELECT l.doc_id, string_agg(substr(d.text, prev + 1, start - prev) || {new}, '' ORDER BY start) AS head, max("end") AS last FROM lagged l JOIN documents d ON l.doc_id = d.doc_id GROUP BY l.doc_id)
SELECT j.doc_id, head || substr(d.text, last + 1) AS redacted FROM joined j JOIN documents d ON j.doc_id = d.doc_id"""


@query(_redact_sql("repeat('█', \"end\" - start)"))
def redact_block(spark, sf_dir):
    return sp.apply(table(spark, sf_dir, "documents"), resolved(spark, sf_dir), "doc_id", "text", sp.STYLES["block"]())


@query(_redact_sql("'[' || upper(kind) || ']'"))
def redact_label(spark, sf_dir):
    return sp.apply(table(spark, sf_dir, "documents"), resolved(spark, sf_dir), "doc_id", "text", sp.STYLES["label"]())


@query(_redact_sql("''"))
def redact_remove(spark, sf_dir):
    return sp.apply(table(spark, sf_dir, "documents"), resolved(spark, sf_dir), "doc_id", "text", sp.STYLES["remove"]())


@query(
    f"""WITH found AS ({FOUND_SQL}),
marked AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM found),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM grouped GROUP BY doc_id, island"""
)
def spans_cover(spark, sf_dir):
    return sp.cover(found(spark, sf_dir), "doc_id")


_CATEGORY = "CASE " + " ".join(f"WHEN category = '{c}' THEN '{p}'" for c, p, _ in lab.CATEGORIES) + " END"
_DESCRIPTION = "CASE " + " ".join(f"WHEN category = '{c}' THEN {_lit(d)}" for c, _, d in lab.CATEGORIES) + " END"
_NAME = r"""(NOT regexp_matches(trim(v), '[0-9]') AND trim(v) <> '' AND len(list_filter(string_split_regex(trim(v), '\s+'), lambda w: w <> '')) <= 4
 AND len(list_filter(string_split_regex(trim(v), '\s+'), lambda w: w <> '' AND NOT (regexp_matches(w, '^[A-Z][\p{L}''’-]*$') AND NOT (length(w) > 1 AND w = upper(w))))) = 0)"""
ENTRIES_SQL = f"""WITH RECURSIVE {RESOLVE_SQL},
things AS (SELECT *, kind || ':' || trim(regexp_replace(lower(coalesce(CASE WHEN kind = 'term' THEN term END, text)), '\\s+', ' ', 'g')) AS identity, coalesce(term, text) AS v FROM kept),
groups AS (SELECT doc_id, identity, min(start) AS first, count(*) AS "count", arg_min(v, start) AS value, min(kind) AS kind, bool_or(kind = 'term' AND {_NAME}) AS name FROM things GROUP BY doc_id, identity),
named AS (SELECT *, CASE WHEN name THEN 'person' ELSE kind END AS category FROM groups),
entries AS (SELECT doc_id, identity, category, {_DESCRIPTION} AS description, {_CATEGORY} || row_number() OVER (PARTITION BY doc_id, category ORDER BY first, identity) AS suggested, value, "count", first FROM named)"""


@query(
    f"""{ENTRIES_SQL} SELECT e.doc_id, e.identity, category, description, suggested, coalesce(nullif(left(regexp_replace(regexp_replace(upper(o.label), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), ''), suggested) AS label, value, "count", first
FROM entries e LEFT JOIN {OVERRIDES.sql} o ON e.identity = o.identity"""
)
def labels_assigned(spark, sf_dir):
    return lab.assign(resolved(spark, sf_dir), "doc_id", OVERRIDES.df(spark))


@query(f'{ENTRIES_SQL} SELECT doc_id, suggested AS label, description, "count" FROM entries')
def labels_legend(spark, sf_dir):
    return lab.legend(lab.assign(resolved(spark, sf_dir), "doc_id"), "doc_id")


@query(f'{ENTRIES_SQL} SELECT doc_id, suggested AS label, value, "count" FROM entries')
def labels_key(spark, sf_dir):
    return lab.key(lab.assign(resolved(spark, sf_dir), "doc_id"), "doc_id")


@query(
    _redact_sql("'[' || label || ']'").replace(
        "lagged AS (SELECT k.*",
        f"""things AS (SELECT *, kind || ':' || trim(regexp_replace(lower(coalesce(CASE WHEN kind = 'term' THEN term END, text)), '\\s+', ' ', 'g')) AS identity, coalesce(term, text) AS v FROM kept),
groups AS (SELECT doc_id, identity, min(start) AS first, min(kind) AS kind, bool_or(kind = 'term' AND {_NAME}) AS name FROM things GROUP BY doc_id, identity),
named AS (SELECT *, CASE WHEN name THEN 'person' ELSE kind END AS category FROM groups),
entries AS (SELECT doc_id, identity, {_CATEGORY} || row_number() OVER (PARTITION BY doc_id, category ORDER BY first, identity) AS label FROM named),
labelled AS (SELECT t.doc_id, t.start, t."end", e.label FROM things t JOIN entries e ON t.doc_id = e.doc_id AND t.identity = e.identity),
lagged AS (SELECT k.*""",
    ).replace("FROM kept k),\njoined", "FROM labelled k),\njoined")
)
def redact_placeholders(spark, sf_dir):
    """The flagship: detect, resolve, label, replace."""
    named = lab.labelled(resolved(spark, sf_dir), "doc_id")
    return sp.apply(table(spark, sf_dir, "documents"), named, "doc_id", "text", t.render_label(F.col("label")))


@query(f'WITH f AS ({FOUND_SQL}) SELECT d.lang, d.source, f.kind, count(*) AS n, count(DISTINCT f.doc_id) AS n_docs FROM f JOIN documents d ON f.doc_id = d.doc_id GROUP BY ROLLUP (d.lang, d.source, f.kind)')
def kind_tally(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return found(spark, sf_dir).join(docs, "doc_id").rollup("lang", "source", "kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    f"""WITH f AS ({FOUND_SQL}) SELECT quality, toxic, 'with' AS spans, count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM f) GROUP BY ALL
UNION ALL SELECT quality, toxic, 'without', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM f) GROUP BY ALL"""
)
def labels_semi_anti(spark, sf_dir):
    labels, ids = table(spark, sf_dir, "labels"), found(spark, sf_dir).select("doc_id")
    count = lambda how, name: labels.join(ids, "doc_id", how).groupBy("quality", "toxic").agg(F.count("*").alias("n")).withColumn("spans", F.lit(name))
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query(
    r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
full_ AS (SELECT *, trim(line) AS body FROM lines WHERE trim(line) <> '')
SELECT doc_id, CAST(no - 1 AS BIGINT) AS line_no, CAST(length(body) AS BIGINT) AS n, coalesce(left(lag(body) OVER w, 20), '') AS above, coalesce(left(lead(body) OVER w, 20), '') AS below, coalesce(left(lead(body, 2) OVER w, 20), '') AS below2 FROM full_ WINDOW w AS (PARTITION BY doc_id ORDER BY no)"""
)
def lines_context(spark, sf_dir):
    from veilwork.operators.names import lines_of, neighbours

    out = neighbours(lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 1, 2)
    return out.select("doc_id", F.col("line").cast("long").alias("line_no"), F.length("body").cast("long").alias("n"), F.left("above1", F.lit(20)).alias("above"), F.left("below1", F.lit(20)).alias("below"), F.left("below2", F.lit(20)).alias("below2"))


@query(
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1)) AS inside, generate_subscripts(regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1), 1) - 1 AS pos FROM pages),
x AS (SELECT page_id, pos, regexp_extract(inside, '(?s)<h1>(.*?)</h1>', 1) AS t, array_to_string(regexp_extract_all(inside, '(?s)<p>(.*?)</p>', 1), ' ') AS b FROM s WHERE regexp_matches(inside, '(?s)<h1>(.*?)</h1>'))
SELECT page_id, CAST(pos AS BIGINT) AS pos, """
    + ", ".join(f"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS {n}""" for c, n in (("t", "title"), ("b", "body")))
    + " FROM x"
)
def html_sections(spark, sf_dir):
    return src.sections(table(spark, sf_dir, "pages"), "page_id", "html", "(?s)<article>(.*?)</article>", "(?s)<h1>(.*?)</h1>", "(?s)<p>(.*?)</p>")
