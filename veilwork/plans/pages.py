"""Queries of layout, read words, suppression and scores, on literal fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.operators import layout as lay
from veilwork.operators import reading as rd
from veilwork.plans.common import Fixture, Registry, kind_sql

query = Registry()

ITEMS = Fixture(
    "page long, seq long, str string, x double, y double, w double, h double, has_eol boolean, angle double",
    (
        (1, 1, "Harbour", 10.0, 100.0, 70.0, 10.0, False, 0.0),
        (1, 2, "Lights", 84.0, 100.0, 60.0, 10.0, False, 0.0),
        (1, 3, "Fund", 145.0, 100.0, 40.0, 10.0, True, 0.0),
        (1, 4, "Second ", 10.0, 100.0, 70.0, 10.0, False, 0.0),
        (1, 5, "line", 90.0, 102.0, 40.0, 10.0, False, 0.0),
        (1, 6, "below", 10.0, 114.0, 50.0, 10.0, False, 0.0),
        (2, 1, "turned", 50.0, 50.0, 60.0, 12.0, False, 1.5707963267948966),
        (2, 2, "x", 200.0, 50.0, 10.0, 12.0, False, 0.0),
    ),
)
_MATRICES = ((1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (12.0, 0.0, 0.0, 12.0, 72.0, 700.0), (0.0, 10.0, -10.0, 0.0, 30.0, 40.0), (-9.0, 0.0, 0.0, -9.0, 5.0, 6.0), (8.0, 2.0, -2.0, 8.0, 1.5, 2.5), (5.0, 0.0, 0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 0.0, 0.0, 1.0, 1.0))
_VIEWS = ((1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2.0, 0.0, 0.0, -2.0, 0.0, 1584.0), (0.0, 1.5, 1.5, 0.0, 0.0, 0.0), (0.0, -1.5, 1.5, 0.0, 10.0, 900.0), (-1.0, 0.0, 0.0, 1.0, 612.0, 0.0))
RUNS_OF_TEXT = Fixture(
    "id long, str string, matrix array<double>, width double, height double, view array<double>, scale double",
    tuple((i, f"run {i}", list(_MATRICES[i % 7]), 10.0 + i, 11.0, list(_VIEWS[i // 7]), (1.0, 2.0, 1.5, 1.5, 1.0)[i // 7]) for i in range(35)) + ((90, None, list(_MATRICES[0]), 1.0, 1.0, list(_VIEWS[0]), 1.0), (91, "no matrix", None, 1.0, 1.0, list(_VIEWS[0]), 1.0)),
)
SPANS = Fixture('page long, span long, start int, end int', ((1, 1, 0, 14), (1, 2, 15, 22), (2, 1, 1, 4)))
RECTS = Fixture(
    "page long, span long, seq long, x double, y double, w double, h double",
    ((1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 12.0, 1.0, 10.0, 10.0), (1, 1, 3, 60.0, 0.0, 10.0, 10.0), (1, 1, 4, 0.0, 30.0, 10.0, 8.0), (1, 2, 1, 5.0, 5.0, 20.0, 10.0), (1, 2, 2, 8.0, 6.0, 4.0, 6.0), (2, 1, 1, 0.0, 0.0, 5.0, 5.0), (2, 1, 2, 100.0, 0.0, 5.0, 5.0)),
)
PAIRS = Fixture(
    "id long, ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double",
    ((1, 0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0, 2.0, 2.0, 4.0, 4.0), (3, 0.0, 0.0, 10.0, 10.0, 20.0, 0.0, 5.0, 5.0), (4, 0.0, 0.0, 10.0, 10.0, 0.0, 8.0, 10.0, 10.0), (5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 5.0)),
)
WORDS = Fixture(
    "page long, seq long, str string, confidence double, x double, y double, w double, h double",
    (
        (1, 1, "Alpha", 90.0, 0.0, 0.0, 50.0, 10.0), (1, 2, "Alpha", 80.0, 5.0, 0.0, 50.0, 10.0), (1, 3, "lp", 30.0, 10.0, 2.0, 10.0, 6.0), (1, 4, "Beta", 90.0, 60.0, 0.0, 40.0, 10.0), (1, 5, "Beta", 90.0, 60.0, 1.0, 40.0, 10.0),
        (1, 6, "no", 50.0, 200.0, 0.0, 20.0, 10.0), (1, 7, "Gamma", 55.0, 0.0, 20.0, 50.0, 10.0), (2, 1, "Alpha", 70.0, 0.0, 0.0, 50.0, 10.0), (2, 2, "Delta", 99.0, 0.0, 30.0, 50.0, 10.0), (1, 8, "Beta", 90.0, 300.0, 0.0, 40.0, 10.0), (1, 9, "'l-p.", 59.0, 10.0, 2.0, 10.0, 6.0), (1, 10, "'l-p.", 60.0, 20.0, 2.0, 10.0, 6.0), (1, 11, "a-l-p", 30.0, 30.0, 2.0, 10.0, 6.0),
    ),
)
INVERTED = Fixture(
    "page long, seq long, str string, confidence double, x double, y double, w double, h double",
    (
        (1, 201, "Banner", 80.0, 0.0, 200.0, 50.0, 10.0), (1, 202, "B4", 90.0, 60.0, 200.0, 20.0, 10.0), (1, 203, "Soft", 49.9, 0.0, 220.0, 50.0, 10.0), (1, 204, "Sure", 50.0, 0.0, 240.0, 50.0, 10.0), (1, 205, "Bare", None, 0.0, 260.0, 50.0, 10.0), (1, 206, " ", 90.0, 0.0, 280.0, 50.0, 10.0),
        (1, 207, "Cover", 90.0, 0.0, 5.5, 50.0, 10.0), (1, 208, "Covers", 90.0, 0.0, 5.6, 50.0, 10.0), (1, 209, "alpha", 90.0, 0.0, 11.0, 50.0, 10.0), (1, 210, "ALPHA ", 90.0, 0.0, 12.5, 50.0, 10.0), (1, 211, "beta", 90.0, 359.0, 0.0, 40.0, 10.0), (1, 212, "beta", 90.0, 361.0, 0.0, 40.0, 10.0),
        (2, 213, "Gamma", 90.0, 0.0, 20.0, 50.0, 10.0), (3, 214, "Alone", 90.0, 0.0, 0.0, 50.0, 10.0), (1, 215, None, 90.0, 0.0, 300.0, 50.0, 10.0),
    ),
)
NEW = Fixture(
    "page long, seq long, str string, confidence double, x double, y double, w double, h double",
    ((1, 101, "Gamme", 70.0, 0.0, 20.0, 50.0, 10.0), (1, 102, "Bota", 95.0, 60.0, 0.0, 40.0, 10.0), (1, 103, "Fresh", 80.0, 0.0, 60.0, 50.0, 10.0), (2, 101, "Alpho", 81.0, 2.0, 0.0, 50.0, 10.0), (2, 102, "Edge", 60.0, 40.0, 30.0, 50.0, 10.0), (2, 103, "Low", 79.0, 300.0, 300.0, 50.0, 10.0), (2, 104, "--", 99.0, 400.0, 300.0, 50.0, 10.0), (2, 105, "Dalta", 100.0, 35.0, 30.0, 50.0, 10.0)),
)
def _grid(page, seq, strs, x, y, columns=3):
    return tuple((page, seq + i, t, x + 30.0 * (i % columns), y + 15.0 * (i // columns), 25.0, 10.0) for i, t in enumerate(strs))


#: A page for each border of the roles: shares of digits, counts, long tokens.
TOKENS = Fixture(
    "page long, seq long, str string, x double, y double, w double, h double",
    _grid(1, 0, ("12", "34%", "5.6", "Q1", "78", "90"), 10.0, 10.0)
    + _grid(1, 10, ("Acme", "Brix", "Cora", "Dune", "Elm", "Fox", "Gate", "Hale", "Iris"), 300.0, 300.0)
    + ((1, 30, "Managing Director", 10.0, 500.0, 90.0, 10.0), (1, 31, "a@b.org", 10.0, 515.0, 60.0, 10.0), (2, 1, "a sentence of several words", 10.0, 10.0, 200.0, 10.0), (2, 2, "and one more of the kind", 10.0, 25.0, 200.0, 10.0), (2, 3, "word", 500.0, 500.0, 40.0, 10.0), (2, 4, "no area", 500.0, 300.0, 0.0, 10.0))
    + _grid(3, 0, ("1", "2", "3", "4", "5", "6", "Abcdefg", "Bcdefgh", "Cdefghi", "Defghij", "Efghijk"), 10.0, 10.0)  # 6 of 11
    + _grid(3, 20, ("1", "2", "3", "4", "Abcdefg", "Bcdefgh", "Cdefghi"), 400.0, 400.0)  # 4 of 7
    + tuple((4, i, t, 10.0 + 35 * i, 10.0 + 18 * i, 30.0, 16.0) for i, t in enumerate(("1", "2", "3", "4", "Abcdefg", "Bcdefgh", "Cdefghi", "Defghij", "Efghijk", "5")))  # 5 of 10, large
    + _grid(5, 0, ("Director", "1", "2", "Abcdefg", "Bcdefgh", "Cdefghi"), 10.0, 10.0) + _grid(5, 20, ("Partner", "1", "2", "3", "Abcdefg"), 400.0, 10.0) + _grid(5, 40, ("Analyst", *("Wordling",) * 12), 10.0, 400.0, 5)
    + _grid(6, 0, ("Ab", "Cd", "Ef", "Gh", "a token of four", "Ij", "Kl", "Mn"), 10.0, 10.0) + _grid(6, 20, ("Ab", "Cd", "Ef", "Gh", "Wordling", "Wordlings", "Wordlet", "Worded"), 400.0, 10.0) + _grid(6, 40, ("Wordling", "Wordlings", "Wordlet"), 10.0, 400.0) + _grid(6, 60, ("Wordling", "Wordlings"), 400.0, 400.0) + _grid(6, 80, ("Tel: 12",), 700.0, 580.0),
)
POINTS = Fixture(
    "page long, id long, kind string, x double, y double, w double, h double",
    ((1, 1, "phone", 12.0, 12.0, 10.0, 5.0), (1, 2, "person", 310.0, 305.0, 10.0, 5.0), (1, 3, "email", 12.0, 12.0, 10.0, 5.0), (1, 4, "phone", 900.0, 900.0, 10.0, 5.0), (2, 5, "phone", 15.0, 12.0, 10.0, 5.0), (1, 6, "address", 95.0, 12.0, 10.0, 5.0))
    + tuple((p, 10 * p + k, kind, x, y, w, 6.0) for p in (3, 4, 5, 6) for k, (kind, x, y, w) in enumerate((("phone", 12.0, 12.0, 10.0), ("person", 410.0, 20.0, 60.0), ("address", 95.0, 30.0, 20.0), ("phone", 390.0, 400.0, 24.0), ("url", 20.0, 410.0, 9.0), ("person", 0.0, 0.0, 4.0))))
    + tuple((9, 100 + i, "phone", 10.0 * i, 10.0, w, 10.0) for i, w in enumerate((10.0, 40.0, 20.0, 30.0, 5.0, 60.0, 10.0, 80.0))),
)
STACKED = Fixture(
    "page long, seq long, role string, score double, x double, y double, w double, h double",
    ((9, 1, "body", 0.7, 0.0, 0.0, 60.0, 40.0), (9, 2, "chart", 0.95, 20.0, 0.0, 30.0, 40.0), (9, 3, "logo_grid", 0.7, 30.0, 0.0, 80.0, 40.0), (9, 4, "other", 0.4, 0.0, 0.0, 200.0, 40.0), (9, 5, "contact", 0.9, 60.0, 5.0, 10.0, 10.0), (9, 6, "chart", 0.7, 70.0, 0.0, 100.0, 15.0)),
)
HITS = Fixture(
    "page long, scale long, seq long, score double, seeded boolean, x double, y double, w double, h double",
    tuple((p, s, 10 * s + i, round(0.9 - 0.07 * ((i * 3 + s * 5 + p) % 11), 2), i == 4, 10.0 * ((i * 7 + s) % 5), 12.0 * ((i + p) % 3), 11.0, 11.0) for p in (1, 2) for s in (0, 1, 2) for i in range(6)),
)
TRUTH = Fixture("page long, seq long, x double, y double, w double, h double", ((1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 0.0, 10.0, 10.0), (1, 3, 100.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 10.0, 10.0), (3, 1, 0.0, 0.0, 10.0, 10.0)))
MARKS = Fixture("page long, seq long, x double, y double, w double, h double", ((1, 1, 4.0, 4.0, 3.0, 3.0), (1, 2, 50.0, 0.0, 4.0, 10.0), (1, 3, 54.0, 0.0, 1.0, 10.0), (1, 4, 109.5, 0.0, 10.0, 10.0), (2, 1, 0.0, 6.0, 10.0, 10.0), (2, 2, 500.0, 0.0, 10.0, 10.0)))
BASELINE = Fixture("name string, found array<string>, alarms long", (("a", ["1", "2"], 0), ("b", ["1"], 1), ("c", ["1"], 0), ("gone", [], 0)))
RUNS = Fixture("name string, found array<string>, alarms long", (("a", ["1", "3"], 0), ("b", ["1"], 0), ("c", ["1"], 2), ("new", ["1"], 0)))

_OVER = "greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0)"


def over(a="a", b="b"):
    return "(" + _OVER.format(a=a, b=b) + ")"


STITCH = f"""s0 AS (SELECT *, lag(str) OVER w AS ps, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(w) OVER w AS pw, lag(h) OVER w AS ph, lag(has_eol) OVER w AS pe FROM {ITEMS.sql} WINDOW w AS (PARTITION BY page ORDER BY seq)),
s1 AS (SELECT *, CASE WHEN ps IS NULL THEN '' WHEN abs(y - py) > greatest(h, ph) * 0.55 OR coalesce(pe, false) THEN chr(10) WHEN x - px - pw > ph * 0.18 AND NOT ends_with(ps, ' ') AND NOT starts_with(str, ' ') THEN ' ' ELSE '' END AS sep FROM s0),
s2 AS (SELECT *, CAST(sum(length(sep) + length(str)) OVER (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS e FROM s1), stitched AS (SELECT *, e - length(str) AS s FROM s2)"""


@query(f"WITH {STITCH} SELECT page, string_agg(sep || str, '' ORDER BY seq) AS text FROM stitched GROUP BY page")
def stitch_items(spark, sf_dir):
    return lay.page_text(lay.stitch(ITEMS.df(spark)))


_SLICED = """SELECT page, span, seq, least(x0, x1, x2, x3) AS x, least(y0, y1, y2, y3) AS y, greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3) AS w, greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) AS h FROM
 (SELECT page, span, seq, """ + ", ".join(f"x + {u} * cos(angle) - {v} * sin(angle) AS x{i}, y + {u} * sin(angle) + {v} * cos(angle) AS y{i}" for i, (u, v) in enumerate((("a", "up"), ("b", "up"), ("a", "down"), ("b", "down")))) + f""" FROM
 (SELECT i.*, p.span, i.w * greatest(p.start - s, 0) / length(str) AS a, i.w * (least(p."end", e) - s) / length(str) AS b, -h * 0.82 AS up, h * 0.22 AS down FROM stitched i JOIN {SPANS.sql} p ON i.page = p.page AND e > p.start AND s < p."end"))"""


@query(f"WITH {STITCH} SELECT page, span, seq, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM ({_SLICED})")
def span_rects(spark, sf_dir):
    out = lay.span_rects(SPANS.df(spark), lay.stitch(ITEMS.df(spark)))
    return out.select("page", "span", "seq", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


@query(
    f"""SELECT id, {over()} AS shared, CASE WHEN a.w * a.h + b.w * b.h - {over()} > 0 THEN {over()} / (a.w * a.h + b.w * b.h - {over()}) ELSE 0 END AS iou, CASE WHEN least(a.w * a.h, b.w * b.h) > 0 THEN {over()} / least(a.w * a.h, b.w * b.h) ELSE 0 END AS smaller,
 CASE WHEN a.w * a.h > 0 THEN {over()} / (a.w * a.h) ELSE 0 END AS covered, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= least(a.h, b.h) * 0.5 AS same_line FROM (SELECT id, {{'x': ax, 'y': ay, 'w': aw, 'h': ah}} AS a, {{'x': bx, 'y': "by", 'w': bw, 'h': bh}} AS b FROM {PAIRS.sql})"""
)
def rect_pairs(spark, sf_dir):
    return PAIRS.df(spark).select("id", lay.overlap("a", "b").alias("shared"), lay.iou("a", "b").alias("iou"), lay.overlap_of_smaller("a", "b").alias("smaller"), lay.covered("a", "b").alias("covered"), lay.same_line("a", "b").alias("same_line"))


@query(f'SELECT page, span, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM {RECTS.sql} GROUP BY page, span')
def union_rects(spark, sf_dir):
    return lay.union_rects(RECTS.df(spark), ["page", "span"])


_MEDIAN = f"med AS (SELECT page, span, list_sort(list(h))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS m FROM {RECTS.sql} GROUP BY page, span)"
#: No merged box of the fixture touches a new one, so components are the fixpoint.
MERGE_SQL = f"""{_MEDIAN}, r AS (SELECT x.*, m FROM {RECTS.sql} x JOIN med USING (page, span)),
e AS (SELECT a.page, a.span, a.seq AS u, b.seq AS v FROM r a JOIN r b ON a.page = b.page AND a.span = b.span AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= least(a.h, b.h) * 0.5 AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= a.m * 0.6),
c AS (SELECT page, span, u, v FROM e UNION SELECT c.page, c.span, c.u, e.v FROM c JOIN e ON c.page = e.page AND c.span = e.span AND c.v = e.u),
k AS (SELECT page, span, u, min(v) AS k FROM c GROUP BY page, span, u)"""


@query(
    f"""WITH RECURSIVE {MERGE_SQL} SELECT r.page, r.span, round(min(x) - min(m) * 0.12, 6) AS x, round(min(y) - min(m) * 0.04, 6) AS y, round(max(x + w) - min(x) + min(m) * 0.24, 6) AS w, round(max(y + h) - min(y) + min(m) * 0.08, 6) AS h
FROM r JOIN k ON r.page = k.page AND r.span = k.span AND r.seq = k.u GROUP BY r.page, r.span, k.k"""
)
def span_boxes(spark, sf_dir):
    out = lay.boxes_for_spans(RECTS.df(spark))
    return out.select("page", "span", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


@query(
    f"""WITH t AS (SELECT *, matrix[1] AS a, matrix[2] AS b, matrix[3] AS c, matrix[4] AS d, matrix[5] AS e, matrix[6] AS f, view[1] AS p, view[2] AS q, view[3] AS r, view[4] AS s, view[5] AS u, view[6] AS v FROM {RUNS_OF_TEXT.sql} WHERE str IS NOT NULL AND matrix IS NOT NULL),
m AS (SELECT id, width, height, scale, p * a + r * b AS m0, q * a + s * b AS m1, p * c + r * d AS m2, q * c + s * d AS m3, p * e + r * f + u AS m4, q * e + s * f + v AS m5 FROM t)
SELECT id, round(m4, 6) AS x, round(m5, 6) AS y, round(width * scale, 6) AS w, round(CASE WHEN m2 = 0 AND m3 = 0 THEN height * scale ELSE sqrt(m2 * m2 + m3 * m3) END, 6) AS h, round(abs(atan2(m1, m0)), 6) AS turned FROM m"""
)
def items_from_matrices(spark, sf_dir):
    out = lay.placed_items(RUNS_OF_TEXT.df(spark), F.col("view"), F.col("scale"))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")], F.round(F.abs("angle"), 6).alias("turned"))


PAGE_W, PAGE_H = 800, 600
CLUSTER_SQL = f"""t AS (SELECT *, {kind_sql('str')} AS kind FROM {TOKENS.sql} WHERE w > 0 AND h > 0),
e AS (SELECT a.page, a.seq AS u, b.seq AS v FROM t a JOIN t b ON a.page = b.page AND greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= 32 AND greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= 18),
c AS (SELECT page, u, v FROM e UNION SELECT c.page, c.u, e.v FROM c JOIN e ON c.page = e.page AND c.v = e.u), k AS (SELECT page, u AS seq, min(v) AS cluster FROM c GROUP BY page, u)"""
REGION_SQL = f"""{CLUSTER_SQL}, p AS (SELECT k.page, cluster, count(*) AS n, {', '.join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in ('digit', 'contact', 'role', 'short', 'long'))}, count(*) FILTER (kind IN ('word', 'empty')) AS n_word,
 min(x) AS x, min(y) AS y, greatest(max(x + w) - min(x), 1) AS w, greatest(max(y + h) - min(y), 1) AS h FROM t JOIN k ON t.page = k.page AND t.seq = k.seq GROUP BY k.page, cluster),
g AS (SELECT *, CASE WHEN n_contact > 0 THEN 'contact' WHEN n_role > 0 AND n <= 12 AND n_digit / n < 0.35 THEN 'contact' WHEN n >= 4 AND n_digit / n >= 0.55 THEN 'chart' WHEN n >= 6 AND n_digit / n >= 0.4 AND w * h >= 0.08 * 480000 THEN 'chart+'
 WHEN n >= 8 AND n_long = 0 AND (n_short + n_digit) / n >= 0.5 AND n_digit / n < 0.45 THEN 'logo_grid' WHEN n_long > 0 THEN 'body' WHEN n_word >= 3 AND n_digit / n < 0.3 AND (n_short + n_digit) / n < 0.5 THEN 'body' ELSE 'other' END AS r FROM p),
q AS (SELECT page, cluster, n, replace(r, '+', '') AS role, round(CASE r WHEN 'contact' THEN 0.85 + least(0.1, 0.05 * n_contact) WHEN 'chart' THEN 0.7 + least(0.25, n_digit / n) WHEN 'chart+' THEN 0.65 WHEN 'other' THEN 0.4 ELSE 0.7 END, 9) AS score,
 greatest(floor(x - 8), 0) AS x, greatest(floor(y - 8), 0) AS y, least(ceil(x + w + 8), 800) AS x2, least(ceil(y + h + 8), 600) AS y2 FROM g WHERE n > 1 OR r = 'contact'),
regions AS (SELECT page, cluster, n, role, CAST(score AS DOUBLE) AS score, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(greatest(x2 - x, 1) AS DOUBLE) AS w, CAST(greatest(y2 - y, 1) AS DOUBLE) AS h FROM q)"""


def regions(spark):
    return lay.regions(TOKENS.df(spark), "page", PAGE_W, PAGE_H)


@query(f"WITH RECURSIVE {CLUSTER_SQL} SELECT page, seq, cluster FROM k")
def token_clusters(spark, sf_dir):
    return lay.clusters(TOKENS.df(spark), "page", *lay.page_gaps(PAGE_W, PAGE_H))


@query(f"WITH RECURSIVE {REGION_SQL} SELECT page, cluster, role, n, score, x, y, w, h FROM regions")
def page_regions(spark, sf_dir):
    return regions(spark).withColumnRenamed("seq", "cluster")


@query(
    f"""WITH RECURSIVE {REGION_SQL}, s AS (SELECT page, role, round(sum(w * h * score), 6) AS weight FROM regions GROUP BY page, role)
SELECT page, role AS hint FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY weight DESC, list_position(['chart', 'body', 'contact', 'logo_grid', 'other'], role)) = 1"""
)
def page_hints(spark, sf_dir):
    return lay.page_hint(regions(spark), "page")


#: Of the sweep over a page's regions: those that raise the largest overlap to a
#: half or more begin anew, then the best score holds.
_ROLE_AT = f"""o AS (SELECT p.page, p.id, r.role, r.score, r.cluster, (p.x + p.w / 2 BETWEEN r.x AND r.x + r.w) AND (p.y + p.h / 2 BETWEEN r.y AND r.y + r.h) AS inside, {over('p', 'r')} / greatest(p.w * p.h, 1) AS share FROM {POINTS.sql} p JOIN {{regions}} r ON p.page = r.page),
m AS (SELECT *, share >= 0.5 AND share > coalesce((SELECT max(b.share) FROM o b WHERE b.page = o.page AND b.id = o.id AND b.cluster < o.cluster), 0) AS wins FROM o),
at_ AS (SELECT page, id, (SELECT role FROM m WHERE m.page = p.page AND m.id = p.id AND (m.inside OR m.wins) AND m.cluster >= coalesce((SELECT max(cluster) FROM m z WHERE z.page = p.page AND z.id = p.id AND z.wins), m.cluster)
  AND (m.inside OR m.cluster = (SELECT max(cluster) FROM m z WHERE z.page = p.page AND z.id = p.id AND z.wins)) ORDER BY score DESC, cluster LIMIT 1) AS role, kind FROM {POINTS.sql} p)"""
_ALLOWED = "CASE WHEN role = 'chart' AND kind IN ('phone', 'address') THEN false WHEN role = 'logo_grid' AND kind IN ('phone', 'person') THEN false ELSE true END"


@query(f"WITH RECURSIVE {REGION_SQL}, {_ROLE_AT.format(regions='regions')} SELECT page, id, role, {_ALLOWED} AS allowed FROM at_")
def role_suppression(spark, sf_dir):
    points = POINTS.df(spark)
    at = lay.role_at(points, regions(spark), "page")
    return points.join(at, ["page", "id"]).select("page", "id", "role", lay.detector_allowed(F.col("kind"), F.col("role")).alias("allowed"))


@query(f"WITH {_ROLE_AT.format(regions=STACKED.sql.replace('seq', 'cluster'))} SELECT page, id, role FROM at_")
def role_of_overlaps(spark, sf_dir):
    """Regions that lie over each other: order, score and overlap all count."""
    return lay.role_at(POINTS.df(spark), STACKED.df(spark), "page")


ACRONYMS = Fixture("id long, term string, role string, hint string", tuple((i, w, r, h) for i, (w, r, h) in enumerate((w, r, h) for w in ("VAS", "V.A.S", "Texas", "12", "a", None, "a1b2c3d") for r in ("logo_grid", "body", None) for h in ("logo_grid", "other"))))


@query(f"SELECT id, CASE WHEN length(regexp_replace(coalesce(term, ''), '[^A-Za-z]', '', 'g')) NOT IN (1, 2, 3) THEN true ELSE NOT (coalesce(role, '') = 'logo_grid' OR hint = 'logo_grid') END AS allowed FROM {ACRONYMS.sql}")
def short_acronyms(spark, sf_dir):
    return ACRONYMS.df(spark).select("id", lay.short_acronym_allowed(F.coalesce("term", F.lit("")), F.col("role"), F.col("hint")).alias("allowed"))


@query(
    f"""WITH w AS (SELECT * FROM {WORDS.sql}) SELECT page, seq, str FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE a.page = b.page AND a.str = b.str AND a.seq <> b.seq AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.seq < a.seq)) AND {over()} / least(a.w * a.h, b.w * b.h) >= 0.5)"""
)
def read_twins(spark, sf_dir):
    return rd.drop_twins(WORDS.df(spark), "page").select("page", "seq", "str")


@query(f"WITH w AS (SELECT * FROM {WORDS.sql}) SELECT page, seq, str FROM w a WHERE NOT (length(regexp_replace(str, '[^A-Za-z0-9]', '', 'g')) < 3 AND confidence < 60 AND EXISTS (SELECT 1 FROM w b WHERE a.page = b.page AND length(regexp_replace(b.str, '[^A-Za-z0-9]', '', 'g')) > 2 AND b.confidence >= 60 AND {over()} / (a.w * a.h) >= 0.6))")
def read_ghosts(spark, sf_dir):
    return rd.drop_ghosts(WORDS.df(spark), "page").select("page", "seq", "str")


@query(f"SELECT page, seq, str FROM {NEW.sql} a WHERE NOT EXISTS (SELECT 1 FROM {WORDS.sql} b WHERE a.page = b.page AND ({over()} / (a.w * a.h) >= 0.3 OR {over()} / (b.w * b.h) >= 0.3))")
def read_gaps(spark, sf_dir):
    return rd.keep_new(WORDS.df(spark), NEW.df(spark), "page").select("page", "seq", "str")


@query(
    f"""SELECT page, seq, str FROM {INVERTED.sql} a WHERE regexp_matches(str, '[A-Za-z]{{2,}}') AND coalesce(confidence, 100) >= 50 AND NOT EXISTS (SELECT 1 FROM {WORDS.sql} b WHERE a.page = b.page AND ({over()} / (a.w * a.h) >= 0.45
 OR (trim(regexp_replace(lower(a.str), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(b.str), '\\s+', ' ', 'g')) AND abs(a.y - b.y) < 1.2 * greatest(a.h, b.h) AND abs(a.x - b.x) < 1.5 * greatest(a.w, b.w))))"""
)
def read_inverted(spark, sf_dir):
    return rd.keep_inverted(INVERTED.df(spark), WORDS.df(spark), "page").select("page", "seq", "str")


@query(
    f"""WITH o AS (SELECT * FROM {WORDS.sql}), n AS (SELECT * FROM {NEW.sql} WHERE regexp_matches(str, '[A-Za-z0-9]')),
hit AS (SELECT a.page, a.seq AS ns, b.seq AS os, a.confidence AS nc, coalesce(b.confidence, 100) AS oc FROM n a JOIN o b ON a.page = b.page AND ({over()} / (a.w * a.h) >= 0.3 OR {over()} / (b.w * b.h) >= 0.3)),
win AS (SELECT page, seq AS ns FROM n WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.page = n.page AND hit.ns = n.seq) OR n.confidence >= (SELECT max(oc) + 10 FROM hit WHERE hit.page = n.page AND hit.ns = n.seq))
SELECT page, seq, str, 'old' AS source FROM o WHERE NOT EXISTS (SELECT 1 FROM hit JOIN win USING (page, ns) WHERE hit.page = o.page AND hit.os = o.seq) UNION ALL SELECT page, seq, str, 'new' FROM n WHERE EXISTS (SELECT 1 FROM win WHERE win.page = n.page AND win.ns = n.seq)"""
)
def read_replacements(spark, sf_dir):
    return rd.replace_words(WORDS.df(spark), NEW.df(spark), "page").select("page", "seq", "str", "source")


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, seq) AS r FROM {WORDS.sql}),
k AS (SELECT page, r, y AS fy, h AS fh, 0 AS line FROM o WHERE r = 1 UNION ALL
 SELECT o.page, o.r, CASE WHEN o.y - k.fy > greatest(o.h, k.fh) * 0.5 THEN o.y ELSE k.fy END, CASE WHEN o.y - k.fy > greatest(o.h, k.fh) * 0.5 THEN o.h ELSE k.fh END, k.line + CASE WHEN o.y - k.fy > greatest(o.h, k.fh) * 0.5 THEN 1 ELSE 0 END FROM k JOIN o ON o.page = k.page AND o.r = k.r + 1)
SELECT o.page, array_to_string(list(o.seq ORDER BY line, x, seq), ',') AS words FROM o JOIN k ON o.page = k.page AND o.r = k.r GROUP BY o.page"""
)
def reading_order(spark, sf_dir):
    words = WORDS.df(spark).groupBy("page").agg(F.collect_list(F.struct("seq", "x", "y", "h")).alias("ws"))
    return words.select("page", F.array_join(F.transform(lay.reading_order(F.col("ws")), lambda s: s.cast("string")), ",").alias("words"))


@query(
    f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, seq) AS r FROM {HITS.sql}),
k AS (SELECT page, 1 AS r, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept, [seq] AS ids FROM h WHERE r = 1 UNION ALL
 SELECT k.page, CAST(k.r + 1 AS INTEGER), CASE WHEN hit THEN kept ELSE list_append(kept, box) END, CASE WHEN hit THEN ids ELSE list_append(ids, seq) END FROM
 (SELECT k.page, k.r, k.kept, k.ids, h.seq, {{'x': h.x, 'y': h.y, 'w': h.w, 'h': h.h}} AS box, len(list_filter(k.kept, lambda b: {_OVER.format(a='h', b='b')} / (h.w * h.h + b.w * b.h - {_OVER.format(a='h', b='b')}) > 0.3)) > 0 AS hit FROM k JOIN h ON h.page = k.page AND h.r = k.r + 1) k)
SELECT page, unnest(ids) AS seq FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page ORDER BY r DESC) = 1)"""
)
def suppress_boxes(spark, sf_dir):
    hits = HITS.df(spark).groupBy("page").agg(F.collect_list(F.struct("score", "seq", "x", "y", "w", "h")).alias("hs"))
    return hits.select("page", F.explode(F.transform(rd.suppress(F.col("hs")), lambda k: k["seq"])).alias("seq"))


@query(
    f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY page, scale ORDER BY score DESC, seq) AS rank FROM {HITS.sql} QUALIFY rank <= 3)
SELECT page, seq, CAST(row_number() OVER (PARTITION BY page ORDER BY rank, scale, seq) AS BIGINT) AS turn FROM a QUALIFY turn <= 7"""
)
def scales_in_turn(spark, sf_dir):
    return rd.interleave(HITS.df(spark), ["page"], "scale", 3, 7).select("page", "seq", F.col("turn").cast("long").alias("turn"))


@query(f"SELECT page, seq FROM (SELECT *, row_number() OVER (PARTITION BY page, seeded ORDER BY score DESC, seq) AS rank FROM {HITS.sql} WHERE seeded OR score >= 0.45) WHERE seeded OR rank <= 4")
def verify_shortlist(spark, sf_dir):
    return rd.shortlist(HITS.df(spark), ["page"], 0.45, 4).select("page", "seq")


@query(
    f"""SELECT 'place' AS what, a.page, a.seq, CASE WHEN count(b.seq) = 0 THEN false ELSE bool_or(a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h) OR sum({over()}) / max(a.w * a.h) >= 0.5 END AS hit FROM {TRUTH.sql} a LEFT JOIN {MARKS.sql} b ON a.page = b.page GROUP BY a.page, a.seq
UNION ALL SELECT 'false alarm', a.page, a.seq, CASE WHEN count(b.seq) = 0 THEN true ELSE sum({over()}) / max(a.w * a.h) < 0.1 END FROM {MARKS.sql} a LEFT JOIN {TRUTH.sql} b ON a.page = b.page GROUP BY a.page, a.seq"""
)
def score_marks(spark, sf_dir):
    found, alarms = rd.score(TRUTH.df(spark), MARKS.df(spark), "page")
    return found.select(F.lit("place").alias("what"), "page", "seq", F.col("found").alias("hit")).unionByName(alarms.select(F.lit("false alarm").alias("what"), "page", "seq", F.col("false_alarm").alias("hit")))


@query(
    f"""SELECT name, CAST(coalesce(len(list_filter(b.found, lambda v: NOT list_contains(r.found, v))), 0) AS BIGINT) AS lost, CAST(coalesce(len(list_filter(r.found, lambda v: NOT list_contains(b.found, v))), 0) AS BIGINT) AS gained,
 CASE WHEN b.name IS NULL OR r.name IS NULL THEN 0 ELSE greatest(r.alarms - b.alarms, 0) END AS more_alarms, CASE WHEN b.found IS NULL THEN 'new' WHEN r.found IS NULL THEN 'gone' WHEN len(list_filter(b.found, lambda v: NOT list_contains(r.found, v))) > 0 OR r.alarms > b.alarms THEN 'worse' ELSE 'kept' END AS status
FROM (SELECT coalesce(b.name, r.name) AS name, b, r FROM {BASELINE.sql} b FULL JOIN {RUNS.sql} r ON b.name = r.name)"""
)
def baseline_compare(spark, sf_dir):
    return rd.compare_runs(BASELINE.df(spark), RUNS.df(spark))
