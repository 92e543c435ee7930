"""Queries of the smaller page operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.operators import layout as lay
from veilwork.operators import names
from veilwork.operators import pixels as pix
from veilwork.operators import placing as pl
from veilwork.plans.common import Fixture, Registry
from veilwork.plans.pages import HITS, PAIRS, RECTS, WORDS, over
from veilwork.plans.pictures import PLANE, plane
from veilwork.sources.tables import page_dpi

query = Registry()


@query(f"SELECT page, seq, NOT coalesce(abs(lead(y) OVER w - y) <= greatest(h, lead(h) OVER w) * 0.5 AND lead(x) OVER w >= x, false) AS has_eol FROM {WORDS.sql} WINDOW w AS (PARTITION BY page ORDER BY seq)")
def line_ends(spark, sf_dir):
    return pl.line_ends(WORDS.df(spark), "page").select("page", "seq", "has_eol")


@query(
    f"""WITH e AS (SELECT *, NOT coalesce(abs(lead(y) OVER w - y) <= greatest(h, lead(h) OVER w) * 0.5 AND lead(x) OVER w >= x, false) AS has_eol, confidence < 40 AS held FROM {WORDS.sql} WINDOW w AS (PARTITION BY page ORDER BY seq))
SELECT page, rtrim(string_agg(str || CASE WHEN has_eol THEN chr(10) ELSE ' ' END, '' ORDER BY seq), ' ') AS text FROM e WHERE NOT held GROUP BY page"""
)
def read_text(spark, sf_dir):
    return pl.read_text(pl.line_ends(WORDS.df(spark).withColumn("held", F.col("confidence") < 40), "page"), "page")


COLUMNS = Fixture("line long, col long, ink boolean, covered boolean", tuple((k, c, (c * (k + 3)) % 7 < 4, 20 <= c < 26 + k) for k in (1, 2, 3) for c in range(60)))


@query(
    f"""WITH m AS (SELECT *, ink AND NOT covered AS open FROM {COLUMNS.sql} WHERE ink OR covered), f AS (SELECT *, CASE WHEN open AND (NOT coalesce(lag(open) OVER w, false) OR col - lag(col) OVER w - 1 > 2) THEN 1 ELSE 0 END AS fresh FROM m WINDOW w AS (PARTITION BY line ORDER BY col)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY col) AS run FROM f) SELECT line, CAST(max(n) AS BIGINT) AS longest FROM (SELECT line, run, max(col) - min(col) + 1 AS n FROM r WHERE open GROUP BY line, run) GROUP BY line"""
)
def uncovered_runs(spark, sf_dir):
    return pl.longest_runs(COLUMNS.df(spark), ["line"], 2)


BOXES = Fixture("id long, w double, h double, s string", ((1, 100.0, 20.0, "P1"), (2, 40.0, 20.0, "CLAIMANT"), (3, 20.0, 40.0, "TOOLONG"), (4, 10.0, 5.0, "P1"), (5, 300.0, 30.0, "A LONGER LABEL OF SOME WORDS")))


@query(
    f"""SELECT id, (SELECT round(max(size), 6) FROM (SELECT least(h * 0.78, w) - k AS size FROM range(0, 400) r(k)) WHERE size >= 7 AND size * 0.6 * (length(s) + 2) <= w * 0.92 + 1e-9) AS size FROM {BOXES.sql}"""
)
def label_sizes(spark, sf_dir):
    return BOXES.df(spark).select("id", pl.label_size(F.col("w"), F.col("h"), F.length("s") + 2).alias("size"))


_WIDTHS = "[" + ", ".join(map(str, pl.HELVETICA)) + "]"


@query(
    f"""SELECT id, list_sum(list_transform(string_split(s, ''), lambda c: CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN {_WIDTHS}[ascii(c) - 31] WHEN ascii(c) BETWEEN 160 AND 255 THEN 556 ELSE 0 END)) * 12.0 / 1000 AS width FROM {BOXES.sql}"""
)
def text_widths(spark, sf_dir):
    return BOXES.df(spark).select("id", pl.text_width(F.col("s"), F.lit(12.0)).alias("width"))


PROSE = Fixture("id long, s string", ((1, "one two three four five"), (2, "incomprehensibilities are long"), (3, ""), (4, "a b c d e f g h i j k l m n")))


@query(
    f"""WITH RECURSIVE w AS (SELECT id, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') AS ws FROM {PROSE.sql}),
k AS (SELECT id, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS line FROM w UNION ALL
 SELECT k.id, k.i + 1, CASE WHEN k.i = 0 OR length(line) + 1 + length(ws[k.i + 1]) <= 12 THEN done ELSE list_append(done, line) END, CASE WHEN k.i = 0 THEN ws[1] WHEN length(line) + 1 + length(ws[k.i + 1]) <= 12 THEN line || ' ' || ws[k.i + 1] ELSE ws[k.i + 1] END FROM k JOIN w ON w.id = k.id WHERE k.i < len(ws))
SELECT id, array_to_string(CASE WHEN i = 0 THEN done ELSE list_append(done, line) END, '/') AS lines FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1)"""
)
def wrapped_text(spark, sf_dir):
    return PROSE.df(spark).select("id", F.array_join(pl.wrap(F.col("s"), 12), "/").alias("lines"))


@query(
    f"""SELECT id, bx - ax - aw BETWEEN -0.25 * greatest(aw, bw) AND greatest(aw, bw) * 2.2 AND abs(ay + ah / 2 - "by" - bh / 2) <= greatest(ah, bh) * 0.8 AS beside,
 "by" - ay - ah BETWEEN -0.35 * greatest(ah, bh) AND 1.2 * greatest(ah, bh) AND least(abs(bx - ax), abs(bx + bw / 2 - ax - aw / 2)) <= greatest(aw, bw) * 0.45 AS under FROM {PAIRS.sql}"""
)
def phrase_places(spark, sf_dir):
    return PAIRS.df(spark).select("id", pl.beside(F.lit(0)).alias("beside"), pl.under().alias("under"))


def _kept(where):
    return f"""(WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, seq) AS r FROM {HITS.sql} WHERE {where}),
k AS (SELECT page, 1 AS r, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept, [seq] AS ids FROM h WHERE r = 1 UNION ALL
 SELECT page, r, CASE WHEN hit THEN kept ELSE list_append(kept, box) END, CASE WHEN hit THEN ids ELSE list_append(ids, seq) END FROM (SELECT k.page, CAST(k.r + 1 AS INTEGER) AS r, k.kept, k.ids, h.seq, {{'x': h.x, 'y': h.y, 'w': h.w, 'h': h.h}} AS box,
 len(list_filter(k.kept, lambda b: {over('h', 'b')} / (h.w * h.h + b.w * b.h - {over('h', 'b')}) > 0.3)) > 0 AS hit FROM k JOIN h ON h.page = k.page AND h.r = k.r + 1))
SELECT x.* FROM {HITS.sql} x JOIN (SELECT page, unnest(ids) AS seq FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page ORDER BY r DESC) = 1)) i ON x.page = i.page AND x.seq = i.seq)"""


@query(
    f"""WITH a AS {_kept('scale < 2')}, b AS {_kept('scale = 2')} SELECT page, seq, false AS by_ink FROM a
UNION ALL SELECT page, seq, true FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page = b.page AND ({over('a', 'b')} / (a.w * a.h + b.w * b.h - {over('a', 'b')}) > 0.3 OR {over('a', 'b')} / (a.w * a.h) > 0.5 OR {over('a', 'b')} / (b.w * b.h) > 0.5))"""
)
def shape_before_ink(spark, sf_dir):
    return pl.shape_first(HITS.df(spark).withColumn("by_ink", F.col("scale") == 2), "page").select("page", "seq", "by_ink")


PROBES = Fixture("doc long, page long, flag boolean", ((1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False), (2, 1, False), (3, 0, True)))


@query(f"SELECT doc, page, NOT coalesce(bool_or(flag) OVER w, false) AS probed, coalesce(bool_or(flag) OVER w, false) OR flag AS could_hide FROM {PROBES.sql} WINDOW w AS (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def hidden_text_probe(spark, sf_dir):
    return pl.hide_probe(PROBES.df(spark), "doc", "page", "flag").select("doc", "page", "probed", "could_hide")


DPI = Fixture("id long, px double, pt double", ((1, 1224.0, 612.0), (2, 500.0, None), (3, 612.0, 612.0), (4, 1.0, 0.0)))


@query(f"SELECT id, CASE WHEN pt IS NULL OR pt <= 0 THEN NULL ELSE px / pt * 72 END AS dpi FROM {DPI.sql}")
def page_resolution(spark, sf_dir):
    return DPI.df(spark).select("id", page_dpi(F.col("px"), F.col("pt")).alias("dpi"))


@query(f"SELECT page, span, seq, least(x, y) AS dx, least(y, x) AS dy, abs(y - x) AS dw, abs(x - y) AS dh, 200 - y - h AS tx, x AS ty, h AS tw, w AS th FROM {RECTS.sql}")
def rect_moves(spark, sf_dir):
    rects = RECTS.df(spark)
    drag = lay.drag(F.col("x"), F.col("y"), F.col("y"), F.col("x"))
    turn = lay.quarter_turn(F.lit(200.0))
    return rects.select("page", "span", "seq", *[c.alias("d" + n) for c, n in zip(drag, "xywh")], *[c.alias("t" + n) for c, n in zip(turn, "xywh")])


@query(f"SELECT page, span, max_by(seq, seq) AS top FROM {RECTS.sql} WHERE 9 BETWEEN x AND x + w AND 7 BETWEEN y AND y + h GROUP BY page, span")
def rect_at(spark, sf_dir):
    r = RECTS.df(spark).where("9 between x and x + w and 7 between y and y + h")
    return r.groupBy("page", "span").agg(F.max("seq").alias("top"))


@query(f"SELECT page, seq FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, seq) AS r FROM {WORDS.sql}) WHERE r <= 3")
def largest_pieces(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy((F.col("w") * F.col("h")).desc(), "seq")
    return WORDS.df(spark).withColumn("r", F.row_number().over(w)).where("r <= 3").select("page", "seq")


@query(
    f"""WITH c AS (SELECT page, x // 3 AS cx, y // 3 AS cy, var_pop(v) AS var FROM (SELECT page, x, y, CASE WHEN x BETWEEN 9 AND 12 AND y BETWEEN 6 AND 8 THEN v * 9 ELSE v END AS v FROM {PLANE}) GROUP BY ALL),
f AS (SELECT page, greatest(40.0, 3 * list_sort(list(var))[CAST(floor(count(*) * 0.5) AS INTEGER) + 1]) AS floor_ FROM c GROUP BY page), b AS (SELECT c.page, cx, cy FROM c JOIN f ON c.page = f.page WHERE var > floor_)
SELECT DISTINCT c.page, c.cx, c.cy FROM c JOIN b ON c.page = b.page AND abs(c.cx - b.cx) <= 1 AND abs(c.cy - b.cy) <= 1"""
)
def busy_cells(spark, sf_dir):
    mark = F.when(F.col("x").between(9, 12) & F.col("y").between(6, 8), F.col("v") * 9).otherwise(F.col("v"))
    return pl.busy_cells(pix.cell_variance(plane(spark).withColumn("v", mark), "page", 3), "page")


@query(f"SELECT h.page, h.seq FROM {HITS.sql} h WHERE EXISTS (SELECT 1 FROM (VALUES (0, 1), (1, 2), (2, 1)) t(scale, page) WHERE t.scale = h.scale AND t.page = h.page)")
def templates_on_their_pages(spark, sf_dir):
    allowed = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "scale long, page long")
    return HITS.df(spark).join(F.broadcast(allowed), ["scale", "page"], "left_semi").select("page", "seq")


PIECES = Fixture("id long, s string, parts string", ((1, "Rowan Hale, Managing Director", "0:Rowan Hale|11: Managing Director"), (2, "Partner – Ada Marlowe", "0:Partner |9: Ada Marlowe"), (3, "one|two", "0:one|4:two"), (4, "plain-hyphen", "0:plain-hyphen")))


@query(f"SELECT id, parts FROM {PIECES.sql}")
def line_pieces(spark, sf_dir):
    found = names.pieces(F.col("s"))
    return PIECES.df(spark).select("id", F.array_join(F.transform(found, lambda p: F.concat_ws(":", p["start"].cast("string"), p["text"])), "|").alias("parts"))
