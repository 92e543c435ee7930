"""Geometry of placed text: rectangles, stitching, spans to boxes, clusters
and roles of regions. Rectangles are columns x, y, w, h (y downwards)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions import text as t

#: Parts of a run's height over and under its baseline.
ASCENT, DESCENT = 0.82, 0.22


# ---- scalars ----


def overlap(a: str, b: str) -> Column:
    """Area that rectangles with column prefixes a and b share."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    h = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: str) -> Column:
    return F.col(f"{a}w") * F.col(f"{a}h")


def _share(a: str, b: str, of: Column) -> Column:
    return F.when(of > 0, overlap(a, b) / of).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    return _share(a, b, area(a) + area(b) - overlap(a, b))


def overlap_of_smaller(a: str, b: str) -> Column:
    return _share(a, b, F.least(area(a), area(b)))


def covered(inner: str, by: str) -> Column:
    """Share of `inner` that `by` covers."""
    return _share(inner, by, area(inner))


def same_line(a: str, b: str) -> Column:
    """At least half of the lower one's height is shared."""
    h = F.least(F.col(f"{a}y") + F.col(f"{a}h"), F.col(f"{b}y") + F.col(f"{b}h")) - F.greatest(F.col(f"{a}y"), F.col(f"{b}y"))
    return h >= F.least(f"{a}h", f"{b}h") * 0.5


def drag(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """A rectangle from two corners."""
    return [F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("w"), F.abs(y1 - y0).alias("h")]


def quarter_turn(height: Column) -> list[Column]:
    """The rectangle after a clockwise quarter turn of a page of that height."""
    return [(height - F.col("y") - F.col("h")).alias("x"), F.col("x").alias("y"), F.col("h").alias("w"), F.col("w").alias("h")]


def slice_rect(start: Column, end: Column) -> list[Column]:
    """Box of characters start to end of a run (str, x, y of the baseline, w,
    h, angle), evenly advanced; of a turned run the box around it."""
    n = F.greatest(F.length("str"), F.lit(1))
    a, b = F.col("w") * start / n, F.col("w") * end / n
    cos, sin = F.cos("angle"), F.sin("angle")
    up, down = F.col("h") * ASCENT, F.col("h") * DESCENT
    corners = [(a, -up), (b, -up), (a, down), (b, down)]
    xs = [F.col("x") + u * cos - v * sin for u, v in corners]
    ys = [F.col("y") + u * sin + v * cos for u, v in corners]
    x, y = F.least(*xs), F.least(*ys)
    return [x.alias("x"), y.alias("y"), (F.greatest(*xs) - x).alias("w"), (F.greatest(*ys) - y).alias("h")]


# ---- text of a page ----


def stitch(items: DataFrame, page: str = "page", order: str = "seq") -> DataFrame:
    """The items with their start and end in the page's text: between two
    items a line break (another baseline, or the end of a line before), a
    blank (a gap that none fills) or nothing. One window per page."""
    w = Window.partitionBy(page).orderBy(order)
    prev = lambda c: F.lag(c).over(w)
    broke = (F.abs(F.col("y") - prev("y")) > F.greatest("h", prev("h")) * 0.55) | F.coalesce(prev("has_eol"), F.lit(False))
    gap = F.col("x") - prev("x") - prev("w") > prev("h") * 0.18
    spaced = prev("str").endswith(" ") | F.startswith("str", F.lit(" "))
    sep = F.when(prev("str").isNull(), "").when(broke, "\n").when(gap & ~spaced, " ").otherwise("")
    out = items.withColumn("sep", sep)
    end = F.sum(F.length("sep") + F.length("str")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("str")).cast("int"))


def page_text(stitched: DataFrame, page: str = "page", order: str = "seq") -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat("sep", "str").alias("s"))))
    return stitched.groupBy(page).agg(F.array_join(F.transform(pieces, lambda p: p["s"]), "").alias("text"))


def span_rects(spans: DataFrame, items: DataFrame, page: str = "page") -> DataFrame:
    """A rectangle for each item that a span touches: an equi join on the page
    with a range condition."""
    s = spans.select(F.col(page), F.col("span"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    both = items.join(s, page).where("end > s0 and start < s1")
    first = F.greatest(F.col("s0") - F.col("start"), F.lit(0))
    last = F.least("s1", "end") - F.col("start")
    return both.select(page, "span", "seq", *slice_rect(first, last))


def upper_median(values: Column) -> Column:
    """The element at half the count, rounded down, of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


RECTS = "array<struct<x:double,y:double,w:double,h:double>>"


def merge_rects(rects: Column, gap: Column) -> Column:
    """Rectangles of one line that are at most `gap` apart, as one: a fold by
    y and x, again and again until nothing joins."""

    def near(a: Column, b: Column) -> Column:
        line = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]) >= F.least(a["h"], b["h"]) * 0.5
        return line & (F.greatest(a["x"], b["x"]) - F.least(a["x"] + a["w"], b["x"] + b["w"]) <= gap)

    def joined(a: Column, b: Column) -> Column:
        x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
        return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))

    def step(out: Column, r: Column) -> Column:
        hit = F.filter(out, lambda k: near(k, r))
        rest = F.filter(out, lambda k: ~near(k, r))
        return F.concat(rest, F.array(F.aggregate(hit, r, joined)))

    by_place = F.array_sort(F.transform(rects, lambda r: F.struct(r["y"].alias("y0"), r["x"].alias("x0"), r.alias("r"))))
    start = F.transform(by_place, lambda r: r["r"])
    # a pass joins at least one pair or changes nothing, so as many passes as
    # rectangles reach the end
    once = lambda acc: F.aggregate(acc, F.array().cast(RECTS), step)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(rects), F.lit(1))), start, lambda acc, _: once(acc))


def boxes_for_spans(rects: DataFrame, page: str = "page") -> DataFrame:
    """Boxes to paint for each span: parts of a line joined over gaps of 0.6
    of the median height, and padded by 0.12 and 0.04 of it."""
    one = F.struct("x", "y", "w", "h")
    lists = rects.groupBy(page, "span").agg(F.array_sort(F.collect_list(one)).alias("r"))
    lists = lists.withColumn("m", upper_median(F.transform("r", lambda r: r["h"])))
    merged = lists.select(page, "span", "m", F.inline(merge_rects(F.col("r"), F.col("m") * 0.6)))
    return merged.select(page, "span", (F.col("x") - F.col("m") * 0.12).alias("x"), (F.col("y") - F.col("m") * 0.04).alias("y"), (F.col("w") + F.col("m") * 0.24).alias("w"), (F.col("h") + F.col("m") * 0.08).alias("h"))


def union_rects(rects: DataFrame, by: list[str]) -> DataFrame:
    x, y = F.min("x"), F.min("y")
    return rects.groupBy(*by).agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def reading_order(words: Column) -> Column:
    """Words in lines, lines downwards: a word starts a line when it is more
    than half a height below the first word of the line."""
    by_y = F.array_sort(F.transform(words, lambda r: F.struct(r["y"].alias("y"), r["x"].alias("x"), r["seq"].alias("seq"), r["h"].alias("h"))))
    kind = "array<struct<line:int,y:double,h:double,x:double,seq:long>>"

    def step(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        new = (F.size(out) == 0) | (r["y"] - last["y"] > F.greatest(r["h"], last["h"]) * 0.5)
        line = F.when(F.size(out) == 0, 0).otherwise(last["line"] + new.cast("int"))
        item = F.struct(line.alias("line"), F.when(new, r["y"]).otherwise(last["y"]).alias("y"), F.when(new, r["h"]).otherwise(last["h"]).alias("h"), r["x"].alias("x"), r["seq"].alias("seq"))
        return F.concat(out, F.array(item))

    placed = F.aggregate(by_y, F.array().cast(kind), step)
    return F.transform(F.array_sort(F.transform(placed, lambda p: F.struct(p["line"].alias("line"), p["x"].alias("x"), p["seq"].alias("seq")))), lambda p: p["seq"])


# ---- items from matrices ----


def compose(first: Column, then: Column) -> Column:
    """The matrix (a, b, c, d, e, f) of `first` followed by `then`."""
    m, v = (lambda i: F.get(then, F.lit(i))), (lambda i: F.get(first, F.lit(i)))
    linear = [m(r) * v(2 * k) + m(r + 2) * v(2 * k + 1) for k in (0, 1) for r in (0, 1)]
    return F.array(*linear, m(0) * v(4) + m(2) * v(5) + m(4), m(1) * v(4) + m(3) * v(5) + m(5))


def placed_items(items: DataFrame, view: Column, scale: Column) -> DataFrame:
    """Runs of text on the page as drawn: items with columns str, matrix,
    width, height become x, y (of the baseline's start), w, h (the composed
    matrix's vertical scale, or the item's height if that is zero) and angle
    (how the run is turned). Items without text or matrix go."""
    real = items.where(F.col("str").isNotNull() & F.col("matrix").isNotNull())
    x = real.withColumn("_m", compose(F.col("matrix"), view))
    at = lambda i: F.get("_m", F.lit(i))
    tall = F.hypot(at(2), at(3))
    out = x.withColumn("x", at(4)).withColumn("y", at(5)).withColumn("w", F.col("width") * scale)
    out = out.withColumn("h", F.when(tall == 0, F.col("height") * scale).otherwise(tall)).withColumn("angle", F.atan2(at(1), at(0)))
    return out.drop("_m")


# ---- clusters and roles ----


def page_gaps(page_w: float, page_h: float) -> tuple[float, float]:
    """How far apart tokens of one cluster may lie, across and down."""
    return max(24.0, page_w * 0.04), max(18.0, page_h * 0.03)


def clusters(tokens: DataFrame, page: str, gap_x: float, gap_y: float) -> DataFrame:
    """(page, seq, cluster): tokens with an area that lie at most so far apart
    across and down, directly or by others; a cluster's name is its least seq. A
    page's tokens are one group of Arrow rows; a page is bounded, the number of
    pages isn't."""
    kind = dict(tokens.dtypes)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        x, y, w, h = (pdf[c].to_numpy(float) for c in ("x", "y", "w", "h"))
        own = np.arange(len(pdf))
        while True:
            new = own.copy()
            for i in range(len(pdf)):
                dx = np.maximum(x[i], x) - np.minimum(x[i] + w[i], x + w)
                dy = np.maximum(y[i], y) - np.minimum(y[i] + h[i], y + h)
                near = (dx <= gap_x) & (dy <= gap_y)
                new[i] = own[near].min() if near.any() else own[i]
            new = new[new]
            if np.array_equal(new, own):
                break
            own = new
        return pd.DataFrame({page: pdf[page], "seq": pdf["seq"], "cluster": pdf["seq"].to_numpy()[own]})

    real = tokens.where((F.col("w") > 0) & (F.col("h") > 0))
    return real.select(page, "seq", "x", "y", "w", "h").groupBy(page).applyInPandas(label, f"{page} {kind[page]}, seq {kind['seq']}, cluster {kind['seq']}")


def profiles(tokens: DataFrame, page: str, by: str) -> DataFrame:
    """Counts of token kinds and the bounds of each cluster."""
    kinds = {k: F.count_if(t.token_kind(F.col("str")).isin(*own)).alias(f"n_{k}") for k, own in {"digit": ["digit"], "contact": ["contact"], "role": ["role"], "short": ["short"], "long": ["long"], "word": ["word", "empty"]}.items()}
    x, y = F.min("x"), F.min("y")
    return tokens.groupBy(page, by).agg(
        F.count("*").alias("n"), *kinds.values(), x.alias("x"), y.alias("y"), F.greatest(F.max(F.col("x") + F.col("w")) - x, F.lit(1.0)).alias("w"), F.greatest(F.max(F.col("y") + F.col("h")) - y, F.lit(1.0)).alias("h")
    )


def role_and_score(share_of_page: Column) -> Column:
    """(role, score) of a cluster by its profile, first match wins."""
    n, digit = F.col("n"), F.col("n_digit") / F.col("n")
    short = (F.col("n_short") + F.col("n_digit")) / n
    is_ = lambda role, score: F.struct(F.lit(role).alias("role"), F.round(score, 9).alias("score"))
    return (
        F.when((F.col("n_contact") >= 1) | ((F.col("n_role") >= 1) & (digit < 0.35) & (n <= 12)), is_("contact", F.lit(0.85) + F.least(F.lit(0.1), F.col("n_contact") * 0.05)))
        .when((n >= 4) & (digit >= 0.55), is_("chart", F.lit(0.7) + F.least(F.lit(0.25), digit)))
        .when((n >= 6) & (digit >= 0.4) & (share_of_page >= 0.08), is_("chart", F.lit(0.65)))
        .when((n >= 8) & (short >= 0.5) & (F.col("n_long") == 0) & (digit < 0.45), is_("logo_grid", F.lit(0.7)))
        .when((F.col("n_long") >= 1) | ((F.col("n_word") >= 3) & (digit < 0.3) & (short < 0.5)), is_("body", F.lit(0.7)))
        .otherwise(is_("other", F.lit(0.4)))
    )


def regions(tokens: DataFrame, page: str, page_w: float, page_h: float) -> DataFrame:
    """(page, seq, role, score, n, x, y, w, h): the clusters of two tokens or
    more, and single contacts, with 8 pixels around them within the page."""
    width, height = max(1, int(page_w)), max(1, int(page_h))
    found = profiles(tokens.join(clusters(tokens, page, *page_gaps(width, height)), [page, "seq"]), page, "cluster")
    found = found.withColumn("r", role_and_score(F.col("w") * F.col("h") / (width * height))).where("n >= 2 or r.role = 'contact'")
    left, top = F.greatest(F.floor(F.col("x") - 8), F.lit(0)), F.greatest(F.floor(F.col("y") - 8), F.lit(0))
    right, bottom = F.least(F.ceil(F.col("x") + F.col("w") + 8), F.lit(width)), F.least(F.ceil(F.col("y") + F.col("h") + 8), F.lit(height))
    box = [left.alias("x"), top.alias("y"), F.greatest(right - left, F.lit(1)).alias("w"), F.greatest(bottom - top, F.lit(1)).alias("h")]
    return found.select(page, F.col("cluster").alias("seq"), "r.role", "r.score", "n", *[b.cast("double").alias(c) for b, c in zip(box, ("x", "y", "w", "h"))])


ROLES = ("chart", "body", "contact", "logo_grid", "other")


def page_hint(found: DataFrame, page: str) -> DataFrame:
    """The role with the greatest area times score; ties by a fixed order."""
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    total = found.groupBy(page, "role").agg(F.round(F.sum(F.col("w") * F.col("h") * F.col("score")), 6).alias("weight"))
    return total.groupBy(page).agg(F.max_by("role", F.struct("weight", -rank)).alias("hint"))


def role_at(points: DataFrame, found: DataFrame, page: str) -> DataFrame:
    """Role under each box, null if there is none. A page's regions are seen
    in order: one that holds the box's centre is taken if none is, or if it
    scores better than the one taken; one that covers more of the box than all
    before, and half of it or more, is taken whatever was. So the last region to
    raise the largest overlap to a half or more begins the count anew."""
    p = points.select(page, "id", *[F.col(c).alias(f"p{c}") for c in ("x", "y", "w", "h")])
    r = found.select(page, "role", "score", F.col("seq").alias("rs"), *[F.col(c).alias(f"r{c}") for c in ("x", "y", "w", "h")])
    cx, cy = F.col("px") + F.col("pw") / 2, F.col("py") + F.col("ph") / 2
    inside = cx.between(F.col("rx"), F.col("rx") + F.col("rw")) & cy.between(F.col("ry"), F.col("ry") + F.col("rh"))
    own = overlap("p", "r") / F.greatest(F.col("pw") * F.col("ph"), F.lit(1.0))
    seen = p.join(r, page).withColumn("in", inside).withColumn("o", own).where("in or o > 0")
    most = F.coalesce(F.max("o").over(Window.partitionBy(page, "id").orderBy("rs").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    seen = seen.withColumn("wins", (F.col("o") > most) & (F.col("o") >= 0.5))
    anew = F.max(F.when(F.col("wins"), F.col("rs"))).over(Window.partitionBy(page, "id"))
    seen = seen.withColumn("anew", anew).where("anew is null or rs >= anew").where("in or rs = anew")
    # from there on the best score, the first of equals
    best = seen.groupBy(page, "id").agg(F.max_by("role", F.struct("score", -F.col("rs"))).alias("role"))
    return points.select(page, "id").join(best, [page, "id"], "left")


def short_acronym_allowed(term: Column, role_: Column, hint: Column) -> Column:
    """Shapes of words of up to three letters match parts of longer marks, so
    they don't count in a logo grid, nor on a page that is one."""
    letters = F.length(F.regexp_replace(term, "[^A-Za-z]", ""))
    return ~letters.between(1, 3) | ~(F.coalesce(role_ == "logo_grid", F.lit(False)) | F.coalesce(hint == "logo_grid", F.lit(False)))


def detector_allowed(kind: Column, role_: Column) -> Column:
    """Charts make false phones and addresses, logo grids phones and names."""
    banned = ((role_ == "chart") & kind.isin("phone", "address")) | ((role_ == "logo_grid") & kind.isin("phone", "person"))
    return ~F.coalesce(banned, F.lit(False))
