"""Pictures: relational operators on small planes, and NumPy kernels for the
real ones (rows of bytes with width and height; never a row for each pixel)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- relational, on rows (page, x, y, v) ----


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def prefix_sums(px: DataFrame, page: str) -> DataFrame:
    """Sum of all pixels up and left of each, by two running sums."""
    row = Window.partitionBy(page, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    col = Window.partitionBy(page, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return px.withColumn("s", F.sum("v").over(row)).withColumn("s", F.sum("s").over(col))


def correlate(px: DataFrame, template: DataFrame, page: str) -> DataFrame:
    """Zero-mean normalised cross-correlation at every place where the
    template fits; places without variance are skipped, and a template
    without any gives nothing. template: (tx, ty, tv), small, broadcast."""
    stats = template.agg(F.avg("tv").alias("m"), F.var_pop("tv").alias("tvar"), F.count("*").alias("n"), F.max("tx").alias("mx"), F.max("ty").alias("my")).where("tvar * n >= 1e-6")
    t = template.crossJoin(F.broadcast(stats))
    size = px.groupBy(page).agg(F.max("x").alias("px"), F.max("y").alias("py"))
    hit = px.join(F.broadcast(t)).withColumn("ox", F.col("x") - F.col("tx")).withColumn("oy", F.col("y") - F.col("ty"))
    hit = hit.where("ox >= 0 and oy >= 0").join(size, page).where("ox + mx <= px and oy + my <= py")
    sums = hit.groupBy(page, "ox", "oy", "tvar", "n").agg(F.sum(F.col("v") * (F.col("tv") - F.col("m"))).alias("num"), F.var_pop("v").alias("pvar"))
    return sums.where("pvar * n >= 1e-6").select(page, F.col("ox").alias("x"), F.col("oy").alias("y"), (F.col("num") / (F.col("n") * F.sqrt(F.col("tvar") * F.col("pvar")))).alias("score"))


def cell_variance(px: DataFrame, page: str, cell: int) -> DataFrame:
    return px.groupBy(page, F.expr(f"x div {cell}").alias("cx"), F.expr(f"y div {cell}").alias("cy")).agg(F.var_pop("v").alias("var"))


def value_mode(px: DataFrame, page: str, bins: int = 8) -> DataFrame:
    """The fullest bin of values; the lowest among equals."""
    n = px.groupBy(page, F.floor(F.col("v") / bins).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return n.groupBy(page).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"))


def busy_share(px: DataFrame, page: str, step: float) -> DataFrame:
    """Share of pixels that differ from the one to the right by `step`."""
    w = Window.partitionBy(page, "y").orderBy("x")
    return px.withColumn("d", F.abs(F.lead("v").over(w) - F.col("v"))).where("d is not null").groupBy(page).agg(F.avg((F.col("d") >= step).cast("double")).alias("busy"))


def skew(px: DataFrame, page: str, dark: float, angles: list[float]) -> DataFrame:
    """The angle whose row profile of dark pixels varies most; the first among equals."""
    a = px.sparkSession.createDataFrame([(i, x) for i, x in enumerate(angles)], "i int, angle double")
    rows = px.where(F.col("v") < dark).join(F.broadcast(a)).withColumn("row", F.round(F.col("y") - F.col("x") * F.tan(F.radians("angle"))).cast("long"))
    n = rows.groupBy(page, "i", "angle", "row").agg(F.count("*").alias("n"))
    var = n.groupBy(page, "i", "angle").agg(F.round(F.sum(F.col("n") * F.col("n")).cast("double"), 6).alias("power"))
    return var.groupBy(page).agg(F.max_by("angle", F.struct("power", -F.col("i"))).alias("angle"))


def index_quantile(values: Column, share: float) -> Column:
    """The sorted value at share of the count, rounded down; not interpolated."""
    return F.get(F.array_sort(values), F.least(F.floor(F.size(values) * share), F.size(values) - 1).cast("int"))


# Steps of the scales near and far from 1, where the near ones end, the
# least area and short side of a copy in pixels, and the largest copy.
NEAR_STEP, FAR_STEP, NEAR_LOW, NEAR_HIGH = 1.08, 1.25, 0.7, 1.6
COPY_AREA, COPY_SHORT, COPY_MOST = 400, 6, 4.0
# Working sizes (long side wanted, least short side, most long side,
# short side under which the length gives way), and the aspect of wide marks.
COARSE, COARSE_WIDE, FINE, NATIVE, WIDE = (20, 7, 96, 4), (20, 12, 160, 6), (40, 10, 160, 6), (160, 12, 160, 6), 3


def _steps(start: float, by: float, inside) -> list[float]:
    """start * by, start * by * by, ... as long as they lie inside."""
    out, s = [], start * by
    while inside(s):
        out.append(s)
        s *= by
    return out


def ladder(low: float, high: float) -> list[float]:
    """Scales around 1, to three decimals: steps of 8 % from 0.7 to 1.6; of 25 %
    outside, counted from the last near one as it is written."""
    short = lambda xs: [round(x, 3) for x in xs]
    down, up = short(_steps(1.0, 1 / NEAR_STEP, lambda s: s >= NEAR_LOW)), short(_steps(1.0, NEAR_STEP, lambda s: s <= NEAR_HIGH))
    down += short(_steps(down[-1], 1 / FAR_STEP, lambda s: s >= low))
    up += short(_steps(up[-1], FAR_STEP, lambda s: s <= high + 0.001))
    return [s for s in [*reversed(down), 1.0, *up] if low * 0.999 <= s <= high * 1.001]


def scales_for(width: float, height: float, least_area: float = COPY_AREA, most: float = COPY_MOST) -> list[float]:
    """The scales at which copies of a mark are looked for: none so small that
    it has too little area or too short a side; 1 is always among them."""
    if min(width, height) <= 0:
        return ladder(0.24, COPY_MOST)
    low = max((least_area / max(1, width * height)) ** 0.5, COPY_SHORT / min(width, height))
    return ladder(min(low, 1.0), max(most, 1.0))


def working_scale(width: Column, height: Column, size: tuple[int, int, int, int]) -> Column:
    """How much a mark is shrunk to be worked on: to the long side wanted, less
    if its short side would get too small, more if its long side stays too
    large, though never so that nothing is left of the short side. Marks are
    not enlarged. 0 for a mark without area."""
    target, least_short, most_long, floor_short = size
    long, short = F.greatest(width, height), F.least(width, height)
    scale = F.greatest(F.least(F.greatest(target / long, least_short / short), most_long / long), floor_short / short)
    return F.when((long > 0) & (short > 0), F.least(F.lit(1.0), scale)).otherwise(0.0)


def coarse_scale(width: Column, height: Column) -> Column:
    """working_scale() of the coarse stage: wide marks keep more of their height."""
    wide = (F.least(width, height) > 0) & (F.greatest(width, height) >= WIDE * F.least(width, height))
    return F.when(wide, working_scale(width, height, COARSE_WIDE)).otherwise(working_scale(width, height, COARSE))


def ground_colour(px: DataFrame, page: str) -> DataFrame:
    """(page, r, g, b): the commonest colour along a picture's edge, in steps
    of 16 and given as the middle of its step; a corner belongs to two edges. Of
    colours that are as common the first met stays: along the top and bottom,
    column by column, then along the sides. px: (page, x, y, r, g, b)."""
    size = px.groupBy(page).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    x = px.join(size, page)
    across = F.when(F.col("y") == 0, F.array(F.col("x") * 2)).otherwise(F.array().cast("array<long>"))
    across = F.concat(across, F.when(F.col("y") == F.col("h") - 1, F.array(F.col("x") * 2 + 1)).otherwise(F.array().cast("array<long>")))
    start = F.col("w") * 2
    down = F.when(F.col("x") == 0, F.array(start + F.col("y") * 2)).otherwise(F.array().cast("array<long>"))
    down = F.concat(down, F.when(F.col("x") == F.col("w") - 1, F.array(start + F.col("y") * 2 + 1)).otherwise(F.array().cast("array<long>")))
    step = [F.floor(F.col(c) / 16).cast("int").alias(c) for c in ("r", "g", "b")]
    met = x.select(page, *step, F.explode(F.concat(across.cast("array<long>"), down.cast("array<long>"))).alias("at"))
    count = met.groupBy(page, "r", "g", "b").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = count.groupBy(page).agg(F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("first"))).alias("c"))
    return best.select(page, *[(F.col(f"c.{k}") * 16 + 8).alias(k) for k in ("r", "g", "b")])


# What makes a page coarse and a template tiny, and the factors.
COARSE_DPI, TINY_SIDE, COARSE_FACTOR, SMALL_TEXT_FACTOR = 150, 12, 2.0, 1.5


def upscale(short_side: Column, dpi: Column, small_text: Column | None = None, allow: Column | None = None, allow_small_text: Column | None = None) -> Column:
    """How much a page is enlarged for a second look: coarse pages and tiny
    templates most (where that is allowed), small text less. A missing or zero
    number says nothing."""
    coarse = F.coalesce((dpi > 0) & (dpi < COARSE_DPI), F.lit(False)) | F.coalesce((short_side > 0) & (short_side < TINY_SIDE), F.lit(False))
    most = coarse if allow is None else coarse & allow
    small = F.lit(False) if small_text is None else F.coalesce(small_text, F.lit(False))
    if allow_small_text is not None:
        small = small & allow_small_text
    return F.when(most, COARSE_FACTOR).when(small, SMALL_TEXT_FACTOR).otherwise(1.0)


def ink_correlation(px: DataFrame, page: str) -> DataFrame:
    """Pearson correlation of colours (r, g, b) and (tr, tg, tb) over ink, all
    channels as one series."""
    long = px.where("ink").select(page, F.explode(F.array(*[F.struct(F.col(c).alias("a"), F.col("t" + c).alias("b")) for c in "rgb"])).alias("s"))
    return long.groupBy(page).agg(F.corr("s.a", "s.b").alias("corr"))


# ---- NumPy kernels ----


def shrink(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area average down to w x h."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        cells = np.arange(n)[None, :]
        share = np.clip(np.minimum(hi, cells + 1) - np.maximum(lo, cells), 0, None)
        return share / share.sum(axis=1, keepdims=True)

    return weights(a.shape[0], h) @ a @ weights(a.shape[1], w).T


def resize(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, at pixel centres."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, fy = axis(a.shape[0], h)
    x0, x1, fx = axis(a.shape[1], w)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + low * fy[:, None]


def trim(a: np.ndarray, margin: int = 1, tolerance: float = 18) -> np.ndarray:
    """Without the border that looks like its median."""
    border = np.sort(np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]]))
    ink = np.abs(a - border[len(border) // 2]) > tolerance
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    if not len(ys):
        return a
    return a[max(0, ys[0] - margin) : ys[-1] + 1 + margin, max(0, xs[0] - margin) : xs[-1] + 1 + margin]


def box_sums(a: np.ndarray, w: int, h: int) -> np.ndarray:
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(axis=0).cumsum(axis=1)
    return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]


def ncc_plane(page: np.ndarray, template: np.ndarray) -> np.ndarray | None:
    """Correlation at every place, by FFT in double precision; NaN where the
    page has no variance; None for a template that has none or doesn't fit."""
    th, tw = template.shape
    if th > page.shape[0] or tw > page.shape[1]:
        return None
    zero = template - template.mean()
    energy = float((zero * zero).sum())
    if energy < 1e-6:
        return None
    centred = page - page.mean()
    shape = [1 << int(np.ceil(np.log2(a + b - 1))) for a, b in zip(page.shape, template.shape)]
    num = np.fft.irfft2(np.fft.rfft2(centred, shape) * np.conj(np.fft.rfft2(zero, shape)), shape)[: page.shape[0] - th + 1, : page.shape[1] - tw + 1]
    total, square = box_sums(centred, tw, th), box_sums(centred * centred, tw, th)
    var = square - total * total / (th * tw)
    return np.divide(num, np.sqrt(np.maximum(var, 1e-12) * energy), out=np.full(num.shape, np.nan), where=var >= 1e-6)


def overlap(a: dict, b: dict) -> float:
    """Intersection over union of two boxes."""
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    both = max(w, 0) * max(h, 0)
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both)


def peaks(flat: np.ndarray, width: int, w: int, h: int, least: float, most: float, keep: int) -> list[int]:
    """The best places of one scale whose boxes overlap no better one's by more than `most`."""
    out: list[dict] = []
    good = np.flatnonzero(flat >= least)
    for i in good[np.argsort(-flat[good], kind="stable")]:
        box = {"i": int(i), "x": int(i % width), "y": int(i // width), "w": w, "h": h}
        if all(overlap(box, k) <= most for k in out):
            out.append(box)
            if len(out) == keep:
                break
    return [k["i"] for k in out]


def interleave(groups: list[list], limit: int) -> list:
    """The best of every group before the second of any."""
    depth = max((len(g) for g in groups), default=0)
    return [g[rank] for rank in range(depth) for g in groups if rank < len(g)][:limit]


def find_template(page: np.ndarray, template: np.ndarray, scales: list[float], bar: float = 0.75, limit: int = 110) -> list[dict]:
    """Hits of a template at any of the scales: coarse on pages of half size
    (8 places of each scale that don't overlap), then `limit` of them, from
    the scales in turn, again in full, then without overlaps."""
    half = shrink(page, max(1, page.shape[1] // 2), max(1, page.shape[0] // 2))
    nominated = []
    for s in scales:
        h, w = (max(4, round(n * s)) for n in template.shape)
        small = resize(template, max(2, w // 2), max(2, h // 2))
        plane = ncc_plane(half, small)
        if plane is None:
            continue
        flat = np.nan_to_num(np.abs(plane), nan=0).ravel()
        best = peaks(flat, plane.shape[1], small.shape[1], small.shape[0], 0.4, 0.4, 8)
        nominated.append([(s, i // plane.shape[1] * 2, i % plane.shape[1] * 2) for i in best])
    hits = []
    for s, y, x in interleave(nominated, limit):
        h, w = (max(4, round(n * s)) for n in template.shape)
        y0, x0 = max(0, y - 4), max(0, x - 4)
        plane = ncc_plane(page[y0 : y + h + 5, x0 : x + w + 5], resize(template, w, h))
        if plane is None or np.isnan(plane).all():
            continue
        i = int(np.nanargmax(np.abs(plane)))
        v = float(plane.ravel()[i])
        if abs(v) >= bar:
            hits.append({"x": x0 + i % plane.shape[1], "y": y0 + i // plane.shape[1], "w": w, "h": h, "score": abs(v), "scale": s, "inverted": v < 0})
    kept: list[dict] = []
    for hit in sorted(hits, key=lambda k: (-k["score"], k["y"], k["x"])):
        if all(overlap(k, hit) <= 0.3 for k in kept):
            kept.append(hit)
    return kept


HIT = "template string, x long, y long, w long, h long, score double, scale double, inverted boolean"


def search_pages(pages: DataFrame, templates: list[tuple[str, np.ndarray]], key: str = "page", scales: tuple[float, float] = (0.7, 1.6)) -> DataFrame:
    """Hits of all templates on pages (key, w, h, px: bytes of doubles). The
    templates, a short list, go with the task; a page is decoded once."""
    steps = ladder(*scales)
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, w, h, px in zip(pdf[key], pdf["w"], pdf["h"], pdf["px"]):
                page = np.frombuffer(px, np.float64).reshape(int(h), int(w))
                for name, t in templates:
                    rows += [(k, name, *(hit[c] for c in ("x", "y", "w", "h", "score", "scale", "inverted"))) for hit in find_template(page, t, steps)]
            yield pd.DataFrame(rows, columns=[key, "template", "x", "y", "w", "h", "score", "scale", "inverted"])

    return pages.select(key, "w", "h", "px").mapInPandas(run, f"{key} {kind}, {HIT}")
