"""Smaller page operators: line ends, runs, fitting and wrapping of text,
phrase parts beside or under each other, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.operators import layout as lay

# Advance widths of Helvetica in thousandths, of U+0020 to U+007E.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
#: Of any other character that the encoding has.
OTHER_WIDTH = 556


def line_ends(words: DataFrame, page: str, order: str = "seq") -> DataFrame:
    """Adds has_eol: the next word lies on another line or further left."""
    w = Window.partitionBy(page).orderBy(order)
    nx, ny, nh = (F.lead(c).over(w) for c in ("x", "y", "h"))
    same = (F.abs(ny - F.col("y")) <= F.greatest("h", nh) * 0.5) & (nx >= F.col("x"))
    return words.withColumn("has_eol", ~F.coalesce(same, F.lit(False)))


def read_text(words: DataFrame, page: str, order: str = "seq") -> DataFrame:
    """Text of the words that aren't held back: a line break after a line's
    end, a blank after any other word."""
    piece = F.struct(F.col(order).alias("o"), F.concat("str", F.when(F.col("has_eol"), "\n").otherwise(" ")).alias("s"))
    return words.where("not held").groupBy(page).agg(F.rtrim(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "")).alias("text"))


def longest_runs(cols: DataFrame, by: list[str], bridge: int) -> DataFrame:
    """Longest run of inked columns that nothing covers; gaps of `bridge`
    blank columns at most are part of it. cols: (by, col, ink, covered)."""
    w = Window.partitionBy(*by).orderBy("col")
    marks = cols.where("ink or covered").withColumn("open", F.col("ink") & ~F.col("covered"))
    fresh = F.col("open") & (~F.coalesce(F.lag("open").over(w), F.lit(False)) | (F.col("col") - F.lag("col").over(w) - 1 > bridge))
    runs = marks.withColumn("run", F.sum(fresh.cast("int")).over(w)).where("open")
    return runs.groupBy(*by, "run").agg((F.max("col") - F.min("col") + 1).alias("n")).groupBy(*by).agg(F.max("n").cast("long").alias("longest"))


def label_size(width: Column, height: Column, chars: Column, least: int = 7, advance: float = 0.6) -> Column:
    """Size of a label in even-width letters that fits a box: from the
    smaller of 0.78 of the height and the width down in steps of one, null
    under `least`."""
    start = F.least(height * 0.78, width)
    steps = F.ceil(F.greatest((start * advance * chars - width * 0.92) / (advance * chars), F.lit(0.0)) - 1e-9)
    size = start - steps
    return F.when(size >= least, F.round(size, 6))


def text_width(text: Column, size: Column) -> Column:
    """Width in Helvetica; what the encoding hasn't got is dropped."""
    table = F.array(*map(F.lit, HELVETICA))
    code = lambda c: F.ascii(c)
    width = lambda c: F.when(code(c).between(32, 126), F.get(table, code(c) - 32)).when(code(c).between(160, 255), OTHER_WIDTH).otherwise(0)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + width(c)) * size / 1000


def wrap(text: Column, chars: int) -> Column:
    """Lines of at most so many characters, broken at blanks; a longer word
    has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def step(out: Column, w: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        fits = (F.size(out) > 0) & (F.length(last) + 1 + F.length(w) <= chars)
        return F.when(fits, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(out, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def beside(skipped: Column) -> Column:
    """Whether rectangle b goes on phrase a on its line (columns ax, ..., bh)."""
    h, w = F.greatest("ah", "bh"), F.greatest("aw", "bw")
    gap = F.col("bx") - F.col("ax") - F.col("aw")
    level = F.abs(F.col("ay") + F.col("ah") / 2 - F.col("by") - F.col("bh") / 2) <= h * 0.8
    return gap.between(-0.25 * w, w * (2.2 + 1.8 * skipped)) & level


def under() -> Column:
    """Whether b goes on phrase a on the line below."""
    h, w = F.greatest("ah", "bh"), F.greatest("aw", "bw")
    gap = F.col("by") - F.col("ay") - F.col("ah")
    shift = F.least(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("bx") + F.col("bw") / 2 - F.col("ax") - F.col("aw") / 2))
    return gap.between(-0.35 * h, 1.2 * h) & (shift <= w * 0.45)


def shape_first(hits: DataFrame, page: str, cutoff: float = 0.3) -> DataFrame:
    """Hits by shape, without overlaps, then those by ink alone that clash
    with none of them."""
    from veilwork.operators.reading import suppress

    one = F.struct("score", "seq", "x", "y", "w", "h")
    kept = lambda rows: rows.groupBy(page).agg(F.collect_list(one).alias("hs")).select(page, F.inline(suppress(F.col("hs"), cutoff)))
    shape, ink = kept(hits.where("not by_ink")), kept(hits.where("by_ink"))
    a = ink.select(page, *[F.col(c).alias("a" + c) for c in ("seq", "x", "y", "w", "h")])
    b = shape.select(page, *[F.col(c).alias("b" + c) for c in ("x", "y", "w", "h")])
    clash = a.join(b, page).where((lay.iou("a", "b") > cutoff) | (lay.covered("a", "b") > 0.5) | (lay.covered("b", "a") > 0.5))
    free = ink.join(clash.select(page, F.col("aseq").alias("seq")).distinct(), [page, "seq"], "left_anti")
    return shape.withColumn("by_ink", F.lit(False)).unionByName(free.withColumn("by_ink", F.lit(True)))


def hide_probe(pages: DataFrame, doc: str, page: str, flag: str) -> DataFrame:
    """Which pages are probed for hidden text - none after the first that
    could hide some - and whether a page could."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(flag).over(w), F.lit(False))
    return pages.withColumn("probed", ~before).withColumn("could_hide", before | F.col(flag))


def busy_cells(cells: DataFrame, page: str) -> DataFrame:
    """Cells (page, cx, cy, var) with more variance than three times the
    median cell (40 at least), and their neighbours."""
    from veilwork.operators.pixels import index_quantile

    floor = cells.groupBy(page).agg(F.greatest(F.lit(40.0), 3 * index_quantile(F.collect_list("var"), 0.5)).alias("floor"))
    busy = cells.join(floor, page).where("var > floor").select(page, "cx", "cy")
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    grown = busy.select(page, "cx", "cy", step.alias("dx")).select(page, "cx", "cy", "dx", step.alias("dy"))
    return grown.select(page, (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).distinct().join(cells.select(page, "cx", "cy"), [page, "cx", "cy"], "left_semi")
