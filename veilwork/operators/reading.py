"""Tables of read words: duplicates, ghosts, replacements, gaps; suppression
of overlapping hits; scores against an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.operators.layout import covered, iou, overlap, overlap_of_smaller


def _as(df: DataFrame, prefix: str, page: str, *more: str) -> DataFrame:
    return df.select(page, *[F.col(c).alias(prefix + c) for c in ("seq", "x", "y", "w", "h", *more)])


def drop_twins(words: DataFrame, page: str) -> DataFrame:
    """Of words with one text that overlap by half, the surer stays, among
    equals the first: a word goes if a better twin is there."""
    a, b = _as(words, "a", page, "str", "confidence"), _as(words, "b", page, "str", "confidence")
    better = (F.col("bconfidence") > F.col("aconfidence")) | ((F.col("bconfidence") == F.col("aconfidence")) & (F.col("bseq") < F.col("aseq")))
    twins = a.join(b, (a[page] == b[page]) & (F.col("astr") == F.col("bstr")) & (F.col("aseq") != F.col("bseq"))).where(better & (overlap_of_smaller("a", "b") >= 0.5))
    return words.join(twins.select(a[page], F.col("aseq").alias("seq")).distinct(), [page, "seq"], "left_anti")


def _letters(c: str) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def drop_ghosts(words: DataFrame, page: str) -> DataFrame:
    """Scraps of two letters and digits at most, unsure, that lie by 0.6 in a
    sure word of three or more."""
    ghost = words.where((_letters("str") <= 2) & (F.col("confidence") < 60))
    sure = words.where((_letters("str") >= 3) & (F.col("confidence") >= 60))
    hit = _as(ghost, "a", page).join(_as(sure, "b", page), page).where(covered("a", "b") >= 0.6)
    return words.join(hit.select(page, F.col("aseq").alias("seq")).distinct(), [page, "seq"], "left_anti")


def keep_new(old: DataFrame, new: DataFrame, page: str, share: float = 0.3) -> DataFrame:
    """New words that no old word overlaps by `share`, seen from either."""
    hit = _as(new, "a", page).join(_as(old, "b", page), page).where((covered("a", "b") >= share) | (covered("b", "a") >= share))
    return new.join(hit.select(page, F.col("aseq").alias("seq")).distinct(), [page, "seq"], "left_anti")


def replace_words(old: DataFrame, new: DataFrame, page: str, margin: float = 10) -> DataFrame:
    """What a second reading adds: words with a letter or digit that overlap
    no old word by 0.3, seen from either, and those that are surer by the margin
    than the surest old word they overlap, which they replace. A word without a
    confidence counts as sure."""
    a = new.select(page, *[F.col(c).alias(f"a{c}") for c in ("seq", "x", "y", "w", "h", "confidence")])
    b = old.select(page, *[F.col(c).alias(f"b{c}") for c in ("seq", "x", "y", "w", "h")], F.coalesce("confidence", F.lit(100.0)).alias("bconfidence"))
    new = new.where(_letters("str") > 0)
    hits = a.join(b, page).where((covered("a", "b") >= 0.3) | (covered("b", "a") >= 0.3))
    best = hits.groupBy(page, "aseq").agg(F.max("bconfidence").alias("surest"), F.max("aconfidence").alias("own"))
    loses = best.where(~F.coalesce(F.col("own") >= F.col("surest") + margin, F.lit(False))).select(page, F.col("aseq").alias("seq"))
    used = new.join(loses, [page, "seq"], "left_anti").select(page, "seq")
    gone = hits.join(used.withColumnRenamed("seq", "aseq"), [page, "aseq"]).select(page, F.col("bseq").alias("seq")).distinct()
    return old.join(gone, [page, "seq"], "left_anti").withColumn("source", F.lit("old")).unionByName(new.join(used, [page, "seq"], "left_semi").withColumn("source", F.lit("new")))


def keep_inverted(found: DataFrame, primary: DataFrame, page: str) -> DataFrame:
    """Words read on an inverted band that the first reading doesn't have: two
    letters side by side, a confidence of 50 or none, no first word that covers
    0.45 of it, and none with the same letters near by."""
    said = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    fit = found.where(F.col("str").rlike("[A-Za-z]{2,}") & F.coalesce(F.col("confidence") >= 50, F.lit(True)))
    a, b = _as(fit, "a", page, "str"), _as(primary, "b", page, "str")
    near = (F.abs(F.col("by") - F.col("ay")) < F.greatest("bh", "ah") * 1.2) & (F.abs(F.col("bx") - F.col("ax")) < F.greatest("bw", "aw") * 1.5)
    hit = a.join(b, page).where((covered("a", "b") >= 0.45) | ((said("astr") == said("bstr")) & near))
    return fit.join(hit.select(page, F.col("aseq").alias("seq")).distinct(), [page, "seq"], "left_anti")


def suppress(hits: Column, cutoff: float = 0.3) -> Column:
    """Of an array of (score, seq, x, y, w, h) those that no better one
    overlaps by more than the cutoff: a greedy fold by score."""
    ordered = F.array_sort(F.transform(hits, lambda r: F.struct((-r["score"]).alias("o"), r["seq"].alias("seq"), r.alias("r"))))

    def clash(a: Column, b: Column) -> Column:
        w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
        h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
        both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
        union = a["w"] * a["h"] + b["w"] * b["h"] - both
        return F.when(union > 0, both / union).otherwise(0.0) > cutoff

    kind = "array<struct<score:double,seq:long,x:double,y:double,w:double,h:double>>"
    return F.aggregate(ordered, F.array().cast(kind), lambda kept, s: F.when(F.exists(kept, lambda k: clash(k, s["r"])), kept).otherwise(F.concat(kept, F.array(s["r"]))))


def interleave(hits: DataFrame, by: list[str], scale: str, per_scale: int = 8, limit: int = 110) -> DataFrame:
    """The best of each scale in turn: rank within the scale, then a limit
    over (rank, scale). The limits are the feature."""
    within = Window.partitionBy(*by, scale).orderBy(F.desc("score"), "seq")
    ranked = hits.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= per_scale)
    turn = Window.partitionBy(*by).orderBy("rank", scale, "seq")
    return ranked.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit)


def shortlist(hits: DataFrame, by: list[str], gate: float = 0.45, limit: int = 16) -> DataFrame:
    """What is verified: the best over the gate, and all seeds."""
    w = Window.partitionBy(*by, "seeded").orderBy(F.desc("score"), "seq")
    return hits.where(F.col("seeded") | (F.col("score") >= gate)).withColumn("rank", F.row_number().over(w)).where(F.col("seeded") | (F.col("rank") <= limit))


def score(truth: DataFrame, marks: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """(truth with found, marks with false_alarm). A place is found if a mark
    holds its centre or marks cover half of it; a mark is false if less than a
    tenth of it lies on places."""
    a, b = _as(truth, "a", page), _as(marks, "b", page)
    both = a.join(b, page).withColumn("o", overlap("a", "b"))
    cx, cy = F.col("ax") + F.col("aw") / 2, F.col("ay") + F.col("ah") / 2
    inside = cx.between(F.col("bx"), F.col("bx") + F.col("bw")) & cy.between(F.col("by"), F.col("by") + F.col("bh"))
    by_place = both.groupBy(page, F.col("aseq").alias("seq")).agg(F.bool_or(inside).alias("centre"), (F.sum("o") / F.max(F.col("aw") * F.col("ah"))).alias("share"))
    by_mark = both.groupBy(page, F.col("bseq").alias("seq")).agg((F.sum("o") / F.max(F.col("bw") * F.col("bh"))).alias("share"))
    found = truth.join(by_place, [page, "seq"], "left").withColumn("found", F.coalesce(F.col("centre") | (F.col("share") >= 0.5), F.lit(False))).drop("centre", "share")
    alarms = marks.join(by_mark, [page, "seq"], "left").withColumn("false_alarm", F.coalesce(F.col("share") < 0.1, F.lit(True))).drop("share")
    return found, alarms


def compare_runs(baseline: DataFrame, run: DataFrame) -> DataFrame:
    """name, lost, gained (places), more_alarms, status: a full outer join."""
    b = baseline.select("name", F.col("found").alias("bf"), F.col("alarms").alias("ba"))
    r = run.select("name", F.col("found").alias("rf"), F.col("alarms").alias("ra"))
    x = b.join(r, "name", "full_outer")
    lost, gained = F.size(F.array_except("bf", "rf")), F.size(F.array_except("rf", "bf"))
    status = F.when(F.col("bf").isNull(), "new").when(F.col("rf").isNull(), "gone").when((lost > 0) | (F.col("ra") > F.col("ba")), "worse").otherwise("kept")
    return x.select("name", F.coalesce(lost, F.lit(0)).cast("long").alias("lost"), F.coalesce(gained, F.lit(0)).cast("long").alias("gained"), F.coalesce(F.greatest(F.col("ra") - F.col("ba"), F.lit(0)), F.lit(0)).cast("long").alias("more_alarms"), status.alias("status"))


def best_mark(words: DataFrame, marks: DataFrame, page: str) -> DataFrame:
    """For each word the mark with the greatest IoU."""
    both = _as(words, "a", page).join(_as(marks, "b", page), page).withColumn("o", iou("a", "b")).where("o > 0")
    return both.groupBy(page, F.col("aseq").alias("seq")).agg(F.max_by("bseq", F.struct("o", -F.col("bseq"))).alias("mark"), F.round(F.max("o"), 9).alias("iou"))
