"""Placeholders: one label for all mentions of a thing, numbered by first
appearance in its document. The legend can be published; the key can't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions import text as t

# Categories with the prefix of their labels and their description.
CATEGORIES = (
    ("person", "P", "a person's name"),
    ("term", "T", "a term chosen by the reviewer"),
    ("email", "E", "an email address"),
    ("phone", "PH", "a telephone number"),
    ("url", "U", "a web address"),
    ("address", "A", "a street address"),
    ("logo", "L", "a logo or other image"),
    ("manual", "R", "a region covered by hand"),
)


def identity(kind: Column, text: Column, term: Column, template: Column | None = None, own: Column | None = None) -> Column:
    """What counts as the same thing: kind and the text, whatever its case and
    white space; of a term what was typed; of a picture its template; a region
    covered by hand is a thing of its own."""
    value = F.when(kind == "term", F.coalesce(term, text)).otherwise(F.coalesce(text, F.lit("")))
    out = F.concat(kind, F.lit(":"), t.squeeze(F.lower(value)))
    if template is not None:
        out = F.when(kind == "image", F.concat(F.lit("logo:"), template.cast("string"))).otherwise(out)
    return out if own is None else F.when(kind == "manual", F.concat(F.lit("manual:"), own.cast("string"))).otherwise(out)


def _lookup(kind: Column, at: int) -> Column:
    out = F
    for row in CATEGORIES:
        out = out.when(kind == row[0], row[at])
    return out


def _identified(spans: DataFrame) -> DataFrame:
    have = lambda name: F.col(name) if name in spans.columns else None
    return spans.withColumn("identity", identity(F.col("kind"), F.col("text"), F.col("term"), have("template_id"), have("id")))


def category_of(kind: Column, name: Column) -> Column:
    """A term of which a mention looks like a name is a person; pictures are
    logos; what has no category counts as covered by hand."""
    known = [row[0] for row in CATEGORIES]
    return F.when(kind == "term", F.when(name, "person").otherwise("term")).when(kind == "image", "logo").when(kind.isin(known), kind).otherwise("manual")


def _is_name() -> Column:
    return (F.col("kind") == "term") & t.looks_like_name(F.coalesce("term", "text"))


def assign(spans: DataFrame, doc: str, overrides: DataFrame | None = None) -> DataFrame:
    """One row per document and thing: identity, category, description,
    suggested, label (the override's, if there is one that isn't empty), value
    (of the first mention; of a term what was typed), count, first. `overrides`
    is what a person typed (identity, label)."""
    value = F.when(F.col("kind") == "term", F.coalesce("term", "text")).otherwise(F.coalesce("text", F.lit("")))
    groups = (
        _identified(spans)
        .groupBy(doc, "identity")
        .agg(F.min("start").alias("first"), F.count("*").alias("count"), F.min_by(value, "start").alias("value"), F.first("kind").alias("kind"), F.bool_or(_is_name()).alias("name"))
    )
    groups = groups.withColumn("category", category_of(F.col("kind"), F.col("name")))
    order = Window.partitionBy(doc, "category").orderBy("first", "identity")
    groups = groups.withColumn("suggested", F.concat(_lookup(F.col("category"), 1), F.row_number().over(order).cast("string")))
    if overrides is not None:
        groups = groups.join(overrides.select("identity", F.col("label").alias("_own")), "identity", "left")
    label = F.col("suggested") if overrides is None else F.coalesce(F.nullif(t.normalise_label(F.col("_own")), F.lit("")), "suggested")
    return groups.select(doc, "identity", "category", _lookup(F.col("category"), 2).alias("description"), "suggested", label.alias("label"), "value", "count", "first")


def labelled(spans: DataFrame, doc: str) -> DataFrame:
    """The spans with their label: that of assign(), by windows over a
    document's spans, with no join."""
    same = Window.partitionBy(doc, "identity")
    x = _identified(spans).withColumn("_first", F.min("start").over(same)).withColumn("_name", F.bool_or(_is_name()).over(same))
    x = x.withColumn("_category", category_of(F.col("kind"), F.col("_name")))
    number = F.dense_rank().over(Window.partitionBy(doc, "_category").orderBy("_first", "identity"))
    return x.withColumn("label", F.concat(_lookup(F.col("_category"), 1), number.cast("string"))).drop("_first", "_name", "_category")


def legend(entries: DataFrame, doc: str) -> DataFrame:
    """What may be published: no value, no identity."""
    return entries.select(doc, "label", "description", "count")


def key(entries: DataFrame, doc: str) -> DataFrame:
    return entries.select(doc, "label", "value", "count")
