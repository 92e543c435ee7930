"""Sources: Parquet tables, text, JSON, HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON with a schema that is given, not inferred."""
    return spark.read.schema(schema).json(path)


# Entities that are decoded; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Text of a piece of HTML: no tags, entities decoded, white space squeezed."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sections(pages: DataFrame, key: str, html: str, block: str, head: str, body: str) -> DataFrame:
    """(key, pos, title, body): each `block` of a page that has a head; without
    one it is skipped. The three are patterns; block's group 1 is its inside,
    head's and body's group 1 the piece."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(1))).alias("pos", "inside"))
    title = F.regexp_extract("inside", head, 1)
    return found.where(F.col("inside").rlike(head)).select(key, F.col("pos").cast("long").alias("pos"), html_text(title).alias("title"), html_text(F.array_join(F.regexp_extract_all("inside", F.lit(body), F.lit(1)), " ")).alias("body"))


def page_dpi(px: Column, points: Column) -> Column:
    """Dots per inch of a page; null for a picture, which has no points."""
    return F.when(points.isNull() | (points <= 0), None).otherwise(px / points * 72)
