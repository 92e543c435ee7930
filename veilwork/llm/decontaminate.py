"""Benchmark decontamination, with DataFrame functions only: short test items
inside long documents.

Items are partitioned by size. From each item's shingles the least m by a hash
are its MinHash sketch, where m comes from its partition's largest size: an
item that is contained to the threshold leaves so few shingles out that one of
any m must be in the document. Documents' shingles probe the index of
sketches; candidates are verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import Workspace, small

WORDS, CONTAINMENT = 5, 0.8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, h), one for every place of a shingle in the text."""
    w = df.select(*keys, words_of(F.col(text)).alias("w")).where(F.size("w") >= WORDS)
    shifted = [F.col("w"), *[F.slice("w", j + 1, F.size("w")) for j in range(1, WORDS)]]
    names = [f"w{j}" for j in range(WORDS)]
    zipped = F.arrays_zip(*[c.alias(n) for c, n in zip(shifted, names)])
    each = w.select(*keys, F.inline(zipped).alias(*names)).where(F.col(names[-1]).isNotNull())
    return each.select(*keys, F.xxhash64(*names).alias("h"))


def short_items(source: DataFrame) -> DataFrame:
    """(item, k, h): items of fewer than WORDS words, each whole."""
    w = source.select("item", words_of(F.col("text")).alias("w")).where(F.size("w").between(1, WORDS - 1))
    return w.select("item", F.size("w").alias("k"), F.xxhash64("w").alias("h")).distinct()


def runs(docs: DataFrame, k: int) -> DataFrame:
    """(doc, th, k, h) of all runs of k words."""
    w = docs.select("doc", "th", words_of(F.col("text")).alias("w")).where(F.size("w") >= k)
    at = w.select("doc", "th", "w", F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("at"))
    return at.select("doc", "th", F.lit(k).alias("k"), F.xxhash64(F.slice("w", F.col("at"), F.lit(k))).alias("h"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, size, h, rank, needed) of the sketches, from distinct rows
    (item, h). needed: so many of the sketch a document must hold."""
    sized = items.withColumn("size", F.count("*").over(Window.partitionBy("item")))
    # the partition's largest size: 1, 3, 7, 15, ...
    most = F.pow(F.lit(2), F.floor(F.log2("size")) + 1) - 1
    missing = lambda n: F.floor(n * (1 - threshold) + 1e-9)
    sized = sized.withColumn("m", F.least(missing(most) + 1, "size")).withColumn("order", F.xxhash64(F.lit(11), "h"))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("order", "h")))
    return ranked.where(F.col("rank") <= F.col("m")).select("item", "size", "h", "order", F.greatest(F.col("m") - missing(F.col("size")), F.lit(1)).alias("needed"))


def contamination(df: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = CONTAINMENT) -> DataFrame:
    """One row per document and item contained in it: the two id columns,
    containment (share of the item's distinct shingles that the document
    holds), n_shingles (of the item), th (hash of the document's text).

    An item of fewer than five words is one shingle, found where a document
    has its words side by side (n_shingles is 1). Null and empty items are never
    found, null and empty documents hold none; a text of any length is read
    whole. Of ties there are none: every item has its own row. Rows that repeat id and text are one document or
    item; items with one id are one item with all their shingles. A null id
    is an id like others. Empty tables give an empty one."""
    ws = Workspace(df.sparkSession, "decontaminate")
    t = F.col(text).cast("string")
    docs = df.select(F.col(doc).alias("doc"), F.xxhash64(t).alias("th"), t.alias("text"))
    source = benchmark.select(F.col(item).alias("id"), F.xxhash64(F.col(item)).alias("item"), F.col(item_text).cast("string").alias("text"))
    ids = ws.write(source.select("id", "item").distinct())
    items = ws.write(shingles(source, ["item"], "text").distinct())
    index = ws.write(sketches(items, threshold))
    last = index.agg(F.max("order")).first()[0]
    if last is None:
        last = -(1 << 63)
    probes = shingles(docs, ["doc", "th"], "text").where(F.xxhash64(F.lit(11), "h") <= F.lit(last))
    hits = probes.join(small(ws, index.select("item", "h", "needed").transform(ws.write)), "h").groupBy("doc", "th", "item", "needed", "h").count()
    found = ws.write(hits.groupBy("doc", "th", "item", "needed").agg(F.count("*").alias("n")).where("n >= needed").select("doc", "th", "item"))
    # exact: all shingles of the candidates
    some = ws.write(found.select(F.col("doc").alias("d"), F.col("th").alias("t")).distinct())
    again = docs.join(small(ws, some), docs["doc"].eqNullSafe(F.col("d")) & (docs["th"] == F.col("t")), "left_semi")
    sized = ws.write(items.withColumn("size", F.count("*").over(Window.partitionBy("item"))))
    held = shingles(again, ["doc", "th"], "text").join(small(ws, sized), "h").groupBy("doc", "th", "item", "size", "h").count()
    counted = held.groupBy("doc", "th", "item", "size").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("size") * F.lit(threshold) - 1e-9)
    pair = [counted["doc"].eqNullSafe(found["doc"]), counted["th"] == found["th"], counted["item"] == found["item"]]
    sure = counted.join(found, pair[0] & pair[1] & pair[2], "left_semi")
    out = sure.select("doc", "th", "item", (F.col("n") / F.col("size")).alias("containment"), F.col("size").cast("long").alias("n_shingles"))
    short = ws.write(short_items(source))
    # of WORDS - 1 lengths at most those that occur
    for r in short.select("k").distinct().orderBy("k").collect():
        hit = runs(docs, r["k"]).join(small(ws, short), ["k", "h"]).select("doc", "th", "item").distinct()
        out = out.unionByName(hit.select("doc", "th", "item", F.lit(1.0).alias("containment"), F.lit(1).cast("long").alias("n_shingles")))
    return out.join(small(ws, ids), "item").select(F.col("doc").alias(doc), F.col("id").alias(item), "containment", "n_shingles", "th")
