"""Balanced label propagation: documents with equal texts are linked, and
iterative joins move linked documents to the shard where most of their
neighbours are, under quotas of free capacity. Unlinked documents give way.
At the end counts of rows differ by one at most."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import Workspace

#: Sub-buckets of row numbers within a key.
BUCKETS = 256


def number_rows(df: DataFrame, key: str, bucket: Column, by: tuple[str, ...] = ("h", "row")) -> DataFrame:
    """Column `no`: 1, 2, ... within `key`, by bucket and then `by`, without a
    task that holds all of a key. df should be a written table: it is read
    twice. `key` and `bucket` have few values, which bounds the broadcast."""
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(key, "_bucket").agg(F.count("*").alias("_n")).select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(key, "_bucket").orderBy(*by)
    return df.join(F.broadcast(offsets), [key, "_bucket"]).withColumn("no", F.col("_offset") + F.row_number().over(own)).drop("_bucket", "_offset")


def _spread(col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), col), F.lit(n)).cast("int")


def _by_shard(df: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [got.get(j, 0) for j in range(shards)]


def _pick(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), index)


def shard_documents(df: DataFrame, shards: int = 24, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the document's column, size (UTF-8 bytes of the
    text plus 8), text_crc32 (0 for null), law (`rows`), shard, slot (from 0,
    gapless in the shard), grown_shard (null under this law), linked (whether
    other rows have the same text).

    Rows with equal texts are neighbours of each other; a null text has none.
    Rounds go on until every linked row has its shard: in each a group claims
    room where most of its rows are, or, where all its shards are full, in one
    that has room; a round settles a row or fills a shard. Equal texts are known
    by their MD5. Repeated rows are rows of their own. Ties go by a hash of id
    and text, so how the table lies in files doesn't count. Texts of any length
    only give their size and digests. An empty table gives an empty one."""
    ws = Workspace(df.sparkSession, "sharding")
    t = F.col(text).cast("string")
    base = ws.write(
        df.select(
            F.col(doc).alias("doc"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("crc"),
            F.md5(t).alias("g"),
        )
        .withColumn("h", F.xxhash64(F.col("doc").cast("string"), "g"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    n = base.count()
    capacity = [n // shards + (j < n % shards) for j in range(shards)]
    groups = ws.write(base.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    # a group that fills the corpus is one row of `groups`: AQE splits the other side
    linked = base.join(groups, "g", "left_semi").select("row", "h", "g")
    # state of the linked rows; all others are free at their first shard
    state = ws.write(linked.withColumn("shard", _spread("h", shards)).withColumn("pinned", F.lit(False)))
    while True:
        free = [max(0, c - p) for c, p in zip(capacity, _by_shard(state.where("pinned"), shards))]
        weight = state.groupBy("g", "shard").agg(F.count("*").alias("n"), F.count_if(~F.col("pinned")).alias("open"))
        target = (
            weight.where(_pick(free, F.col("shard")) > 0)
            .groupBy("g")
            .agg(F.max(F.struct("n", F.xxhash64("g", "shard").alias("h"), "shard")).alias("best"))
            .select("g", F.col("best.shard").alias("target"))
        )
        # a group whose shards are all full goes where there is room
        rooms = [j for j, x in enumerate(free) if x]
        if rooms:
            somewhere = _pick(rooms, F.pmod(F.xxhash64(F.lit(9), "g"), F.lit(len(rooms))).cast("int")).cast("int")
            target = weight.where("open > 0").select("g").distinct().join(target, "g", "left").select("g", F.coalesce("target", somewhere).alias("target"))
        claims = ws.write(state.where("not pinned").join(target, "g"))
        if claims.isEmpty():
            break
        at_home = F.when(F.col("shard") == F.col("target"), 0).otherwise(1)
        order = (at_home * 64 + F.pmod(F.xxhash64("g"), F.lit(64))) * 64 + _spread("h", 64)
        taken = number_rows(claims, "target", order.cast("int")).where(F.col("no") <= _pick(free, F.col("target"))).select("row", F.col("target").alias("to"))
        new = ws.write(
            state.join(taken, "row", "left").select("row", "h", "g", F.coalesce("to", "shard").alias("shard"), (F.col("pinned") | F.col("to").isNotNull()).alias("pinned"))
        )
        ws.drop(state, claims)
        state = new
    placed = ws.write(
        base.join(state.select("row", F.col("shard").alias("s"), "pinned"), "row", "left").select(
            "row", "h", "doc", "size", "crc", F.coalesce("s", _spread("h", shards)).alias("shard"), F.col("s").isNotNull().alias("linked"), F.coalesce("pinned", F.lit(False)).alias("pinned")
        )
    )
    # what is over a shard's count goes where there is room; pinned rows stay first
    rank = F.when(F.col("pinned"), 0).when(F.col("linked"), 1).otherwise(2) * BUCKETS + _spread("h", BUCKETS)
    ranked = ws.write(number_rows(placed, "shard", rank).withColumn("stays", F.col("no") <= _pick(capacity, F.col("shard"))).drop("no"))
    room = [c - k for c, k in zip(capacity, _by_shard(ranked.where("stays"), shards))]
    ends = [sum(room[: j + 1]) for j in range(shards)]
    over = number_rows(ranked.where("not stays").withColumn("one", F.lit(0)), "one", _spread("h", BUCKETS))
    index = reduce(lambda a, b: a + b, [(F.col("no") > F.lit(e)).cast("int") for e in ends])
    final = ws.write(ranked.where("stays").select("row", "h", "doc", "size", "crc", "linked", "shard").unionByName(over.select("row", "h", "doc", "size", "crc", "linked", index.alias("shard"))))
    return number_rows(final, "shard", _spread("h", BUCKETS)).select(
        F.col("doc").alias(doc),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("no") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "linked",
    )
