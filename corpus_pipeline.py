"""Corpus pipeline over `documents`: language ID, line dedup, near-duplicates,
benchmark decontamination, BPE encoding and decoding.

Every stage takes (spark, docs, sf_dir). All but the last return the columns
of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import bpe, decontaminate, langid, linededup, neardup
from veilwork.llm.common import Workspace, scratch, small
from veilwork.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if it has no letter, or if no language has so great
#: a share of its letters.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null and empty texts among them);
    fills in a missing lang. Rows that repeat stay as often as they are; a null
    id is held out from learning only. Without a labelled row all are rejected.
    An empty table gives an empty one."""
    found = langid.identify(docs, langid.fit(docs), keep=tuple(COLUMNS))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that occur before; no document goes, but one may become
    empty. A null text stays null; of equal lines the one of the least id, then
    place, stays; rows that repeat lose the same lines; long lines are compared
    whole. An empty table gives an empty one."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, that of the least id
    (a null id counts as the greatest). Documents without text are no copies of
    each other; of rows that repeat one stays. An empty table gives an empty
    one."""
    ws = Workspace(spark, "pipeline-near")
    found = ws.write(neardup.near_duplicates(docs))
    by = found.groupBy("doc_id", "node").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    gone = small(ws, ws.write(by.where("not kept").select(F.col("doc_id").alias("d"), F.col("node").alias("t"))))
    # a class of rows without text has a row each; rows that repeat id and text stay once
    twice = ws.write(by.where("kept and n > 1").select(F.col("doc_id").alias("d"), F.col("node").alias("t")))
    here = lambda x: docs["doc_id"].eqNullSafe(x["d"]) & (F.xxhash64(docs["text"]) == x["t"])
    out = docs.join(gone, here(gone), "left_anti")
    if twice.isEmpty():
        return out.select(COLUMNS)
    once = out.join(small(ws, twice), here(twice), "left_anti")
    return once.unionByName(out.join(small(ws, twice), here(twice), "left_semi").dropDuplicates(["doc_id", "text"])).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, all rows of them. Null and
    empty texts contain none and stay. An empty table, of documents or of items,
    drops nothing."""
    ws = Workspace(spark, "pipeline-benchmark")
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = small(ws, ws.write(found.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["d"]) & (F.xxhash64(docs["text"]) == bad["t"]), "left_anti").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text that
    they decode to. Null and empty texts have no ids; rows that repeat are
    encoded each. An empty table gives an empty one."""
    out = bpe.encode_decode(docs, bpe.read_spec(vocabulary_path()), keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("line dedup", lines), ("near-duplicates", near), ("decontamination", benchmark), ("BPE", tokens)]
#: None: SQL can't express language ID, fuzzy lines, sampling or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and
    read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(ws):
            before, docs = docs, ws.write(stage(spark, docs, sf_dir))
        if n:
            ws.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
