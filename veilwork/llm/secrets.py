"""Secret scan with corpus-wide ownership frequency.

Pass 1 finds candidates in every text: the base kinds (assign, access, hex)
and, besides, free-standing tokens with mixed characters. Pass 2 counts for
every candidate's hash the distinct repositories and owners that hold it. A
value that many owners hold, or two owners in many repositories, is a copied
example; one with a single owner, in few repositories, that looks random is
live-looking. Base spans always stay; a free-standing token
becomes a span only if it is owner-specific and live-looking."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.bpe import slices
from veilwork.llm.common import Workspace, ship, small, unused

#: Kinds in the order of the output; the first three are the base.
KINDS = ("assign", "access", "hex", "token")
BASE = 3
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: The shortest runs that count are written into the patterns: runs are
#: maximal, so a shorter one never hides a longer one.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}")
#: A value in the hands of so many owners is an example, and so is one of two
#: owners in so many repositories. One that a single owner has in more than the
#: third number of repositories is no live credential for sure.
EXAMPLE_OWNERS, EXAMPLE_REPOS, LIVE_REPOS = 3, 5, 20
#: Bits per character from which a value looks random.
LIVE_ENTROPY = 3.0

FOUND = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base", T.StringType()),
        T.StructField(
            "found",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("kind", T.IntegerType()),
                        T.StructField("hash", T.StringType()),
                        T.StructField("random", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value), by start and then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    base = sorted(out)
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not any(s < m.end() and m.start() < e for s, e, *_ in base):
            out.append((m.start(), m.end(), 3, v))
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Pass 1: the columns of `keep`, the base counts and all candidates."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + FOUND.fields)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("hash", pa.string()), ("random", pa.bool_())]))
        for batch in batches:
            for part in slices(batch, n):
                rows = []
                for t in part.column(n).to_pylist():
                    found = candidates(t) if t else []
                    count = Counter(k for _, _, k, _ in found)
                    base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in found if k < BASE)
                    spans_of = [{"start": s, "end": e, "kind": k, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "random": entropy(v) >= LIVE_ENTROPY} for s, e, k, v in found]
                    rows.append((count[0], count[1], count[2], base, spans_of))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(c, t) for c, t in zip(cols, [*types, spans]))], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias(unused(df, "text")[0])).mapInArrow(run, schema)


def owners(spans: DataFrame, repository: str, owner: str) -> DataFrame:
    """Pass 2: per hash its occurrences, distinct repositories and distinct
    owners. Distinct pairs are formed first, map-side, so that a hash that
    fills the corpus costs each task one row per owner or repository."""
    per_repo = spans.groupBy("hash", repository, owner).agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("hash", owner).agg(F.count(repository).alias("repos"), F.sum("n").alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count(owner).alias("n_owners"))


def scan_secrets(df: DataFrame, doc: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """One row per input row: the document's column, n_assign, n_access,
    n_hex, base (base spans as kind:start:end, comma-joined), spans (all
    spans likewise), n_live (owner-specific live-looking spans), n_example
    (spans whose value many owners hold), secrets (array of start, end, kind,
    verdict, n_repos, n_owners).

    A document is a repository of its owner. Null or empty texts hold no
    secrets; a null owner or document counts for none. Texts of any length are
    searched whole. Spans with one start come in the order of KINDS. Repeated
    rows are scanned each and count once. An empty table gives an empty one."""
    ws = Workspace(df.sparkSession, "secrets")
    src = df.select(F.col(doc).alias("doc"), F.col(owner).cast("string").alias("owner"), F.col(text).alias("text"))
    docs = ws.write(scan(src, "text", ("doc", "owner")).withColumn("row", F.expr("uuid()")))
    spans = docs.where("size(found) > 0").select("row", "doc", "owner", F.explode("found").alias("s")).select("row", "doc", "owner", "s.*")
    held = ws.write(owners(spans, "doc", "owner"))
    verdict: Column = (
        F.when((F.col("n_owners") >= EXAMPLE_OWNERS) | ((F.col("n_owners") == EXAMPLE_OWNERS - 1) & (F.col("n_repos") >= EXAMPLE_REPOS)), "example")
        .when(F.col("random") & (F.col("n_owners") <= 1) & (F.col("n_repos") <= LIVE_REPOS), "live")
        .otherwise("unclear")
    )
    # AQE splits the partition of a hash that fills the corpus
    judged = spans.join(small(ws, held), "hash").withColumn("verdict", verdict).where((F.col("kind") < BASE) | (F.col("verdict") == "live"))
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict", "n_repos", "n_owners"))).alias("secrets")
    )
    name = F.array(*map(F.lit, KINDS))
    out = docs.select("row", "doc", "n_assign", "n_access", "n_hex", "base").join(per_row, "row", "left")
    secrets = F.coalesce("secrets", F.array().cast(per_row.schema["secrets"].dataType))
    return out.select(
        F.col("doc").alias(doc),
        "n_assign",
        "n_access",
        "n_hex",
        "base",
        F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.size(F.filter(secrets, lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter(secrets, lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
        F.transform(secrets, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(name, s["kind"]).alias("kind"), s["verdict"].alias("verdict"), s["n_repos"].alias("n_repos"), s["n_owners"].alias("n_owners"))).alias("secrets"),
    )
