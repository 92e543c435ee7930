"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF
shingles, banded, verified by weighted Jaccard similarity.

A shingle is five words of the lower-case text between white space; a text of
fewer words is one shingle. Its weight in a text is its count there times its
IDF. Document frequencies are counted over all rows in 2^DF_BITS hashed
buckets, a table of a fixed size: shingles that are rare share a bucket's
count, which lies far below that of common ones at every size of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.bpe import rest, slices
from veilwork.llm.common import Memo, Workspace, components, ship, small, trim

WORDS, SIMILARITY = 5, 0.8
#: A pair with the least similarity shares a band with probability 1 - (1 - 0.8^3)^10 > 0.999.
BANDS, ROWS = 10, 3
DF_BITS = 18
#: Pairs of which fewer samples agree aren't compared exactly. A pair with the
#: least similarity has so few with a probability under 0.001.
LEAST_EQUAL = 17
#: Buckets of more members are compared in blocks, not as pairs; a block has
#: about so many members, and texts of about so many bytes.
FEW, BLOCK, BLOCK_BYTES = 16, 1024, 8 << 20
#: Bytes of words whose hash a worker remembers, in each of two generations.
CACHE = 12 << 20
#: Counts of the buckets are summed in so many parts, first in so many branches.
PARTS, BRANCHES = 64, 32

_U = np.uint64
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


_HASHES = Memo(xxhash.xxh3_64_intdigest, CACHE)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most 65,536 texts: number of the text, 48-bit hash and count of
    its distinct shingles, by number and hash. Null, empty and blank texts
    have none."""
    words = [t.lower().split() if t else [] for t in texts]
    for w in words:
        if 0 < len(w) < WORDS:
            w += [""] * (WORDS - len(w))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.fromiter((_HASHES[w] for ws in words for w in ws), np.uint64, total)
    h = np.zeros(total - WORDS + 1, np.uint64)
    for j in range(WORDS):
        h += flat[j : total - WORDS + 1 + j] * _MULTIPLY[j]
    doc = np.repeat(np.arange(len(words)), lengths)
    inside = np.flatnonzero(doc[: total - WORDS + 1] == doc[WORDS - 1 :])
    key = (doc[inside].astype(np.uint64) << _U(48)) | (mix(h[inside]) >> _U(16))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), count


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(48 - DF_BITS)).astype(np.int64)


def idf_of(n: np.ndarray, total: int) -> np.ndarray:
    """1 + ln((1 + N) / (1 + n)) / ln(2 + N), between 1 and 2: a shingle that
    one text holds counts at most twice one that all hold, so a group of many
    near copies, whose common shingles are frequent, stays one group."""
    return 1.0 + np.log((1.0 + total) / (1.0 + n)) / np.log(2.0 + total)


def idf_table(df: DataFrame, text: str) -> np.ndarray:
    """IDF of each bucket, from all rows. Partial counts of a fixed size are cut
    into PARTS and summed as a tree, all in the workers of DataFrames: those of
    RDDs would be a second set of processes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        n, rows = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                _, h, _ = shingles(part.column(0).to_pylist())
                n += np.bincount(bucket(h), minlength=1 << DF_BITS)
                rows += part.num_rows
        _HASHES.forget()
        cut = [*np.split(n, PARTS), np.array([rows])]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["part", "n"])

    def total(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), np.int64) for x in table["n"])
        return pa.table({"part": table["part"][:1], "n": pa.array([n.tobytes()], pa.binary())})

    some = df.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "part int, n binary")
    some = some.groupBy("part", (F.spark_partition_id() % BRANCHES).alias("branch")).applyInArrow(total, "part int, n binary")
    got = some.groupBy("part").applyInArrow(total, "part int, n binary").toArrow()
    n = {p: np.frombuffer(x, np.int64) for p, x in zip(got["part"].to_pylist(), got["n"].to_pylist())}
    if not n:
        return np.ones(1 << DF_BITS)
    return idf_of(np.concatenate([n[p] for p in range(PARTS)]), int(n[PARTS][0]))


class Sampler:
    """Consistent weighted samples. Gamma and uniform variates of a shingle
    come from tables of 65,536 by a hash of it that differs for each sample."""

    def __init__(self, idf: np.ndarray, samples: int = BANDS * ROWS):
        rng = np.random.default_rng(20)
        self.idf, self.samples = idf, samples
        u = 1.0 - rng.random((5, 1 << 16))
        r = -np.log(u[0] * u[1])
        self.r, self.over_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.log_c = np.log(-np.log(u[2] * u[3])).astype(np.float32)
        self.beta = u[4].astype(np.float32)
        self.by = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * _U(2) + _U(1)

    def bands(self, doc: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the texts that have shingles, their band keys, and 16
        bits of each of their samples."""
        if not len(h):
            return np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64), np.zeros((0, self.samples), np.uint16)
        log_w = np.log(count * self.idf[bucket(h)]).astype(np.float32)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc))))
        prints = np.empty((self.samples, len(starts)), np.uint64)
        for k in range(self.samples):
            i = ((h * self.by[k]) >> _U(48)).astype(np.int64)
            t = np.floor(log_w * self.over_r[i] + self.beta[i])
            a = self.log_c[i] - self.r[i] * (t - self.beta[i] + np.float32(1))
            least = np.minimum.reduceat(a, starts)
            hit = np.flatnonzero(a == least[segment])
            hit = hit[np.flatnonzero(np.diff(segment[hit], prepend=-1))]  # the least hash among equals
            prints[k] = mix(h[hit] * _MULTIPLY[0] + t[hit].astype(np.int64).astype(np.uint64) * _MULTIPLY[1])
        keys = np.zeros((BANDS, len(starts)), np.uint64)
        for b in range(BANDS):
            x = np.full(len(starts), b + 1, np.uint64)
            for j in range(ROWS):
                x = mix(x * _MULTIPLY[2] + prints[b * ROWS + j])
            keys[b] = x
        return doc[starts], keys.T.astype(np.int64), (prints.T & _U(0xFFFF)).astype(np.uint16)


class Texts:
    """Shingles of some texts, to compare pairs of them."""

    def __init__(self, texts: list[str | None], idf: np.ndarray):
        doc, self.h, self.count = shingles(texts)
        self.sizes = np.bincount(doc, minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.w = idf[bucket(self.h)]
        self.total = np.bincount(doc, weights=self.count * self.w, minlength=len(texts))

    def _rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[docs]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.starts[docs], n)
        return at, (np.repeat(np.arange(len(docs)), n).astype(np.uint64) << _U(48)) | self.h[at]

    def similarity(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of texts i[k] and j[k]; 0 where one has
        no shingle. At most 65,536 pairs."""
        (at, ka), (bt, kb) = self._rows(i), self._rows(j)
        both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        common = np.bincount((both >> _U(48)).astype(np.int64), weights=np.minimum(self.count[at[ia]], self.count[bt[ib]]) * self.w[at[ia]], minlength=len(i))
        union = self.total[i] + self.total[j] - common
        return np.divide(common, union, out=np.zeros(len(i)), where=union > 0)


def compare_block(texts: list[str], prints: np.ndarray, labels: np.ndarray, first: np.ndarray, second: np.ndarray | None, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that join what the links between texts `first` and
    `second` (None: among `first`) join, beyond equal labels. Pairs come by
    their estimated similarity; once two texts are joined, they aren't compared."""
    found_i, found_j, found_n = [], [], []
    for at in range(0, len(first), 512):
        a = first[at : at + 512]
        b = first[at:] if second is None else second
        equal = np.zeros((len(a), len(b)), np.uint8)
        for k in range(prints.shape[1]):
            equal += prints[a, k][:, None] == prints[b, k][None, :]
        i, j = np.nonzero((equal >= LEAST_EQUAL) & (labels[a][:, None] != labels[b][None, :]))
        found_i.append(a[i])
        found_j.append(b[j])
        found_n.append(equal[i, j])
    i, j, n = map(np.concatenate, (found_i, found_j, found_n))
    order = np.argsort(-n.astype(np.int64), kind="stable")
    i, j = i[order], j[order]
    out_i, out_j = [], []
    if len(i):
        known = Texts(texts, idf)
        _, root = np.unique(labels, return_inverse=True)
        step = 2048
        while len(i):
            a, b, i, j = i[:step], j[:step], i[step:], j[step:]
            for at in range(0, len(a), 256):  # bounds the shingles that are laid out at once
                x, y = a[at : at + 256], b[at : at + 256]
                sure = known.similarity(x, y) >= threshold
                for p, q in zip(x[sure].tolist(), y[sure].tolist()):
                    rp, rq = root[p], root[q]
                    if rp != rq:
                        root[root == max(rp, rq)] = min(rp, rq)
                        out_i.append(p)
                        out_j.append(q)
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per input row: the document's column, class_id (least id among
    the rows it is connected with by equal texts and by links, itself
    included), kept (one row of each class), class_size (rows), node (64-bit
    hash of the text). A link is a pair of texts that share a band and whose
    weighted Jaccard similarity is at least `threshold`.

    Null texts, and those without a word, link with their equals only, null
    with none: each such row is a class of its own. Of rows with the least id
    one is kept. A null id counts as greater than all others. Repeated rows
    are copies. An empty table gives an empty one. Equal texts are known by
    their 64-bit hash."""
    spark = df.sparkSession
    ship(df.sparkSession)
    ws = Workspace(spark, "neardup")
    t = F.col(text).cast("string")
    idf = spark.sparkContext.broadcast(idf_table(df, text))
    src = df.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(t).alias("node"), t.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        sampler = Sampler(idf.value)
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                at, keys, prints = sampler.bands(*shingles(part.column(2).to_pylist()))
                offsets = np.zeros(part.num_rows + 1, np.int32)
                offsets[at + 1] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys.ravel()))
                samples = [None] * part.num_rows
                for i, p in zip(at.tolist(), prints):
                    samples[i] = p.tobytes()
                null = part.column(2).is_null()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(samples, pa.binary()), null], names=["doc", "node", "bands", "prints", "blank"])
        _HASHES.forget()
        del sampler
        trim()

    signed = ws.write(src.mapInArrow(sign, "doc long, node long, bands array<long>, prints binary, blank boolean").withColumn("row", F.monotonically_increasing_id()))
    # a null text equals nothing: its node is its row
    rows = signed.select("doc", "row", F.when(F.col("blank"), F.xxhash64(F.lit("null"), "row")).otherwise(F.col("node")).alias("node"))
    comp = components(_links(signed, src, idf, threshold, ws), ws)
    least = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "row"))
    nodes = ws.write(rows.groupBy("node").agg(least.alias("least"), F.count("*").alias("n")).join(comp, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")))
    classes = nodes.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("class_size"))
    of_node = ws.write(nodes.join(classes, "root").select("node", F.col("first.doc").alias("class_id"), F.col("first.row").alias("kept_row"), "class_size"))
    return rows.join(of_node, "node").select(F.col("doc").alias(doc), "class_id", (F.col("row") == F.col("kept_row")).alias("kept"), "class_size", "node")


def _links(signed: DataFrame, src: DataFrame, idf, threshold: float, ws: Workspace) -> DataFrame:
    """Edges (a, b) between nodes that join what all links join."""
    buckets = signed.select("node", F.explode("bands").alias("key")).distinct()
    keys = ws.write(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = ws.write(buckets.join(small(ws, keys), "key").select("key", "node", "n"))
    # of each text that is to be compared the row with the least id
    one = ws.write(signed.join(small(ws, ws.write(members.select("node").distinct())), "node", "left_semi").groupBy("node").agg(F.min("doc").alias("d")))
    one = small(ws, one).withColumnRenamed("node", "n1")
    here = (F.col("node") == F.col("n1")) & F.col("doc").eqNullSafe(F.col("d"))
    samples = signed.join(one, here).select("node", "prints").dropDuplicates(["node"])
    texts = ws.write(src.join(one, here).select("node", "text").dropDuplicates(["node"]).join(samples, "node"))

    # few members: all pairs, of which there are at most FEW / 2 for a member
    few = members.where(F.col("n") <= FEW).select("key", F.col("node").alias("a"))
    pairs = ws.write(few.join(few.withColumnRenamed("a", "b"), "key").where("a < b").select("a", "b").distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 1 << 20):
                pa_, pb = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(part.num_rows, -1) for k in (4, 5))
                part = part.filter(pa.array((pa_ == pb).sum(axis=1) >= LEAST_EQUAL))
                n = part.num_rows
                both = Texts(part.column(2).to_pylist() + part.column(3).to_pylist(), idf.value)
                like = both.similarity(np.arange(n), np.arange(n) + n)
                yield part.select(["a", "b"]).filter(pa.array(like >= threshold, pa.bool_()))
        _HASHES.forget()
        trim()

    ta, tb = (texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}"), F.col("prints").alias(f"p{k}")) for k in "ab")
    some = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb", "pa", "pb").mapInArrow(compare, "a long, b long")

    # many: blocks. First each node in its largest bucket only, among its block
    many = members.where(F.col("n") > FEW)
    home = many.groupBy("node").agg(F.max(F.struct("n", "key")).alias("m")).select("node", F.col("m.key").alias("key"), F.col("m.n").alias("n"))
    home = home.join(texts, "node").withColumn("label", F.col("node"))
    weight = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    spans = home.groupBy("key").agg(F.max("n").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).select("key", weight.alias("blocks"))
    home = home.join(spans, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))

    def compare_group(table: pa.Table) -> pa.Table:
        side, node = table["side"].to_numpy(), table["node"].to_numpy()
        prints = np.frombuffer(b"".join(table["prints"].to_pylist()), np.uint16).reshape(len(node), -1)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = compare_block(table["text"].to_pylist(), prints, table["label"].to_numpy(), first, second if side.any() else None, idf.value, threshold) if len(first) else (first, first)
        _HASHES.forget()
        return pa.table({"a": pa.array(node[i], pa.int64()), "b": pa.array(node[j], pa.int64())})

    cols = ["key", "i", "j", "side", "node", "label", "prints", "text"]
    inner = home.withColumn("j", F.lit(-1)).withColumn("side", F.lit(0)).select(cols).groupBy("key", "i", "j").applyInArrow(compare_group, "a long, b long")
    edges = ws.write(some.union(inner))

    # then what lies in one bucket, but outside its largest component, with all others
    comp = ws.write(components(edges, ws))
    labelled = ws.write(many.join(small(ws, comp), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("label")))
    main = labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("total"), F.count("*").alias("labels"))
    mixed = ws.write(main.where("labels > 1").select("key", F.col("m.label").alias("main"), (F.col("total") - F.col("m.n")).alias("minor")))
    if mixed.isEmpty():
        return edges
    full = labelled.join(small(ws, mixed), "key").join(texts, "node")
    sized = full.groupBy("key").agg(F.max("n").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).select("key", weight.alias("blocks"))
    full = full.join(sized, "key").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = full.where("label <> main").withColumn("j", F.explode(every)).withColumn("side", F.lit(0)).select(cols)
    # only blocks that hold some of the others
    opposite = left.select("key", F.col("i").alias("x")).distinct()
    right = full.withColumnRenamed("i", "j").join(opposite, "key").withColumnRenamed("x", "i").withColumn("side", F.lit(1)).select(cols)
    outer = left.union(right).groupBy("key", "i", "j").applyInArrow(compare_group, "a long, b long")
    return ws.write(edges.union(outer))
