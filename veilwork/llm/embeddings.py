"""Embedding near-duplicates: exact pairs with a cosine of at least 0.9, by a
dual traversal of nested cover levels.

Unit vectors with cosine c are sqrt(2 - 2 c) apart. The upper levels are the
prefixes of a farthest-first traversal of a bounded sample (nested nets, their
radii fall); every vector goes to its nearest centre, and pairs of cells whose
centres are farther apart than both covering radii and the threshold are
pruned. Cells are cut into blocks of bounded size; each pair of blocks that is
left is one group. In it, levels with halving radii are built over either
block, and pairs of nodes are followed downwards while the covering radii let
them hold a link. What is left is compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Workspace, components, ship

COSINE = 0.9
#: Vectors that the upper levels are fitted on, and cells, at most. All
#: vectors are assigned; the sample only decides how well cells prune.
SAMPLE, CELLS = 4096, 256
#: Vectors in a block, about. Every vector goes to as many pairs of blocks as
#: aren't pruned, so blocks are large.
BLOCK = 16384
#: Radii of the levels in a block. Wider nodes would hold no links of their own
#: at this threshold (0.447 apart) and reach almost every other node.
RADII = (0.5, 0.25, 0.125)
#: Rows of a distance matrix at a time; pairs that are compared one by one.
TILE, FLAT = 2048, 4096


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of x such that each is farthest from those before it."""
    out, gap = [0], np.full(len(x), np.inf)
    while len(out) < min(k, len(x)):
        gap = np.minimum(gap, 2 - 2 * (x @ x[out[-1]]))
        far = int(gap.argmax())
        if gap[far] <= 1e-12:
            break
        out.append(far)
    return x[out]


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which is exact, so that the largest component
    lies between 0.5 and 1: squares neither vanish nor overflow."""
    _, e = np.frexp(np.abs(raw).max(axis=1))
    out = np.ldexp(raw, -(e // 2)[:, None])
    return np.ldexp(out, (e // 2 - e)[:, None])


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


class Level:
    """Nodes of one radius over some rows: a centre, its rows, the largest
    distance of a row from it. owner: the number of each row's centre, if the
    level has been built before."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, radius: float, centres: np.ndarray | None = None, owner: np.ndarray | None = None):
        if owner is None:
            centres, owner = self.build(x, rows, radius)
        order = np.argsort(owner, kind="stable")
        self.centres, self.rows = centres, rows[order]
        self.sizes = np.bincount(owner, minlength=len(centres))
        self.starts = np.cumsum(self.sizes) - self.sizes
        gap = x[rows].astype(np.float64) - x[centres[owner]]
        self.radius = np.zeros(len(centres))
        # the slack covers what single precision leaves out
        np.maximum.at(self.radius, owner, np.where(rows == centres[owner], 0, np.sqrt(np.einsum("ij,ij->i", gap, gap)) + 1e-6))
        # by radius, so that a tile's largest tells much about its nodes
        by = np.argsort(self.radius, kind="stable")
        self.centres, self.sizes, self.starts, self.radius = (v[by] for v in (self.centres, self.sizes, self.starts, self.radius))
        single = int((self.radius == 0).sum())
        cuts = [*range(0, single, TILE), *range(single, len(by), TILE // 8), len(by)]
        self.tiles = list(zip(cuts, cuts[1:]))

    @staticmethod
    def build(x: np.ndarray, rows: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Centres, each farther than the radius from those before, and the
        number of the centre that each row is within the radius of."""
        centres = np.zeros(0, np.int64)
        owner = np.full(len(rows), -1)
        cut = 1 - radius * radius / 2
        for at in range(0, len(rows), TILE):
            part = rows[at : at + TILE]
            own = owner[at : at + TILE]
            for c in range(0, len(centres), TILE):
                near = x[part] @ x[centres[c : c + TILE]].T
                best = near.argmax(axis=1)
                take = (own < 0) & (near[np.arange(len(part)), best] >= cut)
                own[take] = best[take] + c
            free = np.flatnonzero(own < 0)
            if len(free):
                near = x[part[free]] @ x[part[free]].T >= cut
                np.fill_diagonal(near, True)
                open_ = np.ones(len(free), bool)
                new = []
                for i in range(len(free)):
                    if open_[i]:
                        hit = near[i] & open_
                        own[free[hit]] = len(centres) + len(new)
                        open_ &= ~hit
                        new.append(part[free[i]])
                centres = np.concatenate([centres, np.array(new, np.int64)])
        return centres, owner

    def members(self, node: int) -> np.ndarray:
        return self.rows[self.starts[node] : self.starts[node] + self.sizes[node]]


def traverse(x: np.ndarray, la: Level, lb: Level, cosine: float, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of la and lb that may reach the cosine; all that
    do are among them, once. x: unit vectors in single precision."""
    slack = 2e-7 * (x.shape[1] + 16)
    link = float(np.sqrt(2 - 2 * cosine)) + 1e-4
    for at, au in la.tiles:
        ca, ra = x[la.centres[at:au]], la.radius[at:au]
        for bt, bu in lb.tiles:
            if la is lb and bt < at:
                continue
            rb = lb.radius[bt:bu]
            near = ca @ x[lb.centres[bt:bu]].T
            # first by the largest radii, then each pair by its own
            i, j = np.nonzero(near >= 1 - min(ra[-1] + rb[-1] + link, 2.0) ** 2 / 2 - slack)
            reach = np.minimum(ra[i] + rb[j] + link, 2.0)
            close = near[i, j] >= 1 - reach**2 / 2 - slack
            i, j = i[close] + at, j[close] + bt
            if la is lb:  # a pair of nodes comes once
                i, j = i[i <= j], j[i <= j]
            sizes = la.sizes[i] * lb.sizes[j]
            large = sizes > FLAT
            for p, q in zip(i[large].tolist(), j[large].tolist()):
                same = la is lb and p == q
                a, b = la.members(p), lb.members(q)
                if depth + 1 < len(RADII):
                    below = Level(x, a, RADII[depth + 1])
                    yield from traverse(x, below, below if same else Level(x, b, RADII[depth + 1]), cosine, depth + 1)
                    continue
                for u in range(0, len(a), TILE):
                    for v in range(0, len(b), TILE):
                        k, m = np.nonzero(x[a[u : u + TILE]] @ x[b[v : v + TILE]].T >= cosine - slack)
                        k, m = a[u + k], b[v + m]
                        yield (k[k < m], m[k < m]) if same else (k, m)
            small = (~large) & ((i != j) if la is lb else True)
            yield from _products(la, lb, i[small], j[small], sizes[small])
            if la is lb:
                own = (~large) & (i == j)
                for k, m in _products(la, lb, i[own], j[own], sizes[own]):
                    yield k[k < m], m[k < m]


def _products(la: Level, lb: Level, i: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the small pairs of nodes, a bounded number at once."""
    part = np.cumsum(sizes) // (1 << 20)
    for cut in np.split(np.arange(len(i)), np.flatnonzero(np.diff(part)) + 1):
        if len(cut):
            n = sizes[cut]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(lb.sizes[j[cut]], n)
            yield la.rows[np.repeat(la.starts[i[cut]], n) + k // width], lb.rows[np.repeat(lb.starts[j[cut]], n) + k % width]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row of each row's component under links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def compare_blocks(table: pa.Table, cosine: float = COSINE) -> pa.Table:
    """Links within one pair of blocks: for each linked vector the number of
    vectors that it is linked with, counted with their copies, and one vector
    of its component here."""
    side = table["side"].to_numpy()
    node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    raw = scaled(np.frombuffer(b"".join(table["vec"].to_pylist()), np.float64).reshape(table.num_rows, -1))
    norm = np.linalg.norm(raw, axis=1)
    unit = (raw / norm[:, None]).astype(np.float32)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = not len(b)
    links, left, right = np.zeros(len(node), np.int64), [], []
    levels = []
    for rows in (a,) if own else (a, b):
        # the block's first level comes with it: each row's centre
        names, owner = np.unique(table["centre"].to_numpy()[rows], return_inverse=True)
        order = np.argsort(node[rows])
        levels.append(Level(unit, rows, RADII[0], rows[order[np.searchsorted(node[rows], names, sorter=order)]], owner))
    for i, j in traverse(unit, levels[0], levels[-1], cosine):
        for at in range(0, len(i), 1 << 18):
            p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            sure = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) >= cosine
            p, q = p[sure], q[sure]
            links += np.bincount(p, weights=copies[q], minlength=len(node)).astype(np.int64)
            links += np.bincount(q, weights=copies[p], minlength=len(node)).astype(np.int64)
            if len(p) > len(node):  # a forest is enough
                r = roots(len(node), p, q)
                p = np.flatnonzero(r != np.arange(len(r)))
                q = r[p]
            left.append(p)
            right.append(q)
    root = roots(len(node), *(np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right)))
    hit = np.flatnonzero(links)
    return pa.table({"node": pa.array(node[hit], pa.int64()), "links": pa.array(links[hit], pa.int64()), "root": pa.array(node[root[hit]], pa.int64())})


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: the key column, n_links (other rows with a
    cosine of at least `cosine`), component_id (least key reachable by links,
    its own included), kept (the key is component_id).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Vectors of different length aren't compared. Equal
    vectors are one node with copies, known by a 64-bit hash of it; they are
    scaled before use, so very small and very large components count as any
    other. Rows that
    repeat a key are rows; a null key counts for no component. An empty table
    gives an empty one."""
    spark = df.sparkSession
    ship(df.sparkSession)
    ws = Workspace(spark, "embeddings")
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = ws.write(
        df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False)).alias("ok"))
        .select("id", F.when(F.col("ok"), F.xxhash64("v")).alias("node"), F.when(F.col("ok"), F.col("v")).alias("v"))
    )
    nodes = ws.write(rows.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("copies")).withColumn("dim", F.size("v")))
    found = None
    for row in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        part = _links(nodes.where(F.col("dim") == row["dim"]), row["n"], cosine, ws)
        found = part if found is None else found.unionByName(part)
    ids = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    if found is None:
        of_node = ids.select("node", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    else:
        found = ws.write(found)
        comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), ws)
        count = found.groupBy("node").agg(F.sum("links").alias("links"))
        all_ = ws.write(ids.join(count, "node", "left").join(comp, "node", "left").select("node", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
        least = all_.groupBy("root").agg(F.min("least").alias("component_id"))
        of_node = ws.write(all_.join(least, "root").select("node", "n_links", "component_id"))
    out = rows.select("id", "node").join(of_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def _links(nodes: DataFrame, n: int, cosine: float, ws: Workspace) -> DataFrame:
    """(node, links, root) from each pair of blocks of n vectors of one length."""
    spark = nodes.sparkSession
    cells = max(1, min(CELLS, n // BLOCK))
    parts = 1 << 30
    drawn = nodes.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(parts)) < int(parts * min(1.0, SAMPLE / n))).select("v").limit(2 * SAMPLE).collect()
    sample = scaled(np.array([r[0] for r in drawn] or [nodes.first()["v"]], dtype=np.float64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centres = farthest_first(sample, cells)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                unit = scaled(raw)
                near = (unit / np.linalg.norm(unit, axis=1, keepdims=True)) @ shared.value.T
                cell = near.argmax(axis=1)
                d = distance(near[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(cell.astype(np.int32)), pa.array(d), pa.array([r.tobytes() for r in np.ascontiguousarray(raw)], pa.binary())], names=["node", "copies", "cell", "d", "vec"]
                )

    placed = ws.write(nodes.select("node", "v", "copies").mapInArrow(assign, "node long, copies long, cell int, d double, vec binary"))
    sizes = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()}
    pieces = {c: -(-m // BLOCK) for c, (m, _) in sizes.items()}
    # at most CELLS squared pairs of cells
    link = float(np.sqrt(2 - 2 * cosine)) + 1e-4
    apart = distance(centres @ centres.T)
    close = [(c, e, pieces[c], pieces[e]) for c in sizes for e in sizes if c <= e and not apart[c, e] > sizes[c][1] + sizes[e][1] + link]
    pairs = spark.createDataFrame(close, "c int, e int, nc int, ne int")
    pairs = pairs.select("c", "e", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("i"), "ne").select("c", "e", "i", F.explode(F.sequence(F.lit(0), F.col("ne") - 1)).alias("j")).where("c < e or i <= j")
    pairs = ws.write(pairs.repartition(max(1, min(len(close), 64))))
    count = F.get(F.array(*[F.lit(pieces.get(c, 1)) for c in range(len(centres))]), F.col("cell"))
    blocks = placed.withColumn("piece", F.pmod(F.xxhash64(F.lit(5), "node"), count.cast("long")).cast("int")).select("node", "copies", "cell", "piece", "vec")

    def first_level(table: pa.Table) -> pa.Table:
        raw = scaled(np.frombuffer(b"".join(table["vec"].to_pylist()), np.float64).reshape(table.num_rows, -1))
        unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
        centres, owner = Level.build(unit, np.arange(len(unit)), RADII[0])
        return table.append_column("centre", pa.array(table["node"].to_numpy()[centres[owner]]))

    blocks = ws.write(blocks.groupBy("cell", "piece").applyInArrow(first_level, "node long, copies long, cell int, piece int, vec binary, centre long"))
    left = blocks.join(pairs, (F.col("cell") == F.col("c")) & (F.col("piece") == F.col("i")))
    right = blocks.join(pairs.where("c < e or i < j"), (F.col("cell") == F.col("e")) & (F.col("piece") == F.col("j")))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select("c", "i", "e", "j", "side", "node", "copies", "vec", "centre")
    return both.groupBy("c", "i", "e", "j").applyInArrow(lambda t: compare_blocks(t, cosine), "node long, links long, root long")
