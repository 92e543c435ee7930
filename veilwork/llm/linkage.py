"""Links between members of hash buckets without forming all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Workspace, components, scratch, small

#: Pairs that may be left for a full comparison, per row of the buckets.
REST = 16
#: Fewer pairs than these aren't worth another round.
FEW = 100_000
#: Pivots of a bucket in a round, as a multiple of the round before.
GROWTH = 4


def members_of(buckets: DataFrame, ws: Workspace) -> DataFrame:
    """Of distinct rows (key, node) those of keys with two nodes or more."""
    keys = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    return ws.write(buckets.join(small(ws, ws.write(keys.where("a <> b").select("key"))), "key", "left_semi").select("key", "node"))


class _Edges:
    """Pairs that have been verified, each once, and those of them that are
    links. What a round leaves on disk goes: files, many of them small, take
    their room whatever their rows are."""

    def __init__(self, verify: Callable[[DataFrame], DataFrame], ws: Workspace):
        self.verify, self.ws, self.tested, self.found = verify, ws, None, None

    def test(self, pairs: DataFrame) -> None:
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        todo = self.ws.write(pairs)
        sure = self.ws.write(self.verify(todo))
        self.found, self.tested = self._with(self.found, sure), self._with(self.tested, todo)
        self.ws.tidy()

    def _with(self, before: DataFrame | None, new: DataFrame) -> DataFrame:
        if before is None:
            return new
        both = self.ws.write(before.union(new))
        self.ws.drop(before, new)
        return both

    def components(self) -> DataFrame:
        with scratch(self.ws):
            return self.ws.write(components(self.found, Workspace(self.ws.spark, "components")))


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], ws: Workspace, may: Callable[[Column, Column], Column] = lambda a, b: F.lit(True)) -> DataFrame:
    """Edges (a, b) such that their connected components are those of all
    verified pairs that share a bucket. The members (key, node, sign) have two
    nodes or more in each bucket; `may` tells of two signs whether the pair can
    be a link, so that others never get to the verification.

    No pair is verified twice. First each node is verified with one node of its largest bucket only, that
    of the most and largest buckets, which the text that others are copies of
    is: near copies share many buckets, and one link is enough. The same for
    one node of each component that a bucket still holds. Then every
    round takes pivots in each bucket that lies in two components or more,
    GROWTH times as many as the round before, and verifies them with the members
    of other components; then they have met all others and leave the bucket. The
    nodes of the least hashes are pivots, so that buckets that share members
    share pivots and pairs. In a
    bucket of near copies most members join the pivot's component at once, so
    the rounds touch each row a few times, however large the bucket is. When few
    pairs are left untested, they are compared in one step: those outside their
    bucket's largest component with all others."""
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    weight = sized.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = ws.write(sized.join(weight, "node").select("key", "node", "sign", "n", "weight"))
    first = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "sign")).alias("pivot"))
    home = weighed.join(first, "key").groupBy("node").agg(F.max(F.struct("n", "key", "sign", "pivot")).alias("home"))
    star = home.where(may(F.col("home.sign"), F.col("home.pivot.sign"))).select(F.least("node", "home.pivot.node").alias("a"), F.greatest("node", "home.pivot.node").alias("b"))
    edges, left = _Edges(verify, ws), members
    edges.test(star.where("a <> b").distinct())
    # then one of each component with one of the bucket's largest
    comp = edges.components()
    labelled = weighed.join(small(ws, comp), "node", "left").select("key", "node", "sign", "weight", F.coalesce("root", "node").alias("label"))
    one = ws.write(labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node", "sign")).alias("one")))
    main = one.groupBy("key").agg(F.max(F.struct("n", "label", "one")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    apart = one.join(main, "key").where(F.col("label") != F.col("main.label")).where(may(F.col("one.sign"), F.col("main.one.sign")))
    edges.test(apart.select(F.least("one.node", "main.one.node").alias("a"), F.greatest("one.node", "main.one.node").alias("b")).distinct())
    ws.drop(weighed, one, comp)
    step = 0
    while True:
        step += 1
        comp = edges.components()
        labelled = ws.write(left.join(small(ws, comp), "node", "left").select("key", "node", "sign", F.coalesce("root", "node").alias("label")))
        per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
        mixed = ws.write(
            per_label.groupBy("key")
            .agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("total"), F.count("*").alias("labels"))
            .where("labels > 1")
            .select("key", F.col("main.label").alias("main"), "total", (F.col("total") - F.col("main.n")).alias("minor"))
        )
        ws.drop(comp)
        cost = mixed.agg(F.sum(F.col("minor") * F.col("total")).alias("cross"), F.sum("total").alias("rows")).first()
        if not cost["rows"]:
            return edges.found
        here = labelled.join(small(ws, mixed), "key")
        last = cost["cross"] <= max(REST * cost["rows"], FEW)
        if last:
            x, y = here.where("label <> main"), labelled
        else:
            best = ws.write(here.where("label <> main").groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("best")))
            share = (F.xxhash64("node") / F.lit(2.0**64)) + 0.5
            drawn = share * F.col("minor") < F.lit(float(GROWTH) ** step)
            chosen = (F.col("label") != F.col("main")) & (drawn | (F.col("node") == F.col("best.node")))
            marked = ws.write(here.join(small(ws, best), "key").select("key", "node", "sign", "label", chosen.alias("pivot")))
            ws.drop(best)
            x, y = marked.where("pivot"), marked
        x = x.select("key", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("sign").alias("sx"))
        y = y.select("key", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("sign").alias("sy"))
        edges.test(x.join(y, "key").where((F.col("lx") != F.col("ly")) & may(F.col("sx"), F.col("sy"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        ws.drop(labelled, mixed)
        if last:
            return edges.found
        if step > 1:
            ws.drop(left)
        left = ws.write(marked.where("not pivot").select("key", "node", "sign"))
        ws.drop(marked)
