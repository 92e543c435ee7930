"""Shared pieces of the training-data operators: a shared work folder, tables
written there to cut lineage, and distributed connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.shipping import ship

__all__ = ["Memo", "Workspace", "components", "scratch", "shared_dir", "ship", "small", "trim", "unused"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or,
    where it is unset, one of our own on a local master; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="veilwork-")
        spark.sparkContext.setCheckpointDir(path)
    return path


class Memo(dict):
    """Remembered results of a function of a word. It holds two generations of
    some `limit` bytes: what is used again moves to the new one, the rest goes
    with the old one. A long word that doesn't fit isn't kept."""

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit, self.old, self.used = function, limit, {}, 0

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.function(key)
        # a table's entry and the objects' heads take some 200 bytes, and word and
        # result no more than eight for each character
        used = self.used + 200 + 8 * len(key)
        if used > self.limit:
            if len(key) * 800 > self.limit:
                return out
            self.old = dict(self)
            self.clear()
            used = 0
        self[key] = out
        self.used = used
        return out

    def forget(self) -> None:
        self.clear()
        self.old, self.used = {}, 0


def trim() -> None:
    """Gives what this worker has freed back to the system: a worker stays for
    the operators that come after, and its executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


class Workspace:
    """Parquet tables in the shared folder. write() cuts the lineage: what
    reads the table again doesn't depend on executors that made it. Tables go
    when the driver ends, or earlier by drop()."""

    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.made.append(self)
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._path(self.root, "mkdirs")
        self._path(self.root, "deleteOnExit")

    def _path(self, path: str, *call):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if call[0] == "mkdirs":
            fs.mkdirs(p)
        elif call[0] == "deleteOnExit":
            fs.deleteOnExit(p)  # it remembers folders only that exist
        elif call[0] == "delete":
            fs.delete(p, True)
        else:
            return fs.getContentSummary(p).getLength()

    def write(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def bytes(self, table: DataFrame) -> int:
        """Size on disk of a table of this workspace."""
        return self._path(table._workspace_path, "size")

    def remove(self) -> None:
        """Deletes the folder with all its tables."""
        self._path(self.root, "delete")

    def tidy(self) -> None:
        """Lets Spark remove the shuffle files of jobs that have ended, which
        waits for a collection of the driver's garbage."""
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._path(t._workspace_path, "delete")


@contextmanager
def scratch(keep: Workspace) -> Iterator[None]:
    """At its end the workspaces made inside go, with their tables: what is
    needed of them has been written to `keep` by then."""
    start = len(Workspace.made)
    yield
    for ws in [w for w in Workspace.made[start:] if w is not keep]:
        ws.remove()
        Workspace.made.remove(ws)
    keep.tidy()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it differ from
    all columns of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


#: A written table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 8 << 20


def small(ws: Workspace, table: DataFrame) -> DataFrame:
    """The written table, marked for broadcast if its size on disk is under
    the bound; else as it is, and the planner joins by shuffle."""
    return F.broadcast(table) if ws.bytes(table) <= BROADCAST_BYTES else table


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Connected components of edges (a long, b long) as rows (node, root),
    one for each node that has an edge; root is one of the component's nodes.

    Each round maps every node to the least of itself and its neighbours and
    contracts the edges. The ids should be hashes: then the rounds are
    logarithmic in the longest path. All steps are joins and aggregates with
    map-side combining; nothing is collected."""
    e = ws.write(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    maps = []
    while True:
        both = e.select(F.col("a").alias("node"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("node"), F.col("a").alias("v"))
        )
        m = ws.write(
            both.groupBy("node")
            .agg(F.min("v").alias("v"))
            .select("node", F.least("node", "v").alias("to"))
        )
        maps.append(m)
        ma = m.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        mb = m.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        nxt = ws.write(
            e.join(ma, "a")
            .join(mb, "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        ws.drop(e)
        e = nxt
        if e.isEmpty():
            break
    out = maps[-1].select("node", F.col("to").alias("root"))
    for m in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("to"), "root")
        out = m.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out if len(maps) == 1 else ws.write(out)
