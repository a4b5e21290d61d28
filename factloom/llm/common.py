"""Shared folder, written tables, row keys and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session may have it unset; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_open: list[Workspace] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables that operators write inside go at the end of the block, once its result has been written."""
    before = len(_open)
    try:
        yield
    finally:
        for ws in _open[before:]:
            ws.close()
        del _open[before:]


class Workspace:
    """Tables written under the shared folder. They survive lost executors, cut
    lineage, and go when the driver ends, at the end of a ``scope`` or on ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/factloom-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._at: dict[int, str] = {}
        _open.append(self)

    def close(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def write(self, df: DataFrame, *, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{len(self._at)}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        out._factloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._fs.delete(self._path(df._factloom_path), True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less columns that an operator is about to add; its own win over clashing ones."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def long_key(column: Column) -> Column:
    """Null ids sort first and equal each other."""
    return F.coalesce(column.cast("long"), F.lit(-(2**63)))


def components(ws: Workspace, edges: DataFrame, *, rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``.

    Randomised contraction: each round every node moves to the neighbour (or
    itself) of least hash, edges follow, loops and repeats go. The expected
    number of nodes shrinks by a constant factor whatever the shape of the
    graph, so rounds grow with the logarithm of the longest chain. All
    aggregation is a map-side ``min``, and joins are against one row per node,
    so a hub of any degree is split by the adaptive skew join. Nothing is
    collected. Empty edges give an empty table.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    live = ws.write(edges.where("a <> b").select(*ends).distinct())
    moves: list[DataFrame] = []
    for turn in range(rounds):
        if live.isEmpty():
            break
        tag = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        move = (
            live.select("a", tag("b").alias("t"))
            .unionByName(live.select(F.col("b").alias("a"), tag("a").alias("t")))
            .groupBy("a")
            .agg(F.min("t").alias("t"))
            .select(F.col("a").alias("node"), F.least(F.col("t"), tag("a"))["n"].alias("root"))
        )
        move = ws.write(move)
        left, right = move.toDF("a", "ra"), move.toDF("b", "rb")
        after = live.join(left, "a").join(right, "b").where("ra <> rb")
        before, live = live, ws.write(after.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        ws.drop(before)
        moves.append(move)
    else:
        raise RuntimeError("components did not settle")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = moves[0]
    for move in moves[1:]:
        step = move.toDF("root", "next")
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def raw(batch, name: str) -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def extended(batch, drop: tuple[str, ...], **new):
    """An Arrow batch less some columns and with new ones; other columns pass untouched."""
    import pyarrow as pa

    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], names=[*names, *new])
