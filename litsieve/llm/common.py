"""Helpers that the corpus operators share: parked tables, distributed ranks, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (tests, one machine) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if path is None:
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if path is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="corpus-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


#: Tables that are parked and not dropped; see ``tables_of``.
_HELD: list[Parked] = []


class Parked:
    """A DataFrame written to the shared folder once and read from there; ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, label: str):
        self._spark = df.sparkSession
        self.path = f"{shared_dir(self._spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)
        _HELD.append(self)

    def drop(self) -> None:
        if self in _HELD:
            _HELD.remove(self)
        jvm = self._spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def park(df: DataFrame, label: str) -> Parked:
    """Cut the lineage of ``df`` at a table in the shared folder."""
    return Parked(df, label)


class tables_of:
    """``with tables_of() as made: ...; made.drop()`` deletes the tables that the block has parked and not dropped.

    Operators return DataFrames that still read such tables, so they are dropped once their result is written.
    """

    def __enter__(self) -> tables_of:
        self._before = list(_HELD)
        return self

    def __exit__(self, *error) -> None:
        pass

    def drop(self, but: Parked | None = None) -> None:
        for table in [t for t in _HELD if t not in self._before and t is not but]:
            table.drop()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores behind it until ``df`` has no such column (upper and lower case count as one)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    held = np.sort(values)
    new = np.ones(len(held), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    return held[new]


def hand_back() -> None:
    """Give freed memory back to the system, as far as Arrow's pool and the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, that hands unused memory back when its task ends: Python workers go on to other stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return tidied


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int, spread: Column) -> DataFrame:
    """Add ``name``: a gapless number from 0 within ``keys``, however large a key is.

    Rows are dealt into ``buckets`` by ``spread``; the number is the row's place in its (key, bucket)
    plus the sizes of the key's earlier buckets.  Only (key, bucket) sizes meet in one place.
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*keys, b).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*keys, b).orderBy(*order)
    df = df.withColumn("__place", F.row_number().over(within) - 1)
    return (
        df.join(sizes, [*keys, b])
        .withColumn(name, (F.col("__place") + F.col("__before")).cast("long"))
        .drop(b, "__place", "__before")
    )


def components(nodes_edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Alternating large-star and small-star steps; each is one grouped minimum and one join, and the
    edges of a step are written to the shared folder.  Only nodes that stand in an edge appear.
    A node with many neighbours is no trouble: minima combine before the shuffle and the join is
    an ordinary one that Spark can split.
    """
    def stated(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())

    edges = park(
        nodes_edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    state = stated(edges.df)
    while state[0]:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour or itself
        both = edges.df.unionByName(edges.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("x"), F.col("m").alias("y"))
        moved = large.join(low, "a").select(F.explode(F.array(pair("a"), pair("b"))).alias("e"))
        new = park(moved.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), label)
        edges.drop()
        edges, before = new, state
        state = stated(edges.df)
        if state == before:  # the same edges again: every component is a star around its smallest node
            break
    stars = edges.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
