"""Tables that cut lineage, and connected components of a graph given by its edges, by minimum labels over joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.sources.tables import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` as a table in the shared folder.

    Not a checkpoint, since its table keeps the size that was estimated for its plan.  A join's estimate is the product
    of its sides', so that in a loop the number's digits multiply round by round until the driver has no room for it.
    """
    return Cuts()(df)


class Cuts:
    """``cut`` for tables of passing use: ``drop`` deletes those named, ``close`` the rest."""

    def __init__(self) -> None:
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        self._held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table, path in [self._held.pop(id(t)) for t in tables]:
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        self.drop(*(table for table, _ in list(self._held.values())))


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(node, component): the smallest node that the undirected edges (a, b) reach, for nodes with an edge.

    Each round a node takes the smallest label around it and then that label's own label, so long
    chains shrink by halves.
    """
    pairs = edges.where("a <> b").select("a", "b")
    pairs = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        around = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = cut(lower.join(jump, "low").select("node", F.least("low", "further").alias("label"), (F.least("low", "further") < F.col("label")).alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
