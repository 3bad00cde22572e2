"""Centroid clustering: plain Lloyd in whole numbers.

A vector's components become integers, floor(64 x), and so do the centroids: a mean is rounded down.  So no
sum depends on the order of its terms, and neither the deal of the rows nor a lost executor changes a result.

The centroids (sixteen vectors) travel with the function.  A task holds one batch against them, squares the
integer differences centroid by centroid in NumPy and adds up its own rows; the sums of partitions, a few
numbers a centroid, are merged by a grouping.  A round is one pass over the vectors and shuffles no vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import park

#: Components of a vector, steps of a unit, centroids, rounds.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Largest component whose squared distances fit 64 bits for certain; beyond, Python's integers take over.
SMALL = 1 << 27
#: Sums travel in parts of so many bits, so that none overflows.
PART_BITS = 40
LARGEST_LONG = (1 << 63) - 1


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exactly, for finite x of any size."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(scale * x)


def integers(vectors: pd.Series, scale: int = SCALE) -> np.ndarray:
    """The components of a batch as a matrix of 64-bit integers, or of Python's where some are too large."""
    values = np.stack(vectors.to_numpy()).astype(np.float64, copy=False)
    if np.abs(values).max() * scale <= SMALL:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[whole(x, scale) for x in row] for row in values.tolist()], dtype=object)


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equally near ones the smaller number."""
    if rows.dtype != object and any(abs(x) > SMALL for c in centroids for x in c):
        rows = rows.astype(object)
    kind = rows.dtype
    distances = np.empty((len(centroids), len(rows)), dtype=kind)
    for i, c in enumerate(centroids):
        step = rows - np.array(c, dtype=kind)
        step *= step
        distances[i] = step.sum(axis=1)
    cluster = distances.argmin(axis=0)  # the first of equal ones
    return cluster, distances[cluster, np.arange(len(rows))]


def parts(value: int) -> Iterator[tuple[int, int]]:
    """(place, part) of an integer cut into parts of ``PART_BITS`` bits, all with its sign."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value or not place:
        yield place, sign * (value & ((1 << PART_BITS) - 1))
        value, place = value >> PART_BITS, place + 1


def _sums(centroids: list[list[int]], scale: int):
    """The sums of a partition's rows by cluster and dimension (-1: the rows' number), in parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list[int]] = {}
        for frame in frames:
            if not len(frame):
                continue
            rows = integers(frame["vector"], scale)
            cluster, _ = nearest(rows, centroids)
            for c in np.unique(cluster).tolist():
                mine = rows[cluster == c]
                # a batch's 64-bit sums hold 2**36 rows
                added = [len(mine), *(int(x) for x in mine.sum(axis=0))]
                totals[c] = [a + b for a, b in zip(totals[c], added, strict=True)] if c in totals else added
        out = [(c, d - 1, place, part) for c, row in totals.items() for d, value in enumerate(row) for place, part in parts(value)]
        yield pd.DataFrame(out, columns=["cluster", "dimension", "place", "part"]).astype("int64")

    return run


def _assigned(centroids: list[list[int]], scale: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cluster, distance = nearest(integers(frame["vector"], scale), centroids)
                if distance.dtype == object:
                    distance = np.array([min(int(x), LARGEST_LONG) for x in distance], dtype=np.int64)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance.astype(np.int64)})

    return run


def lloyd(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, scale: int = SCALE) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over ``vectors`` (vector: array of double)."""
    for _ in range(rounds):
        merged = vectors.select("vector").mapInPandas(_sums(centroids, scale), "cluster long, dimension long, place long, part long")
        # one row for each centroid, dimension and part
        sums: dict[tuple[int, int], int] = {}
        for r in merged.groupBy("cluster", "dimension", "place").agg(F.sum("part").alias("part")).collect():
            at = (r.cluster, r.dimension)
            sums[at] = sums.get(at, 0) + (r.part << (PART_BITS * r.place))
        centroids = [[sums[c, d] // sums[c, -1] for d in range(len(old))] if (c, -1) in sums else old for c, old in enumerate(centroids)]
    return centroids


def centroid_clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for the vectors of ``embeddings`` (vec_id, embedding).

    Only vectors of ``dimensions`` components, none of them null, NaN or infinite, are kept; all others get no
    row, and an empty table gives none.  Rows that repeat are vectors of their own.  The first centroids are
    the ``k`` vectors with the smallest SHA-256 of ``1:<vec_id>`` (a null id: of ``1:``; rows of one id: by
    their components); where there are fewer vectors, there are fewer centroids.  Other columns are not read.
    Components may be of any size: what does not fit 64 bits is reckoned with Python's integers, and a distance
    or sum too large for a long is given as the largest long.  The input is read ``rounds`` + 2 times.
    """
    # ids pass pandas as text, which would turn whole numbers among nulls into doubles
    rows = embeddings.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where((F.size("vector") == dimensions) & ~F.exists("vector", bad))
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce("vec_id", F.lit(""))), 256)
    first = rows.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    start = [[whole(x, scale) for x in r.vector] for r in first]
    final = lloyd(rows, start, rounds, scale) if start else []
    assigned = rows.mapInPandas(_assigned(final, scale), "vec_id string, cluster int, distance long")
    assigned = park(assigned.withColumn("vec_id", F.col("vec_id").cast(embeddings.schema["vec_id"].dataType)), "clusters").df
    # a row for each centroid at most
    cost = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    most = lambda x: min(x, LARGEST_LONG)
    told = [(c, most(cost[c]), most(sum(cost.values())), hashlib.sha256(",".join(map(str, final[c])).encode()).hexdigest()) for c in cost]
    told = embeddings.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` in sixteen clusters after three rounds."""
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The same rounds in SQL, every vector against every centroid."""
    square = f"list_sum(list_transform(range(1, {DIMENSIONS + 1}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS HUGEINT)) AS e
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c, e FROM v QUALIFY c < {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT v.rid, min({{'d': {square}, 'c': c.c}}) AS b FROM v, c{i} AS c GROUP BY v.rid)")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT a.b.c AS c, u.i, sum(v.e[u.i]) AS s, count(*) AS n FROM a{i} a JOIN v ON v.rid = a.rid, unnest(range(1, {DIMENSIONS + 1})) AS u(i) GROUP BY 1, 2)""")
            # DuckDB rounds quotients towards zero
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN
  (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{i} GROUP BY c) m ON m.c = c.c)""")
    last = f"a{ROUNDS}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.b.c AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance,
  CAST(sum(a.b.d) OVER (PARTITION BY a.b.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM {last} a JOIN v ON v.rid = a.rid JOIN c{ROUNDS} c ON c.c = a.b.c"""


#: Every vector against every centroid; for small tables.
ORACLE = _oracle()
