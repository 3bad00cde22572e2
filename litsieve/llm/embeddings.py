"""Embedding near-duplicates: sign hashes of random hyperplanes in several tables, exact cosines, components.

Equal vectors of a label form one class.  Classes that share a bucket (label, table, signs) are
compared by exact cosine in double precision, block against block, so no task holds a whole large
bucket.  A pair is counted in the first table where it meets.  Blocks return counts of links and
one edge from each linked class to the root of its local component, not pairs.

A pair at cosine 0.98 shares one sign with probability 1 - acos(0.98) / pi = 0.936, all ``BITS`` of a
table with 0.45, and meets in none of ``TABLES`` tables with 6e-7; closer pairs are missed less still.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import components, park
from litsieve.llm.simhash import Forest

#: Least cosine of a link; tables, signs a table; seed of the hyperplanes; classes of a block.
COSINE, TABLES, BITS, SEED, BLOCK = 0.98, 24, 12, 20240229, 1024
#: Rows of buckets and blocks that one call compares, about.
SLOT_ROWS = 8192


def planes(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, TABLES * BITS))


def sign_codes(vectors: np.ndarray, hyper: np.ndarray) -> np.ndarray:
    """(n, TABLES) codes of ``BITS`` signs each."""
    signs = (vectors @ hyper > 0).reshape(len(vectors), TABLES, BITS)
    return (signs * (1 << np.arange(BITS))).sum(axis=2).astype(np.uint16)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("vector").to_pylist()
        made: list = [None] * len(rows)
        sizes = np.array([len(r) for r in rows])
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            for i, code in zip(at, sign_codes(np.array([rows[i] for i in at], dtype=np.float64), planes(int(dims))), strict=True):
                made[i] = code.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("cid", "label", "copies")), pa.array(sizes, pa.int32()), pa.array([_packed(r) for r in rows], pa.binary()), pa.array(made, pa.binary())],
            names=["cid", "label", "copies", "dims", "vector", "codes"],
        )


def _packed(row: list[float]) -> bytes:
    """Single precision where that is exact, else double."""
    wide = np.array(row, dtype=np.float64)
    with np.errstate(over="ignore"):
        short = wide.astype(np.float32)
    return short.tobytes() if (short == wide).all() else wide.tobytes()


def _opened(rows: list[bytes], dims: int) -> np.ndarray:
    if all(len(r) == 4 * dims for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, dims).astype(np.float64)
    return np.array([np.frombuffer(r, dtype=np.float32 if len(r) == 4 * dims else np.float64) for r in rows], dtype=np.float64)


def _compare_all(frame: pd.DataFrame) -> pd.DataFrame:
    """Many small buckets in one call: each run of equal keys is compared on its own."""
    names = ["table", "code", "dims", "left", "right"]
    keys = np.column_stack([frame[names].to_numpy(), pd.factorize(frame["label"])[0]])
    order = np.lexsort(keys.T)
    keys = keys[order]
    cids, copies, block = (frame[c].to_numpy()[order] for c in ("cid", "copies", "block"))
    vectors, codes = (frame[c].to_numpy()[order] for c in ("vector", "codes"))
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    edges = [0, *cut.tolist(), len(frame)]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            table, _, dims, left, right, _ = keys[a].tolist()
            x = _opened(vectors[a:b].tolist(), dims)
            signs = np.frombuffer(b"".join(codes[a:b].tolist()), dtype=np.uint16).reshape(b - a, TABLES)[:, :table]
            side = None if left == right else block[a:b] == left
            hit, links, root = _compare(x, copies[a:b], signs, side)
            out.append((cids[a:b][hit], links, cids[a:b][root]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 3
    return pd.DataFrame(dict(zip(("cid", "links", "root"), cols, strict=True)))


def _compare(x: np.ndarray, copies: np.ndarray, codes: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked rows, their links, roots) among the rows of one block, or between two (``side``: in the left one).

    ``codes`` are those of earlier tables; a pair that shares one was counted there.
    """
    norm = np.sqrt((x * x).sum(axis=1))
    rows = np.arange(len(x))
    a, b = (rows, rows) if side is None else (rows[side], rows[~side])
    links, forest = np.zeros(len(x), dtype=np.int64), Forest(len(x))
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        i, j = np.nonzero((x[part] @ x[b].T) >= COSINE * np.outer(norm[part], norm[b]) * (1 - 1e-12))
        i, j = part[i], b[j]
        if side is None:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        new = ~(codes[i] == codes[j]).any(axis=1)
        i, j = i[new], j[new]
        exact = (x[i] * x[j]).sum(axis=1) / (norm[i] * norm[j]) >= COSINE
        i, j = i[exact], j[exact]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        forest.join(i, j)
    hit = np.flatnonzero(links)
    return hit, links[hit], forest.root[hit]


def embedding_links(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label).

    Only vectors of one label and one length are compared.  Rows with a null label, a null or zero
    vector or null, infinite or NaN components link with nothing.  Repeated rows are vectors of their
    own, linked to their copies.  A null vec_id never names a component.
    """
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0)
    # -0.0 and 0.0 are one value here
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("vector", F.when(F.col("usable"), F.transform("vector", lambda x: x + F.lit(0.0))))
    classes = rows.where("usable").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = park(classes.withColumn("cid", F.monotonically_increasing_id()), "embeddings")
    coded = classes.df.select("cid", "label", "copies", "vector").mapInArrow(_codes, "cid long, label string, copies long, dims int, vector binary, codes binary")
    coded = park(coded, "embeddings-coded")
    # two bytes of ``codes`` per table, little-endian
    byte = lambda i: F.conv(F.hex(F.substr("codes", i, F.lit(1))), 16, 10).cast("int")
    tables = F.sequence(F.lit(0), F.lit(TABLES - 1))
    placed = coded.df.select("cid", "label", "dims", "codes", F.explode(tables).alias("table"))
    placed = placed.select("cid", "label", "dims", "table", (byte(F.col("table") * 2 + 1) + 256 * byte(F.col("table") * 2 + 2)).alias("code"))
    bucket = ["label", "dims", "table", "code"]
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = placed.join(sizes, bucket).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cid", *bucket, "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    full = dealt.join(coded.df.select("cid", "copies", "vector", "codes"), "cid")
    slots = max(1, classes.df.count() * TABLES // SLOT_ROWS)
    slot = F.pmod(F.xxhash64(*bucket, "left", "right"), F.lit(slots))
    found = full.withColumn("slot", slot).groupBy("slot").applyInPandas(_compare_all, "cid long, links long, root long")
    found = park(found.groupBy("cid", "root").agg(F.sum("links").alias("links")), "embeddings-links")
    counts = found.df.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.df.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.df.select("cid", "copies", "least", "label", "vector").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("root", F.coalesce("component", "cid"))
    small = named.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = named.join(small, "root").select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where("usable").join(judged, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and what they reach; for small tables.
ORACLE = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""
