"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of the 5- to 8-grams of the lower-cased text, hashed to ``BUCKETS``.  Over a bounded
sample of labelled rows Spark counts in how many texts of each class a bucket occurs; the log of
the ratio of smoothed rates is the bucket's naive Bayes weight.  The ``FEATURES`` buckets whose
rates differ most significantly are kept, each scaled by its ratio, and a logistic regression is
fitted on them.  Scoring reads every whole text once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import distinct, fresh, hand_back, park, tidy

#: n-gram orders; hash buckets (a power of two); kept features; characters worked on at once.
ORDERS, BUCKETS, FEATURES, BLOCK = (5, 6, 7, 8), 1 << 21, 1536, 1 << 18
#: About so many labelled rows, drawn by hashes of their id and text, are learned from at most.
TRAIN_ROWS = 20_000
#: Scores from here on predict toxicity.
THRESHOLD = 0.3
#: Rows of the counted buckets that travel together; texts that are scored together.
SLICE, TEXTS = 1 << 13, 256


@dataclass
class Model:
    place: np.ndarray  # bucket -> feature or -1
    weight: np.ndarray  # by feature, the log-count ratio included
    bias: float


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, text number of each, characters left in its piece): pieces of about BLOCK
    characters; a longer text is cut with an overlap, so no n-gram is lost."""
    parts, owner, size = [], [], 0
    lap = max(ORDERS) - 1

    def flush():
        sizes = np.array([len(p) for p in parts])
        left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
        return np.concatenate(parts), np.repeat(np.array(owner), sizes), left

    for i, text in enumerate(texts):
        # white space counts as a space, and a text is framed by spaces
        codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)
        for at in range(0, max(1, len(codes) - lap), BLOCK):
            parts.append(codes[at : at + BLOCK + lap])
            owner.append(i)
            size += len(parts[-1])
            if size >= BLOCK:
                yield flush()
                parts, owner, size = [], [], 0
    if parts:
        yield flush()


def _grams(codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket at each position, positions where the n-gram fits) for each order."""
    h = codes.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            mixed = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)
            yield (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)), left[: len(h)] >= n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), dtype=np.int32)
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        for codes, owner, left in _blocks(batch.column("text").to_pylist()):
            keys = [owner[: len(bucket)][fits] * np.int64(BUCKETS) + bucket[fits] for bucket, fits in _grams(codes, left)]
            held = distinct(np.concatenate(keys))
            classes, bucket = toxic[held // BUCKETS], held % BUCKETS
            for label in (0, 1):
                counts[label] += np.bincount(bucket[classes == label], minlength=BUCKETS).astype(np.int32)
    cut = range(0, BUCKETS, SLICE)
    yield pa.RecordBatch.from_arrays(
        [pa.array([at // SLICE for at in cut], pa.int64()), pa.array([zlib.compress(counts[:, at : at + SLICE].tobytes(), 1) for at in cut], pa.binary())],
        names=["slice", "counts"],
    )


def _opened(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype=np.int32).reshape(2, SLICE)


def _add(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(_opened(x) for x in frame["counts"])
    return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _present(place: np.ndarray, texts: list[str | None]) -> list[np.ndarray]:
    """The features that each text holds, sorted."""
    out: list = [[] for _ in texts]
    width = int(place.max()) + 1 if len(place) else 0
    for codes, owner, left in _blocks(texts):
        keys = []
        for bucket, fits in _grams(codes, left):
            feature = place[bucket]
            hit = np.flatnonzero((feature >= 0) & fits)
            keys.append(owner[hit].astype(np.int64) * max(width, 1) + feature[hit])
        found = distinct(np.concatenate(keys))
        who = found // max(width, 1)
        for i, part in zip(*_runs(who), strict=True):
            out[i].append(found[part] % max(width, 1))
    none = np.empty(0, dtype=np.int64)
    return [none if not x else x[0] if len(x) == 1 else distinct(np.concatenate(x)) for x in out]


def _runs(sorted_values: np.ndarray) -> tuple[list, list]:
    if not len(sorted_values):
        return [], []
    cut = np.flatnonzero(np.diff(sorted_values)) + 1
    edges = [0, *cut.tolist(), len(sorted_values)]
    return sorted_values[edges[:-1]].tolist(), [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-penalised logistic regression, by accelerated gradient descent."""
    n, k = x.shape
    rate = y.mean()
    bias = float(np.log(rate / (1 - rate)))
    v = np.full(k, 1 / np.sqrt(max(k, 1)), dtype=x.dtype)
    for _ in range(12):
        v = x.T @ (x @ v)
        norm = np.linalg.norm(v)
        if norm == 0:
            return np.zeros(k), bias
        v /= norm
    size = 1 / (0.25 * (norm / n + 1) * 1.1 + decay)
    w, ahead, ahead_bias, t = np.zeros(k, dtype=x.dtype), np.zeros(k, dtype=x.dtype), bias, 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -40, 40))) - y).astype(x.dtype)
        new = (ahead - size * (x.T @ error / n + decay * ahead)).astype(x.dtype)
        new_bias = ahead_bias - size * float(error.mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = (new + (t - 1) / t_next * (new - w)).astype(x.dtype), new_bias + (t - 1) / t_next * (new_bias - bias)
        w, bias, t = new, new_bias, t_next
    return w, bias


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from the rows of ``documents`` (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    About ``rows`` of them are used at most, drawn by a hash of the id and, where ids repeat so that there are
    still more, by one of id and text; rows equal in both count once.  A doc_id labelled more than once counts
    as toxic if any label says so; null labels and ids are left out.  With one class only (or none) the model
    gives the share of toxic rows (0.5 without rows) to every text.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    # ``rows`` bounds what is broadcast; so the texts of all other documents stay where they are
    learned = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    if documents.select("doc_id").join(F.broadcast(known), "doc_id").count() > rows:  # ids repeat
        key = F.xxhash64("doc_id", "text")
        found = learned.select(key.alias("key")).distinct().count()
        if found > rows:
            learned = learned.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(rows / found * (1 << 30)))
        learned = learned.dropDuplicates(["doc_id", "text"])
    sampled = park(learned.select("text", "toxic"), "toxicity")
    learned = sampled.df
    classes = {r[0]: r[1] for r in learned.groupBy("toxic").count().collect()}
    n0, n1 = classes.get(False, 0), classes.get(True, 0)
    nothing = np.full(BUCKETS, -1, dtype=np.int16)
    if not n0 or not n1:
        rate = min(max(n1 / (n0 + n1), 1e-6), 1 - 1e-6) if n0 + n1 else 0.5
        return Model(nothing, np.zeros(0), float(np.log(rate / (1 - rate))))
    counted = learned.mapInArrow(tidy(_count), "slice long, counts binary").groupBy("slice").applyInPandas(_add, "slice long, counts binary")
    counts = np.zeros((2, BUCKETS))
    for r in counted.collect():  # BUCKETS / SLICE rows
        counts[:, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _opened(r["counts"])
    rate0, rate1 = (counts[0] + 0.5) / (n0 + 1), (counts[1] + 0.5) / (n1 + 1)
    ratio = np.log(rate1 / rate0)
    both = (counts[0] + counts[1] + 0.5) / (n0 + n1 + 1)

    def likelihood(k, n, p):
        return k * np.log(p) + (n - k) * np.log1p(-np.minimum(p, 1 - 1e-9))

    gain = likelihood(counts[1], n1, np.minimum(counts[1] / n1, 1 - 1e-9) + 1e-12) + likelihood(counts[0], n0, np.minimum(counts[0] / n0, 1 - 1e-9) + 1e-12)
    gain -= likelihood(counts[1], n1, both) + likelihood(counts[0], n0, both)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    best = best[gain[best] > 0]
    place = nothing.copy()
    place[best] = np.arange(len(best), dtype=np.int16)
    shared = documents.sparkSession.sparkContext.broadcast(place)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _present(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f.astype(np.int16).tobytes() for f in found], pa.binary())], names=["toxic", "found"])

    if n0 + n1 > 1.2 * rows + 1000:
        raise ValueError(f"{n0 + n1} rows drawn to learn from, {rows} wanted")
    sample = learned.mapInArrow(tidy(held), "toxic boolean, found binary").collect()  # as many short rows
    sampled.drop()
    x, y = np.zeros((len(sample), len(best)), dtype=np.float32), np.zeros(len(sample), dtype=np.float32)
    scale = ratio[best].astype(np.float32)
    for i, r in enumerate(sample):
        held_features = np.frombuffer(r["found"], dtype=np.int16)
        x[i, held_features] = scale[held_features]
        y[i] = r["toxic"]
    weight, bias = fit_logistic(x, y)
    return Model(place, weight * scale, bias)


def _rates(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text; a part of the batch at a time is held as Python strings."""
    sums: list[float] = []
    for at in range(0, len(texts), TEXTS):
        sums += [model.bias + float(model.weight[f].sum()) for f in _present(model.place, texts.slice(at, TEXTS).to_pylist())]
    return 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -40, 40)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of ``documents`` (doc_id, text); a null text counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(_rates(m, batch.column("text")), pa.float64())], names=["doc_id", "score"]
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")


def held_out(doc_id: F.Column) -> F.Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4 (null ids: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the model learns outside the held-out rows.

    Null texts count as empty and are scored, too; rows that repeat stay, with one score; a null doc_id is not
    held out.  An empty table gives an empty result; without usable labels every score is 0.5.
    """
    model = train(documents, labels.where(~held_out(F.col("doc_id"))))
    return score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, all columns kept.

    Rows with a null doc_id and null texts (as empty ones) are judged, too; rows that repeat go or stay together.
    An empty table gives an empty result.  Where the labels do not tell two classes apart nothing is known, and
    every row stays.
    """
    model = train(documents, labels.where(~held_out(F.col("doc_id"))))
    if not len(model.weight):
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array(_rates(shared.value, text), pa.float64())
        hand_back()

    (name,) = fresh(documents, "score")
    marked = documents.withColumn(name, rate(F.col("text").cast("string")))
    return marked.where(F.col(name) < THRESHOLD).drop(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` over all of ``documents``, learned from ``labels.toxic``."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
