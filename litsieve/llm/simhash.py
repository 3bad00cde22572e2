"""SimHash near-duplicates through vantage-point trees.

Fingerprints are split by Hamming distance: a tree of vantage points, built from a bounded
sample, has the shards of the index as its leaves.  A fingerprint is indexed in one shard and
asked in every shard that the triangle inequality cannot rule out, so pairs across a boundary are
found, too.  Inside a shard the same search goes on down to small leaves, where distances of all
64 bits decide.  The sample shapes the shards only; links are exact.

Distances of random 64-bit values crowd around 32, where triangle bounds prune little.  Of two
fingerprints within ``radius``, one of ``bands`` equal slices differs in ``radius // bands`` bits at
most; a tree over each slice prunes far better and loses nothing.

A shard returns, instead of its pairs, one edge from each linked node to the root of its local
component: the output is linear in the nodes however dense a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.anchors import mix64
from litsieve.llm.common import components, distinct, park, tidy

#: Hash seed and words a shingle of the query's fingerprints, and its largest distance.
SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints sampled for the vantage points; rows that a shard should index; rows of a leaf inside a shard.
SAMPLE, SHARD_ROWS, LEAF_ROWS = 1024, 8192, 96
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(raw: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of all ``width``-word shingles of a text, repeats included; A-Z lower-cased, words
    joined by one space.  Fewer words: one hash of all of them; none: no hash."""
    words = raw.lower().split()  # on bytes both are ASCII-only: A-Z, and space with \\x09-\\x0d
    if not words:
        return np.empty(0, dtype=np.uint64)
    text = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    first = (ends - sizes)[: len(words) - width + 1].tolist()
    last = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in zip(first, last, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        block = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype(">u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(shingle_hashes((t or "").encode("utf-8"), width))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row.  A null text counts as empty."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_fingerprints(width)), "doc_id long, fp long")


# ---- the tree -------------------------------------------------------------------------------


def build_tree(values: np.ndarray, depth: int):
    """Nested (pivot, median, near, far) over sampled values; a leaf is its number."""
    leaves = iter(range(1 << depth))

    def grow(part: np.ndarray, left: int):
        if left == 0 or len(part) < 2:
            return next(leaves)
        pivot = part[0]
        d = np.bitwise_count(part[1:] ^ pivot)
        median = int(np.median(d))
        near, far = part[1:][d <= median], part[1:][d > median]
        if not len(near) or not len(far):
            return next(leaves)
        return (int(pivot), median, grow(near, left - 1), grow(far, left - 1))

    return grow(values, depth)


def _homes(tree, values: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if isinstance(tree, int):
        out[rows] = tree
        return
    near = np.bitwise_count(values[rows] ^ np.uint64(tree[0])) <= tree[1]
    _homes(tree[2], values, rows[near], out)
    _homes(tree[3], values, rows[~near], out)


def _visits(tree, values: np.ndarray, rows: np.ndarray, radius: int, out: list) -> None:
    """Leaves that may hold a value within ``radius``: both bounds of the triangle inequality."""
    if not len(rows):
        return
    if isinstance(tree, int):
        out.append((tree, rows))
        return
    d = np.bitwise_count(values[rows] ^ np.uint64(tree[0])).astype(np.int64)
    _visits(tree[2], values, rows[d - radius <= tree[1]], radius, out)
    _visits(tree[3], values, rows[d + radius > tree[1]], radius, out)


def _slice(fp: np.ndarray, band: int, bands: int) -> np.ndarray:
    bits = 64 // bands
    return (fp >> np.uint64(band * bits)) & np.uint64((1 << bits) - 1) if bands > 1 else fp


def _route(trees: list, radius: int):
    """Index rows (asked = false) go to their own shard, questions to every shard they may meet."""
    bands = len(trees)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy().view(np.uint64)
            rows = np.arange(len(frame))
            for band, tree in enumerate(trees):
                values = _slice(fp, band, bands)
                home = np.zeros(len(frame), dtype=np.int64)
                _homes(tree, values, rows, home)
                visits: list = []
                _visits(tree, values, rows, radius // bands, visits)
                for leaf, found in visits:
                    out = frame.iloc[found].copy()
                    out["band"], out["shard"] = band, leaf
                    out["asked"] = home[found] != leaf
                    yield out

    return run


# ---- inside a shard ---------------------------------------------------------------------------


class Forest:
    """Components over local numbers; ``join`` takes arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]


def _search(values, fp, index, asked, radius, narrow, met) -> None:
    """Hand the pairs of ``index`` x ``asked`` within ``radius`` to ``met``, pruning by ``narrow`` on ``values``."""
    if not len(index) or not len(asked):
        return
    if len(index) > LEAF_ROWS:
        pivot = values[index[len(index) // 2]]
        d = np.bitwise_count(values[index] ^ pivot).astype(np.int64)
        median = int(np.median(d))
        close = d <= median
        if close.all():
            median -= 1
            close = d <= median
        q = np.bitwise_count(values[asked] ^ pivot).astype(np.int64)
        near, far = q - narrow <= median, q + narrow > median
        if close.any() and near.sum() + far.sum() < 1.9 * len(asked):
            _search(values, fp, index[close], asked[near], radius, narrow, met)
            _search(values, fp, index[~close], asked[far], radius, narrow, met)
            return
    wide = fp[index]
    step = max(1, (1 << 18) // len(index))
    for at in range(0, len(asked), step):
        part = asked[at : at + step]
        i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ wide[None, :]) <= radius)
        if len(i):
            met(part[i], index[j])


def _shard_edges(radius: int, bands: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["asked", "node"], kind="stable").reset_index(drop=True)
        fp = frame["fp"].to_numpy().view(np.uint64)
        asked = frame["asked"].to_numpy()
        nodes, local = np.unique(frame["node"].to_numpy(), return_inverse=True)
        forest = Forest(len(nodes))

        def met(a: np.ndarray, b: np.ndarray) -> None:
            apart = forest.root[local[a]] != forest.root[local[b]]
            a, b = a[apart], b[apart]
            for at in range(0, len(a), 1 << 14):
                forest.join(local[a[at : at + (1 << 14)]], local[b[at : at + (1 << 14)]])

        rows = np.arange(len(frame))
        values = _slice(fp, int(frame["band"].iloc[0]), bands)
        _search(values, fp, rows[~asked], rows, radius, radius // bands, met)
        root = forest.root
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})

    return run


def near_edges(items: DataFrame, radius: int, bands: int = 2, depth: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes linked over pairs within ``radius``.

    ``items``: node long (unique), fp long.  ``depth``: levels of the trees; None: as the rows ask.
    """
    if radius < 0 or bands not in (1, 2, 4, 8):
        raise ValueError("radius must be 0 or more, bands 1, 2, 4 or 8")
    if depth is None:
        depth = min(8, max(0, int(np.ceil(np.log2(max(items.count(), 1) / shard_rows)))))
    picked = items.select("fp").distinct().orderBy(F.xxhash64("fp")).limit(SAMPLE).collect() if depth else []
    sample = np.array([r[0] for r in picked], dtype=np.int64).view(np.uint64)
    trees = [build_tree(_slice(sample, band, bands), depth) for band in range(bands)]
    routed = items.select("node", "fp").mapInPandas(_route(trees, radius), "node long, fp long, band long, shard long, asked boolean")
    return routed.groupBy("band", "shard").applyInPandas(_shard_edges(radius, bands), "a long, b long").distinct()


def simhash_groups(documents: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``documents`` (doc_id, text).

    Fingerprints at ``radius`` or fewer differing bits are linked; component_id is the smallest doc_id
    reachable.  Null texts count as empty; texts without words have fingerprint zero, linked like any
    other.  Rows that repeat stay; rows with a null doc_id take part and are never the smallest.
    """
    prints = park(fingerprints(documents, width), "simhash")
    unique = park(prints.df.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-unique")
    edges = near_edges(unique.df.select(F.col("fp").alias("node"), "fp"), radius)
    roots = components(edges)
    named = unique.df.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    small = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(small, "root").select("fp", "component_id")
    return prints.df.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- the pipeline's stage: similar sets of shingles ----------------------------------------------

#: The stage: words a shingle, least Jaccard similarity, chance to miss a pair of just that similarity.
STAGE_SHINGLE, STAGE_SIMILARITY, MISS = 5, 0.8, 0.02
#: Bits of a slice beyond the logarithm of the documents; distance of slices that meet.
SLICE_BITS, SLICE_RADIUS = 6, 1
#: Slice values that a shard should index; deepest tree over slices; sampled fingerprints for each of its leaves.
VALUE_ROWS, DEEPEST, LEAF_SAMPLE = 1 << 16, 12, 4
#: Smallest nodes of places that a node is held against before groups are; 64-bit words of a fingerprint that are
#: weighed where nodes meet; shingles that are worked on at once.
NEAREST, WORDS, SHINGLES = 3, 9, 1 << 19
#: Slack of the comparison in floating point; it never loses a pair.
TINY = 1e-9


def slice_plan(rows: int, least: float = STAGE_SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """(bits of a slice, slices) for ``rows`` documents.

    Sets of similarity j have the cosine 2 j / (1 + j), so their fingerprints differ in a bit with the chance
    acos(cosine) / pi.  Slices are so wide that few unrelated ones meet, and so many that sets of similarity
    ``least`` meet in none with the chance ``miss`` only.
    """
    bits = min(48, max(12, int(np.ceil(np.log2(max(rows, 2)))) + SLICE_BITS))
    differ = float(np.arccos(2 * least / (1 + least)) / np.pi)
    meet = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
    return bits, int(np.ceil(np.log(miss) / np.log(1 - meet)))


def most_apart(bits: int, least: float = STAGE_SIMILARITY) -> int:
    """Bits in which fingerprints of ``bits`` bits may differ if sets reach ``least``: the mean and 2.5 deviations,
    beyond which stand 0.6 % of the pairs of just that similarity."""
    differ = float(np.arccos(2 * least / (1 + least)) / np.pi)
    return int(bits * differ + 2.5 * np.sqrt(bits * differ * (1 - differ)))


def set_slices(hashes: np.ndarray, sizes: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, count) slices of the SimHash fingerprints of many sets, whose shingle hashes stand end to end, and the
    fingerprints in words of 64 bits.

    A fingerprint of any width comes from hashing each shingle again; a bit is 1 if over half the hashes have it.
    """
    owner = np.repeat(np.arange(len(sizes)) * 256, sizes)
    pattern = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    out = np.zeros((len(sizes), -(-bits * count // 64) * 64), dtype=np.uint8)
    steps = np.arange(1, out.shape[1] // 64 + 1, dtype=np.uint64) * _STEP
    for word, step in enumerate(steps):
        raw = mix64(hashes + step).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            seen = np.bincount(owner + raw[:, i], minlength=len(sizes) * 256).reshape(-1, 256)
            out[:, 64 * word + 8 * i : 64 * word + 8 * i + 8] = seen @ pattern * 2 > sizes[:, None]
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    whole = np.packbits(out, axis=1).view(np.int64)
    return out[:, : bits * count].reshape(len(sizes), count, bits).astype(np.int64) @ weights, whole[:, : bits * count // 64]


def _texts_in_parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with the sorted distinct shingle hashes of their texts, about SHINGLES at a time."""
    for at in range(0, len(batch), 256):
        part = batch.slice(at, 256)
        sets: list[np.ndarray] = []
        first, held = 0, 0
        for t in part.column("text").to_pylist():
            sets.append(distinct(shingle_hashes((t or "").encode("utf-8"), STAGE_SHINGLE)))
            held += len(sets[-1])
            if held >= SHINGLES:
                yield part.slice(first, len(sets)), sets
                first, held, sets = first + len(sets), 0, []
        if sets:
            yield part.slice(first, len(sets)), sets


def _node(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), len(shingles)))


def _sliced(bits: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _texts_in_parts(batch):
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
                slices, words = set_slices(np.concatenate(sets), sizes, bits, count)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("k"), pa.array([_node(x) for x in sets], pa.int64()), rows(slices), rows(words)],
                    names=["doc_id", "k", "node", "slices", "words"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the texts that really have the wanted node (another text may have the same ``k``)."""
    for batch in batches:
        for part, sets in _texts_in_parts(batch):
            rows = [(n, x) for n, x in zip(part.column("node").to_pylist(), sets, strict=True) if n == _node(x)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([x.view(np.int64) for _, x in rows], pa.list_(pa.int64()))], names=["node", "shingles"])


def _route_values(trees: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, all_values = batch.column("table").to_numpy(), batch.column("value").to_numpy()
            for table in np.unique(tables):
                values = all_values[tables == table].view(np.uint64)
                rows = np.arange(len(values))
                home = np.zeros(len(values), dtype=np.int64)
                _homes(trees[table], values, rows, home)
                visits: list = []
                _visits(trees[table], values, rows, SLICE_RADIUS, visits)
                for leaf, found in visits:
                    n = len(found)
                    cols = [np.full(n, table, dtype=np.int32), np.full(n, leaf, dtype=np.int32), values[found].view(np.int64), home[found] != leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["table", "shard", "value", "asked"])

    return run


def _neighbours(frame: pd.DataFrame) -> pd.DataFrame:
    """Values of a shard and larger ones asked there, at a distance of SLICE_RADIUS or less: every pair once in all shards."""
    values = frame["value"].to_numpy().view(np.uint64)
    asked = frame["asked"].to_numpy()
    rows = np.arange(len(values))
    low, high = [], []

    def met(a: np.ndarray, b: np.ndarray) -> None:
        over = values[a] > values[b]
        high.append(values[a[over]])
        low.append(values[b[over]])

    _search(values, values, rows[~asked], rows, SLICE_RADIUS, SLICE_RADIUS, met)
    flat = lambda x: np.concatenate([np.empty(0, dtype=np.uint64), *x]).view(np.int64)
    return pd.DataFrame({"table": frame["table"].iloc[0], "value": flat(low), "other": flat(high)})


def _value_pairs(values: DataFrame, nodes: DataFrame, bits: int, count: int) -> DataFrame:
    """(table, value, other): slice values of ``values`` (table, value) that differ in one bit, found by vantage-point trees."""
    rows = max(1, values.count() // count)
    depth = min(DEEPEST, max(0, int(np.ceil(np.log2(rows / VALUE_ROWS)))))
    picked = nodes.orderBy(F.xxhash64("node")).limit(LEAF_SAMPLE << depth).select("slices").collect() if depth else []
    sample = np.array([r[0] for r in picked], dtype=np.int64).reshape(-1, count)
    trees = values.sparkSession.sparkContext.broadcast([build_tree(np.unique(sample[:, t]).view(np.uint64), depth) for t in range(count)])
    routed = values.mapInArrow(lambda x: _route_values(trees.value)(x), "table int, shard int, value long, asked boolean")
    return routed.groupBy("table", "shard").applyInPandas(_neighbours, "table int, value long, other long")


def _close(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (batch.column(c).flatten().to_numpy().reshape(len(batch), -1) for c in ("of_a", "of_b"))
                apart = np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int32)
                keep = np.flatnonzero(apart <= limit)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(apart[keep])], names=["a", "b", "apart"])

    return run


def similar_groups(documents: DataFrame, least: float = STAGE_SIMILARITY) -> DataFrame:
    """doc_id, component_id: documents linked where the similarity (Jaccard) of their sets of five-word shingles
    is ``least`` or more.

    Candidates are found by SimHash and vantage-point trees: of a fingerprint of many bits, pairs meet in a
    slice that differs in one bit at most, and trees over the slice values find these (see ``slice_plan`` for
    the chance to miss a pair).  Candidates whose whole fingerprints differ in more bits than ``most_apart``
    says are dropped; all others are confirmed on the sets themselves, so no pair is linked by estimate.

    A slice value with the values one bit away is a place.  First every document is held against the nearest
    few of the smallest nodes of the places where it stands; then those that meet and are in different groups.
    Pairs within a group, however large, are never listed.

    Null texts and texts without words have the empty set and are alike; equal sets are one node.  Rows that
    repeat stay; a null doc_id is never the smallest.  An empty table gives an empty result.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    bits, count = slice_plan(documents.count(), least)
    prints = park(texts.mapInArrow(tidy(_sliced(bits, count)), "doc_id long, k long, node long, slices array<long>, words array<long>"), "similar")
    nodes = park(prints.df.groupBy("node").agg(F.min("k").alias("k"), F.first("slices").alias("slices"), F.first("words").alias("words")), "similar-nodes")
    placed = park(nodes.df.select("node", F.posexplode("slices").alias("table", "value")), "similar-placed")
    values = park(placed.df.select("table", "value").distinct(), "similar-values")
    pairs = park(_value_pairs(values.df, nodes.df, bits, count), "similar-pairs")
    values.drop()
    guests = pairs.df.join(placed.df.withColumnRenamed("value", "other"), ["table", "other"]).select("table", "value", "node", F.lit(False).alias("own"))
    at = ["table", "value"]
    met = placed.df.select(*at, "node", F.lit(True).alias("own")).unionByName(guests)
    centres = met.groupBy(*at).agg(F.count("*").alias("n"), F.min(F.when(F.col("own"), F.col("node"))).alias("a")).where("n > 1").drop("n")
    met = park(met.join(centres, at), "similar-met")
    pairs.drop()
    placed.drop()

    def close(found: DataFrame) -> DataFrame:
        side = lambda x: nodes.df.select(F.col("node").alias(x), F.col("words").alias(f"of_{x}"))
        return found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(tidy(_close(most_apart(bits * count // 64 * 64, least))), "a long, b long, apart int")

    def confirmed(found: DataFrame) -> DataFrame:
        """The pairs whose sets are similar."""
        wanted = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.df.select("node", "k"), "node")
        held = texts.select("k", "text").join(wanted, "k").groupBy("node", "k").agg(F.first("text").alias("text"))
        held = park(held.mapInArrow(tidy(_sets), "node long, shingles array<long>"), "similar-sets")
        side = lambda x: held.df.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        union = F.size("of_a") + F.size("of_b") - both
        out = park(found.join(side("b"), "b").join(side("a"), "a").where(both + TINY >= least * union).select("a", "b"), "similar-edges")
        held.drop()
        return out.df

    stars = park(close(met.df.where("a <> node").select("a", F.col("node").alias("b")).distinct()), "similar-stars")
    nearest = F.slice(F.array_sort(F.collect_set(F.struct("apart", "a"))), 1, NEAREST)  # of as many as a node has places
    tried = park(stars.df.groupBy("b").agg(nearest.alias("near")).select("b", F.explode("near.a").alias("a")), "similar-tried")
    edges = confirmed(tried.df)
    roots = components(edges)
    grouped = met.df.select(*at, "node", "own").join(roots, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    grouped = park(grouped, "similar-grouped")
    met.drop()
    mixed = grouped.df.groupBy(*at).agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select(*at)
    mixed = park(grouped.df.join(mixed, at), "similar-mixed")
    grouped.drop()
    # pairs of different groups are weighed by part of their fingerprints where they meet, so few are ever made
    part = range(bits * count // 64)[:WORDS]
    words = nodes.df.select("node", *[F.element_at("words", i + 1).alias(f"w{i}") for i in part])
    weighed = mixed.df.join(words, "node")
    one, other = weighed.where("own").alias("x"), weighed.alias("y")
    differ = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in part), F.lit(0))
    meet = (F.col("x.group") != F.col("y.group")) & (~F.col("y.own") | (F.col("x.node") < F.col("y.node"))) & (differ <= most_apart(64 * len(part), least))
    cross = one.join(other, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in at] + [meet])
    cross = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    cross = park(cross.join(tried.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "similar-cross")
    mixed.drop()
    roots = components(edges.unionByName(confirmed(cross.df)))
    least_of = prints.df.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least_of.join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    small = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("node", "root").join(small, "root").select("node", "component_id")
    return prints.df.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def keep_first(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are the first of their group.

    Rows equal in doc_id and text count once; of such rows that differ in other columns the one stays that is
    least by these.  Rows with a null doc_id stay.
    """
    firsts = groups.where("doc_id = component_id").select("doc_id").distinct()
    known = documents.where("doc_id is not null").join(firsts, "doc_id", "left_semi")
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    known = known.select("doc_id", "text", F.struct(F.lit(0).alias("text"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    known = known.groupBy("doc_id", "text").agg(F.min("rest").alias("rest")).select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest])
    return known.select(*documents.columns).unionByName(documents.where("doc_id is null"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``simhash_groups`` over all of ``documents``."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
