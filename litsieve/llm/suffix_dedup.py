"""Exact removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else in the corpus.

1. Every window of ``LENGTH`` bytes has an anchor that its own bytes decide (see ``anchors``); a run
   of windows with one anchor and the bytes they cover are a *context*.  Equal windows have equal
   bytes from the anchor on, the core, so only contexts whose core repeats can matter.
2. A context that repeats as a whole, by a 128-bit digest, is decided: all its windows repeat.
3. The other contexts of a repeated core are sorted by suffixes: fingerprints of the windows
   nominate the suffixes where a repeat may begin, deep-shallow sorting orders them, and the longest
   common prefix with a neighbour says how many windows from there on repeat.
4. A core with more than ``HOT`` different contexts is not brought into one task: its windows are
   counted by 128-bit digests, which combine before they are shuffled.

What is shuffled per text is one row per anchor (a byte in 128 is one), the contexts of step 3, and
the text itself twice.  Equal texts are known by 128 bits and their size; so are whole contexts and the
windows of step 4.  Step 3 alone compares bytes.

``removal_report`` looks for two lengths.  A byte under a long string that repeats is under short ones
that repeat, so the search for the long ones reads only the stretches that short ones cover without a gap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.anchors import RangeHash, window_anchors
from litsieve.llm.chunks import slices
from litsieve.llm.common import fresh, hand_back, park, tables_of, tidy

#: Bytes of a repeated string; positions that a window's anchor is chosen from.
LENGTH, WIDTH = 400, 256
#: Bytes of a repeated passage, which is reported and stays: one of over 50 words is rarely shorter.
PASSAGE = 200
#: Different contexts of a core above which its windows are counted instead; contexts that one call sorts, about.
HOT, SLOT_CONTEXTS = 4096, 4096
#: Bytes worked on at once; bytes that the multikey quicksort looks at; groups it hands to plain sorting.
BUFFER, SHALLOW, SMALL = 1 << 20, 32, 24


# ---- deep-shallow sorting -------------------------------------------------------------------------


def _common(data: bytes, a: int, a_end: int, b: int, b_end: int) -> int:
    """Length of the longest common prefix of data[a:a_end] and data[b:b_end]."""
    n = min(a_end - a, b_end - b)
    differ = int.from_bytes(data[a : a + n], "big") ^ int.from_bytes(data[b : b + n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A trie of suffixes whose inner nodes keep only the depth and the bytes where branches part."""

    def __init__(self, data: bytes, starts: list[int], ends: list[int]):
        self.data, self.starts, self.ends = data, starts, ends
        self.root = None  # a leaf is a list of equal suffixes, an inner node (depth, {byte: node}); -1: ends there

    def _byte(self, i: int, depth: int) -> int:
        at = self.starts[i] + depth
        return self.data[at] if at < self.ends[i] else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            path.append(node)
            depth, branches = node
            # a blind descent: where no branch fits, any one will do for the comparison
            node = branches.get(self._byte(i, depth)) or next(iter(branches.values()))
        other = node[0]
        common = _common(self.data, self.starts[i], self.ends[i], self.starts[other], self.ends[other])
        if common == self.ends[i] - self.starts[i] == self.ends[other] - self.starts[other]:
            node.append(i)
            return
        below, k = node, len(path)
        while k and path[k - 1][0] > common:
            k -= 1
            below = path[k]
        if k and path[k - 1][0] == common:
            path[k - 1][1][self._byte(i, common)] = [i]
            return
        made = (common, {self._byte(other, common): below, self._byte(i, common): [i]})
        if k:
            branches = path[k - 1][1]
            branches[self._byte(i, path[k - 1][0])] = made
        else:
            self.root = made

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(suffix, longest common prefix with any other suffix of the trie), in order."""
        stack = [(self.root, 0)]
        while stack:
            node, above = stack.pop()
            if isinstance(node, tuple):
                stack.extend((node[1][b], node[0]) for b in sorted(node[1], reverse=True))
            else:
                for i in node:
                    yield i, above if len(node) == 1 else self.ends[i] - self.starts[i]


def deep_shallow(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end], and each one's longest common prefix with another.

    A multikey quicksort takes eight bytes a step down to ``SHALLOW``; groups that still agree
    there, which repeats make long, are ordered by a blind trie each.  Prefixes shorter than
    ``SHALLOW`` are reported as 0.
    """
    n = len(starts)
    order, longest = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    s, e = starts.tolist(), ends.tolist()
    view = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    filled = 0

    def word(rows: np.ndarray, depth: int) -> np.ndarray:
        at = starts[rows] + depth
        out = np.zeros(len(rows), dtype=np.uint64)
        for k in range(8):
            inside = at + k < ends[rows]
            out = (out << np.uint64(8)) | np.where(inside, view[np.minimum(at + k, len(view) - 1)], 0).astype(np.uint64)
        return out

    def deep(rows: list[int]) -> None:
        nonlocal filled
        trie = BlindTrie(data, s, e)
        for i in rows:
            trie.insert(i)
        for i, common in trie.ordered():
            order[filled] = i
            longest[i] = common if len(rows) > 1 else 0
            filled += 1

    stack = [(np.arange(n), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows):
            continue
        if len(rows) == 1:
            order[filled] = rows[0]
            filled += 1
        elif depth >= SHALLOW:
            deep(rows.tolist())
        elif len(rows) <= SMALL:
            keys: dict[bytes, list[int]] = {}
            for i in rows.tolist():
                keys.setdefault(data[s[i] : min(s[i] + SHALLOW, e[i])], []).append(i)
            for key in sorted(keys):
                deep(keys[key])
        else:
            keys_at = word(rows, depth)
            pivot = np.partition(keys_at, len(rows) // 2)[len(rows) // 2]
            stack.append((rows[keys_at > pivot], depth))
            stack.append((rows[keys_at == pivot], depth + 8))
            stack.append((rows[keys_at < pivot], depth))
    return order, longest


# ---- contexts -------------------------------------------------------------------------------------


def _anchored(length: int, width: int):
    digest = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k")
            for first, texts in slices(batch.column("text"), BUFFER):
                # the texts stand end to end in Arrow's buffer
                bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                joined = memoryview(texts.buffers()[2])[bounds[0] : bounds[-1]]
                data, starts, sizes = np.frombuffer(joined, dtype=np.uint8), bounds[:-1] - bounds[0], np.diff(bounds)
                owner, lo, hi, anchor = window_anchors(data, starts, sizes, length, width)
                if not len(owner):
                    continue
                core = RangeHash(data)(anchor, anchor + length - width + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(first + owner)),
                        pa.array(sizes[owner].astype(np.int32)),
                        pa.array(core.view(np.int64)),
                        pa.array([digest(joined[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)], pa.binary()),
                        pa.array((lo - starts[owner]).astype(np.int32)),
                        pa.array((hi - lo + 1).astype(np.int32)),
                    ],
                    names=["k", "n", "h", "c", "lo", "m"],
                )

    return run


def _cut(length: int):
    """The bytes of each needed context; of hot ones a digest of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in (whole.slice(at, 512) for at in range(0, len(whole), 512))):
            out: list[list] = [[] for _ in range(8)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("k", "n", "text", "need")), strict=True)
            for k, n, text, need in rows:
                raw = text if isinstance(text, bytes) else text.encode("utf-8")
                for x in need:
                    lo, m = x["lo"], x["m"]
                    context = raw[lo : lo + m - 1 + length]
                    digests = None
                    if x["hot"]:
                        digests = [xxhash.xxh3_128_digest(context[i : i + length]) for i in range(m)]
                        context = None
                    for c, v in zip(out, (k, n, x["h"], lo, m, x["single"], context, digests), strict=True):
                        c.append(v)
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["k", "n", "h", "lo", "m", "single", "context", "digests"])

    return run


def _sorted_runs(length: int):
    """Runs of repeated windows in the contexts of one slot that do not repeat as a whole."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        contexts = frame["context"].tolist()
        data = b"".join(contexts)
        size = np.array([len(c) for c in contexts], dtype=np.int64)
        begin, m = np.cumsum(size) - size, frame["m"].to_numpy().astype(np.int64)
        head = np.cumsum(m) - m  # number of each context's first window
        owner = np.repeat(np.arange(len(m)), m)
        within = np.arange(len(owner)) - head[owner]
        at = begin[owner] + within
        mark = RangeHash(np.frombuffer(data, dtype=np.uint8))(at, at + length)
        _, same, often = np.unique(mark, return_inverse=True, return_counts=True)
        open_ = (often[same] > 1) & frame["single"].to_numpy()[owner]
        covered = np.zeros(len(owner) + 1, dtype=np.int64)
        ends = (begin + size)[owner]
        while open_.any():
            leads = open_.copy()
            leads[1:] &= ~(open_[:-1] & (owner[1:] == owner[:-1]))
            lead = np.flatnonzero(leads)
            wanted = np.zeros(len(often), dtype=bool)
            wanted[same[lead]] = True
            chosen = np.flatnonzero(wanted[same])
            _, longest = deep_shallow(data, at[chosen], ends[chosen])
            reach = np.zeros(len(owner), dtype=np.int64)
            reach[chosen] = longest
            more = np.minimum(reach[lead] - length + 1, m[owner[lead]] - within[lead])  # windows that repeat from here on
            open_[lead] = False
            true = more > 0
            spans = np.zeros(len(owner) + 1, dtype=np.int64)
            np.add.at(spans, lead[true], 1)
            np.add.at(spans, lead[true] + more[true], -1)
            covered += spans
            open_ &= np.cumsum(spans)[:-1] == 0
        hit = np.cumsum(covered)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        first, last = edge[::2], edge[1::2] - 1
        # a run may go on from one context into the next: cut it there
        parts = [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        rows = []
        for a, b in parts:
            while owner[a] != owner[b]:
                stop = int(head[owner[a]] + m[owner[a]] - 1)
                rows.append((a, stop))
                a = stop + 1
            rows.append((a, b))
        a = np.array([r[0] for r in rows], dtype=np.int64)
        b = np.array([r[1] for r in rows], dtype=np.int64)
        who = owner[a] if len(a) else a
        return pd.DataFrame(
            {
                "k": frame["k"].to_numpy()[who],
                "n": frame["n"].to_numpy()[who],
                "lo": (frame["lo"].to_numpy()[who] + within[a] if len(a) else a).astype(np.int32),
                "m": (b - a + 1).astype(np.int32),
            }
        )

    return run


def text_key(text: F.Column) -> tuple[F.Column, F.Column]:
    """What equal texts are known by: 128 bits of two hashes and the number of bytes."""
    half = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(half(F.xxhash64(text)), half(F.xxhash64(F.lit(1), text))).alias("k"), F.octet_length(text).cast("int").alias("n")


def repeated_spans(texts: DataFrame, length: int = LENGTH, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """k, n, spans (array of struct start, stop; windows' bytes, unsorted, overlapping) of each text
    of ``texts`` (column text, string or binary, not null) that holds a string of ``length`` bytes which repeats.

    ``width``, less than ``length``: positions an anchor is chosen from.  It decides the work, not the result.
    """
    if not 0 < width < length:
        raise ValueError("width must be positive and less than length")
    keyed = texts.select(*text_key(F.col("text")), "text").where(F.col("n") >= length)
    anchors = park(keyed.mapInArrow(tidy(_anchored(length, width)), "k binary, n int, h long, c binary, lo int, m int"), "anchors")
    twice = park(anchors.df.groupBy("h").count().where("count > 1").select("h"), "twice")
    # no grouping below or on top of the join: Spark may then split the rows of a core that a large part
    # of the corpus holds
    matched = park(anchors.df.join(twice.df, "h"), "matched")
    anchors.drop()
    twice.drop()
    contexts = matched.df.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("k", "n", "lo", "m")).alias("at"))
    contexts = park(contexts, "contexts")
    cores = contexts.df.groupBy("h").agg(F.count("*").alias("different"), F.count_if(F.col("times") == 1).alias("singles")).where("different > 1 and singles > 0")
    whole = matched.df.join(contexts.df.where("times > 1").select("h", "c"), ["h", "c"]).select("k", "n", "lo", "m")
    need = contexts.df.join(cores, "h").select("at.*", F.struct("h", "at.lo", "at.m", (F.col("times") == 1).alias("single"), (F.col("different") > hot).alias("hot")).alias("x"))
    need = need.groupBy("k", "n").agg(F.collect_list("x").alias("need"))
    once = keyed.dropDuplicates(["k", "n"])
    cut = once.join(need, ["k", "n"]).select("k", "n", "text", "need").mapInArrow(tidy(_cut(length)), "k binary, n int, h long, lo int, m int, single boolean, context binary, digests array<binary>")
    cut = park(cut, "cut")
    slots = max(1, cut.df.where("context is not null").count() // SLOT_CONTEXTS)
    slot = F.pmod(F.xxhash64("h"), F.lit(slots))
    some = cut.df.where("context is not null").withColumn("slot", slot).groupBy("slot").applyInPandas(_sorted_runs(length), "k binary, n int, lo int, m int")
    windows = cut.df.where("digests is not null").select("k", "n", "lo", "single", F.posexplode("digests").alias("i", "digest"))
    again = windows.groupBy("digest").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("times")).where("times > 1")
    counted = windows.where("single").join(again, "digest").select("k", "n", (F.col("lo") + F.col("i")).cast("int").alias("lo"), F.lit(1).alias("m"))
    spans = whole.unionByName(some).unionByName(counted).distinct()
    return spans.groupBy("k", "n").agg(F.collect_list(F.struct(F.col("lo").alias("start"), (F.col("lo") + F.col("m") - 1 + length).alias("stop"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merged([(s["start"], s["stop"]) for s in spans or ()])
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts), runs


def with_spans(documents: DataFrame, length: int = LENGTH, width: int | None = None) -> tuple[DataFrame, str]:
    """All rows and columns of ``documents`` and one more, whose name is given, too: the repeated spans, to be
    merged; null where nothing repeats."""
    k, n, spans = fresh(documents, "k", "n", "spans")
    texts = documents.where("text is not null").select(F.col("text").cast("string").alias("text"))
    found = repeated_spans(texts, length, width or length * WIDTH // LENGTH).withColumnsRenamed({"k": k, "n": n, "spans": spans})
    of_text, size = text_key(F.col("text").cast("string"))
    return documents.withColumn(k, of_text).withColumn(n, size).join(found, [k, n], "left").drop(k, n), spans


def _passages(length: int):
    """The bytes and runs of passages of each text, and the runs that may hold a string of ``length`` bytes.

    A text with such runs is handed on; of the others, which stay whole, the digest is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in (whole.slice(at, 512) for at in range(0, len(whole), 512))):
            rows: list[tuple] = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                runs = merged([(s["start"], s["stop"]) for s in spans or ()])
                stretches = [{"start": a, "stop": b} for a, b in runs if b - a >= length]
                whole = (None, hashlib.sha256(raw).hexdigest()) if not stretches else (raw, None)
                rows.append((len(raw), *whole, sum(b - a for a, b in runs), len(runs), stretches))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k", "n")), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                names=["doc_id", "k", "n", "n_bytes", "text", "kept_sha256", "n_passage_bytes", "n_passages", "stretches"],
            )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in (whole.slice(at, 512) for at in range(0, len(whole), 512))):
        rows: list[tuple] = []
        for raw, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            kept, runs = _kept(raw, spans)
            rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), batch.column("n_passage_bytes"), batch.column("n_passages")],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "n_passages"],
        )


def removal_report(documents: DataFrame, length: int = LENGTH, width: int | None = None, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, n_passages of every row of ``documents`` (doc_id, text).

    Strings of ``length`` bytes that repeat are removed.  Passages are strings of ``passage`` bytes, at most
    ``length``, that start anywhere else, too: their bytes and maximal runs are counted, and they stay.
    Null texts count as empty; rows that repeat stay, and their texts, being copies, go as far as
    they have ``length`` bytes.
    """
    if not 1 < passage <= length:
        raise ValueError("passage must be at least 2 and at most length")
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with tables_of() as made:
        found, spans = with_spans(slim, passage)
        found = found.select("doc_id", "text", *text_key(F.col("text")), F.col(spans).alias("spans"))
        kinds = "doc_id long, k binary, n int, n_bytes long, text binary, kept_sha256 string, n_passage_bytes long, n_passages long, stretches array<struct<start:int,stop:int>>"
        held = park(found.mapInArrow(tidy(_passages(length)), kinds), "held")
    made.drop(but=held)
    # a string of ``length`` bytes stands in stretches wherever it stands, so that its other places are all there
    some = held.df.where("size(stretches) > 0")
    pieces = some.select("k", "n", "text", F.explode("stretches").alias("x")).select("k", "n", "x.start", F.substring("text", F.col("x.start") + 1, F.col("x.stop") - F.col("x.start")).alias("text"))
    pieces = park(pieces, "pieces")
    again = repeated_spans(pieces.df.select("text"), length, width or length * WIDTH // LENGTH).withColumnsRenamed({"k": "of", "n": "size"})
    of, size = text_key(F.col("text"))
    moved = F.transform("spans", lambda s: F.struct((s.start + F.col("start")).alias("start"), (s.stop + F.col("start")).alias("stop")))
    runs = pieces.df.select("k", "n", "start", of.alias("of"), size.alias("size")).distinct().join(again, ["of", "size"])
    runs = runs.groupBy("k", "n").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    told = some.drop("n_bytes", "kept_sha256").join(runs, ["k", "n"], "left").select("doc_id", "text", "spans", "n_passage_bytes", "n_passages")
    told = told.mapInArrow(tidy(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long")
    none = F.lit(0).cast("long")
    rest = held.df.where("size(stretches) = 0").withColumns({"n_removed": none, "n_spans": none})
    return told.unionByName(rest.select(told.columns))


def remove_repeats(documents: DataFrame, length: int = LENGTH, width: int | None = None) -> DataFrame:
    """``documents`` with the repeated bytes taken out of ``text``; a character that loses bytes goes.

    All rows and columns stay; a null text stays null; texts that repeat as a whole and are long enough
    become empty; where ``n_chars`` is a column it is counted anew.
    """

    @F.arrow_udf("string")
    def strip(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = [pa.array([], pa.string())]
            for at in range(0, len(texts), 512):
                rows = zip(texts.slice(at, 512).to_pylist(), spans.slice(at, 512).to_pylist(), strict=True)
                out.append(pa.array([t if t is None or s is None else _kept(t.encode("utf-8"), s)[0].decode("utf-8", "ignore") for t, s in rows], pa.string()))
            yield pa.concat_arrays(out)
        hand_back()

    found, spans = with_spans(documents, length, width)
    out = found.withColumn("text", strip(F.col("text").cast("string"), F.col(spans))).drop(spans)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``removal_report`` over all of ``documents``: 400 bytes are removed, passages of 200 bytes are counted."""
    return removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
