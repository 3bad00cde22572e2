"""Best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence.  The fractional program, fewest
sequences that cover every length as often as it occurs, is solved by multiplicative weights: each
round prices the lengths, a knapsack dynamic program finds the best configuration at those prices,
and lengths that it covers get cheaper.  The solution is rounded down to whole sequences; what that
leaves is priced and placed by the same knapsack.  So program and knapsack place about 84 % of the
tokens on the tables at hand; best fit adds the shortest piece of each sequence and the gap fillers.

All of that looks at the histogram only (at most ``CAPACITY`` numbers), whatever the corpus.  The plan
it yields sends the r-th piece of a length to a sequence and an offset, so pieces are placed by their
rank, in parallel.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.chunks import ROOM, Chunks, slices, three_parts
from litsieve.llm.common import park, ranked, tidy

#: Tokens of a sequence; end-of-document id.
CAPACITY, END = 4096, 1
#: Classes of lengths that the program is solved over; how fast a met demand gets cheaper; part of a demand that a round may meet.
CLASSES, RATE, PART = 96, 0.3, 0.15
#: What a piece as long as a sequence is worth beyond its length; part of the volume, in the shortest pieces, that fills gaps at the end.
BONUS, SPARE = 0.05, 0.05
#: Pieces that one bucket ranks, about.
BUCKET_ROWS = 20_000
VOCABULARY = "word_bpe_49k.json"


# ---- tokens ------------------------------------------------------------------------------------------


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What stands for itself between other characters: runs of lower-case letters, runs of ASCII marks but the
#: apostrophe, single digits.  The tokenizer changes none of these and splits between them.
LETTERS, MARKS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PART = re.compile(rf"[{LETTERS}]+|[{MARKS}]+|[0-9]")
_LETTERS = re.compile(rf"[{LETTERS}]+")
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class WordIds:
    """Token ids of texts by a tokenizer that never joins text across white space.

    Distinct chunks between ASCII white space are cut into a run of plain letters and the marks around it,
    and each distinct part is encoded once and remembered (see ``chunks``).  Parts of plain letters, marks
    and digits are encoded many at a time and without normalisation, of which they need none; all others go
    through the whole tokenizer.
    """

    def __init__(self, path: str, end: int = END, room: int = ROOM):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole, self._bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self._bare.normalizer = None
        self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._chunks = Chunks(self._learn, self._cut, 3, np.array([end], dtype="<u4").tobytes(), room)
        vocab = self._whole.get_vocab()
        self._final = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self._final[i] = token.endswith("</w>")

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    @staticmethod
    def _cut(chunks: pa.StringArray) -> pa.StringArray:
        behind = pc.utf8_ltrim(chunks, characters=_EDGES)
        core = pc.utf8_rtrim(behind, characters=_EDGES)
        plain = pc.and_(pc.match_substring_regex(core, f"^[{LETTERS}]+$"), pc.invert(pc.match_substring(chunks, "<|")))
        size = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False)
        return three_parts(chunks, plain.to_numpy(zero_copy_only=False), size(core), size(chunks) - size(behind))

    def _learn(self, parts: list[str]) -> list[bytes]:
        split = {c: _PART.findall(c) for c in parts if not _LETTERS.fullmatch(c) and "<|" not in c}  # special tokens begin so
        split = {c: p for c, p in split.items() if p and sum(map(len, p)) == len(c)}
        letters = [c for c in parts if _LETTERS.fullmatch(c)]
        new = list({*letters, *chain.from_iterable(split.values())})
        # a part has one final token, so many fit one call
        groups = [new[i : i + 32] for i in range(0, len(new), 32)]
        known: dict[str, bytes] = {}
        odd: list[str] = []
        for group, ids in zip(groups, self._encode(self._bare, [" ".join(g) for g in groups]), strict=True):
            made = np.array(ids, dtype="<u4")
            ends = np.flatnonzero(self._final[made]) + 1
            if len(ends) != len(group):
                odd += group
                continue
            whole, begin = made.tobytes(), 0
            for part, stop in zip(group, (ends * 4).tolist(), strict=True):
                known[part] = whole[begin:stop]
                begin = stop
        rest = odd + [c for c in parts if c and c not in known and c not in split]
        alone = {c: np.array(i, dtype="<u4").tobytes() for c, i in zip(rest, self._encode(self._whole, rest), strict=True)}
        known.update(alone)
        known.update([(c, b"".join([known[x] for x in p])) for c, p in split.items()])
        known[""] = b""
        return [known[c] for c in parts]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts`` (strings, not null), each with the end-of-document id, end to end, and where each begins."""
        lower = pc.ascii_lower(texts)
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():  # the strings of special tokens tell cases apart
            lower = pc.if_else(special, texts, lower)
        return self._chunks.gather(pc.ascii_split_whitespace(lower))


_WORDS: dict[tuple, WordIds] = {}


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, end) not in _WORDS:
            _WORDS[path, end] = WordIds(path, end)
        words = _WORDS[path, end]
        for batch in batches:
            docs = batch.column("doc_id")
            for at, texts in slices(pc.fill_null(batch.column("text"), "")):
                ids, bounds = words(texts)
                sizes = np.diff(bounds)
                count = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(texts)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(sizes[owner] - piece * capacity, capacity)
                first = bounds[owner] + piece * capacity
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                marks = [zlib.crc32(raw[a:b]) for a, b in zip((first * 4).tolist(), ((first + length) * 4).tolist(), strict=True)]
                cols = [docs.slice(at, len(texts)).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(marks, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the ids of every text and ``end``, cut at ``capacity``.

    A null text counts as empty and is ``end`` alone; rows that repeat stay.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_pieces(path or vocabulary_path(), capacity, end)), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the plan ----------------------------------------------------------------------------------------


def knapsack(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of ``sizes`` of greatest worth within ``capacity``, size i at most ``most[i]`` times: {index: times}."""
    value = np.zeros(capacity + 1)
    bundles, taken = [], []
    for i in np.flatnonzero((worth > 0) & (most > 0)).tolist():
        left, times = min(int(most[i]), capacity // int(sizes[i])), 1
        while left:  # bundles of 1, 2, 4, ... make up every number of times
            times = min(times, left)
            left -= times
            size, gain = times * int(sizes[i]), times * worth[i]
            better = value[: capacity + 1 - size] + gain
            take = better > value[size:] + 1e-12
            np.copyto(value[size:], better, where=take)
            bundles.append((i, times, size))
            taken.append(take)
            times *= 2
    out: dict[int, int] = {}
    c = capacity
    for (i, times, size), take in zip(reversed(bundles), reversed(taken), strict=True):
        if c >= size and take[c - size]:
            out[i] = out.get(i, 0) + times
            c -= size
    return out


def worths(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """First prices: the share of a sequence, and a little more for long pieces, which are harder to place."""
    share = sizes / capacity
    return share * (1 + BONUS * share)


def fractional(sizes: np.ndarray, demand: np.ndarray, capacity: int, rate: float = RATE, part: float = PART) -> dict[tuple, float]:
    """Multiplicative weights on the covering program: {((index, times), ...): sequences} that meet every demand exactly.

    Each round finds the best configuration at the prices of the moment and uses it until one of its sizes
    has got ``part`` of its demand more, or all of it.  A size's price falls with the share of its demand
    that is met, and is nothing once it is met; so there are len(sizes) / part rounds at most, and a few more.
    """
    found: dict[tuple, float] = {}
    met, worth = np.zeros(len(sizes)), worths(sizes, capacity)
    fits = np.minimum(capacity // sizes, np.ceil(demand)).astype(np.int64)
    while True:
        open_ = met < 1 - 1e-9
        if not open_.any():
            return found
        ahead = met - np.average(met, weights=sizes * demand)
        picked = knapsack(sizes, np.where(open_, worth * np.exp(-rate * ahead), 0.0), fits, capacity)
        step = min(demand[i] * min(part, 1 - met[i]) / t for i, t in picked.items())
        config = tuple(sorted(picked.items()))
        found[config] = found.get(config, 0.0) + step
        for i, t in picked.items():
            met[i] += step * t / demand[i]


def rounded(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """[({index: times}, sequences)] that hold every demand: the fractional program rounded down, and what is
    left by the same knapsack held to what is left, the largest size first."""
    left = demand.copy()
    plan: list[tuple[dict[int, int], int]] = []
    for config, amount in fractional(sizes, demand.astype(np.float64), capacity).items():
        n = int(amount + 1e-6)
        if n:
            plan.append((dict(config), n))
            for i, t in config:
                left[i] -= n * t
    while (left > 0).any():
        first = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[first] -= 1
        picked = knapsack(sizes, worths(sizes, capacity), rest, capacity - int(sizes[first]))
        picked[first] = picked.get(first, 0) + 1
        n = min(int(left[i]) // t for i, t in picked.items())
        plan.append((picked, n))
        for i, t in picked.items():
            left[i] -= n * t
    return plan


def length_classes(histogram: dict[int, int], count: int) -> list[list[int]]:
    """The lengths in order, cut where about equally many pieces stand in each class."""
    sizes = sorted(histogram)
    total, seen = sum(histogram.values()), 0
    out: list[list[int]] = [[] for _ in range(count)]
    for s in sizes:
        out[min(count - 1, (2 * seen + histogram[s]) * count // (2 * total))].append(s)
        seen += histogram[s]
    return [c for c in out if c]


class Stock:
    """The pieces of a class, handed out from either end."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.rows = deque([s, n] for s, n in sorted(rows))

    def take(self, n: int, longest: bool) -> list[tuple[int, int]]:
        """``n`` pieces as (length, number), the last of the list first in turn."""
        out, end = [], -1 if longest else 0
        while n:
            size, held = self.rows[end]
            k = min(held, n)
            out.append((size, k))
            n -= k
            self.rows[end][1] -= k
            if held == k:
                self.rows.pop() if longest else self.rows.popleft()
        return out[::-1]


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """[({length: times}, sequences)]: whole sequences that hold every piece of ``histogram`` exactly.

    The program is solved and rounded over ``classes`` classes of lengths, each at its mean.  Its
    configurations are then filled with pieces of their classes, all but the shortest of each: that one
    closes the sequence, and best fit picks it for the space that the others really leave.  The shortest
    pieces, up to ``SPARE`` of the volume, fill what gaps remain.
    """
    histogram = {int(s): int(n) for s, n in histogram.items() if n > 0}
    if not histogram:
        return []
    volume, rest, spared = sum(s * n for s, n in histogram.items()), {}, 0
    for size in sorted(histogram):
        spared += size * histogram[size]
        if spared > SPARE * volume:
            break
        rest[size] = histogram.pop(size)
    groups = length_classes(histogram, classes)
    demand = np.array([sum(histogram[s] for s in g) for g in groups], dtype=np.int64)
    means = np.array([-(-sum(s * histogram[s] for s in g) // int(d)) for g, d in zip(groups, demand, strict=True)], dtype=np.int64)
    stocks = [Stock([(s, histogram[s]) for s in g]) for g in groups]
    placed: list[tuple[dict[int, int], int]] = []
    for config, n in rounded(means, demand, capacity):
        slots = [i for i in sorted(config, reverse=True) for _ in range(config[i])]
        # long pieces of one class meet short ones of the next, so sums stay near those of the means
        drawn = [stocks[i].take(n, k % 2 == 0) for k, i in enumerate(slots[: max(1, len(slots) - 1)])]
        at = 0
        while at < n:  # as many sequences at once as get the same lengths
            same = min(d[-1][1] for d in drawn)
            made: dict[int, int] = {}
            room = capacity
            for d in drawn:
                size, held = d.pop()
                if held > same:
                    d.append((size, held - same))
                if size <= room:
                    made[size] = made.get(size, 0) + 1
                    room -= size
                else:  # classes count at their means, so a piece may be too long: it goes to the rest
                    stocks[0].rows.append([size, same])
            placed.append((made, same))
            at += same
    for stock in stocks:
        for size, n in stock.rows:
            rest[size] = rest.get(size, 0) + n
    return best_fit(rest, capacity, placed)


def best_fit(histogram: dict[int, int], capacity: int, begun: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over a histogram, into the sequences ``begun`` and new ones: equal lengths and equal
    gaps are placed many at a time."""
    bins: dict[int, list[list]] = {}  # gap -> [[config, number of sequences]]
    gaps: list[int] = []

    def add(gap: int, config: dict, n: int) -> None:
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append([config, n])

    for config, n in begun:
        add(capacity - sum(s * t for s, t in config.items()), config, n)
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                per = capacity // size
                if n >= per:
                    add(capacity - per * size, {size: per}, n // per)
                    n %= per
                if n:
                    add(capacity - n * size, {size: n}, 1)
                    n = 0
                break
            gap = gaps[at]
            config, times = bins[gap][-1]
            fit = min(gap // size, n)
            whole = min(times, n // fit)
            bins[gap][-1][1] -= whole
            if not bins[gap][-1][1]:
                bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
            add(gap - fit * size, config | {size: config.get(size, 0) + fit}, whole)
            n -= fit * whole
    return [(config, n) for rows in bins.values() for config, n in rows]


class Placement:
    """Sequence and offset of the r-th piece of a length: a table with a row for each configuration and length."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows: dict[int, list] = {}
        sequence = 0
        for config, n in plan:
            offset = 0
            for size in sorted(config, reverse=True):
                times = config[size]
                rows.setdefault(size, []).append((times * n, sequence, times, offset))
                offset += times * size
            sequence += n
        self.sequences = sequence
        self.table = {}
        for size, parts in rows.items():
            a = np.array(parts, dtype=np.int64)
            self.table[size] = (np.cumsum(a[:, 0]) - a[:, 0], a[:, 1], a[:, 2], a[:, 3])

    def __call__(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            first, base, times, start = self.table[int(size)]
            row = np.searchsorted(first, ranks[at], side="right") - 1
            within = ranks[at] - first[row]
            sequence[at] = base[row] + within // times[row]
            offset[at] = start[row] + within % times[row] * size
        return sequence, offset


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``documents``
    (doc_id, text); other columns are not read.

    A null or empty text is one piece of length 1 (the end-of-document id).  Rows that repeat, ids included,
    are pieces of their own each; which of equal pieces gets which place is any.  An empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    pieces = park(token_pieces(documents, path, capacity), "pieces")
    counted = {int(r[0]): int(r[1]) for r in pieces.df.groupBy("length").count().collect()}  # at most ``capacity`` rows
    total = sum(counted.values())
    shared = spark.sparkContext.broadcast(Placement(configurations(counted, capacity)))
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = ranked(pieces.df, ["length"], order, "rank", max(1, total // BUCKET_ROWS), F.struct("doc_id", "piece"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` over all of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
