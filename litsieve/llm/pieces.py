"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct stretches between spaces are laid end to end and indexed by a suffix array.
Every piece of the vocabulary is looked up by binary search, which gives the range of suffixes that
start with it: all its occurrences at once.  The occurrences are edges of the batch's lattice; they
are sorted by position and the lattice is relaxed to the encoding.

A byte-pair model defines its encoding by merges, not by a sum of scores, so its lattice is relaxed
best edge first: of the edges that join two neighbouring symbols, each stretch takes the one of the
highest score, leftmost on ties, until none is left.  That gives the ids of the reference library for
such a model; a shortest path would not.

The rules covered are those of byte-pair models without normalisation, with a leading space added,
spaces as U+2581 and unknown characters as bytes; other models are refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.chunks import ROOM, Chunks, slices
from litsieve.llm.common import tidy

MODEL = "piece_bpe_32k.model"
#: Characters indexed at once; characters from which a stretch is relaxed alone.
BATCH, LONG = 1 << 18, 192
SPACE = "▁"
_NONE = np.iinfo(np.int64).max


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary of a model file: pieces, ranks (0: highest score), bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if model.encode("  ﬁ ", out_type=str)[0] not in (SPACE * 2, SPACE * 3, SPACE):
            raise ValueError("models that change the text or add no space are not covered")
        texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if not any(model.is_byte(i) for i in range(n)) or any(SPACE in texts[i].lstrip(SPACE) for i in plain):
            raise ValueError("only models with byte fallback and spaces in front of words are covered")
        scores = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.texts = texts
        self.plain = np.array(plain)
        self.sizes = np.array([len(texts[i]) for i in plain])
        self.rank = rank
        self.longest = int(self.sizes.max())
        self.byte_ids = np.zeros(256, dtype=np.int64)
        self.raw = [t.replace(SPACE, " ").encode("utf-8") for t in texts]
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(texts[i][3:5], 16)] = i
                self.raw[i] = bytes([int(texts[i][3:5], 16)])
            elif model.is_control(i) or model.is_unknown(i):
                self.raw[i] = b""
        self.letters = sorted({c for i in plain for c in texts[i]})
        self._points = np.array([ord(c) for c in self.letters], dtype=np.uint32)
        self._alphabet = np.empty(0, dtype=np.uint32)
        self._probe: tuple | None = None

    def coding(self, letters: np.ndarray) -> tuple[np.ndarray, bool, tuple]:
        """Which of ``letters`` (sorted code points) stand in pieces, whether one byte a character will do,
        and the pieces to look up: their numbers, texts and upper ends in that coding.

        The one-byte alphabet grows with what batches hold, up to 253 letters, so it is seldom coded anew.
        """
        inside = np.isin(letters, self._points)
        known = letters[inside]
        if len(known) > 253:
            probe = [self.texts[i] for i in self.plain]
            top = ["\U0010ffff" * (self.longest - len(p)) for p in probe]
            kind = f"U{self.longest}"
            return inside, False, (np.arange(len(probe)), np.array(probe, dtype=kind), np.array([a + b for a, b in zip(probe, top, strict=True)], dtype=kind))
        if self._probe is None or not np.isin(known, self._alphabet).all():
            grown = np.union1d(self._alphabet, known)
            self._alphabet = (grown if len(grown) <= 253 else known).astype(np.uint32)
            table = {chr(int(c)): i + 1 for i, c in enumerate(self._alphabet)}
            usable = [k for k, i in enumerate(self.plain) if table.keys() >= set(self.texts[i])]
            probe = [bytes(map(table.__getitem__, self.texts[self.plain[k]])) for k in usable]
            kind = f"S{self.longest}"
            self._probe = (np.array(usable), np.array(probe, dtype=kind), np.array([p.ljust(self.longest, b"\xff") for p in probe], dtype=kind))
        return inside, True, self._probe


def suffix_index(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array to ``depth`` characters and the sorted suffixes, as fixed-width strings.

    ``codes`` is of one-byte characters or of code points; both are padded with the largest one.
    """
    one = codes.dtype == np.uint8
    pad = np.full(depth, 255 if one else 0x10FFFF, dtype=codes.dtype)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([codes, pad]), depth)[: len(codes)]
    keys = np.ascontiguousarray(windows).view(f"S{depth}" if one else f"U{depth}").ravel()
    if one:
        width = -(-depth // 8)
        wide = np.zeros((len(codes), width * 8), dtype=np.uint8)
        wide[:, :depth] = windows
        words = wide.view(">u8").astype(np.uint64)
        order = np.lexsort(tuple(words[:, i] for i in range(width - 1, -1, -1)))
    else:
        order = np.argsort(keys, kind="stable")
    return order, keys[order]


def lattice(text: str, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a batch's text as (position, piece number), sorted by position.

    U+10FFFF separates stretches and stands in no piece.
    """
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    letters, which = np.unique(points, return_inverse=True)
    inside, one_byte, (usable, low, high) = pieces.coding(letters)
    if one_byte:  # 1.. for letters of pieces, 254 for all others
        code = np.where(inside, np.searchsorted(pieces._alphabet, letters) + 1, 254).astype(np.uint8)
        codes = code[which]
    else:
        codes = np.where(inside, letters, 0x10FFFE).astype(np.uint32)[which]
    order, keys = suffix_index(codes, pieces.longest)
    first = np.searchsorted(keys, low, side="left")
    last = np.searchsorted(keys, high, side="right")
    times = last - first
    which = np.repeat(usable, times)
    place = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
    at = order[place]
    by = np.argsort(at, kind="stable")
    return at[by], which[by]


def relax(text: str, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> list[bytes]:
    """Ids (32-bit words) of each stretch text[start : start + size] by merging best
    edges first, all stretches in step."""
    at, which = lattice(text, pieces)
    width = pieces.longest + 1
    edge = np.full(len(text) * width, -1, dtype=np.int32)  # piece by (position, length)
    edge[at * width + pieces.sizes[which]] = pieces.plain[which]
    ends = np.arange(1, len(text) + 1)
    symbol = np.ones(len(text), dtype=bool)

    def cost(left: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = stop - left
        found = edge[left * width + np.minimum(size, width - 1)]
        good = (size < width) & (found >= 0)
        return np.where(good, pieces.rank[found], _NONE >> 32)

    short = np.flatnonzero((sizes > 1) & (sizes <= LONG))
    if len(short):
        n = sizes[short]
        owner = np.repeat(np.arange(len(short)), n)
        heads = np.cumsum(n) - n
        pos = np.repeat(starts[short], n) + np.arange(n.sum()) - np.repeat(heads, n)
        while len(pos):
            pair = np.full(len(pos), _NONE, dtype=np.int64)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            price = cost(pos[inner], ends[pos[inner + 1]])
            pair[inner] = np.where(price < _NONE >> 32, (price.astype(np.int64) << 32) | inner, _NONE)
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(pair, head)
            going = best < _NONE
            if not going.any():
                break
            k = best[going] & 0xFFFFFFFF
            ends[pos[k]] = ends[pos[k + 1]]
            symbol[pos[k + 1]] = False
            stay = np.repeat(going, np.diff(np.append(head, len(pos))))
            stay[k + 1] = False
            pos, owner = pos[stay], owner[stay]
    for i in np.flatnonzero(sizes > LONG):
        _relax_one(int(starts[i]), int(sizes[i]), ends, symbol, cost)
    at = np.flatnonzero(symbol)
    found = edge[at * width + np.minimum(ends[at] - at, width - 1)]
    bounds = np.searchsorted(at, np.stack([starts, starts + sizes]))
    unknown = np.concatenate([[0], np.cumsum(found < 0)])
    odd = (unknown[bounds[1]] > unknown[bounds[0]]).tolist()
    flat = found.astype("<u4").tobytes()
    out = []
    for (a, b), some in zip((bounds.T * 4).tolist(), odd, strict=True):
        if not some:
            out.append(flat[a:b])
            continue
        span = slice(a // 4, b // 4)  # characters in no piece are given by their bytes
        parts = [[x] if x >= 0 else pieces.byte_ids[list(text[p].encode("utf-8"))].tolist() for x, p in zip(found[span].tolist(), at[span].tolist(), strict=True)]
        out.append(np.array([x for p in parts for x in p], dtype="<u4").tobytes())
    return out


def _relax_one(start: int, size: int, ends: np.ndarray, symbol: np.ndarray, cost) -> None:
    """The same for one long stretch with a queue, in n log n steps."""
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    stop = list(range(1, size + 1))
    alive = [True] * size
    price = cost(np.arange(start, start + size - 1), np.arange(start + 2, start + size + 1)).tolist()
    none = _NONE >> 32
    queue = [(p, i, i + 1, i + 2) for i, p in enumerate(price) if p < none]
    heapq.heapify(queue)
    while queue:
        _, a, b, end = heapq.heappop(queue)
        if not (alive[a] and b < size and alive[b] and after[a] == b and stop[b] == end):
            continue
        alive[b] = False
        stop[a], after[a] = end, after[b]
        if after[a] < size:
            before[after[a]] = a
        for x, y in ((before[a], a), (a, after[a])):
            if x >= 0 and y < size:
                p = int(cost(np.array([start + x]), np.array([start + stop[y]]))[0])
                if p < none:
                    heapq.heappush(queue, (p, x, y, stop[y]))
    for i in range(size):
        symbol[start + i] = alive[i]
        if alive[i]:
            ends[start + i] = start + stop[i]


class Encoder:
    """Encodes texts; each distinct stretch (a run of spaces and what follows up to the next) is relaxed once.

    No piece has a space behind another character, so stretches do not depend on each other; nor do the
    parts of a stretch on both sides of a line feed that is in no piece.
    """

    def __init__(self, path: str, room: int = ROOM):
        self.pieces = Pieces(path)
        self._chunks = Chunks(self._learn, room=room)
        self._room = room
        self._bare: dict[str, bytes] = {}  # parts that follow a line feed
        self._cut = "\n" not in self.pieces.letters
        self._feed = self.pieces.byte_ids[10:11].astype("<u4").tobytes()
        self._raw = pa.array(self.pieces.raw, pa.binary())

    def _relaxed(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids of stretches, spaces given as U+2581."""
        out: dict[str, bytes] = {}
        at = 0
        while at < len(stretches):
            stop, size = at, 0
            while stop < len(stretches) and (size == 0 or size + len(stretches[stop]) < BATCH):
                size += len(stretches[stop]) + 1
                stop += 1
            some = stretches[at:stop]
            sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            starts = np.cumsum(sizes + 1) - sizes - 1
            text = "\U0010ffff".join(some) + "\U0010ffff"
            out.update(zip(some, relax(text, starts, sizes, self.pieces), strict=True))
            at = stop
        return out

    def _learn(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches, each given without its first space."""
        if len(self._bare) > self._room // 2:
            self._bare.clear()
        bare, split = self._bare, {}
        heads: dict[str, bytes | None] = {}
        tails: set[str] = set()
        for s in stretches:
            if self._cut and "\n" in s:
                first, *rest = split[s] = s.split("\n")
                heads[first] = self._chunks.held(first)
                tails.update(rest)
            else:
                heads[s] = None
        tails.discard("")
        bare[""] = b""
        spaced = lambda s: s.replace(" ", SPACE)
        new = [s for s, ids in heads.items() if ids is None]
        done = self._relaxed([SPACE + spaced(s) for s in new])
        heads.update((s, done[SPACE + spaced(s)]) for s in new)
        new = [s for s in tails if s not in bare]
        done = self._relaxed([spaced(s) for s in new])
        bare.update((s, done[spaced(s)]) for s in new)
        whole = lambda first, *rest: heads[first] + b"".join([self._feed + bare[r] for r in rest])
        return [whole(*split[s]) if s in split else heads[s] for s in stretches]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts`` (strings, not null) end to end, and where each text's begin."""
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        return self._chunks.gather(stretches(texts))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of ids: pieces end to end, without the space that encoding adds."""
        flat = ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py())
        bounds = pc.subtract(ids.offsets, ids.offsets[0])
        text = pc.binary_join(pa.ListArray.from_arrays(bounds, self._raw.take(flat)), b"")
        try:
            text = text.cast(pa.string())
        except pa.ArrowInvalid:  # ids that no text has
            text = pa.array([t.decode("utf-8", "replace") for t in text.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)


def _stretches(text: str) -> list[str]:
    out, spaces = [], 0
    for part in text.split(" ") if text else ():
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    return out + [" " * (spaces - 1)] if spaces else out


def stretches(texts: pa.Array) -> pa.ListArray:
    """The stretches of each text, each without its first space (the text's own is the one added)."""
    # a character that no text holds stands between them
    free = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if not pc.any(pc.match_substring(texts, c)).as_py()), None)
    if free is None:
        return pa.array([_stretches(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    wide = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
    marked = pc.replace_substring(texts, " ", free)
    if pc.any(wide).as_py():  # of more spaces than one, the first parts two stretches
        marked = pc.if_else(wide, pc.replace_substring_regex(texts, "([^ ]) ( *)", rf"\1{free}\2"), marked)
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), None, marked)
    return pc.split_pattern(marked, free)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            docs = batch.column("doc_id")
            for at, texts in slices(pc.fill_null(batch.column("text"), "")):
                ids, bounds = encoder(texts)
                made = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([docs.slice(at, len(texts)), made], names=["doc_id", "ids"])

    return run


def encode_pieces(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``documents`` (doc_id, text).

    Null and empty texts have no ids; rows that repeat stay; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_encode(path or model_path())), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), encoder.decode(part.column("ids"))], names=["doc_id", "ids", "decoded"])

    return run


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with column ``decoded``, the text of the ids.

    Null or no ids give an empty text; ids whose bytes are no text give U+FFFD there; rows that repeat stay.
    """
    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(tidy(_decode(path or model_path())), "doc_id long, ids array<int>, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: numbers of ids and bytes, and their digests."""
    decoded = decode_pieces(encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )
