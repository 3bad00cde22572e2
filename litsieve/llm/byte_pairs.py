"""Byte-pair encoding by a transducer with bounded lookahead, and decoding byte by byte.

A merge can change what stands left of it only through a chain of merges of growing rank, each of which takes
the token before the last one's left part.  The longest such chain, weighed by the symbols it takes, is found
in one pass over the merge list: that many symbols ahead, no continuation changes a token any more.  So the
transducer holds a window a little longer than this lookahead, merges it, tells the tokens that end before
the lookahead begins and drops their symbols.  A stable boundary splits the merging in two, so it may go on
from there.  Memory is the window, however long a word is.

Texts are cut into words as the tokenizer does: runs of plain letters, marks and digits by a pattern,
everything else by the tokenizer's own normalizer and pre-tokenizer.  Its model is not used.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.chunks import Chunks, slices
from litsieve.llm.common import tidy
from litsieve.llm.packing import _LETTERS, _PART, WordIds, vocabulary_path

#: Symbols that a window takes beyond the lookahead; parts of chunks that a worker remembers; ids decoded at once.
AHEAD, ROOM, BLOCK = 4096, 500_000, 1 << 16
#: Symbols up to which all neighbours are looked through for each merge; beyond, a heap holds them.
SHORT = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones of Latin-1 for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class MergeList:
    """The merges of a byte-level model, in order: ``merge`` applies them, ``lookahead`` bounds their reach to the left."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = "", letters: list[str] | None = None):
        letters = byte_letters() if letters is None else letters
        self.inner, self.final = [vocab[c] for c in letters], [vocab[c + suffix] for c in letters]
        #: rank of a pair of ids; what the merge of each rank takes and makes
        self._rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        parts: list[tuple[int, int]] = []
        self.size = dict.fromkeys([*self.inner, *self.final], 1)
        for rank, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            if pair[0] not in self.size or pair[1] not in self.size:
                raise ValueError(f"merge {rank} takes a token that no earlier merge makes")
            token = vocab[a + b]
            self.size.setdefault(token, self.size[pair[0]] + self.size[pair[1]])
            self._rank[pair] = rank
            self.made.append(token)
            parts.append(pair)
        self.longest = max(self.size.values())
        self.lookahead = self._reach(parts)

    def _reach(self, parts: list[tuple[int, int]]) -> int:
        """Symbols before an unknown continuation whose tokens it may still change.

        Where a merge (u, v) across the boundary happens with one continuation and not with another, the boundary
        moves left by u, and the token behind it is then one that begins with u's merges: the next merge that
        moves the boundary has a later rank and a right part whose leftmost parts include u.
        """
        lefts: dict[int, set[int]] = {}
        for token, (a, _) in zip(self.made, parts, strict=True):
            lefts.setdefault(token, set()).add(a)

        def leftmost(token: int) -> set[int]:
            found, open_ = {token}, [token]
            while open_:
                for a in lefts.get(open_.pop(), ()):
                    if a not in found:
                        found.add(a)
                        open_.append(a)
            return found

        beyond: dict[int, int] = {}  # the longest chain of later merges, by a leftmost part of its first right part
        most = 0
        for a, b in reversed(parts):
            reach = self.size[a] + beyond.get(a, 0)
            most = max(most, reach)
            for token in leftmost(b):
                if reach > beyond.get(token, 0):
                    beyond[token] = reach
        return most

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of a run of symbols: the pair of lowest rank, the leftmost of equal ones, until none is left."""
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        rank, made, none = self._rank.get, self.made, len(self.made)
        ids = list(symbols)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, symbols: list[int]) -> list[int]:
        rank, made = self._rank.get, self.made
        ids: list[int | None] = list(symbols)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= len(ids) or rank((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = made[r], None
            k = after[i] = after[j]
            if k < len(ids):
                before[k] = i
                if (s := rank((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x is not None]


class Transducer:
    """One word's bytes in, tokens out as soon as no continuation can change them.

    ``feed`` takes any number of bytes and ``end`` closes the word.  At most ``window`` symbols are held.
    """

    def __init__(self, merges: MergeList, ahead: int = AHEAD):
        self._merges, self._held = merges, []
        self._last: int | None = None  # the byte that may be the word's last
        self.window = merges.lookahead + max(ahead, merges.longest)

    def feed(self, data: bytes) -> Iterator[int]:
        inner = self._merges.inner
        for at in range(0, len(data), AHEAD):
            for byte in data[at : at + AHEAD]:
                if self._last is not None:
                    self._held.append(inner[self._last])
                    if len(self._held) >= self.window:
                        yield from self._stable()
                self._last = byte

    def _stable(self) -> Iterator[int]:
        told, last = 0, len(self._held) - self._merges.lookahead
        for token in self._merges.merge(self._held):
            if told + self._merges.size[token] > last:
                break
            told += self._merges.size[token]
            yield token
        del self._held[:told]

    def end(self) -> list[int]:
        if self._last is None:
            return []
        held, self._held = [*self._held, self._merges.final[self._last]], []
        self._last = None
        return self._merges.merge(held)


class Encoder(WordIds):
    """Token ids of texts as the tokenizer of ``path`` gives them; distinct parts of texts are transduced once and remembered."""

    def __init__(self, path: str, room: int = ROOM):
        super().__init__(path, room=room)
        self._chunks = Chunks(self._learn, self._cut, 3, b"", room)
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.merges = MergeList(model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]], model["end_of_word_suffix"] or "")
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self._special = special
        self._marks = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self._bytes = {ord(c): b for b, c in enumerate(byte_letters())}

    def word(self, data: bytes) -> list[int]:
        """The tokens of one word."""
        if len(data) > self.merges.lookahead:
            machine = Transducer(self.merges)
            return [*machine.feed(data), *machine.end()]
        inner = self.merges.inner
        return self.merges.merge([inner[b] for b in data[:-1]] + [self.merges.final[data[-1]]])

    def _plain(self, text: str) -> Iterator[int]:
        """The tokens of a text without special tokens, by the tokenizer's own rules for words."""
        text = self._whole.normalizer.normalize_str(text)
        for piece, _ in self._whole.pre_tokenizer.pre_tokenize_str(text):
            yield from self.word(piece.translate(self._bytes).encode("latin-1"))

    def _any(self, text: str) -> Iterator[int]:
        at = 0
        for found in self._marks.finditer(text):
            yield from self._plain(text[at : found.start()])
            yield self._special[found.group()]
            at = found.end()
        yield from self._plain(text[at:])

    def _learn(self, parts: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {"": b""}

        def simple(word: str) -> bytes:
            if word not in known:
                known[word] = np.array(self.word(word.encode()), dtype="<u4").tobytes()
            return known[word]

        out = []
        for part in parts:
            if part in known or _LETTERS.fullmatch(part):
                out.append(simple(part))
                continue
            cut = _PART.findall(part) if "<|" not in part else []
            if cut and sum(map(len, cut)) == len(part):
                out.append(b"".join(map(simple, cut)))
            else:
                out.append(np.array(list(self._any(part)), dtype="<u4").tobytes())
        return out


class Decoder:
    """Ids in, text out: the bytes of tokens pass a UTF-8 state machine, which holds an unfinished character.

    ``surface`` gives what the tokenizer itself decodes to, tokens as they are written with a blank between; else
    tokens become the bytes they stand for and the end of a word a blank.  Ids without a token are passed over,
    bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, path: str, surface: bool = True):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        suffix = whole["model"]["end_of_word_suffix"] or ""
        code = {ord(c): b for b, c in enumerate(byte_letters())}
        tokens = {i: t for t, i in whole["model"]["vocab"].items()}
        special = {t["id"]: t["content"] for t in whole["added_tokens"]}

        def stands_for(i: int, token: str) -> bytes:
            if surface or i in special:
                return token.encode()
            ends = bool(suffix) and token.endswith(suffix)
            return (token.removesuffix(suffix) if ends else token).translate(code).encode("latin-1") + b" " * ends

        self._bytes = {i: stands_for(i, t) for i, t in (tokens | special).items()}
        self._between = b" " if surface else b""
        self._begin()

    def _begin(self) -> None:
        self._state, self._first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: list[int]) -> str:
        found = [b for i in ids if (b := self._bytes.get(i)) is not None]
        if not found:
            return ""
        data = self._between.join(found)
        if not self._first:
            data = self._between + data
        self._first = False
        return self._state.decode(data)

    def end(self) -> str:
        """What is left; the machine then stands at the beginning of another text."""
        left = self._state.decode(b"", True)
        self._begin()
        return left

    def text(self, ids: np.ndarray) -> str:
        return "".join([*(self.feed(ids[at : at + BLOCK].tolist()) for at in range(0, len(ids), BLOCK)), self.end()])


_ENCODERS: dict[str, Encoder] = {}
_DECODERS: dict[tuple[str, bool], Decoder] = {}


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        for batch in batches:
            docs = batch.column("doc_id")
            for at, texts in slices(pc.fill_null(batch.column("text"), "")):
                ids, bounds = _ENCODERS[path](texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([docs.slice(at, len(texts)), lists], names=["doc_id", "ids"])

    return run


def _decode(path: str, surface: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, surface) not in _DECODERS:
            _DECODERS[path, surface] = Decoder(path, surface)
        machine = _DECODERS[path, surface]
        for batch in batches:
            lists = batch.column("ids")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [machine.text(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text of ``documents`` (doc_id, text), special tokens' strings told as such.

    A null text counts as empty and has no ids; rows that repeat stay; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_encode(path or vocabulary_path())), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, surface: bool = True) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``; see ``Decoder``.  A null array counts as empty; null ids and ids without a token are passed over."""
    rows = encoded.select("doc_id", F.filter(F.coalesce("ids", F.array().cast("array<int>")), lambda i: i.isNotNull()).alias("ids"))
    return rows.mapInArrow(tidy(_decode(path or vocabulary_path(), surface)), "doc_id long, ids array<int>, decoded string")


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded: the number of ids and the digests of both."""
    told = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
