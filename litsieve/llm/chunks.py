"""Token ids of the chunks that texts fall into, each distinct chunk learned once by a Python worker.

Arrow splits a slice of texts and encodes the chunks as a dictionary, so Python looks up the distinct
chunks of the slice only; ids are then gathered with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; chunks that a worker remembers.
SLICE_BYTES, ROOM = 1 << 22, 800_000


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``most`` bytes each; a longer text comes alone."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.empty(0, dtype=np.int32)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


class Chunks:
    """Numbers for distinct parts of chunks, and their ids in one flat array.

    ``learn`` gives the ids (little-endian 32-bit words) of parts that are met for the first time.  ``cut``
    gives, for an array of n chunks, ``per`` * n parts: each chunk's in turn.  ``last`` is what ends a text.
    Beyond ``room`` parts all are forgotten, so memory stays bounded whatever the texts hold.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], cut: Callable[[pa.StringArray], pa.StringArray] | None = None, per: int = 1, last: bytes = b"", room: int = ROOM):
        self._learn, self._cut, self._per, self._room = learn, cut, per, room
        self._last = np.frombuffer(last, dtype="<u4")
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._ids = np.empty(1 << 16, dtype="<u4")
        self._start, self._size = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64)
        self._used = 0

    def _room_for(self, parts: int, ids: int) -> None:
        known = len(self._number)
        if known + parts > len(self._start):
            self._start, self._size = (np.concatenate([x[:known], np.empty(known + parts, dtype=np.int64)]) for x in (self._start, self._size))
        if self._used + ids > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._used], np.empty(self._used + ids, dtype="<u4")])

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of distinct ``parts``."""
        if len(self._number) > self._room:
            self._forget()
        known = self._number
        missing = [c for c in parts if c not in known]
        if missing:
            found = self._learn(missing)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            first, total = len(known), int(sizes.sum())
            self._room_for(len(missing), total)
            rows = slice(first, first + len(missing))
            self._start[rows], self._size[rows] = self._used + np.cumsum(sizes) - sizes, sizes
            self._ids[self._used : self._used + total] = np.frombuffer(b"".join(found), dtype="<u4")
            self._used += total
            known.update(zip(missing, range(first, first + len(missing)), strict=True))
        return np.fromiter(map(known.__getitem__, parts), dtype=np.int64, count=len(parts))

    def held(self, part: str) -> bytes | None:
        """The ids of a part that is known."""
        i = self._number.get(part)
        return None if i is None else self._ids[self._start[i] : self._start[i] + self._size[i]].tobytes()

    def _dictionary(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks end to end, with ``last`` behind them, and where each begins and how long it is."""
        coded = (self._cut(chunks) if self._cut else chunks).dictionary_encode()
        numbers = self.numbers(coded.dictionary.to_pylist())
        which = numbers[coded.indices.to_numpy()] if len(numbers) else np.empty(0, dtype=np.int64)
        sizes = self._size[which]
        before = np.cumsum(sizes) - sizes
        ids = np.concatenate([self._ids[np.repeat(self._start[which] - before, sizes) + np.arange(sizes.sum())], self._last])
        whole = sizes.reshape(-1, self._per).sum(axis=1)
        return ids, np.append(before[:: self._per], len(ids) - len(self._last)), np.append(whole, len(self._last))

    def gather(self, split: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with ``last`` behind it, and where each begins (one more: where the last ends).

        ``split`` holds each text's chunks.
        """
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        ids, start, size = self._dictionary(coded.dictionary)
        which = coded.indices.to_numpy()
        bounds -= bounds[0]
        if len(self._last):
            which = np.insert(which, bounds[1:], len(start) - 1)
            bounds += np.arange(len(bounds))
        sizes = size[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids[np.repeat(start[which] - total[:-1], sizes) + np.arange(total[-1])], total[bounds]


def three_parts(chunks: pa.StringArray, split: np.ndarray, core: np.ndarray, head: np.ndarray) -> pa.StringArray:
    """Head, core and tail of each chunk, by their sizes in bytes; a chunk that is not ``split`` is all core.  No byte is copied."""
    offsets = np.frombuffer(chunks.buffers()[1], dtype=np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    first, stop = offsets[:-1], offsets[1:]
    begin = np.where(split, first + head, first)
    cuts = np.column_stack([first, begin, np.where(split, begin + core, stop)]).ravel()
    return pa.StringArray.from_buffers(3 * len(chunks), pa.py_buffer(np.append(cuts, offsets[-1:]).astype(np.int32)), chunks.buffers()[2])
