"""Media columns: ISO base media files written and read back by walking their boxes.

``write_media`` lays a payload of unsigned 8-bit samples into one track of an ISO container;
``read_media`` walks the nested boxes, decodes the sample tables and gives codec, duration,
sample count and the byte ranges of sync samples (keyframes).  The payload itself is not decoded:
``payload_ranges`` names where its bytes stand in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples per second, bytes per sample, samples per chunk and samples from one sync sample to the next.
TIMESCALE, SAMPLE_BYTES, CHUNK_SAMPLES, SYNC_EVERY = 8000, 64, 64, 16
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_media(payload: bytes) -> bytes:
    """A file of one audio track (``raw `` codec, unsigned 8-bit, mono) that holds ``payload``.

    The length must be a positive multiple of 64.  Samples of 64 bytes; each is 64 ticks long.
    """
    if not payload or len(payload) % SAMPLE_BYTES:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    n = len(payload) // SAMPLE_BYTES
    ticks = n * SAMPLE_BYTES
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    chunks = -(-n // CHUNK_SAMPLES)
    last = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
    if chunks == 1 or last != CHUNK_SAMPLES:
        runs.append((chunks, last, 1))
    sync = range(1, n + 1, SYNC_EVERY)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    big = len(payload) >= (1 << 32) - (1 << 20)
    head = len(ftyp) + (16 if big else 8)
    offsets = [head + i * CHUNK_SAMPLES * SAMPLE_BYTES for i in range(chunks)]
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
        _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
        _full(b"co64" if big else b"stco", struct.pack(f">I{chunks}{'Q' if big else 'I'}", chunks, *offsets)),
    )
    dref = _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))
    minf = _box(b"minf", _full(b"smhd", struct.pack(">HH", 0, 0)), _box(b"dinf", dref), stbl)
    mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
    hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"text samples\0")
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, version=1, flags=3)
    mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), _MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1)
    moov = _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if big else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((ftyp, mdat, payload, moov))


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes between two places, from sizes alone."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("truncated box header")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            body = at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit its container")
        yield kind, body, at + size
        at += size
    if at != end:
        raise ValueError("bytes left after the last box")


def _walk(data: bytes, start: int, end: int, found: list[dict], track: dict | None) -> None:
    for kind, a, b in boxes(data, start, end):
        if kind == b"trak":
            found.append({})
            _walk(data, a, b, found, found[-1])
        elif kind in CONTAINERS:
            _walk(data, a, b, found, track)
        elif track is not None:
            track[kind.decode("latin-1")] = (a, b)


def _table(data: bytes, at: int, form: str) -> list[tuple]:
    (n,) = struct.unpack_from(">I", data, at + 4)
    size = struct.calcsize(">" + form)
    return list(struct.iter_unpack(">" + form, data[at + 8 : at + 8 + n * size]))


def read_media(data: bytes) -> list[dict]:
    """One dict per track: handler, codec, timescale, duration (ticks), samples, payload_ranges, keyframes.

    Ranges are (first byte, byte after the last) in the file.  Adjacent payload ranges are joined;
    a track without ``stss`` has every sample as a keyframe.
    """
    found: list[dict] = []
    _walk(data, 0, len(data), found, None)
    tracks = []
    for t in found:
        a = t["mdhd"][0]
        scale, ticks = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        handler = data[t["hdlr"][0] + 8 : t["hdlr"][0] + 12].decode("latin-1")
        a = t["stsd"][0]
        codec = data[a + 12 : a + 16].decode("latin-1")
        a = t["stsz"][0]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        sizes = [fixed] * n if fixed else [x for (x,) in struct.iter_unpack(">I", data[a + 12 : a + 12 + 4 * n])]
        offsets = [x for (x,) in (_table(data, t["stco"][0], "I") if "stco" in t else _table(data, t["co64"][0], "Q"))]
        runs = _table(data, t["stsc"][0], "III")
        sync = {x for (x,) in _table(data, t["stss"][0], "I")} if "stss" in t else None
        places, keys, k = [], [], 0
        for i, (first, per, _) in enumerate(runs):
            stop = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
            for chunk in range(first, stop):
                at = offsets[chunk - 1]
                for _ in range(min(per, n - k)):
                    size = sizes[k]
                    k += 1
                    if sync is None or k in sync:
                        keys.append((at, at + size))
                    if places and places[-1][1] == at:
                        places[-1][1] = at + size
                    else:
                        places.append([at, at + size])
                    at += size
        took = sum(c * d for c, d in _table(data, t["stts"][0], "II"))
        if k != n or took != ticks:
            raise ValueError("sample tables disagree")
        tracks.append({"handler": handler, "codec": codec, "timescale": scale, "duration": ticks, "samples": n, "payload_ranges": [tuple(p) for p in places], "keyframes": keys})
    return tracks


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text (null: none), zeros appended up to a positive multiple of 64; and the bare length."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (-len(raw) % SAMPLE_BYTES or (0 if raw else SAMPLE_BYTES)), len(raw)


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [padded(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([write_media(p) for p, _ in made], pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def encode_media(documents: DataFrame) -> DataFrame:
    """The media column of ``documents`` (doc_id, text): doc_id, n_bytes, media.

    A null text counts as empty and gets one sample of zeros; repeated rows stay; other columns are
    not read.  Equal texts give equal files.
    """
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode, MEDIA_SCHEMA)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, samples long, keyframes array<struct<start: long, stop: long>>"


#: The feature of a file whose boxes or tables cannot be read, or that has no track.
UNREADABLE = "unreadable"


def _told(data: bytes | None) -> tuple:
    """The feature columns of one file, from payload_bytes on."""
    if data is None:
        return (None,) * 10
    stored = (len(data), hashlib.sha256(data).hexdigest())
    try:
        track = read_media(data)[0]
    except (ValueError, KeyError, IndexError, struct.error):
        return (None, None, None, *stored, UNREADABLE, None, None, None, None)
    payload = b"".join(data[a:b] for a, b in track["payload_ranges"])
    keys = track["keyframes"]
    span = f" {keys[0][0]}-{keys[-1][1]}" if keys else ""
    feature = f"{track['handler']}/{track['codec'].strip()} {track['samples']}x{SAMPLE_BYTES} {track['duration']}/{track['timescale']} keys {len(keys)}{span}"
    seconds = track["duration"] / track["timescale"] if track["timescale"] else None
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-SAMPLE_BYTES:]), *stored, feature, track["codec"], seconds, track["samples"], [{"start": a, "stop": b} for a, b in keys])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), ranges]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "samples", "keyframes"]
    for batch in batches:
        rows = [_told(data) for data in batch.column("media").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *names])


def media_features(media: DataFrame) -> DataFrame:
    """Read stored files back: payload digests and what the sample tables say (first track).

    A null file has nulls throughout.  One that cannot be read or has no track tells its size and digest and the feature
    ``unreadable``; one without keyframes has none in its feature.  Rows that repeat stay.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a file and read back."""
    return media_features(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
