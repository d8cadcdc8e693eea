"""ISO base media containers: a writer for raw 8-bit frames and a reader of nested boxes.

``store_media`` keeps a payload as uncompressed 24 x 24 grey frames (576 samples of 8
bits) in an MP4 file; ``media_columns`` walks any file's boxes and decodes its sample
tables into codec, duration and keyframe byte ranges without touching the payload, and
``sample_bytes`` reads the samples back by those tables. Both are maps over rows: no
shuffle, memory bounded by one batch of a few MB (or one file).

Defined results: a null or empty payload is padded to one frame; equal payloads give
equal files; a file that is no container or is cut short gives null columns and an
``error``; files without a sync table have keyframes only; repeated rows are repeated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import kernels as K
from linkloom.llm.common import mapped, table

#: Frame side, bytes in a frame, frames in a chunk, ticks in a second, ticks in a frame.
SIDE, FRAME, PER_CHUNK, TIMESCALE, TICKS = 24, 576, 64, 600, 24
PAD = b"\xff"
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """The payload and bytes of 255 up to a positive multiple of a frame."""
    return payload + PAD * ((FRAME - len(payload) % FRAME) % FRAME if payload else FRAME)


def write_media(payload: bytes) -> bytes:
    """An MP4 file with one video track of raw grey frames; the payload is whole frames."""
    frames = len(payload) // FRAME
    ticks = frames * TICKS
    chunks = -(-frames // PER_CHUNK)
    wide = len(payload) > 0xFFFF0000

    def moov(base: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
        at = base + np.arange(chunks, dtype=np.uint64) * np.uint64(PER_CHUNK * FRAME)
        last = frames - (chunks - 1) * PER_CHUNK
        runs = [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != PER_CHUNK)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, TICKS)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    size = len(payload)
    data = struct.pack(">I4sQ", 1, b"mdat", size + 16) if wide else struct.pack(">I4s", size + 8, b"mdat")
    base = len(head) + len(moov(0)) + len(data)
    return b"".join((head, moov(base), data, payload))


def boxes(blob: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of the boxes in a span; sizes of 32 and 64 bits and 'to the end'."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", blob, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box's size is cut short")
            (size,), head = struct.unpack_from(">Q", blob, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} runs past its parent")
        yield kind, start + head, start + size
        start += size


@dataclass
class Track:
    """One track's sample tables. Offsets and sizes are of all samples, in order."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        """(first byte, end) of keyframes; neighbours in the file are one range."""
        at, size = self.offsets[self.sync], self.sizes[self.sync]
        if not len(at):
            return []
        order = np.argsort(at, kind="stable")
        at, end = at[order], (at + size)[order]
        new = np.flatnonzero(np.append(True, at[1:] != end[:-1]))
        return list(zip(at[new].tolist(), end[np.append(new[1:], len(at)) - 1].tolist(), strict=True))


def _array(blob: memoryview, at: int, end: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise ValueError("a table is cut short")
    return np.frombuffer(blob, dtype=kind, count=n, offset=at).astype(np.int64)


def _tables(blob: memoryview, found: dict[bytes, tuple[int, int]], track: Track) -> None:
    u32 = lambda at: struct.unpack_from(">I", blob, at)[0]
    at, end = found[b"stsd"]
    if u32(at + 4):
        track.codec = bytes(blob[at + 12 : at + 16]).decode("latin-1")
    if b"stsz" in found:
        at, end = found[b"stsz"]
        fixed, n = u32(at + 4), u32(at + 8)
        track.sizes = np.full(n, fixed, np.int64) if fixed else _array(blob, at + 12, end, n, ">u4")
    elif b"stz2" in found:
        at, end = found[b"stz2"]
        bits, n = blob[at + 7], u32(at + 8)
        if bits == 4:
            pairs = _array(blob, at + 12, end, (n + 1) // 2, "u1")
            track.sizes = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        else:
            track.sizes = _array(blob, at + 12, end, n, {8: "u1", 16: ">u2"}[bits])
    samples = len(track.sizes)
    at, end = found.get(b"co64") or found[b"stco"]
    chunks = _array(blob, at + 8, end, u32(at + 4), ">u8" if b"co64" in found else ">u4")
    at, end = found[b"stsc"]
    runs = _array(blob, at + 8, end, 3 * u32(at + 4), ">u4").reshape(-1, 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.empty(0, np.int64)
    if int(per.sum()) < samples or len(per) != len(chunks):
        raise ValueError("chunks hold fewer samples than there are")
    chunk = np.repeat(np.arange(len(chunks)), per)[:samples]
    before = np.cumsum(track.sizes) - track.sizes
    first = np.searchsorted(chunk, np.arange(len(chunks)))
    track.offsets = chunks[chunk] + before - before[first[chunk]] if samples else track.offsets
    if b"stts" in found:
        at, end = found[b"stts"]
        steps = _array(blob, at + 8, end, 2 * u32(at + 4), ">u4").reshape(-1, 2)
        deltas = np.repeat(steps[:, 1], steps[:, 0])[:samples]
        track.times = np.cumsum(deltas) - deltas
    if b"stss" in found:
        at, end = found[b"stss"]
        track.sync = _array(blob, at + 8, end, u32(at + 4), ">u4") - 1
        if len(track.sync) and not 0 <= track.sync.min() <= track.sync.max() < samples:
            raise ValueError("a sync sample is out of range")
    else:
        track.sync = np.arange(samples)


def read_media(data: bytes) -> list[Track]:
    """The tracks of a file, from its boxes alone."""
    blob, tracks = memoryview(data), []

    def walk(start: int, end: int, track: Track | None, found: dict[bytes, tuple[int, int]]) -> None:
        for kind, lo, hi in boxes(blob, start, end):
            if kind == b"trak":
                own, inner = Track(), {}
                walk(lo, hi, own, inner)
                if b"stsd" in inner:
                    _tables(blob, inner, own)
                    tracks.append(own)
            elif kind in _CONTAINERS:
                walk(lo, hi, track, found)
            elif track is not None:
                found[kind] = (lo, hi)
                if kind == b"mdhd":
                    track.timescale, track.duration = struct.unpack_from(">IQ" if blob[lo] else ">II", blob, lo + (20 if blob[lo] else 12))
                elif kind == b"hdlr":
                    track.handler = bytes(blob[lo + 8 : lo + 12]).decode("latin-1")

    try:
        walk(0, len(blob), None, {})
    except (struct.error, KeyError, IndexError) as e:
        raise ValueError(f"malformed container: {e}") from e
    if not tracks:
        raise ValueError("no track")
    return tracks


def sample_bytes(data: bytes, track: Track) -> bytes:
    """A track's samples, in order, by its tables."""
    if not len(track.sizes):
        return b""
    at, end = track.offsets, track.offsets + track.sizes
    if at.min() < 0 or end.max() > len(data):
        raise ValueError("a sample is out of the file")
    new = np.flatnonzero(np.append(True, at[1:] != end[:-1]))
    return b"".join(data[a:b] for a, b in zip(at[new].tolist(), end[np.append(new[1:], len(at)) - 1].tolist(), strict=True))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in K.chunks(batch.column(1)):
            body = data.tobytes()
            media = [write_media(padded(body[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a container file."""
    kind = docs.schema[id_column].dataType.simpleString()
    return mapped(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), _store, f"doc_id {kind}, n_bytes long, media binary")


_COLUMNS = "media_bytes long, media_sha256 string, codec string, duration double, n_samples long, keyframes array<struct<start: long, end: long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"
_ARROW = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.string()]


def _describe(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 9 + ("no file",)
    head = (len(data), hashlib.sha256(data).hexdigest())
    try:
        track = read_media(data)[0]
        payload = sample_bytes(data, track)
    except ValueError as e:
        return (*head, *(None,) * 7, str(e))
    ranges = [{"start": a, "end": b} for a, b in track.keyframe_ranges()]
    return (*head, track.codec, track.duration / track.timescale if track.timescale else None, len(track.sizes), ranges, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)


def media_columns(files: DataFrame, media_column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Codec, duration, sample count and keyframe byte ranges of each file's first track, and digests."""
    kept = [f"{c} {files.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(_describe(x.as_py()) for x in batch.column(len(keep))), strict=True)) if batch.num_rows else [[]] * len(_ARROW)
            arrays = [pa.array(x, type=k) for x, k in zip(found, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*keep, *(c.split()[0] for c in _COLUMNS.replace("struct<start: long, end: long>", "x").split(", "))])

    return mapped(files.select(*keep, F.col(media_column).alias("_media")), run, ", ".join([*kept, _COLUMNS]))


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store_media(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), "codec"),
        F.format_string("duration=%.3f", "duration"),
        F.concat(F.lit("samples="), F.col("n_samples").cast("string")),
        F.concat(F.lit("keyframes="), F.array_join(F.transform("keyframes", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")),
    )
    return media_columns(files, keep=("doc_id", "n_bytes")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "duration", "n_samples", "keyframes")
