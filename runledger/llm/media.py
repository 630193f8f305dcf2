"""Media columns: ISO base media containers, written and read without decoding payloads.

A container is a tree of boxes. The reader walks it, decodes the sample tables of each track (sizes, chunk
offsets, sample-to-chunk runs, durations, sync samples) with array arithmetic, and gives codec, duration and
the byte ranges of keyframes; the payload itself is only sliced. The writer stores bytes losslessly as a
track of uncompressed 8-bit grey frames.

Defined results: null media gives a null struct; bytes that are no container, or whose tables contradict each
other or point outside the file, give a struct with `error` and nulls; a container without tracks has codec
null and no samples; of several tracks the first with samples counts. Fragmented files (moof) have no sample
table and count as having no samples. A null text is stored as an empty payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: The writer's frames: their side in pixels of one byte, frames a second, frames in a chunk, and from one keyframe to the next.
SIDE, RATE, CHUNK, KEY_EVERY = 24, 25, 32, 12
FRAME = SIDE * SIDE
FILL = 255
#: Boxes that hold boxes, on the way to the sample tables.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"])
LARGE = 2**32


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < LARGE else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join([head, *parts])


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _table(values: np.ndarray, kind: str = ">u4") -> bytes:
    return struct.pack(">I", len(values)) + values.astype(kind).tobytes()


def write(payload: bytes) -> bytes:
    """A container whose frames are the payload, which must be a positive multiple of FRAME bytes."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of a frame")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else [(1, CHUNK, 1), (chunks, n % CHUNK, 1)]
    runs = runs[-1:] if chunks == 1 else runs
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"", 8, -1)

    def moov(first: int) -> bytes:
        offsets = first + FRAME * CHUNK * np.arange(chunks, dtype=np.int64)
        wide = int(offsets[-1]) >= LARGE
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", _table(1 + KEY_EVERY * np.arange(-(-n // KEY_EVERY)))),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", _table(offsets, ">u8" if wide else ">u4")),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mdat_head = 8 if len(payload) + 8 < LARGE else 16
    first = len(ftyp) + len(moov(0)) + mdat_head
    head = moov(first)
    if len(ftyp) + len(head) + mdat_head != first:  # wide offsets made the tables longer
        first = len(ftyp) + len(head) + mdat_head
        head = moov(first)
    return b"".join([ftyp, head, box(b"mdat", payload)])


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of each box; a size of 0 reaches to the end, 1 means a 64-bit size."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box ends within its head")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box ends within its head")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        size = end - start if size == 0 else size
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit its parent")
        yield kind, start + head, start + size
        start += size


def tree(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box below, with the path that leads to it; opened depth first, in file order, without recursion."""
    stack = [((), boxes(data, start, end))]
    while stack:
        path, rest = stack[-1]
        if (found := next(rest, None)) is None:
            stack.pop()
            continue
        kind, a, b = found
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            stack.append(((*path, kind), boxes(data, a, b)))


@dataclass
class Track:
    codec: str | None = None
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray | None = None
    chunks: np.ndarray | None = None
    runs: np.ndarray | None = None
    ticks: int = 0
    timed: int = 0
    sync: np.ndarray | None = None

    def offsets(self) -> np.ndarray:
        """The offset of each sample: its chunk's, and the sizes before it in that chunk."""
        n = len(self.sizes)
        first, each = self.runs[:, 0].astype(np.int64) - 1, self.runs[:, 1].astype(np.int64)
        last = np.append(first[1:], len(self.chunks))
        if (np.diff(first) <= 0).any() or (first[:1] != 0).any() or (last < first).any():
            raise ValueError("sample-to-chunk runs are out of order")
        per_chunk = np.repeat(each, last - first)
        if per_chunk.sum() != n:
            raise ValueError("chunks do not hold as many samples as there are")
        of = np.repeat(np.arange(len(self.chunks)), per_chunk)
        before = np.cumsum(self.sizes) - self.sizes
        starts = (np.cumsum(per_chunk) - per_chunk)[per_chunk > 0]
        base = np.zeros(len(self.chunks), np.int64)
        base[per_chunk > 0] = before[starts]
        return self.chunks[of] + before - base[of]


def _array(data: memoryview, at: int, end: int, kind: str, count: int) -> np.ndarray:
    if count < 0 or at + count * np.dtype(kind).itemsize > end:
        raise ValueError("a table ends before its last entry")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def tracks(media: bytes) -> list[Track]:
    data, out = memoryview(media), []
    for path, a, b in tree(data, 0, len(data)):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            out.append(Track())
        if len(path) < 3 or path[:2] != (b"moov", b"trak"):
            continue
        t = out[-1]
        word = lambda at: struct.unpack_from(">I", data, a + at)[0]
        if kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd" and word(4):
            name, at, stop = next(boxes(data, a + 8, b))
            t.codec = name.decode("latin-1")
            if stop - at >= 28:
                t.width, t.height = struct.unpack_from(">HH", data, at + 24)
        elif kind == b"stts":
            pairs = _array(data, a + 8, b, ">u4", 2 * word(4)).reshape(-1, 2)
            t.timed, t.ticks = int(pairs[:, 0].sum()), int((pairs[:, 0] * pairs[:, 1]).sum())
        elif kind == b"stss":
            t.sync = _array(data, a + 8, b, ">u4", word(4))
        elif kind == b"stsc":
            t.runs = _array(data, a + 8, b, ">u4", 3 * word(4)).reshape(-1, 3)
        elif kind == b"stsz":
            if word(4) * word(8) > len(data):
                raise ValueError("samples are larger than the file")
            t.sizes = np.full(word(8), word(4), np.int64) if word(4) else _array(data, a + 12, b, ">u4", word(8))
        elif kind == b"stz2":
            bits, n = data[a + 7], word(8)
            if bits == 4:
                pairs = _array(data, a + 12, b, ">u1", -(-n // 2))
                t.sizes = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:n]
            else:
                t.sizes = _array(data, a + 12, b, f">u{bits // 8}", n)
        elif kind in (b"stco", b"co64"):
            t.chunks = _array(data, a + 8, b, ">u8" if kind == b"co64" else ">u4", word(4))
    return out


@dataclass
class Media:
    track: Track
    starts: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray

    def payload(self, media: bytes) -> bytes:
        """The samples in order; neighbours in the file are sliced at once."""
        ends = self.starts + self.lengths
        cut = np.flatnonzero(self.starts[1:] != ends[:-1]) + 1
        first, last = np.append(0, cut), np.append(cut, len(self.starts)) - 1
        return b"".join(media[a:b] for a, b in zip(self.starts[first].tolist(), ends[last].tolist(), strict=True))


def read(media: bytes) -> Media:
    """The first track with samples. Raises ValueError or struct.error for bytes that are no such container."""
    found = tracks(media)
    none = np.empty(0, np.int64)
    for t in found:
        if t.sizes is None or not len(t.sizes):
            continue
        if t.chunks is None or t.runs is None or t.timed != len(t.sizes):
            raise ValueError("a track lacks sample tables")
        starts = t.offsets()
        if (starts < 0).any() or (starts + t.sizes > len(media)).any():
            raise ValueError("samples lie outside the file")
        keys = np.arange(len(t.sizes)) if t.sync is None else t.sync - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= len(t.sizes)):
            raise ValueError("keyframes lie outside the samples")
        return Media(t, starts, t.sizes, keys)
    if not any(kind[0] in (b"ftyp", b"moov", b"moof", b"mdat") for kind, _, _ in tree(memoryview(media), 0, len(media))):
        raise ValueError("no container")
    return Media(found[0] if found else Track(), none, none, none)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (-len(raw) % FRAME or (0 if raw else FRAME))


PROBED = (
    "codec string, width int, height int, timescale long, duration long, n_samples long, keyframes array<struct<start: long, length: long>>, "
    "payload_bytes long, payload_sha256 string, unpadded_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, error string"
)
_FIELDS = ("codec", "width", "height", "timescale", "duration", "n_samples", "keyframes", "payload_bytes", "payload_sha256", "unpadded_bytes", "tail_crc32", "media_bytes", "media_sha256", "error")


def _probe(media: bytes | None) -> dict | None:
    if media is None:
        return None
    out = dict.fromkeys(_FIELDS) | {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        m = read(media)
    except (ValueError, struct.error, IndexError, OverflowError, MemoryError) as e:
        return out | {"error": str(e)}
    t, payload = m.track, m.payload(media) if len(m.starts) else b""
    ranges = [{"start": a, "length": n} for a, n in zip(m.starts[m.keys].tolist(), m.lengths[m.keys].tolist(), strict=True)]
    out |= {"codec": t.codec, "width": t.width, "height": t.height, "timescale": t.timescale, "duration": t.ticks or t.duration, "n_samples": len(m.starts), "keyframes": ranges}
    return out | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "unpadded_bytes": len(payload.rstrip(bytes([FILL]))), "tail_crc32": zlib.crc32(payload[-32:])}


def stored(text: Column) -> Column:
    """Binary column: the container that holds the text's padded bytes."""

    @F.pandas_udf(T.BinaryType())
    def media(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([write(padded(t)) for t in texts], dtype=object)

    return media(text)


def probed(media: Column) -> Column:
    """Struct column of what the container says and of digests of its payload."""

    @F.pandas_udf(PROBED)
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            empty = dict.fromkeys(_FIELDS)
            yield pd.DataFrame([_probe(r) or empty for r in rows], columns=_FIELDS, dtype=object)

    return F.when(media.isNotNull(), probe(media))


def media_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    shared.small_batches(docs.sparkSession)
    return docs.withColumn(media, stored(docs[text]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = media_column(docs).select("doc_id", probed(F.col("media")).alias("p"))
    keys = F.array_join(F.transform("p.keyframes", lambda k: F.concat(k["start"].cast("string"), F.lit("+"), k["length"].cast("string"))), ",")
    feature = F.concat_ws(" ", F.concat(F.lit("codec="), F.trim("p.codec")), F.concat(F.lit("frame="), F.col("p.width"), F.lit("x"), F.col("p.height")), F.concat(F.lit("duration="), F.col("p.duration"), F.lit("/"), F.col("p.timescale")), F.concat(F.lit("samples="), F.col("p.n_samples")), F.concat(F.lit("keyframes="), keys))
    return out.select("doc_id", F.col("p.unpadded_bytes").alias("n_bytes"), "p.payload_bytes", "p.payload_sha256", "p.tail_crc32", "p.media_bytes", "p.media_sha256", feature.alias("feature"))
