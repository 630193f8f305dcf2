import hashlib
import struct
import zlib

import numpy as np
import pytest
from runledger.llm import media as md
from runledger.llm import queries

F8 = md.F


def simple_frames(data):
    """Keyframe ranges and payload by a plain byte-wise reading of the writer's tables, in Python loops."""

    def find(blob, at, *path):
        end = at + len(blob)
        pos = 0
        while pos < len(blob):
            size = int.from_bytes(blob[pos : pos + 4], "big")
            if blob[pos + 4 : pos + 8] == path[0]:
                inner = blob[pos + 8 : pos + size]
                return inner if len(path) == 1 else find(inner, 0, *path[1:])
            pos += size
        raise KeyError(path, end)

    stbl = find(data, 0, b"moov", b"trak", b"mdia", b"minf", b"stbl")
    ints = lambda b: struct.unpack(f">{len(b) // 4}I", b)
    _, size, n = ints(find(stbl, 0, b"stsz"))
    offsets = ints(find(stbl, 0, b"stco"))[2:]
    runs = ints(find(stbl, 0, b"stsc"))[2:]
    runs = [runs[i : i + 3] for i in range(0, len(runs), 3)]
    sync = ints(find(stbl, 0, b"stss"))[2:]
    places = []
    for c, off in enumerate(offsets, 1):
        each = [r[1] for r in runs if r[0] <= c][-1]
        places += [off + size * k for k in range(each)]
    assert len(places) == n
    return [(places[s - 1], size) for s in sync], b"".join(data[p : p + size] for p in places)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 31, 576 * 32, 576 * 32 + 1, 576 * 65, 300_000])
def test_round_trip(n):
    text = ("é" + "x" * n)[: n - 1] if n > 1 else "x" * n
    payload = md.padded(text)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload.rstrip(b"\xff") == text.encode()
    data = md.write(payload)
    got = md.read(data)
    keys, plain = simple_frames(data)
    assert got.payload(data) == payload == plain
    assert list(zip(got.starts[got.keys].tolist(), got.lengths[got.keys].tolist(), strict=True)) == keys
    assert got.track.codec == "raw " and (got.track.width, got.track.height, got.track.timescale, got.track.ticks) == (24, 24, 25, len(payload) // 576)


def other_file(sizes, per_chunk, gap, wide=False, compact=0, last_open=False):
    """A container by another writer: mdat first, tables of every kind, gaps between chunks."""
    bodies = [bytes([i % 251]) * s for i, s in enumerate(sizes)]
    blob, offsets, at, i = b"", [], 0, 0
    head = md.box(b"ftyp", b"mp42") + md.box(b"free", b"?" * 5)
    base = len(head) + 16
    while i < len(bodies):
        offsets.append(base + at)
        chunk = b"".join(bodies[i : i + per_chunk])
        blob += chunk + b"#" * gap
        at += len(chunk) + gap
        i += per_chunk
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(blob) + 16) + blob
    n = len(sizes)
    runs = [(1, per_chunk, 1)] + ([(len(offsets), n % per_chunk, 1)] if n % per_chunk else [])
    runs = runs[-1:] if len(offsets) == 1 else runs
    if compact == 4:
        nibbles = [*sizes, 0]
        size_box = md.full(b"stz2", struct.pack(">II", 4, n), bytes(nibbles[k] << 4 | nibbles[k + 1] for k in range(0, n, 2)))
    elif compact:
        size_box = md.full(b"stz2", struct.pack(">II", compact, n), np.array(sizes, f">u{compact // 8}").tobytes())
    else:
        size_box = md.full(b"stsz", struct.pack(">II", 0, n), np.array(sizes, ">u4").tobytes())
    stbl = md.box(b"stbl", size_box, md.full(b"stsd", struct.pack(">I", 1), md.box(b"mp4a", bytes(28))), md.full(b"stts", struct.pack(">IIIII", 2, 1, 7, n - 1, 3)), md.full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), md.full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), np.array(offsets, ">u8" if wide else ">u4").tobytes()))
    mdia = md.box(b"mdia", md.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 48000, 7 + 3 * (n - 1), 0), version=1), md.box(b"minf", stbl))
    moov = md.box(b"moov", md.box(b"trak", md.full(b"tkhd")), md.box(b"udta", b""), md.box(b"trak", mdia))
    if last_open:
        moov = struct.pack(">I", 0) + moov[4:]
    return head + mdat + moov, b"".join(bodies)


@pytest.mark.parametrize("options", [{}, {"wide": True}, {"compact": 4}, {"compact": 8}, {"compact": 16, "last_open": True}])
def test_other_containers(options):
    data, payload = other_file([3, 1, 15, 0, 9, 2, 7], 3, 4, **options)
    got = md.read(data)
    assert got.payload(data) == payload and got.track.codec == "mp4a" and got.track.timescale == 48000 and got.track.ticks == 25
    assert got.keys.tolist() == list(range(7))


def test_broken_bytes_never_crash():
    good = md.write(md.padded("some text " * 400))
    rng = np.random.default_rng(0)
    for _ in range(3000):
        b = bytearray(good)
        for _ in range(rng.integers(1, 4)):
            b[rng.integers(0, min(len(b), 900))] = rng.integers(0, 256)
        out = md._probe(bytes(b[: rng.integers(1, len(b) + 1)] if rng.random() < 0.3 else b))
        assert (out["error"] is None) == (out["payload_bytes"] is not None)
    assert md._probe(b"")["error"] and md._probe(b"hello world")["error"] and md._probe(None) is None
    assert md._probe(md.box(b"ftyp", b"isom"))["n_samples"] == 0


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.queries()["op2_media"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        data = md.write(payload)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        keys, _ = simple_frames(data)
        n = len(payload) // 576
        assert r.feature == f"codec=raw frame=24x24 duration={n}/25 samples={n} keyframes=" + ",".join(f"{a}+{b}" for a, b in keys)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "é" * 100_000)], "doc_id long, text string").withColumn("media", F8.lit("clash"))
    got = md.media_column(docs, media="stored").withColumn("p", md.probed(F8.col("stored"))).collect()
    assert sorted(r.p.unpadded_bytes for r in got) == [0, 0, 0, 1, 200_000] and {r.media for r in got} == {"clash"}
    assert md.media_column(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,), (b"junk",)], "media binary").select(md.probed(F8.col("media")).alias("p")).collect()
    assert nulls[0].p is None and nulls[1].p.error and nulls[1].p.media_bytes == 4
