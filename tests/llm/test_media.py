import random
import struct

import pytest

from recordloom.llm import media as md


def test_key_frames_are_the_lines(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join("w" * rng.randrange(0, 30) for _ in range(rng.randrange(0, 80)))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(md._pack, "doc_id bigint, content binary")
    blobs = {r.doc_id: bytes(r.content) for r in df.collect()}
    for r in md.media_columns(df).collect():
        lines, keys = md.samples(dict(rows)[r.doc_id].encode())
        t = r.tracks[0]
        assert r.error is None and r.brand == "isom" and (t.codec, t.handler, t.timescale, t.n_samples) == ("avc1", "vide", 1000, len(lines))
        assert [blobs[r.doc_id][k.start : k.start + k.size] for k in t.keyframes] == [lines[k] for k in keys]
        assert t.duration == sum(len(x) + 40 for x in lines) and abs(r.duration_s * 1000 - t.duration) < 1e-6


def test_large_boxes_and_open_end():
    b = md.pack(b"one\ntwo\n")
    at = b.index(b"moov") - 4
    size = struct.unpack_from(">I", b, at)[0]
    wide = b[:at] + struct.pack(">I4sQ", 1, b"moov", size + 8) + b[at + 8 : at + size] + struct.pack(">I4s", 0, b"mdat") + b"one\ntwo\n"
    got, plain = md.read(wide), md.read(b)
    assert got["error"] is None and got["tracks"] == plain["tracks"]


def test_fragments():
    base = md.pack(b"")
    trun = md.box(b"trun", struct.pack(">III", 0x701 | 0x4 & 0, 3, 100), struct.pack(">9I", 10, 5, 0, 10, 6, 0x10000, 20, 7, 0))
    moof = md.box(b"moof", md.box(b"mfhd", b"\0" * 8), md.box(b"traf", md.box(b"tfhd", struct.pack(">II", 0x20000, 1)), trun))
    got = md.read(base + moof)
    t = got["tracks"][0]
    assert got["error"] is None and t["n_samples"] == 3 and t["duration"] == 40 and t["bytes"] == 18
    at = len(base) + 100
    assert t["keyframes"] == [{"start": at, "size": 5}, {"start": at + 11, "size": 7}]


def test_broken_content_never_fails():
    rng = random.Random(3)
    b = md.pack(b"a\nbb\n\nccc\n" * 20)
    assert md.read(b[:200])["error"] == "truncated"
    for _ in range(500):
        x = bytearray(b)
        for _ in range(rng.randrange(1, 6)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        md.read(bytes(x[: rng.randrange(len(x))]))


@pytest.mark.parametrize("rows", [[], [(1, None), (2, b""), (3, b"no box at all"), (None, md.pack(b"x")), (4, md.pack(b"y" * 3_000_000)), (4, md.pack(b"y" * 3_000_000))]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, content binary, brand string, error int")
    got = md.media_columns(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    if rows:
        assert by[1].tracks is None and by[2].error == "no moov" and by[3].error and by[None].tracks[0].n_samples == 1 and by[4].tracks[0].bytes == 3_000_000
