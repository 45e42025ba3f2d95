"""Media columns: what ISO media containers (MP4, MOV, 3GP and fragmented MP4) say about themselves.

Nested boxes are walked by their headers, with 32- and 64-bit sizes and boxes that reach to the end.  The sample tables (stts, stss, stsz or
stz2, stsc, stco or co64) and, in fragments, tfhd and trun are decoded with numpy into codec, duration and the byte ranges of key frames.
Payloads in mdat are never looked at.

The test tables have no containers, so `pack` makes one from each document: every line is a sample, and lines after a blank line and every
tenth line are key frames; what is read from it is held against the lines.

Defined cases: null content has null columns; content without a moov box has the error "no moov"; a box or table that reaches over
the end of its parent ends the walk and gives the error "truncated", with what was read until then; boxes nested deeper than DEPTH give the
error "too deep"; a table that names more samples than the file has bytes gives the error "impossible count"; a duration of all ones is unknown and
null; tracks are in the order of the file; without stss every sample is a key frame, and stss without entries means none; repeated rows and rows
without an id are treated like others; an empty table gives an empty result; other columns are kept only if named, whatever their names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches

_NEST = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"mvex", b"edts", b"dinf", b"udta"}
TRACK = "struct<track_id:bigint,handler:string,codec:string,timescale:bigint,duration:bigint,n_samples:bigint,bytes:bigint,keyframes:array<struct<start:bigint,size:bigint>>>"
SCHEMA = f"brand string, duration_s double, tracks array<{TRACK}>, error string"


DEPTH = 64


class Bad(Exception):
    """Content that the walk can't go on with; its text is the error."""


class Truncated(Bad):
    def __init__(self):
        super().__init__("truncated")


def known(value: int, wide: bool) -> int | None:
    """A duration, None where all its bits are set."""
    return None if value == (0xFFFFFFFFFFFFFFFF if wide else 0xFFFFFFFF) or value >= 1 << 63 else value


def boxes(data: memoryview, lo: int, hi: int):
    """(kind, start, end) of the bodies of the boxes in data[lo:hi]."""
    while hi - lo >= 8:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if hi - lo < 16:
                raise Truncated
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            if kind == b"mdat" and size >= head:  # a payload that was cut off matters to nobody here
                return
            raise Truncated
        yield kind, lo + head, lo + size
        lo += size
    if hi > lo and any(data[lo:hi]):
        raise Truncated


def _u32(data: memoryview, at: int, end: int, count: int, per: int) -> np.ndarray:
    if count * per * 4 > end - at:
        raise Truncated
    return np.frombuffer(data, ">u4", count * per, at).reshape(count, per).astype(np.int64)


def _u(data: memoryview, kind: str, at: int, end: int) -> tuple:
    if struct.calcsize(kind) > end - at:
        raise Truncated
    return struct.unpack_from(kind, data, at)


class Track:
    def __init__(self):
        self.id = self.scale = 0
        self.duration: int | None = None
        self.handler = self.codec = ""
        self.sizes = self.chunks = self.offsets = np.empty(0, np.int64)
        self.times = np.empty((0, 2), np.int64)
        self.sync = None
        self.more: list[tuple[int, int, bool]] = []  # samples of fragments
        self.extra = 0

    def row(self) -> dict:
        n = self.sizes.size
        starts = self.places()
        keys = np.arange(n) if self.sync is None else self.sync[(self.sync >= 0) & (self.sync < n)]
        keys = keys[keys < starts.size]
        frames = [{"start": int(s), "size": int(z)} for s, z in zip(starts[keys], self.sizes[keys], strict=True)]
        frames += [{"start": s, "size": z} for s, z, k in self.more if k]
        length = min(int((self.times[:, 0].astype(float) * self.times[:, 1]).sum()), (1 << 62)) or self.duration
        if self.extra:
            length = (length or 0) + self.extra
        return {"track_id": self.id, "handler": self.handler, "codec": self.codec, "timescale": self.scale, "duration": length, "n_samples": n + len(self.more), "bytes": int(self.sizes.sum()) + sum(z for _, z, _ in self.more), "keyframes": frames}

    def places(self) -> np.ndarray:
        """Byte offset of each sample."""
        m = self.offsets.size
        if not m or not self.chunks.size:
            return np.empty(0, np.int64)
        first = self.chunks[:, 0] - 1
        per = np.repeat(np.minimum(self.chunks[:, 1], self.sizes.size), np.diff(np.append(np.minimum(first, m), m)).clip(0))[:m]
        upto = np.cumsum(per)
        per = per[: int(np.searchsorted(upto, self.sizes.size)) + 1]  # chunks beyond the last sample hold none
        n = min(int(per.sum()), self.sizes.size)
        per = np.diff(np.minimum(np.concatenate([[0], np.cumsum(per)]), n))
        chunk = np.repeat(np.arange(per.size), per)[:n]
        upto = np.concatenate([[0], np.cumsum(self.sizes[:n])])
        begin = np.concatenate([[0], np.cumsum(per)])[:-1]
        return self.offsets[chunk] + upto[:-1] - upto[np.minimum(begin, n)][chunk]


def _table(t: Track, data: memoryview, kind: bytes, a: int, b: int) -> None:
    if kind == b"tkhd":
        v = _u(data, ">B", a, b)[0]
        t.id = _u(data, ">I", a + (20 if v else 12), b)[0]
    elif kind == b"mdhd":
        v = _u(data, ">B", a, b)[0]
        t.scale, length = _u(data, ">IQ", a + 20, b) if v else _u(data, ">II", a + 12, b)
        t.duration = known(length, bool(v))
    elif kind == b"hdlr":
        t.handler = _u(data, ">4s", a + 8, b)[0].decode("latin-1")
    elif kind == b"stsd":
        t.codec = _u(data, ">4s", a + 12, b)[0].decode("latin-1") if _u(data, ">I", a + 4, b)[0] else ""
    elif kind == b"stts":
        t.times = _u32(data, a + 8, b, _u(data, ">I", a + 4, b)[0], 2)
    elif kind == b"stss":
        t.sync = _u32(data, a + 8, b, _u(data, ">I", a + 4, b)[0], 1)[:, 0] - 1
    elif kind == b"stsz":
        same, n = _u(data, ">II", a + 4, b)
        if same and n > max(0, len(data)):  # samples of a byte or more; a file in which they are elsewhere is out of reach
            raise Bad("impossible count")
        t.sizes = np.full(n, same, np.int64) if same else _u32(data, a + 12, b, n, 1)[:, 0]
    elif kind == b"stz2":
        bits, n = _u(data, ">BI", a + 7, b)
        if -(-n * bits // 8) > b - a - 12:
            raise Truncated
        if bits == 4:
            x = np.frombuffer(data, np.uint8, -(-n // 2), a + 12)
            t.sizes = np.stack([x >> 4, x & 15], axis=1).ravel()[:n].astype(np.int64)
        else:
            t.sizes = np.frombuffer(data, ">u2" if bits == 16 else np.uint8, n, a + 12).astype(np.int64)
    elif kind == b"stsc":
        t.chunks = _u32(data, a + 8, b, _u(data, ">I", a + 4, b)[0], 3)
    elif kind == b"stco":
        t.offsets = _u32(data, a + 8, b, _u(data, ">I", a + 4, b)[0], 1)[:, 0]
    elif kind == b"co64":
        x = _u32(data, a + 8, b, _u(data, ">I", a + 4, b)[0], 2)
        t.offsets = (x[:, 0] << 32) | x[:, 1]


def _fragment(out: dict, data: memoryview, a: int, b: int, moof: int) -> None:
    t, base, at, size, length, flags_all = None, moof, None, 0, 0, 0
    for kind, x, y in boxes(data, a, b):
        if kind == b"tfhd":
            flags = _u(data, ">I", x, y)[0] & 0xFFFFFF
            number, p = _u(data, ">I", x + 4, y)[0], x + 8
            t = next((k for k in out["tracks"] if k.id == number), None)
            length, size, flags_all = out["trex"].get(number, (0, 0, 0))
            for bit, form in ((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")):
                if flags & bit:
                    v = _u(data, form, p, y)[0]
                    p += struct.calcsize(form)
                    if bit == 1:
                        base = v
                    elif bit == 8:
                        length = v
                    elif bit == 16:
                        size = v
                    elif bit == 32:
                        flags_all = v
        elif kind == b"trun" and t is not None:
            flags, n = _u(data, ">II", x, y)
            flags, p, first = flags & 0xFFFFFF, x + 8, None
            if flags & 1:
                at, p = base + _u(data, ">i", p, y)[0], p + 4
            at = base if at is None else at
            if flags & 4:
                first, p = _u(data, ">I", p, y)[0], p + 4
            per = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if not per and n > len(data):
                raise Bad("impossible count")
            rows = _u32(data, p, y, n, len(per)) if per else np.empty((n, 0), np.int64)
            col = lambda bit, other: rows[:, per.index(bit)] if bit in per else np.full(n, other, np.int64)
            marks = col(0x400, flags_all)
            if first is not None and n:
                marks = marks.copy()
                marks[0] = first
            t.extra += int(col(0x100, length).sum())
            for z, m in zip(col(0x200, size).tolist(), marks.tolist(), strict=True):
                t.more.append((at, z, not m & 0x10000))
                at += z


def _walk(out: dict, data: memoryview) -> None:
    stack = [(boxes(data, 0, len(data)), 0)]
    while stack:
        at, moof = stack[-1]
        kind, a, b = next(at, (b"", 0, 0))
        if not kind:
            stack.pop()
        elif kind == b"ftyp" and not out["brand"]:
            out["brand"] = _u(data, ">4s", a, b)[0].decode("latin-1")
        elif kind == b"mvhd":
            v = _u(data, ">B", a, b)[0]
            out["scale"], length = _u(data, ">IQ", a + 20, b) if v else _u(data, ">II", a + 12, b)
            out["duration"] = known(length, bool(v))
        elif kind == b"trex":
            number, _, length, size, flags = _u(data, ">IIIII", a + 4, b)
            out["trex"][number] = (length, size, flags)
        elif kind == b"traf":
            _fragment(out, data, a, b, moof)
        elif kind in _NEST:
            if kind == b"moov":
                out["moov"] = True
            if kind == b"trak":
                out["tracks"].append(Track())
            if len(stack) >= DEPTH:
                raise Bad("too deep")
            stack.append((boxes(data, a, b), a - 8 if kind == b"moof" else moof))
        elif out["tracks"]:
            _table(out["tracks"][-1], data, kind, a, b)


def read(content: bytes | None) -> dict:
    if content is None:
        return {"brand": None, "duration_s": None, "tracks": None, "error": None}
    out: dict = {"brand": "", "scale": 0, "duration": 0, "tracks": [], "trex": {}, "moov": False}
    error = None
    try:
        _walk(out, memoryview(content))
    except Bad as e:
        error = str(e)
    if not out["moov"]:
        error = error or "no moov"
    tracks = [t.row() for t in out["tracks"]]
    lengths = [t["duration"] / t["timescale"] for t in tracks if t["timescale"] and t["duration"] is not None]
    seconds = max(lengths) if lengths else out["duration"] / out["scale"] if out["scale"] and out["duration"] is not None else None
    return {"brand": out["brand"] or None, "duration_s": seconds, "tracks": tracks, "error": error}


_FRAME = pa.struct([("start", pa.int64()), ("size", pa.int64())])
_TRACKS = pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("bytes", pa.int64()), ("keyframes", pa.list_(_FRAME))]))


def _columns(batches):
    for batch in batches:
        at = batch.num_columns - 1
        rows = [read(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(at)]
        own = [pa.array([r["brand"] for r in rows], pa.string()), pa.array([r["duration_s"] for r in rows], pa.float64()), pa.array([r["tracks"] for r in rows], _TRACKS), pa.array([r["error"] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], "brand", "duration_s", "tracks", "error"])


def media_columns(df: DataFrame, content_col: str = "content", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and brand, duration_s, tracks, error of the container in each row."""
    small_batches(df.sparkSession)
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{content_col}`").cast("binary")).toDF(*[f"c{i}" for i in range(len(keep))], "content")
    fields = "".join(f"c{i} {own.schema[i].dataType.simpleString()}, " for i in range(len(keep)))
    return own.mapInArrow(_columns, fields + SCHEMA).toDF(*keep, "brand", "duration_s", "tracks", "error")


def box(kind: bytes, *body: bytes) -> bytes:
    b = b"".join(body)
    return struct.pack(">I4s", 8 + len(b), kind) + b


def samples(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines of a text with their line ends, and the numbers of those that are key frames."""
    lines = text.splitlines(keepends=True) if text else []
    return lines, [i for i, _ in enumerate(lines) if i % 10 == 0 or not lines[i - 1].strip()]


def pack(text: bytes, codec: bytes = b"avc1", per_chunk: int = 4) -> bytes:
    """A container with the lines of a text as samples of 40 ms and 1 ms for each byte."""
    lines, keys = samples(text)
    size = np.array([len(x) for x in lines], np.int64)
    times = size + 40
    edge = np.flatnonzero(np.diff(times, prepend=-1)) if size.size else np.empty(0, np.int64)
    runs = np.stack([np.diff(np.append(edge, size.size)), times[edge]], axis=1) if size.size else np.empty((0, 2), np.int64)
    n, rest = divmod(size.size, per_chunk)
    stsc = [(1, per_chunk, 1)] * (n > 0) + [(n + 1, rest, 1)] * (rest > 0)
    full = lambda kind, *x: box(kind, b"\0\0\0\0", *x)
    many = lambda rows: struct.pack(">I", len(rows)) + np.asarray(rows, ">u4").tobytes()
    upto = np.concatenate([[0], np.cumsum(size)])
    whole = int(times.sum())
    ftyp = box(b"ftyp", b"isom\0\0\2\0isommp41")

    def moov(base: int) -> bytes:
        chunks = upto[:-1][::per_chunk] + base
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, b"\0" * 8)), full(b"stts", many(runs)), full(b"stss", many([k + 1 for k in keys])), full(b"stsz", struct.pack(">I", 0), many(size)), full(b"stsc", many(stsc)), full(b"stco", many(chunks)))
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, min(whole, 0xFFFFFFFF), 0, 0)), full(b"hdlr", b"\0\0\0\0vide", b"\0" * 13), box(b"minf", stbl))
        return box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, min(whole, 0xFFFFFFFF)), b"\0" * 80), box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, 0), b"\0" * 60), mdia))

    head = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(head) + box(b"mdat", text)


def _pack(batches):
    for batch in slices(batches, 1, 4_000_000):
        out = [pack(t.encode(), b"avc1") if t is not None else None for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return media_columns(docs.mapInArrow(_pack, "doc_id bigint, content binary"))
