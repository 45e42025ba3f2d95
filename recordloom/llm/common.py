"""What the operators share: written intermediate tables, and byte kernels over Arrow text columns.

Null text counts as empty text in every kernel.  Kernels work on whole texts; long ones are cut into
blocks only to bound memory, and never in the middle of a word.
"""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BLOCK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only where that is unset, and the master is local, one of this machine is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder there that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="recordloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, unless the session says so itself: 10,000 long texts in one would fill a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.isModifiable(name) or spark.sparkContext.getConf().get(name):
        return
    unset = spark._jsparkSession.sessionState().conf().settings().get(name) is None
    if unset:
        spark.conf.set(name, str(4 << 20))


_made: list[str] = []


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/recordloom/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables `written` has made so far."""
    return len(_made)


def remove(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables that `written` made from number `since` on, but for the last `keep`: nothing may read them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    upto = len(_made) - keep
    for path in _made[since:upto]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _made[since:upto]


def numbered(df: DataFrame) -> DataFrame:
    """df with the columns c0, c1, ...: names of any kind, dotted ones too, then clash with none of an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


SMALL, FILTER_BITS = 8 << 20, 1 << 28


def _bits(ids: pa.Array, bits: int) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) & U64(bits - 1)).astype(np.int64)


def _mark(bits: int):
    def run(batches):
        found = np.zeros(0, np.int64)
        for batch in batches:
            found = np.union1d(found, _bits(batch.column(0), bits))
        if not found.size:
            return
        at = np.flatnonzero(np.diff(found >> 16, prepend=-1))
        for lo, hi in zip(at, [*at[1:], found.size], strict=True):
            own = np.zeros(1 << 16, bool)
            own[found[lo:hi] & 0xFFFF] = True
            yield pa.RecordBatch.from_arrays([pa.array([int(found[lo] >> 16)]), pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())], names=["slot", "bits"])

    return run


def _union(pdf):
    own = np.zeros(1 << 13, np.uint8)
    for b in pdf["bits"]:
        own |= np.frombuffer(zlib.decompress(b), np.uint8)
    return pdf[:1].assign(bits=[zlib.compress(own.tobytes(), 1)])


def _split(shared, bits: int, at: int, want: bool):
    def run(batches):
        table = np.zeros(bits >> 3, np.uint8)
        for slot, packed in shared.value.items():
            table[slot << 13 : (slot + 1) << 13] = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            ids = batch.column(at)
            b = _bits(pc.fill_null(ids, 0), bits)
            hit = ((table[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool) & ~np.asarray(ids.is_null())
            if (hit == want).any():
                yield batch.filter(pa.array(hit == want))

    return run


def parted(df: DataFrame, at: int, ids: DataFrame, n: int, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of df (bigint ids in column `at`) that surely aren't among the n ids, and those that may be, by a bit filter of 32 MB at most.

    So that only the second need a shuffle; the first go on where they are read."""
    spark = df.sparkSession
    small_batches(spark)
    bits = min(bits, 1 << max(16, (8 * n).bit_length()))
    slots = ids.mapInArrow(_mark(bits), "slot bigint, bits binary").groupBy("slot").applyInPandas(_union, "slot bigint, bits binary")
    shared = spark.sparkContext.broadcast({r.slot: bytes(r.bits) for r in slots.collect()})  # at most bits / 65536 rows
    return df.mapInArrow(_split(shared, bits, at, False), df.schema), df.mapInArrow(_split(shared, bits, at, True), df.schema)


def bounded_sample(rows: DataFrame, total: int, sample: int, key: Column) -> DataFrame:
    """At most `sample` of about `total` rows: those with the smallest hash of the key.

    Only rows below a hash that about twice as many lie below are put in order, so what moves doesn't grow with the table.
    """
    h = F.pmod(key, F.lit(1 << 40))
    few = rows.where(h < F.lit(int(min(1.0, 2 * sample / max(1, total)) * (1 << 40)))) if total else rows
    return few.orderBy(h).limit(sample)


def give_back() -> None:
    """Hands memory that is free, but kept by the allocators, back to the system: the worker goes on with other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about `limit` bytes in the column each; a longer text makes a batch of its own."""
    batch = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    del batch
    give_back()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column one after another, and the n + 1 offsets of its rows."""
    big = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = pc.fill_null(column, b"" if big == pa.large_binary() else "")
    column = column.cast(big)
    _, offs, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return bytes_[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_P = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each."""
    if not _tables or _tables[0].size < n:
        size = max(n, BLOCK + 4096)
        up, down = np.full(size, _P, U64), np.full(size, pow(_P, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _tables[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _tables[0], _tables[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each non-empty span; codes hold one byte value each."""
    up, down = powers(codes.size)
    t = codes.astype(U64)
    t += U64(1)
    t *= up[: codes.size]
    run = np.empty(codes.size + 1, U64)
    run[0] = 0
    np.cumsum(t, out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U64))


FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    if lead.size:  # capitals of Latin-1, as in "É"
        second = data[lead]
        low[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    w = low != 0
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cuts = cuts[(cuts > 0) & (cuts < data.size)]
    first[cuts] = w[cuts]
    last[cuts - 1] = w[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(low, starts, ends) if starts.size else np.empty(0, U64)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts that the offsets divide data into: start of each, its hash, and for each text the number of words before it (n + 1).

    A word is a run of ASCII letters, digits and bytes from 0x80 on; case of ASCII and Latin-1 letters doesn't count.
    """
    parts, at = [], 0
    while at < data.size:
        to = min(at + BLOCK, data.size)
        if to < data.size:
            gap = np.flatnonzero(FOLD[data[at:to]] == 0)
            if gap.size:
                to = at + int(gap[-1]) + 1
            else:  # a word longer than a block
                while to < data.size and FOLD[data[to]]:
                    rest = np.flatnonzero(FOLD[data[to : to + BLOCK]] == 0)
                    to = to + int(rest[0]) if rest.size else min(to + BLOCK, data.size)
        s, _, h = _words(data[at:to], off - at)
        parts.append((s + at, h))
        at = to
    starts = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    hashes = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, U64)
    return starts, hashes, np.searchsorted(starts, off)


def segments(values: np.ndarray, bounds: np.ndarray, op, empty) -> np.ndarray:
    """op reduced over values[bounds[i]:bounds[i + 1]]; `empty` where there are none."""
    out = np.full(bounds.size - 1, empty, values.dtype)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if some.size:
        out[some] = op.reduceat(values, bounds[:-1][some])
    return out


def arrow_out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
