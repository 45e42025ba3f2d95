"""BPE encoding and decoding with a given byte-level vocabulary.

A text falls apart before every white space that follows something else: no pre-token of the vocabulary's pattern spans such
a place, so the stretches between are encoded apart and equal ones of a batch only once.

A pre-token longer than LEAF bytes is encoded by tree concatenation: its halves are encoded apart, then a window around the join
is encoded again and grows until its first token is the one that the left half has there and its last token the one that the
right half has there.  A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of
theirs; every pair of the result lies in the left half, the window or the right half, so the result is exact.  Texts of more
than LONG bytes are cut into leaves that are encoded in parallel tasks and then joined this way, once for equal texts.

Defined cases: null text has null tokens and n_tokens 0; empty text has no tokens; repeated rows and rows without an id are kept
and encoded alike; other columns are kept only if named, whatever their names; an empty table gives an empty result.  In decoding, null gives
null, as does a sequence with a number outside the vocabulary; bytes that are no UTF-8 become U+FFFD.

The driver reads the vocabulary (about a megabyte) and broadcasts it, so executors need no such file.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, slices, small_batches, span_hashes

VOCABULARY = os.environ.get("BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF, LONG, WINDOW, BATCH = 4096, 65536, 8, 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_READY: dict = {}


class Codec:
    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding._encode_single_piece
        self.pattern = regex.compile(PATTERN)
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.table = table
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of both, each being the encoding of its own."""
        if not left or not right:
            return left + right
        n = WINDOW
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            w = self.piece(b"".join([self.table[t] for t in left[i:]] + [self.table[t] for t in right[:j]]))
            if (i == 0 or w[0] == left[i]) and (j == len(right) or w[-1] == right[j - 1]):
                return left[:i] + w + right[j:]
            n *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def long_piece(self, data: bytes) -> list[int]:
        return self.tree([self.piece(x) for x in leaves(data)])

    def stretch(self, data: bytes) -> list[int]:
        """Encoding of UTF-8 text of any length."""
        text = data.decode("utf-8")
        if len(data) <= LEAF:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            p = m.group().encode()
            out += self.piece(p) if len(p) <= LEAF else self.long_piece(p)
        return out

    def encode_all(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts one after another, and the n + 1 bounds of each text's own."""
        if not data.size:
            return np.empty(0, np.int32), np.zeros(off.size, np.int64)
        starts = np.flatnonzero(cuts(data, off))
        ends = np.append(starts[1:], data.size)
        h = span_hashes(data, starts, ends)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        lo, hi = starts[first], ends[first]
        # stretches that begin with white space and end plainly fall apart again when they are encoded one after another
        calm = _SPACE[data[lo]] & plain(data)[hi - 1] & (hi - lo <= LEAF)
        lens = np.zeros(lo.size, np.int64)
        parts = []
        if calm.any():
            text = spread(data, lo, hi - lo, np.flatnonzero(calm))
            got = self.encoding.encode_to_numpy(text.tobytes().decode("utf-8")).astype(np.int32)
            upto = np.concatenate([[0], np.cumsum(self.sizes[got])])
            lens[calm] = np.diff(np.searchsorted(upto, np.concatenate([[0], np.cumsum((hi - lo)[calm])])))
            parts.append(got)
        for k in np.flatnonzero(~calm):
            got = np.array(self.stretch(data[lo[k] : hi[k]].tobytes()), np.int32)
            lens[k] = got.size
            parts.append(got)
        place = np.argsort(~calm, kind="stable")  # the order of parts
        begin = np.empty(lo.size, np.int64)
        begin[place] = np.concatenate([[0], np.cumsum(lens[place])])[:-1]
        ids = spread(np.concatenate(parts), begin, lens, which)
        upto = np.concatenate([[0], np.cumsum(lens[which])])
        return ids, upto[np.searchsorted(starts, off)]

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens, and the end of each one's."""
        n = self.sizes[ids]
        return spread(self.flat, self.starts, self.sizes, ids), np.cumsum(n)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def codec(vocabulary: bytes) -> Codec:
    key = xxhash.xxh3_128_digest(vocabulary)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Codec(vocabulary)
    return _READY[key]


def spread(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + lens[k]] for each k of which, one after another."""
    n = lens[which]
    total = int(n.sum())
    at = np.repeat(starts[which] - (np.cumsum(n) - n), n)
    at += np.arange(total)
    return flat[at]


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes that end a character that surely isn't white space: of ASCII, or of two bytes from U+00C0 on."""
    out = ~_SPACE[data] & (data < 0x80)
    out[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return out


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where texts start, and white space after something that isn't."""
    cut = np.zeros(data.size, bool)
    cut[1:] = _SPACE[data[1:]] & plain(data)[:-1]
    cut[off[:-1][off[:-1] < data.size]] = True
    return cut


def leaves(data: bytes) -> list[bytes]:
    """Halves of halves, until none is over LEAF; the number is a power of two."""
    parts = [data]
    while len(parts[0]) > LEAF:
        parts = [x for p in parts for x in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
    return parts


def _lists(ids: np.ndarray, bounds: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))


def _encode(shared, at: int):
    def run(batches):
        c = codec(shared.value)
        for batch in slices(batches, at, BATCH):
            text = batch.column(at)
            data, off = raw(text)
            ids, bounds = c.encode_all(data, off)
            back, ends = c.decode_all(ids)
            if back.size != data.size or not np.array_equal(back, data):  # two stretches of one hash
                parts = [c.stretch(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                ids, bounds = np.array([t for p in parts for t in p], np.int32), np.cumsum([0, *map(len, parts)])
                back, ends = c.decode_all(ids)
            place = np.concatenate([[0], ends])[bounds]
            if back.size == data.size and np.array_equal(back, data):
                same = (place[1:] == off[1:]) & (place[:-1] == off[:-1])
            else:
                same = np.array([np.array_equal(back[a:b], data[x:y]) for a, b, x, y in zip(place[:-1], place[1:], off[:-1], off[1:], strict=True)], bool)
            null = np.asarray(text.is_null())
            rest = [col for i, col in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(bounds)), _lists(ids, bounds, null), pa.array(same)], names=[*names, "n_tokens", "tokens", "round_trip"])

    return run


_LEAF = pa.schema([("k", pa.binary()), ("seq", pa.int64()), ("piece", pa.int64()), ("data", pa.binary())])


def _cut_long(batches):
    """k, text in; leaves out: stretches of about LEAF bytes or more with piece -1, and the halves of halves of longer pieces, numbered by piece."""
    pattern = regex.compile(PATTERN)
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode()
            arr = np.frombuffer(data, np.uint8)
            at = np.append(np.flatnonzero(cuts(arr, np.array([0, arr.size]))), arr.size)
            rows, lo, pieces = [], 0, 0
            for hi, nxt in zip(at[1:], np.append(at[2:], arr.size), strict=True):
                if hi - lo > LEAF or nxt - hi > LEAF or hi == arr.size:
                    if hi - lo <= 8 * LEAF:
                        rows.append((-1, data[lo:hi]))
                    else:
                        for m in pattern.finditer(data[lo:hi].decode()):
                            p = m.group().encode()
                            rows += [(pieces, x) for x in leaves(p)]
                            pieces += 1
                    lo = hi
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.binary()), pa.array(range(i, i + len(part)), pa.int64()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], schema=_LEAF)


def _encode_leaves(shared):
    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            out = [c.stretch(d) if p < 0 else c.piece(d) for p, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([np.array(x, np.int32).tobytes() for x in out], pa.binary())], names=["k", "seq", "piece", "ids"])

    return run


def _join_leaves(shared):
    def run(table: pa.Table) -> pa.Table:
        c = codec(shared.value)
        table = table.sort_by("seq")
        out, run_of, last = [], [], -1
        for p, ids in zip(table["piece"].to_pylist(), table["ids"].to_pylist(), strict=True):
            if p != last or p < 0:
                if run_of:
                    out += c.tree(run_of)
                run_of, last = [], p
            run_of.append(np.frombuffer(ids, np.int32).tolist())
        if run_of:
            out += c.tree(run_of)
        return pa.table({"k": table["k"].slice(0, 1), "tokens": pa.array([out], pa.list_(pa.int32()))})

    return run


def _check_long(shared, at: int):
    """Rows with text in column at and its tokens in the last column: what _encode gives."""

    def run(batches):
        c = codec(shared.value)
        for batch in slices(batches, at, BATCH):
            tokens = batch.column(batch.num_columns - 1)
            off, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            text = batch.column(at).to_pylist()
            ok = [c.decode_all(flat[a:b])[0].tobytes() == t.encode() for a, b, t in zip(off[:-1], off[1:], text, strict=True)]
            rest = [(n, x) for i, (n, x) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if i != at and i != batch.num_columns - 1]
            yield pa.RecordBatch.from_arrays([*[x for _, x in rest], pc.list_value_length(tokens).cast(pa.int64()), tokens, pa.array(ok)], names=[*[n for n, _ in rest], "n_tokens", "tokens", "round_trip"])

    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", vocabulary: str = VOCABULARY, long: int = LONG) -> DataFrame:
    """The columns `keep`, n_tokens, tokens, and whether decoding them gave the text again."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    at = len(keep)
    names = [f"c{i}" for i in range(at)]
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string")).toDF(*names, "text")
    schema = "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in names) + "n_tokens bigint, tokens array<int>, round_trip boolean"
    short = own.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= long).mapInArrow(_encode(shared, at), schema)
    big = own.where(F.octet_length("text") > long).withColumn("key", F.unhex(F.sha2("text", 256)))
    parts = big.select("key", "text").mapInArrow(_cut_long, "k binary, seq bigint, piece bigint, data binary").dropDuplicates(["k", "seq"])
    ids = parts.repartition("k", "seq").mapInArrow(_encode_leaves(shared), "k binary, seq bigint, piece bigint, ids binary")
    whole = ids.groupBy("k").applyInArrow(_join_leaves(shared), "k binary, tokens array<int>")
    joined = big.join(whole, F.col("key") == F.col("k")).select(*names, "text", "tokens")
    return short.unionByName(joined.mapInArrow(_check_long(shared, at), schema)).toDF(*keep, "n_tokens", "tokens", "round_trip")


def _decode(shared):
    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            tokens = batch.column(batch.num_columns - 1)
            out = []
            for t in tokens:
                ids = None if t.as_py() is None else t.values.to_numpy(zero_copy_only=False)
                bad = ids is None or t.values.null_count or (ids.size and (ids.min() < 0 or ids.max() >= len(c.table)))
                out.append(None if bad else c.decode_all(ids.astype(np.int64))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return run


def decode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and the text of the tokens."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = [f"c{i}" for i in range(len(keep))]
    own = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{tokens_col}`").cast("array<int>")).toDF(*names, "tokens")
    fields = "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in names)
    return own.mapInArrow(_decode(shared), f"{fields}text string").toDF(*keep, "text")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
