"""Line deduplication with two Bloom filters.

The first filter holds bits that some line's hash has set, the second those set at least twice.  Tasks build both over
their own lines, slot by slot, and send them compressed, so what is sent follows the number of lines; slots merge with
`twice |= twice' | (once & once')`.  Only lines whose bits are all in the second filter are suspected, and only these are
shuffled: grouped by their 128-bit hash, the first occurrence by (doc_id, line number) stays and later ones go.  A false
suspicion therefore costs a shuffled row and never a line.

The filter that is broadcast has at most MAX_BITS bits.  Where the lines need more, none is: hashes are divided into ranges, each task
holds the two filters of its range, and a line that is repeated within a batch is suspected there and then, so that of the commonest
line each batch sends one row to its range.  All ranges are one job, and no line is left out.

Texts aren't shuffled to lose their lines while the numbers of lost lines are few enough to broadcast (their size is counted, SMALL at
most).  Beyond that a bit filter of the documents that lose a line divides the table, and only these documents' rows move.

A line counts without the spaces, tabs and carriage returns around it; blank lines are never dropped.  Defined cases: null
text stays null; rows without an id stay as they are and count for nothing; rows that repeat an id are treated alike, as one
document; an empty table gives an empty result; other columns are kept whatever their names, dotted ones too.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, U64, arrow_out, give_back, numbered, parted, raw, slices, small_batches, written

SLOT_BITS, PROBES, BITS_PER_LINE = 1 << 20, 4, 8
MAX_BITS, RANGE_BITS = 1 << 29, 1 << 24
AROUND = b" \t\r"
_LINES = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])


def _hash_lines(batches):
    for batch in slices(batches, 1, 4_000_000):
        data, off = raw(batch.column(1))
        data, ids = data.tobytes(), batch.column(0).to_numpy(zero_copy_only=False)
        digest, at, doc = [], [], []
        one = xxhash.xxh3_128_digest
        for i in range(ids.size):
            n = 0
            for n, line in enumerate(data[off[i] : off[i + 1]].split(b"\n")):  # noqa: B007
                key = line.strip(AROUND)
                if key:
                    digest.append(one(key))
                    at.append(n)
                    doc.append(i)
        if digest:
            hg = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield arrow_out(_LINES, ids[doc], np.array(at, np.int32), np.ascontiguousarray(hg[:, 0]), np.ascontiguousarray(hg[:, 1]))


def probes(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each hash, and its PROBES bit positions in the slot."""
    h = h.view(U64)
    slot = ((h >> U64(32)) * U64(slots)) >> U64(32)
    x = h * U64(0x9E3779B97F4A7C15)
    step = (x >> U64(20)) | U64(1)
    bits = np.stack([((x >> U64(44)) + U64(j) * step) & U64(SLOT_BITS - 1) for j in range(PROBES)], axis=1)
    return slot.astype(np.int64), bits.astype(np.int64)


def _squeeze(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _build(slots: int):
    def run(batches):
        schema = pa.schema([("slot", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])
        hashes = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not hashes:
            return
        slot, bits = probes(np.concatenate(hashes), slots)
        order = np.argsort(slot, kind="stable")
        slot, bits = slot[order], bits[order]
        at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        for lo, hi in zip(at, [*at[1:], slot.size], strict=True):
            seen = np.bincount(bits[lo:hi].ravel(), minlength=SLOT_BITS)
            yield arrow_out(schema, slot[lo : lo + 1], [_squeeze(seen > 0)], [_squeeze(seen > 1)])
        del hashes, slot, bits, order
        give_back()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(SLOT_BITS // 8, np.uint8), np.zeros(SLOT_BITS // 8, np.uint8)
    for a, b in zip(pdf["once"], pdf["twice"], strict=True):
        a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
        twice |= b | (once & a)
        once |= a
    return pd.DataFrame({"slot": pdf["slot"][:1].to_list(), "twice": [zlib.compress(twice.tobytes(), 1)]})


def _suspect(shared, slots: int):
    def run(batches):
        filters = {k: np.frombuffer(zlib.decompress(v), np.uint8) for k, v in shared.value.items()}
        table = np.concatenate([filters.get(s, np.zeros(SLOT_BITS // 8, np.uint8)) for s in range(slots)])
        for batch in batches:
            if batch.num_rows:
                slot, bits = probes(batch.column(2).to_numpy(), slots)
                bits += slot[:, None] * SLOT_BITS
                hit = ((table[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=1)
                if hit.any():
                    yield batch.filter(pa.array(hit))
        del table, filters
        give_back()

    return run


def _local(batches):
    """Lines with n: 0 for a line that is repeated within the batch, which is suspected for sure; besides, one row for each hash, with n = 1 or 2 for its occurrences."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        order = np.lexsort((g, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
        count = np.diff(np.append(np.flatnonzero(new), h.size))
        one, many = order[new], order[np.repeat(count > 1, count)]
        rows = np.concatenate([one, many])
        n = np.concatenate([np.minimum(count, 2), np.zeros(many.size, np.int64)]).astype(np.int32)
        part = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n)], names=["doc_id", "line", "h", "g", "n"])


def _range(batches):
    """Both filters over the lines of one range; the lines that occurred once in their batch and are in the second filter."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    n = table["n"].to_numpy()
    slot, bits = probes(table["h"].to_numpy(), max(1, math.ceil(n.size * BITS_PER_LINE / SLOT_BITS)))
    order = np.argsort(slot, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], slot[order][1:] != slot[order][:-1]]))
    for lo, hi in zip(at, [*at[1:], n.size], strict=True):
        own = order[lo:hi]
        seen = np.bincount(bits[own].ravel(), weights=np.repeat(n[own], PROBES), minlength=SLOT_BITS)
        hit = own[(seen[bits[own]] > 1).all(axis=1) & (n[own] == 1)]
        if hit.size:
            yield from table.select(["doc_id", "line", "h", "g"]).take(pa.array(hit)).to_batches()


def suspects(lines: DataFrame, total: int, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of lines whose hash the second filter holds: every repeated one, and few others."""
    spark = lines.sparkSession
    if total * BITS_PER_LINE > max_bits:
        local = written(lines.mapInArrow(_local, "doc_id bigint, line int, h bigint, g bigint, n int"), "local")
        ranges = max(1, math.ceil(total * BITS_PER_LINE / min(max_bits, RANGE_BITS)))
        own = local.where("n > 0").repartition(ranges, "g").mapInArrow(_range, lines.schema)
        return local.where("n = 0").drop("n").unionByName(own)
    slots = max(1, math.ceil(total * BITS_PER_LINE / SLOT_BITS))
    merged = lines.select("h").mapInArrow(_build(slots), "slot bigint, once binary, twice binary").groupBy("slot").applyInPandas(_merge, "slot bigint, twice binary")
    shared = spark.sparkContext.broadcast({x.slot: bytes(x.twice) for x in merged.collect()})  # max_bits at most
    return lines.mapInArrow(_suspect(shared, slots), lines.schema)


def later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, drop: numbers from 0 of the lines of that document that occurred before."""
    small_batches(docs.sparkSession)
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = written(own.mapInArrow(_hash_lines, "doc_id bigint, line int, h bigint, g bigint"), "lines")
    s = written(suspects(lines, lines.count(), max_bits), "suspects")
    first = s.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = s.join(first.select("h", "g", "first"), ["h", "g"]).where(F.struct("doc_id", "line") > F.col("first"))
    return again.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("drop"))


def _apply(text_at: int, drop_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            drops, text = batch.column(drop_at), batch.column(text_at)
            rows = np.flatnonzero(~np.asarray(drops.is_null()))
            lines = pc.add(pc.count_substring(text, "\n"), 1).cast(pa.int64())
            lost = np.zeros(batch.num_rows, np.int64)
            if rows.size:
                new = []
                for i, t, d in zip(rows, text.take(pa.array(rows)).to_pylist(), drops.take(pa.array(rows)).to_pylist(), strict=True):
                    gone = set(d)
                    new.append("\n".join([x for n, x in enumerate(t.split("\n")) if n not in gone]))
                    lost[i] = len(gone)
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            columns = [text if i == text_at else c for i, c in enumerate(batch.columns) if i != drop_at]
            yield pa.RecordBatch.from_arrays([*columns, pc.fill_null(lines, 0), pa.array(lost)], names=names)
        give_back()

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped", max_bits: int = MAX_BITS, small: int = SMALL) -> DataFrame:
    """docs with later occurrences of lines removed from the text, and the number of its lines and of those removed.

    Two columns of one name result where docs has one named like a count; lines_col and dropped_col name them otherwise."""
    names = docs.columns
    i, t = names.index(id_col), names.index(text_col)
    own = numbered(docs)
    own = own.withColumns({f"c{t}": F.col(f"c{t}").cast("string"), "id": F.col(f"c{i}").cast("bigint")})
    drop = written(later_lines(own, f"c{i}", f"c{t}", max_bits), "drops").select(F.col("doc_id").alias("drop_id"), "drop")
    n, size = drop.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("drop") * 4 + 16), F.lit(0))).first()
    if size <= small:
        joined = own.join(F.broadcast(drop), F.col("id") == F.col("drop_id"), "left")
    else:
        rest, hit = parted(own, len(names), drop.select("drop_id"), n)
        moved = hit.join(drop.hint("shuffle_hash"), F.col("id") == F.col("drop_id"), "left")
        joined = rest.withColumns({"drop_id": F.lit(None).cast("bigint"), "drop": F.lit(None).cast("array<int>")}).unionByName(moved)
    joined = joined.drop("id", "drop_id")
    schema = own.drop("id").withColumns({"lines": F.lit(0).cast("bigint"), "lost": F.lit(0).cast("bigint")}).schema
    return joined.mapInArrow(_apply(t, len(names), schema.names), schema).toDF(*names, lines_col, dropped_col)


def stage(docs: DataFrame) -> DataFrame:
    """The columns of docs, each line only at its first occurrence; documents left with no line of theirs go, n_chars follows."""
    names = docs.columns
    out = dedup_lines(docs).toDF(*[f"c{i}" for i in range(len(names))], "lines", "lost")
    text = F.col(f"c{names.index('text')}")
    out = out.where((F.col("lost") == 0) | (F.translate(text, "\n\t\r ", "") != ""))
    if "n_chars" in names:
        c = f"c{names.index('n_chars')}"
        out = out.withColumn(c, F.when(F.col("lost") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(c)))
    return out.drop("lines", "lost").toDF(*names)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM keyed),
done AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k = '' OR rn = 1) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE k <> '' AND rn > 1) AS n_dropped
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(done.text, '') END AS text,
       coalesce(done.n_lines, 0) AS n_lines, coalesce(done.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN done USING (doc_id)
"""
