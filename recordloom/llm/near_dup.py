"""Near duplicates by b-bit MinHash.

Each text becomes 256 minima over hashes of its three-word shingles.  Bands of five full minima make candidates;
after that only the two low bits of every minimum are kept, packed into 64 bytes, and similarity is estimated from the
number of equal fields, corrected for the fields that agree by chance: J = (share - 2**-b) / (1 - 2**-b).

Equal minima collapse to one row before candidates are sought, so thousands of copies cost one row.  Band keys are counted with
partial sums, so that no task gets all rows of a common key; only rows of keys with two members or more move on.  Within a bucket
members are joined by breadth-first search that compares each reached member with those not reached yet: every pair of the
bucket that could change the components is compared, and none is dropped, yet a bucket of n copies costs n comparisons.  A key
with more than HOT unlike members is divided into blocks of about HOT, and each pair of blocks is a bucket of its own: every pair of its
members meets in one of them, and no task holds more than two blocks.

Defined cases: a text that is null or has no word has no signature and is in no group; a text of one or two words has
one shingle; rows without an id take no part; rows that repeat an id are copies of each other; the smallest id of a group
represents it; an empty table gives an empty result; other columns are not read, and keep_one keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, U64, arrow_out, mix, numbered, parted, raw, slices, small_batches, words, written

K, BITS, ROWS, BANDS, SHINGLE = 256, 2, 5, 32, 3
THRESHOLD, SLACK, SEED, HOT = 0.6, 0.04, 7, 4096
WORDS64 = K * BITS // 64
_SIG = pa.schema([("doc_id", pa.int64()), ("sk", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of k-word shingles, and the n + 1 bounds of each text's own; shorter texts have one of all their words."""
    _, h, wo = words(data, off)
    n = h.size
    if not n:
        return np.empty(0, np.uint32), np.zeros(off.size, np.int64)
    left = np.repeat(wo[1:], np.diff(wo)) - np.arange(n)  # words from here to the end of the text
    total = np.zeros(n, U64)
    for j in range(k):
        part = mix(h[j:] + U64(0x51ED27 * (j + 1)))
        there = left[: n - j] > j
        total[: n - j] += np.where(there, part, U64(0))
    keep = left >= k
    heads = wo[:-1][(np.diff(wo) > 0) & (np.diff(wo) < k)]
    keep[heads] = True
    bounds = np.concatenate([[0], np.cumsum(keep)])[wo]
    return (mix(total[keep]) >> U64(32)).astype(np.uint32), bounds


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 31, K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 1 << 32, K, dtype=np.uint32)


def minima(sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """K minima of each text with a shingle, as rows."""
    a, b = _coefficients()
    some = np.flatnonzero(np.diff(bounds))
    out = np.empty((K, some.size), np.uint32)
    if some.size:
        at = bounds[:-1][some]
        buf = np.empty_like(sh)
        for k in range(K):
            np.multiply(sh, a[k], out=buf)
            np.add(buf, b[k], out=buf)
            out[k] = np.minimum.reduceat(buf, at)
    # the low bits of a product depend on low bits alone; spread them before they are retained
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return np.ascontiguousarray(out.T)


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, in WORDS64 64-bit integers a row."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint8).reshape(m.shape[0], -1, 8 // BITS)
    packed = np.zeros(low.shape[:2], np.uint8)
    for j in range(8 // BITS):
        packed |= low[:, :, j] << np.uint8(BITS * j)
    return packed.view(U64)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed rows x to packed row(s) y, from bit counts, corrected for chance collisions."""
    d = x ^ y
    d = (d | (d >> U64(1))) & U64(0x5555555555555555)
    share = 1 - np.bitwise_count(d).sum(axis=-1, dtype=np.int64) / K
    c = 2.0**-BITS
    return (share - c) / (1 - c)


def _sign(batches):
    for batch in slices((b.select([0, 1]) for b in batches), 1, 300_000):
        sh, bounds = shingles(*raw(batch.column(1)))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[np.diff(bounds) > 0]
        if not ids.size:
            continue
        m = minima(sh, bounds)
        wide = m.astype(U64)
        key = np.zeros(ids.size, U64)
        for k in range(K):
            key = mix(key + wide[:, k] + U64(k + 1))
        bands = np.empty((ids.size, BANDS), U64)
        for j in range(BANDS):
            h = np.full(ids.size, j + 1, U64)
            for k in range(j * ROWS, (j + 1) * ROWS):
                h = mix(h + wide[:, k])
            bands[:, j] = h
        yield arrow_out(_SIG, ids, key.view(np.int64), [r.tobytes() for r in pack(m)], pa.ListArray.from_arrays(np.arange(0, ids.size * BANDS + 1, BANDS, dtype=np.int32), bands.view(np.int64).ravel()))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sk (hash of all minima), sig (packed low bits), bands (keys) of every text with a word."""
    small_batches(docs.sparkSession)
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_sign, "doc_id bigint, sk bigint, sig binary, bands array<bigint>")


def _runs(batches):
    """Batches cut where the first column's value changes: equal values stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        if held and k[0] == k[-1] == held[-1].column(0)[-1].as_py():
            held.append(batch)
            continue
        cut = int(np.searchsorted(k, k[-1], "left"))
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _connect(floor: float):
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.float64())])
        for t in _runs(batches):
            bucket, rep = t.column(0).to_numpy(), t.column(1).to_numpy()
            sig = np.frombuffer(b"".join(t.column(2).to_pylist()), U64).reshape(-1, WORDS64)
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.concatenate([at[1:], [bucket.size]])
            a, b, e = [], [], []
            pairs = at[ends - at == 2]
            if pairs.size:
                est = agreement(sig[pairs], sig[pairs + 1])
                ok = est >= floor
                a.append(rep[pairs][ok]), b.append(rep[pairs + 1][ok]), e.append(est[ok])
            for lo, hi in zip(at[ends - at > 2], ends[ends - at > 2], strict=True):
                rest = np.arange(lo, hi)
                while rest.size > 1:
                    queue, rest = [rest[0]], rest[1:]
                    while queue and rest.size:
                        x = queue.pop()
                        est = agreement(sig[rest], sig[x])
                        ok = est >= floor
                        if ok.any():
                            hit = rest[ok]
                            a.append(np.full(hit.size, rep[x])), b.append(rep[hit]), e.append(est[ok])
                            queue.extend(hit)
                            rest = rest[~ok]
            if a:
                yield arrow_out(schema, np.concatenate(a), np.concatenate(b), np.concatenate(e))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges stay as they are; each round is written out.
    """
    e = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.col("v") % 1000003), F.sum(F.col("u") % 1000003)).first()
        if now == mark:
            break
        mark = now
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        e = written(small.where("v <> u").distinct(), "edges")
    star = e.groupBy("v").agg(F.min("u").alias("root"))
    return star.select(F.col("v").alias("node"), "root").unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def buckets(r: DataFrame, hot: int = HOT) -> DataFrame:
    """bucket, sk: rows of r (sk, bands) whose pairs are to be compared, in sets of 2 * hot or so at most."""
    keyed = r.select(F.explode("bands").alias("key"), "sk")
    keys = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sk")).alias("code")).where("n > 1"), "keys")
    n, n_hot = keys.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > hot, 1))).first()
    shared = parted(keyed, 0, keys.select("key"), n)[1]
    common = keys.where(F.col("n") > hot).select(F.col("key").alias("k"), F.ceil(F.col("n") / hot).cast("int").alias("m"))
    if n_hot * 12 <= SMALL:
        common = F.broadcast(common)
    rare = shared.join(common, F.col("key") == F.col("k"), "left_anti") if n_hot else shared
    cold = rare.join(keys.where(F.col("n") <= hot), "key").select(F.xxhash64("code", "n").alias("bucket"), "sk").distinct()
    if not n_hot:
        return cold
    block, other = F.pmod(F.xxhash64("sk", "key"), F.col("m")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")
    pairs = shared.join(common, F.col("key") == F.col("k")).select("key", "sk", block, "m").select("key", "sk", "block", other)
    return cold.unionByName(pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "sk"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK, hot: int = HOT) -> DataFrame:
    """doc_id, group_id (smallest doc_id of the group), est_similarity (to the nearest partner that was compared), for each
    document with a duplicate.  Estimates from `threshold - slack` on count, as an estimate's deviation is about `slack`."""
    s = written(signatures(docs), "signatures")
    r = written(s.groupBy("sk").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "distinct")
    full = buckets(r, hot).join(r.select("sk", "rep", "sig"), "sk").select("bucket", "rep", "sig").repartition("bucket").sortWithinPartitions("bucket", "rep")
    edges = written(full.mapInArrow(_connect(threshold - slack), "a bigint, b bigint, est double"), "links")
    roots = components(edges)
    best = edges.select(F.explode(F.array("a", "b")).alias("node"), "est").groupBy("node").agg(F.max("est").alias("est"))
    linked = roots.join(best, "node")
    groups = r.select("sk", "rep", "copies").join(linked, F.col("rep") == F.col("node"), "left").where("copies > 1 or root is not null")
    groups = groups.select(F.col("sk").alias("gk"), F.coalesce("root", "rep").alias("group_id"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("est")).alias("est_similarity"))
    return s.select("doc_id", "sk").join(groups, F.col("sk") == F.col("gk")).select("doc_id", "group_id", "est_similarity")


def _without(df: DataFrame, at: int, ids: DataFrame, n: int, small: int) -> DataFrame:
    """Rows of df whose id in column `at` isn't among the n ids; only rows that may be among them are shuffled."""
    key = F.col(df.columns[at])
    if n * 16 <= small:
        return df.join(F.broadcast(ids), key == F.col("gone"), "left_anti")
    rest, hit = parted(df, at, ids, n)
    return rest.unionByName(hit.join(ids, key == F.col("gone"), "left_anti"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, slack: float = SLACK, small: int = SMALL) -> DataFrame:
    """docs with one row of each group of near duplicates, the one with the smallest id; columns as they are."""
    names = docs.columns
    i, t = names.index("doc_id"), names.index("text")
    own = numbered(docs).withColumn("id", F.col(f"c{i}").cast("bigint"))
    found = near_duplicates(own.select(F.col("id").alias("doc_id"), F.col(f"c{t}").alias("text")), threshold, slack)
    found = written(found.groupBy("doc_id", "group_id").agg(F.count(F.lit(1)).alias("rows")), "groups")
    gone = found.where("doc_id <> group_id").select(F.col("doc_id").alias("gone"))
    again = found.where("doc_id = group_id and rows > 1").select(F.col("doc_id").alias("again"))
    n, m = found.agg(F.count(F.when(F.col("doc_id") != F.col("group_id"), 1)), F.count(F.when((F.col("doc_id") == F.col("group_id")) & (F.col("rows") > 1), 1))).first()
    out = _without(own, len(names), gone, n, small)
    if m:  # rows that repeat an id
        one = out.join(again, F.col("id") == F.col("again"), "left_semi").dropDuplicates(["id"])
        out = _without(out, len(names), again.withColumnRenamed("again", "gone"), m, small).unionByName(one)
    return out.drop("id").toDF(*names)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
