"""Texts as sets: n-gram bits with Tanimoto, and trigram MinHash signatures.

Hashes are products of code points modulo 2**31 - 1, so that any engine can compute them.  A quadgram sets eight bits, a trigram two and a
bigram one, of 65,536."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

P, RANGE, HASHES = (1 << 31) - 1, 65536, 128
COEFFICIENTS = (1000003, 786433, 393241, 196613)
SPREAD = (40503, 92821, 130363, 262147, 524309, 611953, 745649, 999331)
PER_GRAM = {4: 8, 3: 2, 2: 1}
PIECE, PART = 1 << 18, 1 << 20  # hashes at a time; numbers in a batch that goes back to the JVM


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n code points in a row."""
    m = codes.size - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    h = np.full(m, n * 7919, np.int64)
    for j in range(n):
        h += codes[j : j + m] * COEFFICIENTS[j]
    return np.unique(h % P)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _mod(x: np.ndarray) -> np.ndarray:
    """x % P for x of 0 to 2**62, without a division: twice the high part is added to the low one."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.minimum(x.view(np.uint64), (x - P).view(np.uint64)).view(np.int64)  # below 0 it is large


def bits(text: str) -> np.ndarray:
    own, on = codes(text), np.zeros(RANGE, bool)
    for n, k in PER_GRAM.items():
        m = own.size - n + 1
        for lo in range(0, m, PIECE):
            h = np.full(min(PIECE, m - lo), n * 7919, np.int64)
            for j in range(n):
                h += own[lo + j : lo + j + h.size] * COEFFICIENTS[j]
            h = _mod(h)
            for s in SPREAD[:k]:
                on[_mod(h * s) % RANGE] = True
    return np.flatnonzero(on).astype(np.int32)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB, unless the session sets it: 10,000 texts in one are what they happen to be."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.isModifiable(name) and spark._jsparkSession.sessionState().conf().settings().get(name) is None:
        spark.conf.set(name, str(4 << 20))


def _texts(batch: pa.RecordBatch):
    """The texts of the last column, one at a time; null counts as empty."""
    return (t.as_py() or "" for t in batch.column(batch.num_columns - 1))


def _added(name: str, kernel, kind: pa.DataType):
    """The last column, a text, replaced by an array that the kernel makes of it; null counts as empty.  A batch goes on in parts of PART numbers, as the arrays are many times their texts."""

    def run(batches):
        for batch in batches:
            out, size, lo = [], 0, 0

            def part(hi):
                flat = np.concatenate(out) if out else np.empty(0, np.int64)  # noqa: B023
                col = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(flat, kind))  # noqa: B023
                return pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), col], names=[*batch.schema.names[:-1], name])  # noqa: B023

            for i, t in enumerate(_texts(batch)):
                out.append(kernel(t))
                size += out[-1].size
                if size >= PART:
                    yield part(i + 1)
                    out, size, lo = [], 0, i + 1
            if lo < batch.num_rows:
                yield part(batch.num_rows)

    return run


# Arrow kernels: as higher-order functions these take a hundred times as long, since lambdas are interpreted for each character


def with_bits(df: DataFrame, text: Column, out: str = "bits") -> DataFrame:
    """df with the sorted distinct bit numbers of the text, trimmed and in lower case."""
    small_batches(df.sparkSession)
    own = df.select("*", F.lower(F.trim(text)).alias("_text"))
    return own.mapInArrow(_added(out, bits, pa.int32()), df.withColumn(out, F.array().cast("array<int>")).schema)


def overlaps(df: DataFrame, text: Column, asked: list[str]) -> DataFrame:
    """df (id, ...) by id and query (the place in asked), where the text and it share a bit: k of them, of rn and qn.  The bits stay in the worker."""
    small_batches(df.sparkSession)
    wanted = np.zeros((len(asked), RANGE), bool)
    for i, q in enumerate(asked):
        wanted[i, bits(q.strip(" ").lower())] = True

    def run(batches):
        qn = wanted.sum(axis=1)
        for batch in batches:
            row, query, k, rn = [], [], [], []
            for i, t in enumerate(_texts(batch)):
                own = bits(t)
                n = wanted[:, own].sum(axis=1)
                some = np.flatnonzero(n)
                row += [i] * some.size
                query += some.tolist()
                k += n[some].tolist()
                rn += [own.size] * some.size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(query, pa.int32()), pa.array(k, pa.int64()), pa.array(rn, pa.int64()), pa.array(qn[query] if query else [], pa.int64())], names=["id", "query", "k", "rn", "qn"])

    return df.select("id", F.lower(F.trim(text)).alias("_text")).mapInArrow(run, "id bigint, query int, k bigint, rn bigint, qn bigint")


def pairs(df: DataFrame, one: Column, two: Column) -> DataFrame:
    """df's first column (id) with n and total, number and sum of the bits of the first text, m and k, number of the second's and of those in common.  Texts are shuffled to come together, not their bits."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, 4), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                own, other = bits(x.as_py() or ""), bits(y.as_py() or "")
                on = np.zeros(RANGE, bool)
                on[other] = True
                out[i] = own.size, own.sum(dtype=np.int64), other.size, on[own].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, j]) for j in range(4))], names=["id", "n", "total", "m", "k"])

    low = lambda t: F.lower(F.trim(t))
    return df.select("id", low(one), low(two)).mapInArrow(run, "id bigint, n bigint, total bigint, m bigint, k bigint")


def _places_with(digit: int) -> int:
    """The word whose bits are at the places that have that binary digit, as a signed number."""
    w = sum(1 << i for i in range(64) if i >> digit & 1)
    return w - (1 << 64) if w >> 63 else w


def united(df: DataFrame, text: Column) -> DataFrame:
    """By key (df: key, ...) how many bits its texts have together, and their sum: each task unites its own texts, and words of 64 bits are what is shuffled."""
    small_batches(df.sparkSession)

    def run(batches):
        seen: dict = {}

        def out():
            for key, on in seen.items():
                w = np.packbits(on, bitorder="little").view("<i8")
                at = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array([key] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(w[at])], names=["key", "at", "word"])
            seen.clear()

        for batch in batches:
            for key, t in zip(batch.column(0), _texts(batch), strict=True):
                key = key.as_py()
                if key not in seen:
                    if len(seen) >= 512:
                        yield from out()
                    seen[key] = np.zeros(RANGE, bool)
                seen[key][bits(t)] = True
        yield from out()

    w = df.select("key", F.lower(F.trim(text)).alias("_text")).mapInArrow(run, "key string, at int, word bigint").groupBy("key", "at").agg(F.bit_or("word").alias("word"))
    n = F.bit_count("word").cast("bigint")
    # the places of a word's bits add up, binary digit by digit
    places = sum((F.bit_count(F.col("word").bitwiseAND(F.lit(_places_with(j)))).cast("bigint") * (1 << j) for j in range(6)), F.lit(0).cast("bigint"))
    return w.groupBy("key").agg(F.sum(n).alias("n"), F.sum(F.col("at") * 64 * n + places).alias("total"))


def tanimoto(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.greatest(union, F.lit(1))).otherwise(0.0)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, HASHES + 1, dtype=np.int64)
    return (k * 1103515245 + 12345) % P, (k * 214013 + 2531011) % P


def signature(shingles: np.ndarray) -> np.ndarray:
    """The HASHES minima over the shingles, in pieces."""
    a, b = permutations()
    out = np.full(HASHES, P, np.int64)
    for lo in range(0, shingles.size, PIECE // HASHES):
        out = np.minimum(out, _mod(a[:, None] * shingles[lo : lo + PIECE // HASHES] + b[:, None]).min(axis=1))
    return out


def cleaned(text: Column) -> Column:
    """In lower case, other characters than letters and digits being blanks."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " ")


def agreements(df: DataFrame, text: Column, asked: DataFrame, words: Column) -> DataFrame:
    """df (id, ...) by id and query of asked (query, ...; a few rows): share of equal positions of the two texts' signatures, where there is one.  Signatures stay in the worker."""
    small_batches(df.sparkSession)
    q = [(r[0], s) for r in asked.select("query", cleaned(words)).collect() if (s := hashes(codes(r[1] or ""), 3)).size]
    known = [(i, signature(s)) for i, s in q]

    def run(batches):
        for batch in batches:
            row, query, share = [], [], []
            for i, t in enumerate(_texts(batch)):
                own = hashes(codes(t), 3)
                if own.size:
                    own = signature(own)
                    for j, sig in known:
                        if n := int((own == sig).sum()):
                            row.append(i)
                            query.append(j)
                            share.append(n / HASHES)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(query, pa.int32()), pa.array(share, pa.float64())], names=["id", "query", "share"])

    return df.select(F.col("id").cast("bigint").alias("id"), cleaned(text).alias("_text")).mapInArrow(run, "id bigint, query int, share double")


def _sql_rows(name: str, source: str, key: str, text: str, n: int) -> str:
    """A table with the code points c0 .. of each place of the texts."""
    leads = ", ".join(f"lead(c0, {j}) OVER w AS c{j}" for j in range(1, n))
    return f"""{name}_u AS (SELECT {key}, unnest(string_split({text}, '')) AS ch, unnest(range(length({text}))) AS i FROM {source}),
{name}_c AS (SELECT {key}, c0, {leads} FROM (SELECT {key}, i, unicode(ch) AS c0 FROM {name}_u WHERE ch <> '') WINDOW w AS (PARTITION BY {key} ORDER BY i))"""


def _sql_hash(n: int) -> str:
    return "(" + " + ".join(f"CAST(c{j} AS BIGINT) * {COEFFICIENTS[j]}" for j in range(n)) + f" + {n * 7919}) % {P}"


def sql_bits(name: str, source: str, key: str, text: str) -> str:
    """Tables for DuckDB: `name` (key, bit), with the bits of the texts of `source`."""
    parts = [f"SELECT {key}, h * {SPREAD[j]} % {P} % {RANGE} AS bit FROM (SELECT DISTINCT {key}, {_sql_hash(n)} AS h FROM {name}_c WHERE c{n - 1} IS NOT NULL)" for n, k in PER_GRAM.items() for j in range(k)]
    return f"{_sql_rows(name, source, key, text, 4)}, {name} AS ({' UNION '.join(parts)})"


def sql_shingles(name: str, source: str, key: str, text: str) -> str:
    clean = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')"
    return f"{_sql_rows(name, f'(SELECT {key}, {clean} AS tt FROM {source})', key, 'tt', 3)}, {name} AS (SELECT DISTINCT {key}, {_sql_hash(3)} AS s FROM {name}_c WHERE c2 IS NOT NULL)"
