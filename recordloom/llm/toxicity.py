"""Toxicity by cumulative-link ordinal regression.

Features are hashed words with the value log(1 + count), which doesn't fade with the text's length, times the log of how much
more often toxic rows of the fitting sample hold the word than clean ones.  One weight vector serves all thresholds:
P(grade >= k) = sigmoid(w.x - t_k) with t_1 < t_2 < t_3.  Expected severity is the sum of these three.  A document is toxic
where P(grade >= 1) reaches the model's cut.  Weight decay and cut are chosen on rows held out from the fit, each of FOLDS
parts scored by a model of the others: those with the greatest share of toxic rows found, less COST times the share of clean
rows flagged.  With fewer than FEW toxic or clean rows to choose on they are DECAYS[0] and CUT.

Labels say only toxic or not.  Grades for the fit: 0 for clean rows; toxic rows get 1, 2 or 3 by the tertile of their share
of marker words, which are the words that toxic rows of the fitting sample hold far more often than clean ones.

The fit takes at most `sample` labelled rows, those with the smallest hash of their id, on the driver; scoring covers every
row and whole texts.  Defined cases: a text that is null or has no word has severity 0 and isn't toxic; rows without an id
are scored like others; a label or id that is null, and labels of unknown documents, are not fitted; of several labels of
one document the largest counts; without both kinds of label nothing is toxic; an empty table gives an empty result; other
columns are not read, and `stage` keeps them whatever their names, dotted ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, numbered, raw, segments, slices, small_batches, words

BITS, GRADES, SAMPLE, CUT, DECAYS = 18, 3, 8000, 0.5, (1e-3, 3e-3, 1e-2)
FOLDS, COST, FEW = 4, 10.0, 10


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = CUT

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def counted(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and counts of each text, and the n + 1 bounds of each text's own."""
    _, h, wo = words(data, off)
    n = np.diff(wo)
    row = np.repeat(np.arange(n.size), n).astype(U64)
    keys, counts = np.unique((row << U64(BITS)) | (h >> U64(64 - BITS)), return_counts=True)
    rows = (keys >> U64(BITS)).astype(np.int64)
    return (keys & U64((1 << BITS) - 1)).astype(np.int32), counts.astype(np.int32), np.searchsorted(rows, np.arange(n.size + 1))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of each text, the roots of their shares of its words, and the n + 1 bounds of each text's own."""
    idx, counts, bounds = counted(data, off)
    return idx, np.sqrt(shares(counts, bounds)).astype(np.float32), bounds


def shares(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return counts / np.repeat(segments(counts.astype(float), bounds, np.add, 0.0), np.diff(bounds))


def lbfgs(fun, x: np.ndarray, rounds: int = 120, memory: int = 8) -> np.ndarray:
    """Minimum of fun, which returns a value and a gradient."""
    f, g = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, al = g.copy(), []
        for s, y, r in reversed(steps):
            a = r * s.dot(q)
            q -= a * y
            al.append(a)
        q *= steps[-1][0].dot(steps[-1][1]) / steps[-1][1].dot(steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(steps, reversed(al), strict=True):
            q += s * (a - r * y.dot(q))
        slope, t = -g.dot(q), 1.0
        while True:
            new = x - t * q
            fn, gn = fun(new)
            if fn <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = new - x, gn - g
        if s.dot(y) > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / s.dot(y))]
        done = abs(f - fn) < 1e-7 * max(1.0, abs(f))
        x, f, g = new, fn, gn
        if done:
            break
    return x


def markers(idx: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each feature is far more frequent among toxic rows."""
    size = 1 << BITS
    row = np.repeat(np.arange(toxic.size), np.diff(bounds))
    bad, good = np.bincount(idx[toxic[row]], minlength=size), np.bincount(idx[~toxic[row]], minlength=size)
    n1, n0 = max(1, toxic.sum()), max(1, (~toxic).sum())
    return (bad >= max(3, 0.02 * n1)) & (bad / n1 > 8 * (good + 0.5) / n0)


def ratios(idx: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log of the share of toxic rows that hold each feature against that of clean rows; 0 for features of fewer than two rows."""
    size = 1 << BITS
    row = np.repeat(np.arange(toxic.size), np.diff(bounds))
    bad, good = np.bincount(idx[toxic[row]], minlength=size), np.bincount(idx[~toxic[row]], minlength=size)
    r = np.log((bad + 1) / (toxic.sum() + 2)) - np.log((good + 1) / ((~toxic).sum() + 2))
    return np.where(bad + good >= 2, r, 0.0)


def grades(idx: np.ndarray, counts: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    share = segments(np.where(markers(idx, bounds, toxic)[idx], shares(counts, bounds), 0.0), bounds, np.add, 0.0)
    some = share[toxic & (share > 0)]
    cuts = np.quantile(some, [1 / 3, 2 / 3]) if some.size else np.array([np.inf, np.inf])
    return np.where(toxic, 1 + np.searchsorted(cuts, share, "right"), 0)


def loss(row: np.ndarray, col: np.ndarray, val: np.ndarray, size: int, grade: np.ndarray, decay: float):
    """Penalised negative log likelihood, with its gradient, of parameters [t_1, log gaps, weights]; entries (row, col, val) of the features."""
    n, lo, hi = grade.size, np.maximum(grade, 1) - 1, np.minimum(grade, GRADES - 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def value(p):
        w, gaps = p[GRADES:], np.exp(np.clip(p[1:GRADES], -8, 5))
        t = np.concatenate([[p[0]], p[0] + np.cumsum(gaps)])
        s = np.bincount(row, weights=w[col] * val, minlength=n)
        up, down = sig(s - t[lo]), sig(s - t[hi])  # P(>= grade), P(>= grade + 1)
        up, d_up = np.where(grade > 0, up, 1.0), np.where(grade > 0, up * (1 - up), 0.0)
        down, d_down = np.where(grade < GRADES, down, 0.0), np.where(grade < GRADES, down * (1 - down), 0.0)
        q = np.maximum(up - down, 1e-12)
        ds = -(d_up - d_down) / q / n
        dt = np.bincount(lo, weights=d_up / q / n, minlength=GRADES) - np.bincount(hi, weights=d_down / q / n, minlength=GRADES)
        g = np.empty_like(p)
        g[0] = dt.sum()
        g[1:GRADES] = [dt[k:].sum() * gaps[k - 1] for k in range(1, GRADES)]
        g[GRADES:] = np.bincount(col, weights=val * ds[row], minlength=size) + decay * w
        return -np.log(q).mean() + decay / 2 * w.dot(w), g

    return value


def fit(idx: np.ndarray, counts: np.ndarray, bounds: np.ndarray, grade: np.ndarray, decay: float = DECAYS[0]) -> Model:
    """Weights and thresholds by penalised maximum likelihood."""
    if not grade.size or not (grade > 0).any() or not (grade == 0).any():
        return Model(np.zeros(1 << BITS, np.float32), np.full(GRADES, 40.0))
    df, scale = np.bincount(idx, minlength=1 << BITS), ratios(idx, bounds, grade > 0)
    used = np.flatnonzero(df >= 2)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(used.size)
    row = np.repeat(np.arange(grade.size), np.diff(bounds))
    ok = place[idx] >= 0
    value = loss(row[ok], place[idx][ok], (np.log1p(counts) * scale[idx])[ok], used.size, grade, decay)
    base = np.log((grade == 0).sum() / (grade > 0).sum())
    p = lbfgs(value, np.concatenate([[base], np.zeros(GRADES - 1 + used.size)]))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = p[GRADES:] * scale[used]
    return Model(weights, np.concatenate([[p[0]], p[0] + np.cumsum(np.exp(np.clip(p[1:GRADES], -8, 5)))]))


def first(model: Model, idx: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return segments(model.weights[idx].astype(float) * np.log1p(counts), bounds, np.add, 0.0)


def choose(idx: np.ndarray, counts: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The decay, and the cut of P(grade >= 1), that do best on rows held out from the fit."""
    if min(toxic.sum(), (~toxic).sum()) < FEW:
        return DECAYS[0], CUT
    part = np.arange(toxic.size) % FOLDS

    def take(mask):
        own = np.repeat(mask, np.diff(bounds))
        return idx[own], counts[own], np.concatenate([[0], np.cumsum(np.diff(bounds)[mask])])

    held = np.zeros((len(DECAYS), toxic.size))
    for k in range(FOLDS):
        rest, own, y = take(part != k), take(part == k), toxic[part != k]
        grade = grades(*rest, y)
        for i, decay in enumerate(DECAYS):
            model = fit(*rest, grade, decay)
            held[i, part == k] = model.above(first(model, *own))[:, 0]
    held[:, np.diff(bounds) == 0] = 0
    best = (0.0, DECAYS[0], CUT)
    for decay, p in zip(DECAYS, held, strict=True):
        order = np.argsort(-p, kind="stable")
        p, y = p[order], toxic[order]
        gain = np.cumsum(y) / y.sum() - COST * np.cumsum(~y) / (~y).sum()
        gain[:-1][p[:-1] == p[1:]] = -np.inf  # equal ones go together
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), decay, float((p[at] + p[min(at + 1, p.size - 1)]) / 2))
    return best[1:]


def _featurize(batches):
    schema = pa.schema([("toxic", pa.int32()), ("idx", pa.binary()), ("counts", pa.binary())])
    for batch in slices(batches, 1):
        idx, counts, b = counted(*raw(batch.column(1)))
        parts = [(idx[x:y].tobytes(), counts[x:y].tobytes()) for x, y in zip(b[:-1], b[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], schema=schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model fitted to at most `sample` labelled rows of docs (doc_id, text) and labels (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic"))
    chosen = own.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__doc"), F.col("text").cast("string").alias("__text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__toxic", "__text")
    table = rows.mapInArrow(_featurize, "toxic int, idx binary, counts binary").toArrow()
    idx = np.frombuffer(b"".join(table["idx"].to_pylist()), np.int32)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in table["idx"].to_pylist()])]).astype(np.int64)
    toxic = np.asarray(table["toxic"].to_pylist(), int) > 0
    decay, cut = choose(idx, counts, bounds, toxic)
    model = fit(idx, counts, bounds, grades(idx, counts, bounds, toxic), decay)
    model.cut = cut
    return model


def score(model: Model, column: pa.Array) -> np.ndarray:
    """P(grade >= 1..3) of each text; 0 where it has no word."""
    idx, counts, b = counted(*raw(column))
    p = model.above(first(model, idx, counts, b))
    p[np.diff(b) == 0] = 0
    return p


def _scores(shared):
    def run(batches):
        for batch in slices(batches, 1):
            p = score(shared.value, batch.column(1))
            severity = p.sum(axis=1)
            columns = [pa.array(x) for x in (severity, *p.T, (p >= 0.5).sum(axis=1).astype(np.int32), p[:, 0] >= shared.value.cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "expected_severity", "p1", "p2", "p3", "grade", "toxic"])

    return run


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, p1..p3 (probability of at least that grade), grade (largest that is likely), toxic."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scores(shared), "doc_id bigint, expected_severity double, p1 double, p2 double, p3 double, grade int, toxic boolean")


def _clean(shared, text_at: int):
    def run(batches):
        for batch in slices(batches, text_at):
            yield batch.filter(pa.array(score(shared.value, batch.column(text_at))[:, 0] < shared.value.cut))

    return run


def stage(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't toxic, as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own, t = numbered(docs), docs.columns.index("text")
    own = own.withColumn(f"c{t}", F.col(f"c{t}").cast("string"))
    return own.mapInArrow(_clean(shared, t), own.schema).toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return severity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
