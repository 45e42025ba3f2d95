"""Language identification by a byte convolutional network.

Every text is cut into windows of WINDOW bytes, the last filled up with zeros.  Bytes are embedded, filters of 2, 3 and 4 bytes
slide over the window, each filter's largest output is kept, and a dense layer with softmax gives the languages.  A text's
probabilities are the softmax of its windows' mean log probabilities, each window counting by its number of bytes.  All windows
of the whole text are classified.

The network is fitted in numpy with Adam to at most `sample` labelled rows, those with the smallest hash of id and text, and at most
PER_TEXT windows of each, which are spread over the whole text.  For use, embedding and filters are folded into one table by byte pair.

Defined cases: null or empty text has language "und" with probability 0 and no windows; without labels every text is "und"; null
labels are not fitted; repeated rows and rows without an id are treated like others; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, raw, slices, small_batches

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 8, 8
SAMPLE, PER_TEXT, EPOCHS, BATCH, RATE, SEED = 3000, 6, 5, 128, 0.01, 11
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    pairs: np.ndarray  # (65536, 3 * FILTERS): what a byte pair adds to the filters that start at it
    third: np.ndarray  # (256, FILTERS): the third byte of the filters of three
    last: np.ndarray  # (65536, FILTERS): the third and fourth byte of the filters of four
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """Log probability of each language for each window of bytes."""
        out = np.empty((windows.shape[0], len(self.labels)), np.float32)
        for at in range(0, windows.shape[0], 512):
            b = windows[at : at + 512].astype(np.int32)
            p = (b[:, :-1] << 8) | b[:, 1:]
            v = self.pairs[p]
            top = np.empty((b.shape[0], 3 * FILTERS), np.float32)
            top[:, :FILTERS] = v[:, :, :FILTERS].max(axis=1)
            top[:, FILTERS : 2 * FILTERS] = (v[:, :-1, FILTERS : 2 * FILTERS] + self.third[b[:, 2:]]).max(axis=1)
            top[:, 2 * FILTERS :] = (v[:, :-2, 2 * FILTERS :] + self.last[p[:, 2:]]).max(axis=1)
            z = np.maximum(top + self.bias, 0) @ self.dense + self.offset
            z -= z.max(axis=1, keepdims=True)
            out[at : at + 512] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows, the number of bytes in each, and the n + 1 bounds of each text's own."""
    n = np.diff(off)
    count = -(-n // WINDOW)
    bounds = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(n.size), count)
    start = (np.arange(bounds[-1]) - bounds[:-1][row]) * WINDOW
    size = np.minimum(n[row] - start, WINDOW)
    out = np.zeros(bounds[-1] * WINDOW, np.uint8)
    to = np.repeat(bounds[:-1] * WINDOW - off[:-1], n) + np.arange(data.size)
    out[to] = data
    return out.reshape(-1, WINDOW), size, bounds


def fit(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = EPOCHS) -> Model:
    """x: windows of bytes; y: numbers of labels."""
    rng = np.random.default_rng(SEED)
    k, d = max(1, len(labels)), EMBED
    p = {"e": rng.normal(0, 0.5, (256, d)), "b": np.zeros(3 * FILTERS), "u": rng.normal(0, 0.3, (3 * FILTERS, k)), "c": np.zeros(k)}
    p |= {w: rng.normal(0, 1 / np.sqrt(w * d), (w * d, FILTERS)) for w in WIDTHS}
    p = {a: v.astype(np.float32) for a, v in p.items()}
    m, s, step = {a: np.zeros_like(v) for a, v in p.items()}, {a: np.zeros_like(v) for a, v in p.items()}, 0
    for epoch in range(epochs if len(labels) > 1 else 0):
        order = rng.permutation(y.size)
        for at in range(0, y.size, BATCH):
            rows = order[at : at + BATCH]
            b, t = x[rows].astype(np.int64), y[rows]
            e = p["e"][b]
            top, where = [], []
            for w in WIDTHS:
                flat = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                out = flat @ p[w]
                i = out.argmax(axis=1)
                where.append((flat, i))
                top.append(np.take_along_axis(out, i[:, None, :], 1)[:, 0])
            h = np.maximum(np.concatenate(top, axis=1) + p["b"], 0)
            z = h @ p["u"] + p["c"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(t.size), t] -= 1
            q /= t.size
            dh = (q @ p["u"].T) * (h > 0)
            g = {"u": h.T @ q, "c": q.sum(axis=0), "b": dh.sum(axis=0), "e": np.zeros_like(p["e"])}
            for n, w in enumerate(WIDTHS):
                flat, i = where[n]
                own = dh[:, n * FILTERS : (n + 1) * FILTERS]
                hit = np.take_along_axis(flat, i[:, :, None], 1)  # (rows, filters, w * d)
                g[w] = np.einsum("rf,rfd->df", own, hit)
                de = (own[:, :, None] * p[w].T[None]).reshape(-1, w, d)
                for j in range(w):
                    np.add.at(g["e"], np.take_along_axis(b, i + j, 1).ravel(), de[:, j])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / max(1, epochs - 1))
            for a in p:
                m[a] = 0.9 * m[a] + 0.1 * g[a]
                s[a] = 0.999 * s[a] + 0.001 * g[a] ** 2
                p[a] = (p[a] - rate * (m[a] / (1 - 0.9**step)) / (np.sqrt(s[a] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    part = {(w, j): p["e"] @ p[w][j * d : (j + 1) * d] for w in WIDTHS for j in range(w)}
    both = lambda w, j: (part[w, j][:, None] + part[w, j + 1][None]).reshape(65536, FILTERS)
    return Model(labels, np.concatenate([both(w, 0) for w in WIDTHS], axis=1), part[3, 2], both(4, 2), p["b"], p["u"][:, : len(labels)], p["c"][: len(labels)])


def _pick(batches):
    for batch in slices(batches, 1):
        w, _, bounds = windows(*raw(batch.column(1)))
        labels, out = batch.column(0).to_pylist(), []
        for i, label in enumerate(labels):
            n = bounds[i + 1] - bounds[i]
            for k in range(min(n, PER_TEXT)):
                out.append((label, w[bounds[i] + k * n // min(n, PER_TEXT)].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], names=["label", "window"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The network fitted to at most `sample` rows of docs (doc_id, text, lang) with a language."""
    labelled = docs.where(F.col("lang").isNotNull())
    rows = labelled.select(F.col("lang").cast("string").alias("label"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h")).where("octet_length(text) > 0")
    chosen = bounded_sample(rows, labelled.count(), sample, F.col("h")).select("label", "text")
    table = chosen.mapInArrow(_pick, "label string, window binary").toArrow()
    names = table["label"].to_pylist()
    labels = sorted(set(names))
    x = np.frombuffer(b"".join(table["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    place = {v: i for i, v in enumerate(labels)}
    return fit(x, np.array([place[v] for v in names], np.int64), labels)


def classify(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its probability and the number of windows of each text."""
    w, size, bounds = windows(*raw(column))
    n = np.diff(bounds)
    if not model.labels:
        return [UNKNOWN] * n.size, np.zeros(n.size), n
    total = np.zeros((n.size, len(model.labels)))
    some = np.flatnonzero(n)
    if some.size:
        weighted = model.log_probs(w) * size[:, None]
        total[some] = np.add.reduceat(weighted.astype(float), bounds[:-1][some], axis=0) / np.add.reduceat(size, bounds[:-1][some])[:, None]
    q = np.exp(total - total.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    best = q.argmax(axis=1)
    return [model.labels[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, q.max(axis=1), 0.0), n


def _label(shared):
    def run(batches):
        for batch in slices(batches, 1):
            label, prob, n = classify(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(prob), pa.array(n)], names=["doc_id", "language", "probability", "n_windows"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, language, probability, n_windows of each row."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_label(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, language string, probability double, n_windows bigint")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
