import random

import numpy as np
import pytest

from recordloom.llm import langid as li

SYLLABLES = {"xa": ["tion", "ing", "the", "er", "on"], "xb": ["eau", "ou", "é", "ment", "qu"], "xc": ["sch", "ü", "ung", "der", "ei"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang] + ["a", "e", "s"], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(8, 200)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df.where("doc_id < 400"))
    got = {r.doc_id: r.language for r in li.identify(df.where("doc_id >= 400"), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows[400:]]) > 0.97


def test_tables_like_plain_convolution():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (40, li.WINDOW)).astype(np.uint8), rng.integers(0, 2, 40)
    m = li.fit(x, y, ["a", "b"], epochs=2)
    one = lambda b: m.pairs[b[:, :-1].astype(int) * 256 + b[:, 1:]]
    v, x8, x = one(x), x, x.astype(int)
    tops = []
    for f in range(3 * li.FILTERS):
        w = 2 + f // li.FILTERS
        g = f % li.FILTERS
        out = [[v[r, i, f] + (m.third[x[r, i + 2], g] if w == 3 else 0) + (m.last[int(x[r, i + 2]) * 256 + x[r, i + 3], g] if w == 4 else 0) for i in range(li.WINDOW - w + 1)] for r in range(40)]
        tops.append(np.max(out, axis=1))
    z = np.maximum(np.array(tops).T + m.bias, 0) @ m.dense + m.offset
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.abs(m.log_probs(x8) - want).max() < 1e-3


def test_windows_cover_everything():
    texts = [b"a" * 300, b"", b"b" * 128, b"c"]
    off = np.cumsum([0, *map(len, texts)])
    w, size, bounds = li.windows(np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.diff(bounds).tolist() == [3, 0, 1, 1] and size.tolist() == [128, 128, 44, 128, 1]
    for t, lo, hi in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert w[lo:hi].tobytes().rstrip(b"\0") == t


@pytest.mark.parametrize("rows", [[], [(1, None, "xa"), (2, "", "xb"), (None, "word", None), (3, "the ing", "xa"), (3, "the ing", "xa"), (4, "y" * 3_000_000, "xb")], [(1, "no label", None)]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, language string, h int")
    got = li.identify(df, li.train(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    if len(rows) > 1:
        assert by[1].language == by[2].language == "und" and by[1].n_windows == 0 and by[4].n_windows == 23438 and by[4].language == "xb"
    elif rows:
        assert by[1].language == "und"
