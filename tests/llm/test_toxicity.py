import random

import numpy as np
import pytest

from recordloom.llm import toxicity as tx

BAD = ["vile", "rotten", "filth", "scorn", "bile", "wretch"]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) for _ in range(300)]
    rows, labels, share = [], [], []
    for i in range(n):
        s = rng.choice([0, 0, 0, 0.02, 0.06, 0.15])
        w = [rng.choice(BAD) if rng.random() < s else rng.choice(words) for _ in range(rng.randrange(30, 300))]
        bad = any(x in BAD for x in w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad != (rng.random() < 0.03))))
        share.append(sum(x in BAD for x in w) / len(w))
    return rows, labels, np.array(share)


def test_held_out_accuracy_and_order(spark):
    rows, labels, share = corpus(900, 1)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels[:600], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.severity(docs, tx.train(docs, lab)).collect()}
    held = range(600, 900)
    assert np.mean([got[i].toxic == (share[i] > 0) for i in held]) > 0.93
    sev = np.array([got[i].expected_severity for i in held])
    mean = [sev[(share[600:] >= a) & (share[600:] < b)].mean() for a, b in ((0, 1e-9), (1e-9, 0.04), (0.04, 0.1), (0.1, 1))]
    assert mean == sorted(mean) and mean[0] < 0.4 and mean[3] > 2
    assert all(r.p1 >= r.p2 >= r.p3 and abs(r.p1 + r.p2 + r.p3 - r.expected_severity) < 1e-9 for r in got.values())


def test_gradient():
    rng = np.random.default_rng(0)
    f = lambda x: (((x - 3) ** 4).sum() + (x**2).sum(), 4 * (x - 3) ** 3 + 2 * x)
    x = tx.lbfgs(f, rng.normal(size=5))
    assert np.abs(f(x)[1]).max() < 0.02


def test_score_like_plain_loop():
    texts = ["a b a", "", "c!  É é b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    idx, values, b = tx.features(data, off)
    assert list(np.diff(b)) == [2, 0, 3]
    assert sorted(values[:2] ** 2) == pytest.approx([1 / 3, 2 / 3]) and sorted(values[2:] ** 2) == pytest.approx([0.25, 0.25, 0.5])


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 0), (None, 1), (3, None), (1, 0), (99, 1)], [(1, 0)]])
def test_defined_cases(spark, labels):
    rows = [(1, "bad bad"), (2, "good good"), (2, "good good"), (3, None), (4, ""), (None, "good"), (5, "x" * 2_500_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, toxic int, grade int")
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = tx.severity(docs, model).collect()
    assert len(got) == 7 and not any(r.toxic for r in got if r.doc_id in (3, 4))
    assert all(r.expected_severity == 0 for r in got if r.doc_id in (3, 4))
    assert len(labels) == 6 or not any(r.toxic for r in got)
    kept = tx.stage(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    assert tx.severity(docs.limit(0), model).count() == 0


def test_rare_words_in_long_texts_of_several_languages(spark):
    rng = random.Random(3)
    parts = {"a": "abcdefg", "m": "mnopqrs"}
    usual = {k: ["".join(rng.choices(v, k=rng.randrange(2, 6))) for _ in range(400)] for k, v in parts.items()}
    bad = {"a": [f"aa{i}" for i in "bcdefghijk"], "m": [f"mm{i}" for i in "bcdefghijk"]}
    rows, toxic, langs = [], [], []
    for i in range(1600):
        lang = "a" if rng.random() < 0.75 else "m"
        w = rng.choices(usual[lang], k=rng.randrange(50, 900))
        toxic.append(rng.random() < 0.12)
        if toxic[-1]:
            for word in rng.sample(bad[lang], 3):
                w[rng.randrange(len(w))] = word
        rows.append((i, " ".join(w)))
        langs.append(lang)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic[:1100])], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = {r.doc_id: r.toxic for r in tx.severity(docs, model).collect()}
    held = range(1100, 1600)
    for lang in parts:
        assert np.mean([got[i] for i in held if toxic[i] and langs[i] == lang]) >= 0.85
    assert np.mean([got[i] for i in held if not toxic[i]]) <= 0.02
    assert {r.doc_id for r in tx.stage(docs, model).select("doc_id").collect()} == {i for i, t in got.items() if not t}
