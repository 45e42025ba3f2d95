import random
import re

import numpy as np
import pytest

from recordloom.llm import near_dup as nd


def rand_text(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(r"\w+", t.lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_estimate_follows_exact_similarity():
    rng = random.Random(1)
    for changed in (0, 3, 10, 30):
        base = rand_text(rng, 400).split()
        other = list(base)
        for i in rng.sample(range(400), changed):
            other[i] = "zz" + str(i)
        texts = [" ".join(base), " ".join(other)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
        sig = nd.pack(nd.minima(*nd.shingles(data, off)))
        assert abs(float(nd.agreement(sig[0], sig[1])) - jaccard(*texts)) < 0.12
        assert changed or float(nd.agreement(sig[0], sig[1])) == 1.0


def test_groups_match_brute_force(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for g in range(25):
        base = rand_text(rng, 80 + g * 5).split()
        for c in range(g % 4 + 1):
            w = list(base)
            for i in rng.sample(range(len(w)), c):
                w[i] = "changed"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, rows[3][1]), (n + 1, rows[3][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group_id for r in nd.near_duplicates(df).collect()}
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.6]
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.9 * len(pairs)
    far = {a for a, _ in rows} - {z for a, x in rows for b, y in rows if a != b and jaccard(x, y) >= 0.5 for z in (a, b)}
    assert not far & set(got)
    kept = {r.doc_id for r in nd.keep_one(df).collect()}
    assert kept == {a for a, _ in rows if got.get(a, a) == a}


def test_many_copies_and_chain(spark):
    rng = random.Random(3)
    base = rand_text(rng, 150).split()
    rows = []
    for i in range(400):  # near copies that all differ
        w = list(base)
        w[rng.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(df).collect()
    assert len(got) == 700 and {r.group_id for r in got} == {0}
    assert nd.keep_one(df).count() == 1


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, " .,"), (None, "a b c"), (4, "one"), (4, "one"), (5, "One!")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, 9, 8, 7) for r in rows], "doc_id long, text string, sk int, group_id int, rep int")
    got = {(r.doc_id, r.group_id) for r in nd.near_duplicates(df).collect()}
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    if rows:
        assert got == {(4, 4), (5, 4)}
        assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, 1), (False, 2), (False, 3), (False, 4)]
        assert kept.count() == 5
    else:
        assert not got and kept.count() == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    long = rand_text(rng, 300_000)
    rows = [(1, long), (2, long + " tail"), (3, "x" * 3_000_000), (4, "x" * 3_000_000)]
    got = {(r.doc_id, r.group_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_components(spark):
    edges = [(i, i + 1, 1.0) for i in range(40)] + [(100, 101, 1.0), (102, 101, 1.0), (7, 7, 1.0)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a long, b long, est double")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
