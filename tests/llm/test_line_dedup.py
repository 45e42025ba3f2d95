import random

import numpy as np
import pytest

from recordloom.llm import line_dedup as ld


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        keep, lost = [], 0
        for line in t.split("\n"):
            k = line.strip(" \t\r")
            if k and k in seen:
                lost += 1
                continue
            seen.add(k)
            keep.append(line)
        out[i] = ("\n".join(keep), t.count("\n") + 1, lost)
    return out


def result(df, **kw):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in ld.dedup_lines(df, **kw).collect()}


def sample(n, seed=1):
    rng = random.Random(seed)
    common = [f"shared line number {i}" for i in range(30)]
    return [(i, "\n".join(rng.choice(common) if rng.random() < 0.3 else f"own {i} {j} {rng.random()}" for j in range(rng.randrange(0, 40)))) for i in range(n)]


def test_like_brute_force(spark):
    rows = sample(200)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_rounds_give_the_same(spark):
    rows = sample(150, 2)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), max_bits=4000) == brute(rows)


def test_filters_never_miss_a_repeat():
    rng = np.random.default_rng(5)
    h = rng.integers(-(1 << 62), 1 << 62, 50_000)
    slot, bits = ld.probes(h, 3)
    assert slot.min() >= 0 and slot.max() == 2 and bits.max() < ld.SLOT_BITS and bits.min() >= 0
    again = ld.probes(h.copy(), 3)
    assert (again[0] == slot).all() and (again[1] == bits).all()


def test_few_false_suspects(spark):
    rows = [(i, "\n".join(f"{i} {j}" for j in range(50))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).mapInArrow(ld._hash_lines, "doc_id bigint, line int, h bigint, g bigint")
    assert ld.suspects(df, 20_000).count() < 400


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "\n\n"), (None, "a\na"), (4, "a\r\nb\n a \n\n"), (5, "b"), (5, "b")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], 1, 2, 3) for r in rows], "doc_id long, text string, h int, line int, n_chars long")
    got = ld.dedup_lines(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    if rows:
        assert by[1].text is None and by[2].text == "" and by[3].text == "\n\n" and by[None].text == "a\na"
        assert by[4].text == "a\r\nb\n\n" and by[4].n_dropped == 1 and by[5].text == ""
    out = ld.stage(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == (["1", "2", "3", "4", "None"] if rows else [])


def test_long_text(spark):
    text = "\n".join(f"line {i % 70000}" for i in range(140_000))
    got = result(spark.createDataFrame([(1, text), (2, "y" * 3_000_000 + "\nline 5")], "doc_id long, text string"))
    assert got[1][2] == 70_000 and got[2][0] == "y" * 3_000_000
