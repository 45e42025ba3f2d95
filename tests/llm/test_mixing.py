import itertools
import random

import pytest

from recordloom.llm import mixing as mx


def brute_cost(patterns, quota, passes):
    """Least cost of the largest flow, token by token over all ways to divide patterns among sources."""
    best = None
    ways = []
    for members, tokens in patterns:
        m = [x for x in members if x in quota]
        ways.append([dict(zip(m, c, strict=True)) for c in itertools.product(range(passes * tokens + 1), repeat=len(m)) if sum(c) <= passes * tokens])
    for pick in itertools.product(*ways):
        got = {k: sum(p.get(k, 0) for p in pick) for k in quota}
        if any(got[k] > quota[k] for k in quota):
            continue
        cost = 0
        for p, (_, tokens) in zip(pick, patterns, strict=True):
            for i in range(sum(p.values())):
                cost += (i // tokens + 1) ** 2
        key = (-sum(got.values()), cost)
        best = key if best is None else min(best, key)
    return best


def test_flow_like_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        patterns = [(m, rng.randrange(1, 3)) for m in [("a",), ("a", "b"), ("b", "c")] if rng.random() < 0.8]
        quota = {k: rng.randrange(0, 6) for k in "abc"}
        flows, cost = mx.route(patterns, quota, 2)
        assert (-sum(f for *_, f in flows), cost) == brute_cost(patterns, quota, 2)


def simple(rows, spark, **kw):
    """The selection in plain Python."""
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows], "doc_id long, text string, lang string, source string")
    keys = {r["__doc"]: tuple(r["__key"]) for r in mx.keyed(df, None, mx.SEED).select("__doc", "__key").collect()}
    groups = {}
    for i, t, lang, s in rows:
        m = tuple(sorted(x for x in (s and f"source:{s}", lang and f"lang:{lang}") if x))
        if t and m:
            by = groups.setdefault(m, {})
            by.setdefault(keys[i], [i, []])[1].append((len(t.encode()) + 3) // 4)
    patterns = sorted((m, sum(sum(v[1]) for v in g.values())) for m, g in groups.items())
    flows, _ = mx.route(patterns, mx.quotas(patterns, None, mx.BUDGET, mx.TEMPERATURE, mx.FAMILIES))
    out = []
    for n, (m, t) in enumerate(patterns):
        bounds, at = [], 0
        for i, b, f in flows:
            if i == n:
                bounds.append((b, at, at + f))
                at += f
        c = 0
        for key in sorted(groups[m]):
            i, toks = groups[m][key]
            for b, lo, hi in bounds:
                k = sum(2 * lo <= 2 * (c + p * t) + sum(toks) < 2 * hi for p in range(mx.PASSES + 1))
                if k:
                    out += [(i, b, k, x) for x in toks]
            c += sum(toks)
    return df, sorted(out, key=str), {b: sum(f for _, x, f in flows if x == b) for _, b, _ in flows}


def test_selection_like_plain_python(spark):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randrange(0, 400), rng.choice(["en", "de", "fr"]), rng.choice(["s0"] * 8 + ["s1", "s2"])) for i in range(1500)]
    rows += [rows[3], rows[3], (None, "abcdefgh", "en", "s1"), (None, "xyz", "en", "s1")]
    df, want, quota = simple(rows, spark)
    chosen = mx.plan(df)
    got = mx.mixture(df, chosen).collect()
    assert sorted(map(tuple, got), key=str) == want
    for b, q in quota.items():
        assert abs(sum(r.copies * r.tokens for r in got if r.bucket == b) - q) < 2500
    rows_out = mx.stage(df, chosen)
    assert rows_out.columns == df.columns
    assert rows_out.count() == sum(r.copies for r in got)


def test_given_weights_are_met(spark):
    rows = [(i, "t" * 40, "en" if i % 4 else "de", f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mx.mixture(df, mx.plan(df, {"lang:de": 1.0, "source:s0": 1.0})).collect()
    for b in ("lang:de", "source:s0"):
        assert abs(sum(r.copies * r.tokens for r in got if r.bucket == b) - 4500) <= 20


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a"), (2, "", "en", "a"), (3, "abc", None, None), (4, "abc", None, "a"), (5, "x" * 3_000_000, "en", "a"), (4, "abc", None, "a")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], "doc_id long, text string, lang string, source string, m int, key int, bucket string")
    chosen = mx.plan(df)
    got = mx.mixture(df, chosen).collect()
    assert {r.doc_id for r in got} <= {4, 5} and bool(got) == bool(rows)
    out = mx.stage(df, chosen)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
