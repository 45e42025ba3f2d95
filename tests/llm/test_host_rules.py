import random

import numpy as np
import pytest

from recordloom.llm import host_rules as hr


def measures(t):
    t = t or ""
    w, lines, n = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), t.split("\n"), max(1, len(t))
    w = [x for x in w if x]
    f = {
        "wordless": not w,
        "symbols": sum(c in "#$%&*<>{}|\\^~=_+@" for c in t) / n > 0.1,
        "monotonous": len(w) >= 50 and len(set(w)) / len(w) ** 0.5 < 3,
        "repeated_lines": len(lines) >= 4 and len(set(lines)) / len(lines) < 0.5,
        "long_words": bool(w) and n / len(w) > 15,
        "digits": sum(c in "0123456789" for c in t) / n > 0.5,
    }
    return f, sum(f.values()), sum(3 if k in hr.SEVERE else 1 for k, v in f.items() if v)


def plain(rows):
    by = {}
    for _, t, s in rows:
        by.setdefault(s or "", []).append(measures(t)[1] > 0)
    rate = {s: np.mean(v) for s, v in by.items()}
    m, v = np.mean(list(rate.values())), np.var(list(rate.values()))
    v = max(0.0, v - np.mean([rate[s] * (1 - rate[s]) / len(by[s]) for s in by]))  # less what chance gives
    k = min(hr.MOST, max(hr.LEAST, m * (1 - m) / v - 1)) if v > 1e-12 else hr.MOST
    out = []
    for i, t, s in rows:
        r = round((sum(by[s or ""]) + m * k) / (len(by[s or ""]) + k), 9)
        verdict = "bad" if r >= hr.BAD else "suspect" if r >= hr.SUSPECT else "good"
        out.append((i, s or "", measures(t)[1], measures(t)[2], r, verdict, measures(t)[2] < {"bad": 1, "suspect": 2, "good": 3}[verdict]))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.host, r.n_failed, r.points, r.host_rate, r.host_verdict, r.keep) for r in hr.verdicts(df).collect()), key=str)


def test_like_plain_python(spark):
    rng = random.Random(1)
    kinds = [lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=80)), lambda: "#$% " * 20, lambda: "12345 678 " * 9, lambda: "a\nb\nb\nb\nb", lambda: "x" * 40, lambda: "a clean text of some words"]
    rows = [(i, rng.choice(kinds if i % 3 else kinds[5:])(), ["good", "mixed", "small", "bad"][i % 4 if i % 50 else 2]) for i in range(300)]
    rows += [(1000 + i, "$$$$ " * 10, "worst") for i in range(40)] + [(2000, "clean words here", "worst")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string, source string")) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a"), (None, "b c", "a"), (3, "fine text", "b"), (3, "fine text", "b"), (4, "z" * 3_000_000, "b")], [(1, "one host", "a")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, 5, "v") for r in rows], "doc_id long, text string, source string, rate int, h string")
    assert got(df) == (plain(rows) if rows else [])
    assert all(k for i, *_, k in got(df) if i in (None, 3))


def test_host_of_url(spark):
    urls = [("https://a.B.org:80/x?y", "a.b.org"), ("http://u@c.net#z", "c.net"), ("nothing", ""), (None, None)]
    df = spark.createDataFrame(urls, "u string, want string")
    assert [r[0] for r in df.select(hr.host_of("u")).collect()] == [w for _, w in urls]


def test_pages_by_the_host_of_their_url(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "https://u@A.example.org:80/x", "<p>one two</p>"), (2, "http://a.example.org", "<b></b>"), (3, None, "x"), (4, "http://b.example.net/?q", None), (5, "http://b.example.net", "<i>" + "12345 " * 30 + "</i>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = hr.page_host_quality(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(hr.PAGES_SQL)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    assert {r.host for r in got.collect()} == {"a.example.org", "b.example.net", ""}
