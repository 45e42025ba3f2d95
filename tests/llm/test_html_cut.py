import itertools
import random

import numpy as np
import pytest

from recordloom.llm import html_cut as hc


def energy(odds, links, side):
    return sum(max(0, o) if not s else max(0, -o) for o, s in zip(odds, side, strict=True)) + sum(c for a, b, c in links if side[a] != side[b])


def test_cut_like_all_labellings():
    rng = random.Random(1)
    for _ in range(150):
        graphs = []
        for _ in range(3):
            n = rng.randrange(1, 8)
            graphs.append(([rng.randrange(-9, 10) for _ in range(n)], [(i, j, rng.randrange(0, 7)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]))
        bounds = np.cumsum([0, *[len(g[0]) for g in graphs]])
        e = np.array(sorted((a + o, b + o, c) for (_, links), o in zip(graphs, bounds, strict=False) for a, b, c in links), np.int64).reshape(-1, 3)
        got = hc.label(np.array([o for g in graphs for o in g[0]]), e[:, 0], e[:, 1], e[:, 2], bounds)
        for (odds, links), lo, hi in zip(graphs, bounds[:-1], bounds[1:], strict=True):
            best = min(energy(odds, links, s) for s in itertools.product([False, True], repeat=len(odds)))
            assert energy(odds, links, list(got[lo:hi])) == best
            assert energy(odds, links, hc.max_flow(odds, links)) == best


def page(rng, n):
    words = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(k))
    body = "".join(f"<p>{words(rng.randrange(15, 60)).capitalize()}. {words(12)}.</p>" for _ in range(n))
    nav = "".join(f'<li><a href="/{i}">{words(1)}</a></li>' for i in range(6))
    return f"<!DOCTYPE html><html><head><title>T</title><script>x='<p>no</p>'</script></head><body><nav><ul>{nav}</ul></nav><article>{body}</article><footer>&copy; {words(3)}</footer></body></html>"


def test_held_out_pages(spark):
    rng = random.Random(2)
    rows = [(i, page(rng, rng.randrange(1, 9))) for i in range(120)]
    w = hc.train(spark.createDataFrame(rows[:80], "page_id long, html string"))
    for r in hc.extract(spark.createDataFrame(rows[80:], "page_id long, html string"), w).collect():
        want = [b.text for b in hc.blocks(rows[r.page_id][1]) if b.weak == 1]
        got = r.text.split("\n")
        assert len(set(got) & set(want)) >= 0.9 * len(want) and len(set(got) - set(want)) <= 1


def test_blocks():
    b = hc.blocks("<p>one<p>two <a href=x>link</a> &amp; more<div class='ad top'>buy<br>now</div><!-- c --><style>p{}</style>tail</p> < 5")
    assert [x.text for x in b] == ["one", "two link & more", "buy", "now", "tail", "< 5"]
    assert b[1].linked == 4 and [x.weak for x in b][2:4] == [0, 0]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "plain"), (None, "<p>x</p>"), (4, "<div>" * 3000 + "deep"), (4, "<p>" + "w " * 400_000)]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, "a", 3) for r in rows], "page_id long, html string, text string, n_blocks int")
    got = hc.extract(df, hc.train(df)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    if rows:
        assert by[1].text == "" and by[2].n_blocks == 0 and by[3].text == "plain" and by[None].n_content == 1


BODY = "<p>one</p><header>two</header>three"


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><body>" + BODY,
    "<html><HEAD lang=en><meta charset=utf-8><title>T</title><link rel=x>" + BODY,
    "<head><title>T" + BODY,
    "<head><title>T</title><script>a<b</script><noscript><style>p{}</style></noscript></head><body>" + BODY,
    "<head><title>T</title><noscript><link rel=x><body>" + BODY,
    "<body><noscript>" + BODY,
    "<body><template>" + BODY,
    "<body><template>a<template>b</template>c</template>" + BODY + "<noscript>gone</noscript>",
    "<body><noscript>" + BODY.replace("three", "three<noscript>gone</noscript>"),
    "<head><title>T</title></head></div><body><!-- <noscript> -->" + BODY + "<script>'<template>'</script>",
])
def test_unclosed_head_noscript_and_template(page):
    assert [b.text for b in hc.blocks(page)] == ["one", "two", "three"]


def test_text_ends_a_head():
    assert [b.text for b in hc.blocks("<head><title>T</title>\nplain text")] == ["plain text"]
