import random

import numpy as np
import pytest

from recordloom.llm import bpe

C = bpe.codec(bpe.read_vocabulary(bpe.VOCABULARY))


def rand_piece(rng, n):
    return "".join(rng.choice(["a", "b", "ab", "the", "ing", "é", "ß", "q", "zz", "tion"]) for _ in range(n))


def test_tree_concatenation_is_exact():
    rng = random.Random(1)
    for n in (3, 50, 3000, 30_000):
        for text in (rand_piece(rng, n), "x" * n, "ab" * n, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))):
            p = text.encode()
            parts = [p]
            while len(parts[0]) > 20:
                parts = [x for q in parts for x in (q[: len(q) // 2], q[len(q) // 2 :])]
            assert C.tree([C.piece(x) for x in parts]) == C.piece(p)


def test_cuts_change_nothing():
    rng = random.Random(2)
    chars = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "1", "!", "é", "日", "😀", "\r\n", "\x1c"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(0, 60))) for _ in range(3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    ids, b = C.encode_all(data, off)
    for t, x, y in zip(texts, b[:-1], b[1:], strict=True):
        assert ids[x:y].tolist() == C.encoding.encode_ordinary(t), repr(t)


def test_long_texts_and_round_trip(spark):
    rng = random.Random(3)
    texts = ["w" * 100_000, rand_piece(rng, 30_000), " ".join(rand_piece(rng, 3) for _ in range(40_000)), "日本" * 50_000, " " * 200_000, "a b " * 10 + "k" * 90_000 + " tail", "short one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode(df)
    for r in got.collect():
        assert r.round_trip and r.n_tokens == len(r.tokens) and list(r.tokens) == C.encoding.encode_ordinary(texts[r.doc_id])
    assert got.count() == 8
    assert {r.doc_id: r.text for r in bpe.decode(got).collect()} == dict(rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "a b"), (3, "a"), (3, "a")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, k string, tokens int")
    got = bpe.encode(df, keep=("doc_id", "k")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    if rows:
        assert by[1].tokens is None and by[1].n_tokens == 0 and by[2].tokens == [] and by[3].n_tokens == 1 and by[None].n_tokens == 2
    ids = spark.createDataFrame([(1, [60000]), (2, None), (3, []), (4, [-1]), (5, [64])], "doc_id long, tokens array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(ids).collect()} == {1: None, 2: None, 3: "", 4: None, 5: "a"}
