import random

import numpy as np
import pytest

from recordloom.llm import licenses as lc


def least_edits(pattern, text):
    """Fewest edits of the pattern anywhere in the text, by dynamic programming."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        sub = row[:-1] + np.array([c != t for t in text], int)
        for j in range(1, len(text) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, sub[j - 1])
        row = new
    return int(row.min())


def spoil(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        op = rng.random()
        if op < 0.4:
            s[i] = rng.choice("abcxyz ")
        elif op < 0.7:
            del s[i]
        else:
            s.insert(i, rng.choice("abcxyz"))
    return "".join(s)


def test_like_dynamic_programming():
    rng = random.Random(1)
    notices = lc.ALL[:6]
    for _ in range(60):
        n = rng.choice(notices)
        noise = lambda: "".join(rng.choices("abcdefg licen", k=rng.randrange(0, 30)))
        text = (noise() + spoil(rng, n.text.decode(), rng.randrange(0, n.k + 3)) + noise()).encode()
        got = lc.scan(text + b"\0", np.array([0, len(text) + 1]), notices)
        for m in notices:
            least = least_edits(m.text, text)
            own = [f for f in got if f[2:] and any(f[1] == x.name for x in (m,))]
            assert bool([f for f in lc.scan(text + b"\0", np.array([0, len(text) + 1]), [m])]) == (least <= m.k)
            if least <= m.k:
                assert own and min(f[4] for f in lc.scan(text + b"\0", np.array([0, len(text) + 1]), [m])) == least


def test_spans(spark):
    rows = [(1, "é Ünï. LICENSED under the\napache Lisense, version 2.0. More"), (2, "nothing"), (3, "Released under the MIT License. And: Released undr the MIT Licence."), (4, "Licensed under CC BY-NC 4.0.")]
    got = lc.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert [(r.doc_id, r.license, r.edits) for r in sorted(got, key=lambda r: (r.doc_id, r.start))] == [(1, "Apache-2.0", 1), (3, "MIT", 0), (3, "MIT", 2), (4, "CC-BY-NC-4.0", 0)]
    assert all(text[r.doc_id][r.start : r.end] == r.matched for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "CC0 1.0 Universal"), (3, "CC0 1.0 Universal"), (3, "CC0 1.0 Universal"), (4, "w" * 3_000_000 + " Released under the MIT License.")]])
def test_defined_cases(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, start int")
    got = sorted(((r.doc_id or 0, r.license, r.start) for r in lc.notices(df).collect()))
    assert got == ([(0, "CC0-1.0", 0), (3, "CC0-1.0", 0), (3, "CC0-1.0", 0), (4, "MIT", 3_000_001)] if rows else [])


LINES = [  # as they stand in the test documents, and common lines besides
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("All rights reserved.", "all rights reserved"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Copyright (c) the authors.", "copyright"),
    ("Copyright 2021 The Authors", "copyright"),
    ("Tous droits réservés.", "all rights reserved"),
    ("SPDX-License-Identifier: ISC", "ISC"),
]


def test_notice_lines_of_documents(spark):
    prose = "It was and the whered of a thing.\n"
    rows = [(i, prose + line + "\n" + prose) for i, (line, _) in enumerate(LINES)]
    got = lc.notices(spark.createDataFrame([*rows, (99, prose * 50)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(i, name) for i, (_, name) in enumerate(LINES)]
    assert all(dict(rows)[r.doc_id][r.start : r.end] == r.matched for r in got)
