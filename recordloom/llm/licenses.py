"""Fuzzy search for short licence notices.

A notice of n bytes may have k = max(1, n // 12) edits.  It is split into k + 1 seeds; by the pigeonhole principle one of them stands
unchanged in any text within k edits.  Seeds are searched exactly over all texts; each hit gives a window of the notice's length and k
bytes more at both ends, and in each the regex library's bounded-error matching finds the match of least edits.  Only windows are
matched, yet no occurrence is missed: each has a seed and so a window.  Of matches that overlap one stays.

A line that only reserves rights or names a copyright counts as a notice too, under "all rights reserved" and "copyright".

Letters of ASCII compare without case, and each white-space character as a blank.  Edits count bytes; spans are in characters of the text.

Defined cases: null or empty text has no match; repeated rows give repeated results and rows without an id are searched too; an empty table
gives an empty result; other columns are not read.  Of equally good matches the leftmost counts.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, slices, small_batches

NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0", "under the terms of the GNU General Public License"],
    "LGPL": ["under the terms of the GNU Lesser General Public License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License", "licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose", "SPDX-License-Identifier: ISC"],
    "all rights reserved": ["All rights reserved", "Tous droits réservés", "Alle Rechte vorbehalten", "Todos los derechos reservados", "Proprietary and confidential", "Unauthorized copying of this file", "No part of this publication may be reproduced", "SPDX-License-Identifier: LicenseRef-Proprietary"],
    "copyright": ["Copyright (c)", "Copyright ©", "Copyright 19", "Copyright 20", "© Copyright"],
}
EDIT_EVERY = 12
FOLD = bytes(32 if c in b"\t\n\r\x0b\x0c" else c for c in range(256))


class Notice:
    def __init__(self, name: str, text: str):
        self.name, self.text = name, text.encode().lower().translate(FOLD)
        n = len(self.text)
        self.k = max(1, n // EDIT_EVERY)
        cut = [n * i // (self.k + 1) for i in range(self.k + 2)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.pattern = regex.compile(b"(?b)(?:" + regex.escape(self.text, special_only=True) + b"){e<=%d}" % self.k)

    def best_in(self, data: bytes, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the match of least edits in data[lo:hi], which is no longer than two notices."""
        at = data.find(self.text, lo, hi)
        if at >= 0:
            return at, at + len(self.text), 0
        m = self.pattern.search(data, lo, hi)
        return (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None


ALL = [Notice(name, text) for name, texts in NOTICES.items() for text in texts]


def scan(data: bytes, off: np.ndarray, notices: list[Notice] | None = None) -> list[tuple[int, str, int, int, int]]:
    """(row, licence, start, end, edits) with byte offsets in data; data holds the texts one after another, folded, each with a 0 after it.

    Each seed's window is matched apart, so that a run of notices costs as many matches as it has seeds."""
    found = []
    for notice in ALL if notices is None else notices:
        n, k = len(notice.text), notice.k
        spans = set()
        for seed, at in notice.seeds:
            i = data.find(seed)
            while i >= 0:
                spans.add((i - at - k, i - at + n + k))
                i = data.find(seed, i + 1)
        if not spans:
            continue
        windows = sorted(spans)
        row = np.searchsorted(off, np.clip([(a + b) // 2 for a, b in windows], 0, off[-1] - 1), "right") - 1
        seen: set[tuple[int, int, int]] = set()
        for (a, b), r in zip(windows, row.tolist(), strict=True):
            for q in (r - 1, r, r + 1):  # a window may reach over the end of its text
                if 0 <= q < off.size - 1:
                    x, y = max(a, int(off[q])), min(b, int(off[q + 1]) - 1)
                    if y - x >= n - k and (hit := notice.best_in(data, x, y)):
                        seen.add((q, *hit))
        found += [(q, notice.name, s, e, m) for q, s, e, m in sorted(seen)]
    return found


def best(found: list[tuple[int, str, int, int, int]]) -> list[tuple[int, str, int, int, int]]:
    """Where matches of a text overlap, the one with the fewest edits for its length, then the longest, then the first stays."""
    kept: list[tuple[int, str, int, int, int]] = []
    places: list[tuple[int, int, int]] = []  # (row, start, end) of those kept, in order; they never overlap
    for f in sorted(found, key=lambda f: (f[0], f[4] / (f[3] - f[2]), f[2] - f[3], f[2], f[1])):
        i = bisect.bisect_left(places, (f[0], f[3], -1))  # the first that starts at or after its end
        if i and places[i - 1][0] == f[0] and places[i - 1][2] > f[2]:
            continue
        places.insert(i, (f[0], f[2], f[3]))
        kept.append(f)
    return sorted(kept, key=lambda f: (f[0], f[2]))


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())])
    for batch in slices(batches, 1, 4_000_000):
        data, off = raw(batch.column(1))
        text = data.tobytes()
        texts = [text[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        folded = b"\0".join(texts).lower().translate(FOLD) + b"\0"
        at = off + np.arange(off.size)
        ids = batch.column(0).to_pylist()
        rows = []
        by_row: dict[int, list] = {}
        for f in scan(folded, at):
            by_row.setdefault(f[0], []).append(f)
        for q, own in sorted(by_row.items()):
            for _, name, s, e, n in best(own):
                a, b = s - int(at[q]), e - int(at[q])
                head = len(texts[q][:a].decode("utf-8", "ignore"))
                part = texts[q][a:b].decode("utf-8", "ignore")
                rows.append((ids[q], name, head, head + len(part), n, part))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, license, start, end, edits, matched (the text of the span) of each notice found."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_scan, "doc_id bigint, license string, start bigint, end bigint, edits int, matched string")


def op6_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
