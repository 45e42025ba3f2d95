"""corpus_pipeline.run against a plain version, stage by stage, on the smallest tables."""

import numpy as np
import pytest
from test_line_dedup import brute
from test_mixing import simple

import corpus_pipeline as cp
from recordloom.llm import bpe, mixing, near_dup, toxicity
from recordloom.llm.common import written

SF = "/root/testdata/sf0.001"


def arrays(texts):
    enc = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0, *map(len, enc)])


def copies_dropped(rows):
    """Ids that go: all pairs that share a band and whose estimate is high enough are linked, the smallest id of each component stays."""
    sh, bounds = near_dup.shingles(*arrays([r.text for r in rows]))
    ids = np.array([r.doc_id for r in rows])[np.diff(bounds) > 0]
    m = near_dup.minima(sh, bounds)
    sig, root = near_dup.pack(m), {int(i): int(i) for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    bands = m[:, : near_dup.BANDS * near_dup.ROWS].reshape(len(ids), near_dup.BANDS, near_dup.ROWS)
    for i in range(len(ids)):
        for j in range(i):
            if (bands[i] == bands[j]).all(axis=1).any() and near_dup.agreement(sig[i], sig[j]) >= near_dup.THRESHOLD - near_dup.SLACK:
                a, b = sorted((find(int(ids[i])), find(int(ids[j]))))
                root[b] = a
    return {i for i in root if find(i) != i}


def test_stages_like_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), name)
        after = docs.collect()
        if name == "toxicity":
            model = toxicity.train(docs.sparkSession.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            import pyarrow as pa

            p = toxicity.score(model, pa.array([r.text for r in before]))[:, 0]
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, x in zip(before, p, strict=True) if x < model.cut)
        elif name == "line_dedup":
            want = brute([(r.doc_id, r.text) for r in before])
            want = {i: t for i, (t, _, lost) in want.items() if not lost or t.strip(" \t\r\n")}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "near_dedup":
            gone = copies_dropped(before)
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in gone) and gone
        elif name == "mixing":
            _, want, _ = simple([(r.doc_id, r.text, r.lang, r.source) for r in before], spark)
            n = {}
            for i, _, k, _ in want:
                n[i] = n.get(i, 0) + k
            assert sorted(r.doc_id for r in after) == sorted(i for i, k in n.items() for _ in range(k))
            assert set(n.values()) >= {1, 2} and len(n) < len(before)
        else:
            text = {r.doc_id: r.text for r in before}
            plain = bpe.codec(bpe.read_vocabulary(bpe.VOCABULARY)).encoding
            assert len(after) == len(before) and all(list(r.tokens) == plain.encode_ordinary(text[r.doc_id]) and r.round_trip and r.n_tokens == len(r.tokens) for r in after)
    got = sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.n_tokens) for r in after)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 15), (3, "same\nline", "de", "t", 9), (3, "same\nline", "de", "t", 9), (4, "w " * 300_000, "en", "s", 600_000), (5, "same\nline", "en", "t", 9)]])
def test_defined_cases(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "tokens", "round_trip"]
    out = got.collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} <= {None, 3, 4, 5} and bool(out) == bool(rows)
    if rows:
        assert {4, None} <= {r.doc_id for r in out}
