"""Nearest vectors against brute force over all pairs."""

import numpy as np
import pytest

from recordloom.operators import recall


@pytest.mark.parametrize("block", [7, 4096])
def test_every_vector_is_a_query(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(recall, "BLOCK_ROWS", block, raising=False)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1, 61)]  # no row 0
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, [0.0] * 8), (73, None), (74, [1.0, 2.0]), (75, [2.0, 4.0]), (76, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in recall.cosine_topk(spark, str(tmp_path)).collect():
        got.setdefault(r.query, []).append((-r.score, r.vec_id))
    for i, a in rows:
        want = []
        for j, b in rows:
            if a and b and len(a) == len(b) and any(a) and any(b):
                s = round(float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))), 6)
                want += [(-s, j)] if s > 0 else []
        mine = sorted(got.get(i, []))
        assert [j for _, j in mine] == [j for _, j in sorted(want)[:20]]
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in sorted(want)[:20]], abs=1.1e-6)
