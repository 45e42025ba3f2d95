"""What queries shuffle, and what one task or worker is given: figures that must not grow faster than the tables."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.functions import bits as B
from recordloom.functions import text as T
from recordloom.operators import causal, concepts, recall, texts


def _list(sc, none, halves):
    stages = sc.statusStore().stageList(none, False, False, halves, none)
    return [stages.apply(i) for i in range(stages.size())]


def shuffled(spark, df):
    """Rows of the result and the bytes that the shuffles up to it wrote."""
    sc = spark.sparkContext._jsc.sc()
    none = spark._jvm.java.util.ArrayList()
    halves = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        return sum(s.shuffleWriteBytes() for s in _list(sc, none, halves))

    before = so_far()
    rows = df().collect()
    return rows, so_far() - before


def events(spark, path, n, users):
    rng = np.random.default_rng(6)
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    rows = [(i if i % 11 else None, at(int(rng.integers(0, 20 * 86400)) // 600 * 600), int(rng.integers(0, users)), [None, "click", "view", "error", "login"][int(rng.integers(0, 60) ** 0.5) % 5], None if i % 13 == 0 else float(rng.integers(-1, 9)), "{}") for i in range(n)]
    rows += rows[: n // 10] + [(None, at(60), None, "view", 1.0, "{}"), (5, None, 1, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_causal_strength_shuffles_events_and_not_their_asks(spark, tmp_path):
    n = 4000
    rows, wrote = shuffled(spark, lambda: causal.causal_strength(spark, events(spark, tmp_path, n, 60)))
    assert len(rows) > 500 and wrote < 150 * n


@pytest.mark.parametrize("hot", [0, 900, 1 << 40])
def test_users_divided_by_day_and_others_come_out_as_in_sql(spark, tmp_path, monkeypatch, hot):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(causal, "HOT", hot)
    monkeypatch.setattr(causal, "SHARE", 500)
    d = events(spark, tmp_path, 1200, 8)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    want = sorted(con.execute(causal.ORACLE_SQL["causal_strength"]).fetchall())
    got = sorted(tuple(r) for r in causal.causal_strength(spark, d).select("user_id", "cause_type", "effect_type", "support", "lift", "strength").collect())
    assert len(got) > 50 and [r[:4] for r in got] == [r[:4] for r in want]
    assert max(abs(a - b) for x, y in zip(got, want, strict=True) for a, b in zip(x[4:], y[4:], strict=True)) <= 1e-6


TEXTS = ["", "a", "Ab", " the trend of the pattern ", "Größe und Maß, the END", *(f"word{i} of {i * 7919 % 1000} and the rest" for i in range(400)), "x" * 5000]


def test_arrays_go_back_to_the_jvm_in_parts():
    out = list(B._added("bits", B.bits, pa.int32())([pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array([f"text {i} of {i * 7919}" * 20 for i in range(8000)])], names=["id", "t"])]))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(8000))
    assert max(b.column(1).values[b.column(1).offsets[0].as_py() :].__len__() for b in out) <= B.PART + B.RANGE


def test_bits_in_pieces_are_the_same(monkeypatch):
    plain = lambda t: sorted({h * s % B.P % B.RANGE for n, k in B.PER_GRAM.items() for h in (int(x) for x in B.hashes(B.codes(t), n)) for s in B.SPREAD[:k]})
    want = [plain(t) for t in TEXTS]
    for piece in (7, 1 << 18):
        monkeypatch.setattr(B, "PIECE", piece)
        assert [B.bits(t).tolist() for t in TEXTS] == want


def test_bits_and_signatures_stay_in_the_worker(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (9999, None)], "id long, t string")
    asked = ["en src1 size2", "the trend of the pattern"]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    low = [t.strip(" ").lower() for t in TEXTS]
    hit = B.overlaps(df, F.col("t"), asked)
    own, q = [set(B.bits(t).tolist()) for t in low], [set(B.bits(t).tolist()) for t in asked]
    assert "Generate" not in plan(hit)
    assert {tuple(r) for r in hit.collect()} == {(i, j, len(a & b), len(a), len(b)) for i, a in enumerate(own) for j, b in enumerate(q) if a & b}
    n = B.united(df.where("id < 9999").select((F.col("id") % 3).cast("string").alias("key"), "t"), F.col("t"))
    got = {r.key: (r.n, r.total) for r in n.collect()}
    sets = {str(k): set().union(*(a for i, a in enumerate(own) if i % 3 == k)) for k in range(3)}
    assert got == {k: (len(x), sum(x)) for k, x in sets.items()}


def test_recall_does_not_list_bits(spark):
    plan = recall.bit_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_signatures_agree_as_in_plain_python(spark):
    a, b = B.permutations()
    sig = lambda t: [min((int(x) * int(s) + int(y)) % B.P for s in h) for x, y in zip(a, b, strict=True)] if (h := B.hashes(B.codes(t), 3)).size else None
    texts = [t.lower().replace(",", " ") for t in TEXTS[:60]] + ["the trend of the pattern again"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    asked = spark.createDataFrame([(0, "the trend of the pattern"), (1, "a"), (2, "word7 of the rest")], "query int, q string")
    want = {(i, j, sum(x == y for x, y in zip(s, z, strict=True)) / 128) for i, t in enumerate(texts) for j, z in ((0, sig("the trend of the pattern")), (2, sig("word7 of the rest"))) if (s := sig(t)) and any(x == y for x, y in zip(s, z, strict=True))}
    assert {tuple(r) for r in B.agreements(df, F.col("t"), asked, F.col("q")).collect()} == want


def test_text_bits_shuffle_texts_and_not_bits(spark, tmp_path):
    rng = np.random.default_rng(2)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 7)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(300)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, wrote = shuffled(spark, lambda: recall.text_bits(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert len(rows) == 300 and wrote < 4 * sum(map(len, texts))


@pytest.mark.parametrize("query", ["record_format", "preamble"])
def test_records_without_a_cause_and_hot_groups_are_no_single_task(spark, tmp_path, query):
    n = 1500  # all without a cause, of one namespace and level, and with long texts
    rng = np.random.default_rng(3)
    texts_ = [" ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60)) for _ in range(n)]
    spark.createDataFrame([(i * 20, t, "en", "s", len(t)) for i, t in enumerate(texts_)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sc = spark.sparkContext._jsc.sc()
    none, halves = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sc.listenerBus().waitUntilEmpty()
        known = {s.stageId() for s in _list(sc, none, halves)}
        texts.QUERIES[query](spark, str(tmp_path)).collect()
        sc.listenerBus().waitUntilEmpty()
        most = 0
        for s in _list(sc, none, halves):
            if s.stageId() not in known and s.status().toString() == "COMPLETE":
                tasks = sc.statusStore().taskList(s.stageId(), s.attemptId(), 1000)
                most = max(most, *(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().localBytesRead() for i in range(tasks.size())))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert most < 0.6 * sum(map(len, texts_))


@pytest.mark.parametrize("held", [3, 1 << 20])
def test_terms_are_counted_where_the_texts_are(spark, monkeypatch, held):
    monkeypatch.setattr(concepts, "HELD", held)
    said = ["The garden, the (garden) and\u00a0x", "«Größe» größe! ab\vcd ef a--b", "", None, "... --- 12 123 12³", "garden's -garden- THE\tof\x1cword"]
    rows = [(k, t) for k in ("a:fact", "b:trend") for t in (said if k == "a:fact" else said[::2])]
    df = spark.createDataFrame(rows, "key string, content string")
    out = list(concepts._counted_terms([pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([(t or "").lower().encode() for _, t in rows])], names=["key", "t"])]))
    mine = {}
    for b in out:
        for k, t, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            mine[k, t] = mine.get((k, t), 0) + n
    w = F.transform(F.filter(F.split(F.lower("content"), r"[ \t\n\f\r]+"), lambda x: F.octet_length(x) >= 3), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    plain = df.select("key", F.explode(F.array_distinct(F.filter(w, lambda x: (x != "") & ~x.isin(*concepts.STOP)))).alias("term")).groupBy("key", "term").count()
    want = {(r["key"], r["term"]): r["count"] for r in plain.collect()}
    assert mine == want and {(r.key, r.term): r.k for r in concepts.key_terms(df).collect()} == want


def test_vectors_are_shuffled_for_few_blocks():
    n = 700_000  # of 64 numbers: 171 blocks of BLOCK_ROWS before
    assert recall.blocks(n, 64 * n, 12) <= 22 and recall.blocks(0, 0, 12) == 1
    assert recall.blocks(50_000, 50_000 * 64, 12) == 7 and recall.blocks(2000, 2000 * 4096, 12) >= 4


def test_large_blocks_hold_few_scores_at_a_time(monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 6)).round(1)
    t = pa.table({"row": pa.array(range(300), pa.int64()), "id": pa.array(range(300), pa.int64()), "v": pa.array(v.tolist(), pa.list_(pa.float32()))})
    want = recall._block_pair(t, t).to_pydict()
    monkeypatch.setattr(recall, "TILE", 700)
    assert recall._block_pair(t, t).to_pydict() == want


def test_words_are_counted_as_by_the_column_expressions(spark):
    said = [*TEXTS[:9], "I love it, LOVE it always; my secret_key: critical!", "very very important  never\n\nhate 12", "дуже важливо, я люблю", "x\u00a0y\u0085z love\u00b2 born", " \t", "a a b", "critical danger, me"]
    df = spark.createDataFrame([*enumerate(said)], "id long, content string")
    c, w = F.col("content"), T.words(F.col("content"))
    plain = T.with_entropy(df, "content", "e").select("id", T.intensity(c, w).alias("x"), T.salience_legacy(c, w).alias("legacy"), T.safety_critical(w).alias("critical"), "e")
    want = {r.id: r for r in plain.collect()}
    for r in T.word_scores(df).collect():
        p = want[r.id]
        assert (r.x, r.legacy, r.critical) == (p.x, p.legacy, p.critical) and r.e == pytest.approx(p.e, abs=1e-12), r
