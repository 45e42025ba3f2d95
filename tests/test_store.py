"""The record store, backups, versions and streams on small tables."""

import pytest

from recordloom.operators import recall, texts
from recordloom.sources.store import DELETE, UPDATE, Backups, RecordStore, Versions, ancestors, checksum, replay
from recordloom.streaming import records as stream


def rows(df):
    return {r.id: r.payload for r in df.collect()}


def make(spark, pairs):
    return spark.createDataFrame(pairs, "id long, payload string")


def test_store_log_snapshot_and_compaction(spark, tmp_path):
    s = RecordStore(spark, str(tmp_path / "s"))
    assert rows(s.scan()) == {}
    s.append(make(spark, [(1, "a"), (2, "b"), (3, None)]))
    s.append(make(spark, [(2, "B")]), UPDATE)
    s.append(spark.createDataFrame([(1,)], "id long"), DELETE)
    want = {2: "B", 3: None}
    assert rows(s.scan()) == want and rows(s.get(2)) == {2: "B"} and rows(s.get(1)) == {}
    s.save()
    s.append(make(spark, [(4, "d")]))
    assert rows(s.scan()) == {**want, 4: "d"}
    s.compact()
    assert s.log().count() == 0 and rows(s.scan()) == {**want, 4: "d"}
    s.append(make(spark, [(5, "e")]))
    assert rows(s.scan()) == {**want, 4: "d", 5: "e"}


def test_a_torn_entry_ends_the_log(spark):
    log = spark.createDataFrame([(0, "store", 1, "a"), (1, "store", 2, "b"), (2, "store", 3, "c")], "seq long, op string, id long, payload string").withColumn("crc", checksum(__import__("pyspark").sql.functions.col("payload")))
    bad = log.selectExpr("seq", "op", "id", "payload", "crc + if(seq = 1, 1, 0) crc")
    assert rows(replay(make(spark, [(9, "z")]), log, -1)) == {9: "z", 1: "a", 2: "b", 3: "c"}
    assert rows(replay(make(spark, [(9, "z")]), bad, -1)) == {9: "z", 1: "a"}
    assert rows(replay(make(spark, [(9, "z")]), log, 1)) == {9: "z", 3: "c"}


def test_backups(spark, tmp_path):
    b = Backups(spark, str(tmp_path / "b"))
    df = spark.createDataFrame([(i, i * 10) for i in range(20)], "seq long, x long")
    b.create(df.where("seq < 15"), "one")
    b.create(df, "two", since=14)
    assert b.verify("one") and b.restore("one", "two").count() == 20 and {r.name: r.n for r in b.list().collect()} == {"one": 15, "two": 5}
    spark.range(3).selectExpr("id seq", "id x").write.mode("append").parquet(f"{tmp_path}/b/one/data")
    assert not b.verify("one")
    with pytest.raises(ValueError):
        b.restore("one")


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    one, two = v.create(spark.range(3), "first"), v.create(spark.range(4), "second")
    v.branch("side")
    v.checkout("side")
    three = v.create(spark.range(5), "third")
    assert v.history() == [three, two, one] and v.load(two).count() == 4
    v.checkout("main")
    assert v.history() == [two, one] and v.gc() == 0
    v.tag(one, "release")
    with pytest.raises(ValueError):
        v.checkout("nowhere")


def test_ancestors_of_a_long_history(spark):
    p = spark.createDataFrame([(i, i - 1 if i else None) for i in range(200)] + [(500, 501), (501, 500)], "id long, parent long")
    got = {r.id for r in ancestors(p, spark.createDataFrame([(150,), (501,)], "id long")).collect()}
    assert got == set(range(151)) | {500, 501}


def test_upserts_of_a_stream(spark, tmp_path):
    make(spark, [(1, "a"), (2, "b")]).write.parquet(str(tmp_path / "in"))
    seen, s = [], RecordStore(spark, str(tmp_path / "s"))
    q = stream.upsert(spark.readStream.schema("id long, payload string").parquet(str(tmp_path / "in")), s, str(tmp_path / "cp"), after=lambda df, n: seen.append(df.count()), once=True)
    q.awaitTermination(60)
    assert rows(s.scan()) == {1: "a", 2: "b"} and seen == [2]


def test_experience_of_a_table(spark):
    t = spark.createDataFrame([(1, 0, "user", "I will never do this thing."), (1, 1, "assistant", "I will fix it by friday. Perhaps it is slow, but it works fine. The sky is blue today! Too short.")], "conv_id long, turn long, role string, text string")
    assert [(r.kind, r.certainty, r.deadline) for r in stream.experience(t).collect()] == [("commitment", "asserted", "by friday"), ("uncertainty", "hedged", None), ("claim", "asserted", "today")]


def plain_chunks(text):
    if len(text.encode()) <= 1000:
        return [text]
    out, now = [], ""
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            if len(now.encode()) > 100:
                out, now = [*out, now], ""
            continue
        if len(now.encode()) + len(line.encode()) > 1000:
            out, now = [*out, now], ""
        now = f"{now}\n{line}" if now else line
    out += [now] if now else []
    return out if len(out) > 1 else [text]


def test_chunks(spark):
    cases = ["short", "w" * 1500, "\n".join("x" * n for n in (300, 400, 500, 20, 0, 90, 0, 200, 1200)), "é" * 400 + "\n\n" + "b" * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", texts.chunks(df["t"]).alias("c")).collect()}
    assert got == {i: [c for c in plain_chunks(t)] for i, t in enumerate(cases)}


def test_no_record_moves_more_than_two_places(spark):
    base = spark.createDataFrame([(0, i, 1 - i * 0.001, i) for i in range(10)], "query int, id long, score double, pos int")
    up = spark.createDataFrame([(9, 1.2), (0, 0.5)], "id long, multiplier double")
    got = {r.id: (r.pos, r.score) for r in recall.overlays(base, up, 0.05).collect()}
    assert all(abs(p - i) <= 2 for i, (p, _) in got.items()) and got[9][1] == pytest.approx(0.991 * 1.05) and got[0][1] == pytest.approx(0.95)
    assert {r.id: r.pos for r in recall.overlays(base.where("id < 3"), up, 0.05).collect()} == {0: 0, 1: 1, 2: 2}


def test_corpus_fingerprint_follows_causes_not_order(spark, tmp_path):
    from recordloom.operators.health import corpus_fingerprint

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def of(name, d):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return tuple(corpus_fingerprint(spark, f"{tmp_path}/{name}").first())

    same = of("a", docs)
    assert of("b", docs.orderBy("text").repartition(3)) == same
    assert of("c", docs.selectExpr("* except (text)", "concat(text, 'x') as text")) == same
    other = of("d", docs.selectExpr("* except (source)", "case when doc_id = 7 then 'elsewhere' else source end as source"))
    assert other[:2] == same[:2] and other[2:] != same[2:]
    assert of("e", docs.limit(0)) == (0, 0, 0, 0)
