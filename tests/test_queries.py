"""Every registered query against its SQL on the smallest tables, and edge cases of the scores."""

import datetime as dt
import math
import os

import pytest

from recordloom import registry
from recordloom.functions import scalars as S
from recordloom.operators import recall
from recordloom.streaming.sessions import session_counts

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


# unions and further views of queries that are here themselves
VIEWS = {"insight_union", "maintenance_run", "recall_trace", "belief_shadow", "recall_text", "recall_activation", "explain_records"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - VIEWS))
def test_like_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = rows(df.collect(), df.columns), rows(got.fetchall(), names)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(x == y or (isinstance(x, (int, float)) and y is not None and abs(float(x) - float(y)) < 1e-4) for x, y in zip(a, b, strict=True)), (a, b)


def test_jaccard_of_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.jaccard(df["a"], df["b"])).collect()] == [0.0, 0.0, 1 / 3]


def test_liveness_and_promotion_bounds(spark):
    df = spark.createDataFrame([(0.05, 5, 3), (0.049, 5, 4), (0.7, 4, 1), (0.7, 5, 3)], "strength double, activation_count long, level int")
    assert [tuple(r) for r in df.select(S.alive(), S.promotable()).collect()] == [(True, False), (False, False), (True, False), (True, True)]


def test_fusion_of_two_lists(spark):
    s = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 1, 0)], "query int, id long, rank int")
    assert {r.id: r.fused for r in recall.fuse(s, 2).collect()} == {1: 1.0, 2: round((1 / 62) / (2 / 61), 9)}


def test_sessions_of_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    events = [(1, at(0)), (1, at(20)), (1, at(60)), (2, at(5)), (3, at(600))]
    df = spark.createDataFrame(events, "user_id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    want = {(1, 2), (1, 1), (2, 1), (3, 1)}
    assert {(r.user_id, r.n) for r in session_counts(df).collect()} == want
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = session_counts(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.n) for r in spark.table("sessions_out").collect()} == want - {(3, 1)}  # still open behind the watermark


def test_queries_without_sql_are_few_and_named():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"text_chunks", "overlay_rerank"}  # held against plain versions in test_store.py


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())
