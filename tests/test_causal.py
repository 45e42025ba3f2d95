"""Causal edges and patterns against plain Python over all pairs of a user's events."""

import datetime as dt
from collections import defaultdict
from math import log

import numpy as np
import pytest

from recordloom.operators import causal

WEEK = 7 * 86400


def table(spark, tmp_path, rows):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    spark.createDataFrame([(i, at(s), u, t, v, "{}") for i, (s, u, t, v) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def some():
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 30 * 86400)), int(rng.integers(0, 3)), str(rng.choice(["click", "view", "error"])), float(rng.random() * 9)) for _ in range(150)]
    rows += [(86400, 7, "view", 1.0)] * 30 + [(86400 + WEEK, 7, "click", 2.0), (86401 + WEEK, 7, "error", 2.0)]  # ties; the ends of the week
    return rows + [(i * 60, 8, "view", 3.0) for i in range(60)]  # a hot hour


def edges(rows):
    return {(i, j, (b[0] - a[0]) * 1000000) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] == b[1] and 0 < b[0] - a[0] <= WEEK}


def test_edges_are_all_pairs_of_the_week(spark, tmp_path):
    rows = some()
    got = [tuple(r) for r in causal.causal_edges(spark, table(spark, tmp_path, rows)).select("cause", "effect", "gap_us").collect()]
    assert len(got) == len(set(got)) and set(got) == edges(rows)


def patterns(rows):
    by = defaultdict(list)
    for i, j, _ in edges(rows):
        by[rows[i][1], rows[i][2], rows[j][2]].append((i, j))
    return by


def test_support_and_lift_count_all_pairs(spark, tmp_path):
    rows = some()
    got = {(r.user_id, r.cause_type, r.effect_type): (r.support, r.lift) for r in causal.causal_strength(spark, table(spark, tmp_path, rows)).collect()}
    by = patterns(rows)
    assert set(got) == set(by)
    for k, e in by.items():
        causes, effects = len({i for i, _ in e}), len({j for _, j in e})
        assert got[k] == (len(e), pytest.approx(min(len(e) / causes / (effects / sum(r[1] == k[0] for r in rows)), 5) / 5, abs=1e-6))


def test_strength_has_all_four_terms(spark, tmp_path):
    rows = [*some(), (5, 9, "signup", 4.0), (9, 9, "purchase", 5.0), (5, 10, "signup", 4.0), (9, 10, "login", 5.0), (12, 10, "login", 25.0)]
    got = {(r.user_id, r.cause_type, r.effect_type): r.strength for r in causal.causal_strength(spark, table(spark, tmp_path, rows)).collect()}
    by = patterns(rows)
    assert set(got) == set(by) and got[9, "signup", "purchase"] == pytest.approx(0.3 * 0.4)
    for k, e in by.items():
        causes, effects = {i for i, _ in e}, {j for _, j in e}
        lift = min(len(e) / len(causes) / (len(effects) / sum(r[1] == k[0] for r in rows)), 5) / 5
        order = np.mean([rows[j][0] > rows[i][0] for i in causes for j in effects])
        v = np.array([rows[j][3] for j in effects])
        stable = max(0.0, 1 - v.std() / v.mean()) if v.size > 1 else 0.5
        full = 0.35 * lift + 0.3 * order + 0.2 * stable + 0.15 * min(log(len(e) + 1) / log(21), 1)
        assert got[k] == pytest.approx(full if len(e) > 1 else 0.3 * lift, abs=2e-6), k


def by_sql(duckdb, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet/*.parquet')")
    return sorted(con.execute(causal.ORACLE_SQL["causal_strength"]).fetchall())


def test_ties_of_the_rounding_come_out_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(s, 0, t, -1.0) for s, t in enumerate(["view", "view", "click", "click"])]  # lift 0.5203125, the double scaled just below the tie
    rows += [(i * 864000 + s, 0, t, -1.0) for i in range(1, 15) for s, t in enumerate(["view", "click"])] + [(i * 864000, 0, "login", -1.0) for i in range(15, 20)]
    for u, later in enumerate((73, 83, 97, 103, 107, 117, 133, 137, 147, 157, 173), 1):  # pairs in order of 12 x 16: strengths end in a 5 at the seventh place
        after = [16] + [(later - 16) // 11 + (i < (later - 16) % 11) for i in range(11)]
        rows += [(10 * i, u, "click", -1.0) for i in range(16)] + [(10 * (16 - k) - 5, u, "view", -1.0) for k in after]
    got = sorted(tuple(r) for r in causal.causal_strength(spark, table(spark, tmp_path, rows)).select("user_id", "cause_type", "effect_type", "support", "lift", "strength").collect())
    assert got == by_sql(duckdb, tmp_path)
    assert {(r[0], r[4]) for r in got if r[1:3] == ("view", "click")} == {(0, 0.520312)} | {(u, 1.0) for u in range(1, 12)}


def test_repeated_and_missing_ids_come_out_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    rows = [(None if i % 7 == 0 else i // 2, at(s), u, t, v, "{}") for i, (s, u, t, v) in enumerate(some())]
    rows += [(i, at(s), u, t, v + 1, "{}") for i, (s, u, t, v) in enumerate(some()[:40])] + rows[:20]  # an id with two values; whole rows twice
    rows += [(None, at(s), 11, t, 2.0, "{}") for s, t in enumerate(["view", "click", "click", "error"])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = causal.causal_strength(spark, str(tmp_path)).select("user_id", "cause_type", "effect_type", "support", "lift", "strength").collect()
    assert sorted(tuple(r) for r in got) == by_sql(duckdb, tmp_path)
