"""Time: edges and patterns between events, sessions, activation rates, co-occurrence, log replay and retention."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.counting import counted, neighbour, running, stored
from ..sources.records import table

WEEK, GAP, NEAR, CUTOFF, DAY = 7 * 86400, 1800, 300, 1705276800, 86400000000  # CUTOFF: 2024-01-15; DAY in microseconds
SHARE, HOT = 1 << 20, 1 << 21  # events times types of a user: what one task is given at a time, and from where a user is divided by day


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with all later ones of the same user within seven days: an equi-join on user and day, not a range join."""
    day = F.floor(F.col("us") / 86400000000).cast("bigint")
    e = _events(spark, sf_dir).select("user_id", "event_id", "us", day.alias("day"))
    right = e.select("user_id", F.explode(F.sequence(F.col("day") - 7, F.col("day"))).alias("day"), F.col("event_id").alias("effect"), F.col("us").alias("us2"))
    gap = F.col("us2") - F.col("us")
    return e.join(right, ["user_id", "day"]).where((gap > 0) & (gap <= WEEK * 1000000)).select(F.col("event_id").alias("cause"), "effect", gap.alias("gap_us"))


def _ends(e: DataFrame) -> DataFrame:
    """By user and pair of types, its causes and effects: event_id, us, value (of effects), support (effects of a cause), is_cause, is_effect.

    Each event is counted against each type that its user has, by events of that type within seven days after and before it; pairs
    are not listed, and a user's events are divided by day."""
    types = e.select("user_id", F.col("event_type").alias("type")).distinct()
    ask = lambda x, strict, sign, cause: F.struct(x.alias("x"), F.lit(strict).alias("strict"), F.lit(sign).alias("sign"), F.lit(cause).alias("is_cause"))
    us, week = F.col("us"), WEEK * 1000000
    asks = F.explode(F.array(ask(us + week, False, 1, 1), ask(us, False, -1, 1), ask(us, True, 1, 0), ask(us - week, True, -1, 0)))
    q = e.join(types, "user_id").select("user_id", "type", "event_id", "us", "value", F.col("event_type").alias("own"), asks.alias("q")).select("user_id", "type", "event_id", "us", F.when(F.col("q.is_cause") == 0, F.col("value")).alias("value"), "own", "q.*")
    c = counted(e.select("user_id", F.col("event_type").alias("type"), F.col("us").alias("x")), q, ["user_id", "type"], DAY)
    n = c.groupBy("user_id", "event_id", "us", "value", "own", "type", "is_cause").agg(F.sum(F.col("sign") * F.col("n")).alias("n")).where("n > 0")
    cause = F.col("is_cause") == 1
    return n.select("user_id", F.when(cause, F.col("own")).otherwise(F.col("type")).alias("cause_type"), F.when(cause, F.col("type")).otherwise(F.col("own")).alias("effect_type"), "event_id", "us", "value", (F.col("n") * F.col("is_cause")).alias("support"), "is_cause", (1 - F.col("is_cause")).alias("is_effect"))


def _divided(e: DataFrame) -> DataFrame:
    """What strength is made of, by user and pair of types, for users of any number of events: these are divided by day, so that a row for each event and type is shuffled."""
    keys = ["user_id", "cause_type", "effect_type"]
    t = _ends(e)
    strict = F.lit(True).alias("strict")
    later = counted(t.where("is_cause = 1").select(*keys, F.col("us").alias("x")), t.where("is_effect = 1").select(*keys, F.col("us").alias("x"), strict), keys, 3600000000).groupBy(*keys).agg(F.sum("n").alias("later"))
    ids = [F.count_distinct(F.when(F.col(c) == 1, F.col("event_id"))).alias(c) for c in ("is_cause", "is_effect")]
    return t.groupBy(*keys).agg(F.sum("support").alias("support"), *ids, F.count("value").alias("nv"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")).join(later, keys)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, -1 for null; and these."""
    d = column.combine_chunks().dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _pairs_of_types(t: pa.Table) -> pa.Table:
    """The same as _divided over all events of some users.  Times count by their place among the distinct ones, so that a user's number and a time are one number to search for."""
    user, users = _codes(t["user_id"])
    own, types = _codes(t["event_type"])
    ident, known = _codes(t["event_id"])
    us = t["us"].to_numpy()
    value, valued = t["value"].to_numpy().astype(float) + 0.0, ~t["value"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    times, at = np.unique(us, return_inverse=True)
    width, kinds = times.size + 1, len(types)
    base = user * width
    till, since = (np.searchsorted(times, us + s * WEEK * 1000000, side) for s, side in ((1, "right"), (-1, "left")))
    # a repeated event counts once as an end, and as an effect once for each value
    pair = lambda a, b: np.unique(a * (b.max(initial=0) + 2) + b + 1, return_inverse=True)[1]
    code = pair(pair(user * kinds + own, at), ident)
    worth = np.where(valued, np.unique(value, return_inverse=True)[1], -1)
    once = [np.zeros(us.size, bool), np.zeros(us.size, bool)]
    for mark, c in zip(once, (code, pair(code, worth)), strict=True):
        mark[np.unique(c, return_index=True)[1]] = True
    causes, effects = [], []
    for k in range(kinds):
        there = np.sort((base + at)[own == k])
        upto = lambda x: np.searchsorted(there, base + x)  # noqa: E731, B023
        n = upto(till) - upto(at + 1)
        row = np.flatnonzero(n)
        causes.append(((user[row] * kinds + own[row]) * kinds + k, row, n[row]))
        row = np.flatnonzero(upto(at) - upto(since))
        effects.append(((user[row] * kinds + k) * kinds + own[row], row))
    cp, crow, n = (np.concatenate(x) for x in zip(*causes, strict=True))
    fp, frow = (np.concatenate(x) for x in zip(*effects, strict=True))
    patterns, cp = np.unique(cp, return_inverse=True)
    fp = np.searchsorted(patterns, fp)
    total = lambda p, w=None: np.bincount(p, w, patterns.size)

    def distinct(p, row):
        named = ident[row] >= 0
        return total(np.unique(p[named] * (len(known) + 1) + ident[row[named]]) // (len(known) + 1))

    ids = distinct(cp, crow), distinct(fp, frow)
    support = total(cp, n).astype(np.int64)
    cp, crow = cp[once[0][crow]], crow[once[0][crow]]
    fp, frow = fp[once[1][frow]], frow[once[1][frow]]
    before = np.sort(cp * width + at[crow])
    later = total(fp, np.searchsorted(before, fp * width + at[frow]) - np.searchsorted(before, fp * width)).astype(np.int64)
    fp, v = fp[valued[frow]], value[frow[valued[frow]]]
    nv = total(fp)
    with np.errstate(invalid="ignore"):
        mean = total(fp, v) / np.maximum(nv, 1)
        variance = total(fp, (v - mean[fp]) ** 2) / np.maximum(nv, 1)
    who, cause, effect = patterns // kinds**2, patterns // kinds % kinds, patterns % kinds
    return pa.table({"user_id": users.take(pa.array(who)), "cause_type": types.take(pa.array(cause)), "effect_type": types.take(pa.array(effect)), "support": support, "is_cause": ids[0], "is_effect": ids[1], "nv": nv, "mean": mean, "variance": variance, "later": later})


def _evidence(e: DataFrame) -> DataFrame:
    """What strength is made of, by user and pair of types.  Events go to a task by user, SHARE of events times types at a time, and only the result leaves it; users beyond HOT are divided by day."""
    e = e.where("user_id is not null and us is not null and event_type is not null").withColumn("value", F.col("value").cast("double"))
    size = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg((F.sum("n") * F.count(F.lit(1))).alias("size"))
    hot = stored(size.where(F.col("size") > HOT).select("user_id")) if (most := size.agg(F.sum("size"), F.max("size")).first())[1] and most[1] > HOT else None
    few = e if hot is None else e.join(hot, "user_id", "left_anti")
    share = F.pmod(F.xxhash64("user_id"), F.lit(max(e.sparkSession.sparkContext.defaultParallelism, -(-int(most[0] or 0) // SHARE))))
    kind = e.schema["user_id"].dataType.simpleString()
    g = few.groupBy(share).applyInArrow(_pairs_of_types, f"user_id {kind}, cause_type string, effect_type string, support bigint, is_cause bigint, is_effect bigint, nv bigint, mean double, variance double, later bigint")
    return g if hot is None else g.unionByName(_divided(e.join(hot, "user_id", "left_semi")))


def _six(x):
    """x to six places as SQL does it, by the scaled double; Spark's own round takes the decimal digits, and ties come out otherwise."""
    return F.round(x * 1e6) / 1e6


def causal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user (the namespace of the pattern) and pair of types: support, transition lift against the effect's share of the user's events (at most 5, in fifths), and strength: 0.35 lift, 0.30 temporal
    consistency (share of later effects among all pairs of a cause and an effect), 0.20 outcome stability (1 - coefficient of variation
    of the effects' values, 0.5 for fewer than two or a mean not above 0) and 0.15 log of the support, full at 20."""
    keys = ["user_id", "cause_type", "effect_type"]
    g = _evidence(_events(spark, sf_dir))
    stable = F.when((F.col("nv") >= 2) & (F.col("mean") > 0), F.greatest(F.lit(0.0), 1 - F.sqrt("variance") / F.col("mean"))).otherwise(0.5)
    # multiplied first, as in the SQL: ties of the rounding hang on it; and, as there, infinite where no event has an id
    in_order = F.coalesce(F.try_divide(0.30 * F.col("later"), F.col("is_cause").cast("double") * F.col("is_effect")), F.lit(float("inf")))
    total = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    lift = F.least(F.try_divide(F.try_divide("support", "is_cause"), F.col("is_effect") / F.col("total")), F.lit(5.0)) / 5
    full = 0.35 * F.col("lift") + in_order + 0.20 * stable + 0.15 * F.least(F.log(1.0 + F.col("support")) / F.log(F.lit(21.0)), F.lit(1.0))
    return g.join(total, "user_id").withColumn("lift", lift).select(*keys, "support", _six(F.col("lift")).alias("lift"), _six(F.when(F.col("support") < 2, 0.3 * F.col("lift")).otherwise(full)).alias("strength"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a gap of half an hour."""
    e = neighbour(_events(spark, sf_dir).select("user_id", "us", "event_id"), ["user_id"], "us", "event_id", DAY)
    e = e.withColumn("new", F.coalesce((F.col("us") - F.col("near.x") > GAP * 1000000).cast("int"), F.lit(0)))
    e = running(e, ["user_id"], "us", "event_id", DAY, "new")
    return e.groupBy("user_id", F.col("upto").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def activation_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average of a user's rate of events, 0.3 x min(1 / gap in days, 100) + 0.7 x the former, as the sum of 0.3 x 0.7 ** later events x rate; and the
    strength of a record so activated, which began at 0.1 and got 0.2 each time, 1 at most."""
    e = neighbour(_events(spark, sf_dir).select("user_id", "us", "event_id"), ["user_id"], "us", "event_id", DAY)
    r = e.where("near is not null").withColumns({"rate": F.least(1 / F.greatest((F.col("us") - F.col("near.x")) / 86400e6, F.lit(0.001)), F.lit(100.0)), "one": F.lit(1)})
    r = running(r, ["user_id"], "us", "event_id", DAY, "one")
    r = r.join(r.groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("total")), F.col("user_id") == F.col("u"))
    return r.groupBy("user_id").agg(F.round(F.sum(0.3 * F.pow(F.lit(0.7), F.col("total") - F.col("upto")) * F.col("rate")), 6).alias("velocity"), F.round(F.least(0.1 + 0.2 * (F.max("total") + 1), F.lit(1.0)), 6).alias("strength"), (F.max("total") + 1).alias("activations"))


def cooccurrence_300s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of types among a user's events at most 300 s apart: an equi-join on user and 300 s bucket, not a range join."""
    e = _events(spark, sf_dir).withColumn("b", F.floor(F.col("us") / (NEAR * 1000000)).cast("bigint"))
    right = e.select("user_id", F.explode(F.array("b", F.col("b") - 1)).alias("b"), F.col("us").alias("us2"), F.col("event_id").alias("id2"), F.col("event_type").alias("t2"))
    later = (F.col("us2") > F.col("us")) | ((F.col("us2") == F.col("us")) & (F.col("id2") > F.col("event_id")))
    p = e.join(right, ["user_id", "b"]).where(later & (F.col("us2") - F.col("us") <= NEAR * 1000000))
    return p.groupBy(F.least("event_type", "t2").alias("a"), F.greatest("event_type", "t2").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of each user's record: the last one counts, and where it is an error the record is gone."""
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("us", "event_id", "event_type", "value")).alias("x"))
    return last.where("x.event_type <> 'error'").select("user_id", "x.event_id", "x.event_type", "x.value")


def retention_keep_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user and type the newest three stay, and those not older than the cutoff."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("us"), F.desc("event_id"))
    return _events(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= 3) | (F.col("us") >= CUTOFF * 1000000)).select("event_id", "user_id", "event_type")


def layer_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type: users who stay, come and go from before the cutoff to after it."""
    e = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.max((F.col("us") < CUTOFF * 1000000).cast("int")).alias("old"), F.max((F.col("us") >= CUTOFF * 1000000).cast("int")).alias("new"))
    g = e.groupBy("event_type").agg(F.sum(F.col("old") * F.col("new")).alias("retained"), F.sum((1 - F.col("old")) * F.col("new")).alias("added"), F.sum(F.col("old") * (1 - F.col("new"))).alias("dropped"), F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "retained", "added", "dropped", F.round((F.col("added") + F.col("dropped")) / F.col("n"), 6).alias("churn"))


_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
_EDGE = f""", edge AS (SELECT a.user_id, a.event_id AS cause, b.event_id AS effect, a.event_type AS cause_type, b.event_type AS effect_type, b.us - a.us AS gap_us, a.us AS ta, b.us AS tb, b.value FROM e a JOIN e b ON a.user_id = b.user_id AND b.us > a.us AND b.us - a.us <= {WEEK}000000)"""
QUERIES = {f.__name__: f for f in (causal_edges, causal_strength, sessions, activation_velocity, cooccurrence_300s, log_replay, retention_keep_recent, layer_churn)}
ORACLE_SQL = {
    "causal_edges": _E + _EDGE + " SELECT cause, effect, gap_us FROM edge",
    "causal_strength": _E + _EDGE + """, g AS (SELECT user_id, cause_type, effect_type, count(*) AS support, count(DISTINCT cause) AS causes, count(DISTINCT effect) AS effects FROM edge GROUP BY 1, 2, 3),
ca AS (SELECT DISTINCT user_id, cause_type, effect_type, cause, ta FROM edge), ef AS (SELECT DISTINCT user_id, cause_type, effect_type, effect, tb, value FROM edge),
ends AS (SELECT user_id, cause_type, effect_type, ta AS t, 1 AS c, 0 AS f FROM ca UNION ALL SELECT user_id, cause_type, effect_type, tb, 0, 1 FROM ef),
o AS (SELECT user_id, cause_type, effect_type, sum(f * before) AS later FROM (SELECT user_id, cause_type, effect_type, f, coalesce(sum(c) OVER (PARTITION BY user_id, cause_type, effect_type ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ends) GROUP BY 1, 2, 3),
v AS (SELECT user_id, cause_type, effect_type, CASE WHEN count(value) >= 2 AND avg(value) > 0 THEN greatest(0e0, 1 - stddev_pop(value) / avg(value)) ELSE 0.5e0 END AS stable FROM ef GROUP BY 1, 2, 3),
l AS (SELECT *, least((support / causes) / (effects / (SELECT count(*) FROM e WHERE e.user_id = g.user_id)), 5) / 5 AS lift FROM g JOIN o USING (user_id, cause_type, effect_type) JOIN v USING (user_id, cause_type, effect_type))
SELECT user_id, cause_type, effect_type, support, round(lift, 6) AS lift, round(CASE WHEN support < 2 THEN 0.3e0 * lift ELSE 0.35e0 * lift + 0.3e0 * later / (CAST(causes AS DOUBLE) * effects) + 0.2e0 * stable + 0.15e0 * least(ln(1e0 + support) / ln(21e0), 1) END, 6) AS strength FROM l""",
    "sessions": _E + f""", f AS (SELECT *, CASE WHEN us - lag(us) OVER w > {GAP}000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM s GROUP BY 1, 2""",
    "activation_velocity": _E + """, l AS (SELECT user_id, us, event_id, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM e), r AS (SELECT *, least(1 / greatest((us - p) / 86400e6, 0.001e0), 100) AS rate FROM l WHERE p IS NOT NULL)
SELECT user_id, round(list_reduce(list_prepend(0e0, list(rate ORDER BY us, event_id)), lambda s, x: 0.7e0 * s + 0.3e0 * x), 6) AS velocity, round(least(0.1e0 + 0.2e0 * (count(*) + 1), 1), 6) AS strength, count(*) + 1 AS activations FROM r GROUP BY 1""",
    "cooccurrence_300s": _E + f""" SELECT least(x.event_type, y.event_type) AS a, greatest(x.event_type, y.event_type) AS b, count(*) AS n FROM e x JOIN e y ON x.user_id = y.user_id
AND (y.us > x.us OR (y.us = x.us AND y.event_id > x.event_id)) AND y.us - x.us <= {NEAR}000000 GROUP BY 1, 2""",
    "log_replay": _E + " SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM e) WHERE rn = 1 AND event_type <> 'error'",
    "retention_keep_recent": _E + f" SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) AS rn FROM e) WHERE rn <= 3 OR us >= {CUTOFF}000000",
    "layer_churn": _E + f""", k AS (SELECT event_type, user_id, max(CASE WHEN us < {CUTOFF}000000 THEN 1 ELSE 0 END) AS o, max(CASE WHEN us >= {CUTOFF}000000 THEN 1 ELSE 0 END) AS n FROM e GROUP BY 1, 2)
SELECT event_type, CAST(sum(o * n) AS BIGINT) AS retained, CAST(sum((1 - o) * n) AS BIGINT) AS added, CAST(sum(o * (1 - n)) AS BIGINT) AS dropped, round((sum((1 - o) * n) + sum(o * (1 - n))) / count(*), 6) AS churn FROM k GROUP BY 1""",
}
