"""Detectors over records and their links: one row for each record, pair or class of an insight; and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.records import CONNECTIONS_SQL, LINKS_SQL, NOW, RECORDS_SQL, connections, links, records

DAY = 86400.0
CHAIN = 10


def _age() -> Column:
    """Days since the last activation."""
    return (F.lit(NOW) - F.col("last_activated")) / DAY


def _tagged(r: DataFrame) -> DataFrame:
    return r.select("id", "level", "namespace", F.explode(F.array_distinct("tags")).alias("tag"))


def insight_decay(spark, sf_dir):
    """Records about to go."""
    return records(spark, sf_dir).where("strength >= 0.05 and strength < 0.15").select("id", "namespace", "strength")


def insight_promotion(spark, sf_dir):
    return records(spark, sf_dir).where(S.promotable()).select("id", "namespace", "level")


def insight_clusters(spark, sf_dir):
    """Each record of a tag with three or more records, and the tag's size: counts are summed first and joined back, so no tag is one task's."""
    t = _tagged(records(spark, sf_dir)).select("tag", "id")
    return t.join(t.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"), "tag").select("tag", "id", "n")


def insight_level_conflict(spark, sf_dir):
    """Records of a tag that has both working and identity records; and live records that are contradictions."""
    r = records(spark, sf_dir)
    t = _tagged(r)
    both = t.groupBy("tag").agg(F.max((F.col("level") == 1).cast("int")).alias("low"), F.max((F.col("level") == 4).cast("int")).alias("high")).where("low = 1 and high = 1").select("tag")
    marked = r.where(S.alive() & (F.col("semantic_type") == "contradiction")).select(F.lit("semantic_type").alias("signal"), F.lit(None).cast("string").alias("tag"), "id")
    return t.join(both, "tag").select(F.lit("level_mismatch").alias("signal"), "tag", "id").unionByName(marked)


def insight_stale(spark, sf_dir):
    return records(spark, sf_dir).where(S.alive() & (_age() >= 14)).select("id", "namespace", F.round(_age(), 6).alias("days"))


def insight_hot(spark, sf_dir):
    return records(spark, sf_dir).where((F.col("activation_count") >= 3) & (_age() < 1)).select("id", "activation_count", F.round(_age(), 6).alias("days"))


def insight_trending(spark, sf_dir):
    return records(spark, sf_dir).where(S.alive() & (F.col("velocity") >= 2.0) & (_age() < 3)).select("id", "velocity", "namespace")


def insight_preferences(spark, sf_dir):
    """Live preferences whose first tag has two or more."""
    r = records(spark, sf_dir).where(S.alive() & (F.col("semantic_type") == "preference")).select(F.coalesce(F.get("tags", F.lit(0)), F.lit("general")).alias("tag"), "id")
    return r.join(r.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "tag").select("tag", "id", "n")


def insight_hubs(spark, sf_dir):
    return links(spark, sf_dir).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 6).alias("weight")).where("degree >= 10")


def insight_coactivation(spark, sf_dir):
    return connections(spark, sf_dir).where("weight >= 0.5 and a < b").select("a", "b", F.round("weight", 6).alias("weight"))


def insight_chains(spark, sf_dir):
    """From each root, a record without a cause that others name as theirs, on to a child (the one with the smallest id) and so forth, ten steps at most."""
    r = records(spark, sf_dir)
    child = r.where("caused_by is not null and caused_by <> id").groupBy(F.col("caused_by").alias("parent")).agg(F.min("id").alias("child"))
    step = r.where("caused_by is null").select("id").join(child, F.col("id") == F.col("parent")).select(F.col("id").alias("root"), F.lit(1).alias("step"), F.col("child").alias("at"))
    out = step
    for n in range(2, CHAIN + 1):
        step = step.join(child, F.col("at") == F.col("parent")).select("root", F.lit(n).alias("step"), F.col("child").alias("at"))
        out = out.unionByName(step)
    return out.select("root", F.col("step").cast("bigint").alias("step"), F.col("at").alias("id"))


def _ends(spark, sf_dir) -> DataFrame:
    """Live and important records with their tags: what an end of a link must be."""
    r = records(spark, sf_dir)
    degree = connections(spark, sf_dir).groupBy("a").agg(F.countDistinct("b").alias("degree"))
    r = r.join(degree, F.col("id") == F.col("a"), "left").where(S.alive() & (S.importance(F.coalesce("degree", F.lit(0))) >= 0.3))
    return r.select("id", "namespace", "tags")


def insight_serendipity(spark, sf_dir):
    """Strong links, not causal ones, within a namespace between records with few common tags."""
    e = connections(spark, sf_dir).where("weight >= 0.6 and kind <> 'causal' and a < b").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    x = _ends(spark, sf_dir)
    left, right = (x.select(F.col("id").alias(s), F.col("namespace").alias(f"ns_{s}"), F.col("tags").alias(f"t_{s}")) for s in "ab")
    j = e.join(left, "a").join(right, "b").where("ns_a = ns_b")
    same = F.when((F.size("t_a") == 0) & (F.size("t_b") == 0), 1.0).otherwise(S.jaccard(F.col("t_a"), F.col("t_b")))
    return j.withColumn("jaccard", same).where("jaccard < 0.2").select("a", "b", F.round("weight", 6).alias("weight"), F.round("jaccard", 6).alias("jaccard"))


def insight_gaps(spark, sf_dir):
    """For each tag with three or more live records, how many other such tags share no record with it and at most one link: all clusters less those related to it, so that pairs needn't be listed."""
    t = _tagged(records(spark, sf_dir).where(S.alive())).select("tag", "id")
    big = t.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    own = t.join(big.select("tag"), "tag")
    other = own.select(F.col("tag").alias("tag2"), F.col("id").alias("id2"))
    shared = own.join(other, F.col("id") == F.col("id2")).where("tag <> tag2").select("tag", "tag2").distinct()
    e = connections(spark, sf_dir).select("a", "b").distinct()
    bridged = e.join(own, F.col("a") == F.col("id")).select("tag", "b").join(other, F.col("b") == F.col("id2")).where("tag <> tag2").groupBy("tag", "tag2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tag", "tag2")
    related = shared.unionByName(bridged).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("related"))
    total = big.agg(F.count(F.lit(1)).alias("total"))
    return big.join(related, "tag", "left").crossJoin(F.broadcast(total)).select("tag", "n", (F.col("total") - 1 - F.coalesce("related", F.lit(0))).alias("gaps"))  # the broadcast has one row


def insight_decisions(spark, sf_dir):
    """Live decisions of a namespace with a tag Jaccard of 0.3 or more, as pairs of classes: records with the same tags are one class.  n_pairs counts the pairs of records."""
    r = records(spark, sf_dir).where(S.alive() & (F.col("semantic_type") == "decision"))
    c = r.groupBy("namespace", F.array_sort(F.array_distinct("tags")).alias("tags")).agg(F.count(F.lit(1)).alias("n"))
    inside = c.select("namespace", F.col("tags").alias("a"), F.col("tags").alias("b"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"), F.lit(1.0).alias("jaccard"))
    x = c.select("namespace", "tags", "n", F.explode("tags").alias("tag"))
    y = x.select(F.col("namespace").alias("ns2"), F.col("tags").alias("b"), F.col("n").alias("n2"), F.col("tag").alias("tag2"))
    common = x.join(y, (F.col("namespace") == F.col("ns2")) & (F.col("tag") == F.col("tag2"))).where("tags < b").groupBy("namespace", F.col("tags").alias("a"), "b").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    across = common.select("namespace", "a", "b", (F.col("n") * F.col("n2")).alias("n_pairs"), (F.col("k") / (F.size("a") + F.size("b") - F.col("k"))).alias("jaccard"))
    out = inside.unionByName(across).where("n_pairs > 0 and jaccard >= 0.3")
    return out.select("namespace", F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"), "n_pairs", F.round("jaccard", 6).alias("jaccard"))


DETECTORS = {
    "decay_risks": (insight_decay, "high", 0), "promotion_candidates": (insight_promotion, "medium", 0), "cluster": (insight_clusters, "low", 1), "conflict": (insight_level_conflict, "high", 1), "stale_topics": (insight_stale, "low", 1),
    "hot_topics": (insight_hot, "low", 1), "coactivation_momentum": (insight_coactivation, "low", 1), "graph_hubs": (insight_hubs, "medium", 1), "causal_chain": (insight_chains, "low", 1), "serendipity": (insight_serendipity, "medium", 2),
    "trending": (insight_trending, "medium", 2), "knowledge_gap": (insight_gaps, "low", 2), "preference_pattern": (insight_preferences, "medium", 2), "decision_conflict": (insight_decisions, "high", 2),
}


def insight_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen detectors: their rows, severity and phase."""
    one = lambda name, f, severity, phase: f(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("insight"), F.lit(severity).alias("severity"), F.lit(phase).cast("bigint").alias("phase"), "n")
    return reduce(DataFrame.unionByName, [one(name, *d) for name, d in DETECTORS.items()])


_R = f"WITH {RECORDS_SQL} "
_RC = f"WITH {RECORDS_SQL}, {CONNECTIONS_SQL} "
_AGE = f"(({NOW}e0 - last_activated) / 86400e0)"
_TAGS = "t AS (SELECT DISTINCT id, level, unnest(tags) AS tag FROM records)"
_LIVE = "t AS (SELECT DISTINCT id, unnest(tags) AS tag FROM records WHERE strength >= 0.05), big AS (SELECT tag, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 3)"
QUERIES = {f.__name__: f for f in (insight_decay, insight_promotion, insight_clusters, insight_level_conflict, insight_stale, insight_hot, insight_trending, insight_preferences, insight_hubs, insight_coactivation, insight_chains, insight_serendipity, insight_gaps, insight_decisions, insight_union)}
_BODY = {
    "insight_decay": ("", "SELECT id, namespace, strength FROM records WHERE strength >= 0.05 AND strength < 0.15"),
    "insight_promotion": ("", "SELECT id, namespace, level FROM records WHERE activation_count >= 5 AND strength >= 0.7 AND level < 4"),
    "insight_clusters": (f", {_TAGS}", "SELECT tag, id, n FROM t JOIN (SELECT tag, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 3) USING (tag)"),
    "insight_level_conflict": (f", {_TAGS}", "SELECT 'level_mismatch' AS signal, tag, id FROM t WHERE tag IN (SELECT tag FROM t WHERE level = 1 INTERSECT SELECT tag FROM t WHERE level = 4) UNION ALL SELECT 'semantic_type', NULL, id FROM records WHERE strength >= 0.05 AND semantic_type = 'contradiction'"),
    "insight_stale": ("", f"SELECT id, namespace, round({_AGE}, 6) AS days FROM records WHERE strength >= 0.05 AND {_AGE} >= 14"),
    "insight_hot": ("", f"SELECT id, activation_count, round({_AGE}, 6) AS days FROM records WHERE activation_count >= 3 AND {_AGE} < 1"),
    "insight_trending": ("", f"SELECT id, velocity, namespace FROM records WHERE strength >= 0.05 AND velocity >= 2 AND {_AGE} < 3"),
    "insight_preferences": (", p AS (SELECT coalesce(tags[1], 'general') AS tag, id FROM records WHERE strength >= 0.05 AND semantic_type = 'preference')", "SELECT tag, id, n FROM p JOIN (SELECT tag, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 2) USING (tag)"),
    "insight_hubs": (f", {LINKS_SQL}", "SELECT a AS node, count(*) AS degree, round(sum(weight), 6) AS weight FROM links GROUP BY 1 HAVING count(*) >= 10"),
    "insight_coactivation": (f", {CONNECTIONS_SQL}", "SELECT a, b, round(weight, 6) AS weight FROM connections WHERE weight >= 0.5 AND a < b"),
    "insight_chains": (f", child AS (SELECT caused_by AS parent, min(id) AS child FROM records WHERE caused_by <> id GROUP BY 1), chain AS (SELECT r.id AS root, 1 AS step, c.child AS cur FROM records r JOIN child c ON r.id = c.parent WHERE r.caused_by IS NULL UNION ALL SELECT root, step + 1, c.child FROM chain JOIN child c ON cur = c.parent WHERE step < {CHAIN})", "SELECT root, CAST(step AS BIGINT) AS step, cur AS id FROM chain"),
    "insight_serendipity": (f", {CONNECTIONS_SQL}, ends AS (SELECT id, namespace, tags FROM records LEFT JOIN (SELECT a, count(DISTINCT b) AS degree FROM connections GROUP BY 1) ON a = id WHERE strength >= 0.05 AND 0.4e0 * strength + 0.25e0 * level / 4 + 0.2e0 * least(coalesce(degree, 0) / 50, 1) + 0.15e0 * least(activation_count / 20, 1) + 0.1e0 * salience >= 0.3),"
        " e AS (SELECT a, b, max(weight) AS weight FROM connections WHERE weight >= 0.6 AND kind <> 'causal' AND a < b GROUP BY 1, 2),"
        " j AS (SELECT e.*, CASE WHEN len(x.tags) + len(y.tags) = 0 THEN 1e0 ELSE len(list_intersect(x.tags, y.tags)) / len(list_distinct(list_concat(x.tags, y.tags))) END AS jaccard FROM e JOIN ends x ON x.id = a JOIN ends y ON y.id = b AND x.namespace = y.namespace)", "SELECT a, b, round(weight, 6) AS weight, round(jaccard, 6) AS jaccard FROM j WHERE jaccard < 0.2"),
    "insight_gaps": (f", {CONNECTIONS_SQL}, {_LIVE}, own AS (SELECT * FROM t WHERE tag IN (SELECT tag FROM big)), e AS (SELECT DISTINCT a, b FROM connections),"
        " rel AS (SELECT x.tag AS a, y.tag AS b FROM own x JOIN own y ON x.id = y.id UNION SELECT x.tag, y.tag FROM e JOIN own x ON x.id = e.a JOIN own y ON y.id = e.b GROUP BY 1, 2 HAVING count(*) > 1)", "SELECT x.tag, x.n, count(*) AS gaps FROM big x LEFT JOIN big y ON NOT EXISTS (SELECT 1 FROM rel WHERE rel.a = x.tag AND rel.b = y.tag) AND x.tag <> y.tag WHERE y.tag IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT tag, n, 0 FROM big x WHERE NOT EXISTS (SELECT 1 FROM big y WHERE y.tag <> x.tag AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.a = x.tag AND rel.b = y.tag))"),
    "insight_decisions": (", d AS (SELECT id, namespace, list_sort(list_distinct(tags)) AS t FROM records WHERE strength >= 0.05 AND semantic_type = 'decision'), p AS (SELECT x.namespace, CASE WHEN x.t < y.t THEN x.t ELSE y.t END AS a, CASE WHEN x.t < y.t THEN y.t ELSE x.t END AS b FROM d x JOIN d y ON x.id < y.id AND x.namespace = y.namespace),"
        " c AS (SELECT namespace, a, b, count(*) AS n_pairs, CASE WHEN len(a) + len(b) = 0 THEN 1e0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM p GROUP BY 1, 2, 3)", "SELECT namespace, array_to_string(a, ',') AS a, array_to_string(b, ',') AS b, n_pairs, round(jaccard, 6) AS jaccard FROM c WHERE jaccard >= 0.3"),
}
ORACLE_SQL = {k: f"WITH RECURSIVE {RECORDS_SQL}{extra} {body}" for k, (extra, body) in _BODY.items()}
ORACLE_SQL["insight_union"] = " UNION ALL ".join(f"SELECT '{name}' AS insight, '{severity}' AS severity, CAST({phase} AS BIGINT) AS phase, count(*) AS n FROM ({ORACLE_SQL[f.__name__]})" for name, (f, severity, phase) in DETECTORS.items())
