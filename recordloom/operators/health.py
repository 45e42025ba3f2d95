"""Scores of a record as queries, and belief groups by namespace and type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.records import AUTHORITY, CONNECTIONS_SQL, NOW, RECORDS_SQL, connections, records
from .recall import _TRUST

DAY = 86400.0


def importance_decay(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("id", F.round(S.importance(F.size("tags")), 6).alias("importance"), F.round(S.decayed(), 6).alias("decayed"), S.alive().alias("alive"), S.promotable().alias("promotable"))


def effective_trust(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.round(S.trust(NOW, AUTHORITY), 6).alias("trust"))


def belief_groups(spark, sf_dir):
    """Hypotheses by namespace and semantic type, and by whether they support or oppose: mean confidence, masses, recency, consistency, score."""
    from .beliefs import hypotheses

    h = hypotheses(records(spark, sf_dir).withColumn("key", F.concat_ws(":", "namespace", "semantic_type")))
    return h.select("namespace", "semantic_type", "stance", "n", F.round("conf", 6).alias("confidence"), "support", "conflict", F.round("recency", 6).alias("recency"), F.round("consistency", 6).alias("consistency"), F.round("score", 6).alias("score"))


def corpus_fingerprint(spark, sf_dir):
    """Two 48-bit sums of hashes over all records (id, namespace, creation, cause) and their causal links: equal sums mean that nothing causal changed, so a rebuild can be skipped.
    Sums need no order, so each task adds up its own rows and only the sums are shuffled.  An empty table has zeros."""
    text = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in c])
    r = records(spark, sf_dir).withColumn("us", (F.col("created_at") * 1000000).cast("bigint")).select(F.lit(1).alias("record"), F.md5(text("id", "namespace", "us", "caused_by")).alias("h"))
    e = connections(spark, sf_dir).where("kind = 'causal'").select(F.lit(0).alias("record"), F.md5(F.concat(F.lit("link|"), text("a", "b"))).alias("h"))
    part = lambda at: (F.coalesce(F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(20,0)")), F.lit(0)) % F.lit(1 << 48)).cast("bigint")
    return r.unionByName(e).agg(F.coalesce(F.sum("record"), F.lit(0)).cast("bigint").alias("n_records"), F.coalesce(F.sum(1 - F.col("record")), F.lit(0)).cast("bigint").alias("n_links"), part(1).alias("first"), part(13).alias("second"))


_R = f"WITH {RECORDS_SQL} "
_BASE = "[0.80e0, 0.90e0, 0.95e0, 0.99e0][CAST(level AS INT)]"
QUERIES = {f.__name__: f for f in (importance_decay, effective_trust, belief_groups, corpus_fingerprint)}
ORACLE_SQL = {
    "corpus_fingerprint": f"""WITH {RECORDS_SQL}, {CONNECTIONS_SQL},
h AS (SELECT 1 AS record, md5(coalesce(CAST(id AS VARCHAR), '') || '|' || coalesce(namespace, '') || '|' || coalesce(CAST(CAST(created_at * 1000000 AS BIGINT) AS VARCHAR), '') || '|' || coalesce(CAST(caused_by AS VARCHAR), '')) AS h FROM records
UNION ALL SELECT 0, md5('link|' || a || '|' || b) FROM connections WHERE kind = 'causal')
SELECT CAST(coalesce(sum(record), 0) AS BIGINT) AS n_records, CAST(coalesce(sum(1 - record), 0) AS BIGINT) AS n_links,
CAST(coalesce(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)), 0) % {1 << 48} AS BIGINT) AS first, CAST(coalesce(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)), 0) % {1 << 48} AS BIGINT) AS second FROM h""",
    "importance_decay": _R + f"""SELECT id, round(0.4e0 * strength + 0.25e0 * level / 4 + 0.2e0 * least(len(tags) / 50, 1) + 0.15e0 * least(activation_count / 20, 1) + 0.1e0 * salience, 6) AS importance,
round(strength * least(least({_BASE} + (0.999e0 - {_BASE}) * least(activation_count / 10, 1), 0.999e0) + 0.03e0 * salience, 0.999e0), 6) AS decayed, strength >= 0.05 AS alive,
activation_count >= 5 AND strength >= 0.7 AND level < 4 AS promotable FROM records""",
    "effective_trust": _R + f"SELECT id, round({_TRUST}, 6) AS trust FROM records",
    "belief_groups": _R + f""", g AS (SELECT namespace, semantic_type, CASE WHEN semantic_type = 'contradiction' OR conflict > support THEN 'oppose' ELSE 'support' END AS stance, count(*) AS n, avg(confidence) AS c,
sum(support) AS support, sum(conflict) AS conflict, exp(-greatest(({NOW} - max(last_activated)) / 86400e0, 0) / 14) AS r, 1 / (1 + coalesce(var_samp(confidence), 0)) AS k FROM records GROUP BY 1, 2, 3)
SELECT namespace, semantic_type, stance, n, round(c, 6) AS confidence, CAST(support AS BIGINT) AS support, CAST(conflict AS BIGINT) AS conflict, round(r, 6) AS recency, round(k, 6) AS consistency,
round(greatest((1 + ln(1 + support)) * c * r * k - 0.35e0 * ln(1 + conflict), 0), 6) AS score FROM g""",
}
