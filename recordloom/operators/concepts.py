"""Concepts: groups of settled beliefs of a namespace that speak of the same things, with their terms, tags and worth."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits as B
from ..functions.counting import components, layered, stored
from ..sources.records import records
from . import beliefs as L

STOP = tuple("the and for are with that this was you not but have from they all one had her has his der die das und les des une que los las por con est pas ein eine den dem".split())
_STOP = frozenset(STOP)
ALIKE, CORE, SHELL = 0.12, 0.70, 0.20
HELD = 500000  # words, and terms by key, that a task holds before it passes them on


def _term(word: bytes) -> str | None:
    """A word of three bytes or more without signs at its ends, unless it is one of the commonest."""
    w = word.decode(errors="replace")
    if not w.isalnum():  # letters and digits of any script
        i, j = 0, len(w)
        while i < j and not w[i].isalnum():
            i += 1
        while i < j and not w[j - 1].isalnum():
            j -= 1
        w = w[i:j]
    return w if w and w not in _STOP else None


def _counted_terms(batches):
    """key, term, k: how many texts of the key hold the term, as far as this task and its memory go; the parts are added up later."""
    known, n = {}, {}

    def out():
        for key, own in n.items():
            terms = list(own)
            for lo in range(0, len(terms), 1 << 16):
                part = terms[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array(part, pa.string()), pa.array([own[t] for t in part], pa.int64())], names=["key", "term", "k"])
        n.clear()

    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py() or b""
            own = set()
            for w in set(re.split(rb"[ \t\n\f\r]+", raw) if b"\v" in raw else raw.split()):
                if len(w) >= 3:
                    try:
                        t = known[w]
                    except KeyError:
                        if len(known) >= HELD:
                            known.clear()
                        t = known[w] = _term(w)
                    if t is not None:
                        own.add(t)
            mine = n.setdefault(key.as_py(), {})
            before = len(mine)
            for t in own:
                mine[t] = mine.get(t, 0) + 1
            held += len(mine) - before
            if held >= HELD:
                yield from out()
                held = 0
    yield from out()


def key_terms(g: DataFrame) -> DataFrame:
    """key, term, k of g (key, content): how many of the key's texts hold the term (a distinct word of three bytes or more, without signs at its ends and without the commonest ones)."""
    B.small_batches(g.sparkSession)
    return g.select("key", F.lower("content").cast("binary")).mapInArrow(_counted_terms, "key string, term string, k bigint").groupBy("key", "term").agg(F.sum("k").alias("k"))


def seeds(b: DataFrame, stability: float = 1.0, confidence: float = 0.40) -> DataFrame:
    """Settled beliefs that are steady and sure enough."""
    return b.where((F.col("state") != "Unresolved") & (F.col("stability") >= stability) & (F.col("confidence") >= confidence))


def _parts(spark, sf_dir):
    """The seeds; and their records' terms and tags, by key."""
    s = seeds(L.beliefs(spark, sf_dir))
    g = L.grouped(records(spark, sf_dir)).join(s.select("key"), "key")
    return s, g


def similar(s: DataFrame, g: DataFrame, terms: DataFrame) -> DataFrame:
    """namespace, a, b, jaccard of the terms, for pairs of beliefs of a namespace with a common term and tag."""
    t = terms.join(s.select("namespace", "key"), "key").select("namespace", "key", "term")
    n = t.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    # the sets of beliefs that hold one thing are few, however many things there are: counted first, as bits, they are paired after
    place = s.select("namespace", "key", (F.row_number().over(Window.partitionBy("namespace").orderBy("key")) - 1).alias("i"))
    words = [f"w{j}" for j in range(-(-(place.agg(F.max("i")).first()[0] or 0) // 62) + 1)]
    bit = lambda j: F.when(F.floor(F.col("i") / 62) == j, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("i") % 62).cast("int"))).otherwise(0)
    held = lambda d, c: d.join(place, ["namespace", "key"]).where(F.col(c).isNotNull()).groupBy("namespace", c).agg(*[F.bit_or(bit(j)).alias(w) for j, w in enumerate(words)]).groupBy("namespace", *words).agg(F.count(F.lit(1)).alias("c"))
    on = lambda: sum((F.when((F.floor(F.col("i") / 62) == j), F.getbit(F.col(w), (F.col("i") % 62).cast("int")).cast("int")).otherwise(0) for j, w in enumerate(words)), F.lit(0)) > 0

    def pair(d, c):
        one = held(d, c).join(place.withColumnRenamed("key", "a"), "namespace").where(on()).drop("i")
        return one.join(place.withColumnRenamed("key", "b"), "namespace").where(on() & (F.col("a") < F.col("b"))).select("namespace", "a", "b", "c")

    both = pair(t, "term").groupBy("namespace", "a", "b").agg(F.sum("c").alias("c"))
    tags = pair(g.select("namespace", "key", F.explode("tags").alias("tag")).distinct(), "tag").select("a", "b").distinct()
    j = both.join(tags, ["a", "b"], "left_semi").join(n.withColumnsRenamed({"k": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"k": "b", "n": "nb"}), "b")
    return j.select("namespace", "a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts; their members (concept, key); the seeds' records.  Beliefs are joined by single linkage at ALIKE."""
    s, g = _parts(spark, sf_dir)
    pairs = layered(spark, sf_dir, "pairs", lambda: similar(s, g, layered(spark, sf_dir, "terms", lambda: key_terms(g))))
    members = layered(spark, sf_dir, "members", lambda: components(pairs.where(F.col("jaccard") >= ALIKE)).select(F.col("root").alias("concept"), F.col("node").alias("key")))
    one, two = (members.select(F.col("concept").alias(f"c{x}"), F.col("key").alias(x)) for x in "ab")
    cohesion = pairs.join(one, "a").join(two, "b").where("ca = cb").groupBy(F.col("ca").alias("cc")).agg(F.sum("jaccard").alias("sum"))
    m = members.join(s, "key").groupBy("concept").agg(F.first("namespace").alias("namespace"), F.count(F.lit(1)).alias("n_beliefs"), F.sum("n").alias("n_records"), F.sum("support").alias("support"), F.avg("confidence").alias("confidence"), F.avg("stability").alias("stability"))
    m = m.join(cohesion, F.col("concept") == F.col("cc"), "left").withColumn("cohesion", F.coalesce("sum", F.lit(0.0)) / (F.col("n_beliefs") * (F.col("n_beliefs") - 1) / 2))
    score = 0.35 * F.least(F.log(1.0 + F.col("support")), F.lit(1.0)) + 0.25 * F.col("confidence") + 0.20 * (F.col("stability") / (F.col("stability") + 3)) + 0.20 * F.col("cohesion")
    m = m.withColumn("score", F.round(score, 9)).withColumn("state", F.when(F.col("score") >= 0.75, "Stable").when(F.col("score") >= 0.50, "Candidate").otherwise("Rejected"))
    return m.drop("cc", "sum"), members, g


def concept_clusters(spark, sf_dir):
    return concepts(spark, sf_dir)[0].select("concept", "namespace", "n_beliefs", "n_records", "support", *[F.round(c, 6).alias(c) for c in ("confidence", "stability", "cohesion", "score")], "state")


def concept_terms(spark, sf_dir):
    """Terms by the share of the concept's records that hold them: core from 0.70, shell from 0.20."""
    _, members, g = concepts(spark, sf_dir)
    r = layered(spark, sf_dir, "terms", lambda: key_terms(g)).join(members, "key")  # a record is of one belief, so that its concept's counts are sums
    n = g.join(members, "key").groupBy(F.col("concept").alias("c")).agg(F.countDistinct("id").alias("n"))
    t = r.groupBy("concept", "term").agg(F.sum("k").alias("k")).join(n, F.col("concept") == F.col("c")).withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= SHELL)
    return t.select("concept", "term", F.round("share", 6).alias("share"), F.when(F.col("share") >= CORE, "core").otherwise("shell").alias("kind"))


def concept_tags(spark, sf_dir):
    """Tags of at least half of a concept's beliefs."""
    _, members, g = concepts(spark, sf_dir)
    n = members.groupBy(F.col("concept").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    t = g.join(members, "key").select("concept", "key", F.explode("tags").alias("tag")).distinct().groupBy("concept", "tag").agg(F.count(F.lit(1)).alias("k"))
    return t.join(n, F.col("concept") == F.col("c")).where(F.col("k") >= F.ceil(F.col("n") * 0.5)).select("concept", "tag", "k")


def concept_stats(spark, sf_dir):
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s.lower())
    return concepts(spark, sf_dir)[0].agg(F.count(F.lit(1)).alias("total"), count("Stable"), count("Candidate"), count("Rejected"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score"))


def surfaced_concepts(spark, sf_dir):
    """Stable concepts and candidates from 0.70 on, the best first: five of a namespace at most, ten in all."""
    c = concepts(spark, sf_dir)[0].select("concept", "namespace", "n_beliefs", "state", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence")).where("state = 'Stable' or (state = 'Candidate' and score >= 0.70)")
    order = [F.desc("score"), F.desc("confidence"), F.desc("n_beliefs"), "concept"]
    return c.withColumn("i", F.row_number().over(Window.partitionBy("namespace").orderBy(*order))).where("i <= 5").drop("i").orderBy(*order).limit(10)


def concept_records(spark, sf_dir):
    """Each record of a concept's beliefs, with the concept's state."""
    c, members, g = concepts(spark, sf_dir)
    return g.select("id", "key").join(members, "key").join(c.select("concept", "state"), "concept").select("id", "concept", "state")


def belief_concepts(spark, sf_dir):
    """From each settled belief to its concept, where that isn't rejected."""
    c, members, _ = concepts(spark, sf_dir)
    return members.join(c.where("state <> 'Rejected'").select("concept", "state"), "concept").select("key", "concept", "state")


def belief_centroids(spark, sf_dir):
    """The union of the bits of each settled belief's records: how many, and their sum."""
    _, g = _parts(spark, sf_dir)
    return B.united(g.select("key", "content"), F.col("content"))


_TERMS = f"list_distinct(list_filter(list_transform(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: strlen(x) >= 3), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda x: x <> '' AND x NOT IN ({', '.join(repr(w) for w in STOP)})))"
_C = f"""{L._B}, s AS (SELECT * FROM b WHERE state <> 'Unresolved' AND stability >= 1 AND confidence >= 0.4), sg AS (SELECT * FROM g WHERE key IN (SELECT key FROM s)), rt AS (SELECT id, key, unnest({_TERMS}) AS term FROM sg),
t AS (SELECT DISTINCT split_part(key, ':', 1) AS ns, key, term FROM rt), n AS (SELECT key, count(*) AS n FROM t GROUP BY 1), tg AS (SELECT DISTINCT split_part(key, ':', 1) AS ns, key, unnest(tags) AS tag FROM sg),
common AS (SELECT x.key AS a, y.key AS b, count(*) AS c FROM t x JOIN t y ON x.ns = y.ns AND x.term = y.term AND x.key < y.key GROUP BY 1, 2), tagged AS (SELECT DISTINCT x.key AS a, y.key AS b FROM tg x JOIN tg y ON x.ns = y.ns AND x.tag = y.tag AND x.key < y.key),
pr AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM common SEMI JOIN tagged USING (a, b) JOIN n x ON x.key = a JOIN n y ON y.key = b), edge AS (SELECT a, b FROM pr WHERE jaccard >= {ALIKE} UNION SELECT b, a FROM pr WHERE jaccard >= {ALIKE}),
reach AS (SELECT a, a AS b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a), mem AS (SELECT a AS key, min(b) AS concept FROM reach GROUP BY 1),
coh AS (SELECT x.concept, sum(jaccard) AS j FROM pr JOIN mem x ON x.key = a JOIN mem y ON y.key = b AND x.concept = y.concept GROUP BY 1),
c1 AS (SELECT concept, any_value(namespace) AS namespace, count(*) AS n_beliefs, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(support) AS BIGINT) AS support, avg(confidence) AS confidence, avg(stability) AS stability FROM mem JOIN s USING (key) GROUP BY 1),
c2 AS (SELECT c1.*, coalesce(j, 0e0) / (n_beliefs * (n_beliefs - 1) / 2) AS cohesion FROM c1 LEFT JOIN coh USING (concept)),
c3 AS (SELECT *, round(0.35e0 * least(ln(1e0 + support), 1) + 0.25e0 * confidence + 0.2e0 * (stability / (stability + 3)) + 0.2e0 * cohesion, 9) AS score FROM c2),
c AS (SELECT *, CASE WHEN score >= 0.75 THEN 'Stable' WHEN score >= 0.5 THEN 'Candidate' ELSE 'Rejected' END AS state FROM c3)"""
QUERIES = {f.__name__: f for f in (concept_clusters, concept_terms, concept_tags, concept_stats, surfaced_concepts, concept_records, belief_concepts, belief_centroids)}
ORACLE_SQL = {
    "concept_clusters": f"{_C} SELECT concept, namespace, n_beliefs, n_records, support, round(confidence, 6) AS confidence, round(stability, 6) AS stability, round(cohesion, 6) AS cohesion, round(score, 6) AS score, state FROM c",
    "concept_terms": f"{_C}, nr AS (SELECT concept, count(DISTINCT id) AS n FROM sg JOIN mem USING (key) GROUP BY 1), k AS (SELECT concept, term, count(*) AS k FROM rt JOIN mem USING (key) GROUP BY 1, 2) SELECT concept, term, round(k / n, 6) AS share, CASE WHEN k / n >= {CORE} THEN 'core' ELSE 'shell' END AS kind FROM k JOIN nr USING (concept) WHERE k / n >= {SHELL}",
    "concept_tags": f"{_C}, k AS (SELECT concept, tag, count(*) AS k FROM tg JOIN mem USING (key) GROUP BY 1, 2) SELECT concept, tag, k FROM k JOIN c1 USING (concept) WHERE k >= ceil(n_beliefs * 0.5e0)",
    "concept_stats": f"{_C} SELECT count(*) AS total, count(*) FILTER (WHERE state = 'Stable') AS stable, count(*) FILTER (WHERE state = 'Candidate') AS candidate, count(*) FILTER (WHERE state = 'Rejected') AS rejected, round(coalesce(avg(score), 0), 6) AS avg_score FROM c",
    "surfaced_concepts": f"{_C}, k AS (SELECT concept, namespace, n_beliefs, state, round(score, 6) AS score, round(confidence, 6) AS confidence FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, confidence DESC, n_beliefs DESC, concept) AS i FROM k WHERE state = 'Stable' OR (state = 'Candidate' AND score >= 0.7)) SELECT concept, namespace, n_beliefs, state, score, confidence FROM r WHERE i <= 5 ORDER BY score DESC, confidence DESC, n_beliefs DESC, concept LIMIT 10",
    "concept_records": f"{_C} SELECT id, concept, c.state AS state FROM sg JOIN mem USING (key) JOIN c USING (concept)",
    "belief_concepts": f"{_C} SELECT key, concept, c.state AS state FROM mem JOIN c USING (concept) WHERE c.state <> 'Rejected'",
    "belief_centroids": f"{L._B}, s AS (SELECT * FROM b WHERE state <> 'Unresolved' AND stability >= 1 AND confidence >= 0.4), x0 AS (SELECT id, key, lower(trim(content, ' ')) AS tx FROM g WHERE key IN (SELECT key FROM s)), {B.sql_bits('x1', 'x0', 'id', 'tx')}, x2 AS (SELECT DISTINCT key, bit FROM x1 JOIN x0 USING (id)) SELECT key, count(*) AS n, CAST(sum(bit) AS BIGINT) AS total FROM x2 GROUP BY 1",
}
