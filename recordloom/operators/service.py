"""What callers of the engine ask for on top of its layers: retrieval by thresholds, activation, recall as text, contradiction clusters, the maintenance run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits as B
from ..functions import text as T
from ..functions.counting import components, stored
from ..sources.records import NOW, PHRASES, RECORDS_SQL, _sql_pick, connections, pick, records, table
from . import admin, beliefs, causal, concepts, insights, recall, texts
from .admin import _LAYER, layer
from .beliefs import _B
from .recall import _RECALL

DAY, LIMIT = 86400, 20
WANTED = ("what is the stable release", PHRASES[12], "the latency of calls is often measured in ms")


def threshold(length: Column) -> Column:
    """How alike a text must be, by the number of the query's words."""
    return F.when(length <= 2, 0.22).when(length <= 5, 0.18).otherwise(0.15)


def _asked(spark: SparkSession) -> DataFrame:
    q = spark.createDataFrame(list(enumerate(WANTED)), "query int, q string").select("query", T.sharpened(F.col("q")).alias("q"))
    return B.with_bits(q, F.col("q")).select("query", "bits", F.size(F.split("q", " ")).alias("words"))


def adaptive_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By query the twenty best phrases' records that are alike enough for its length: Tanimoto, intensity (as salience x 10), their product, and the place by product
    with a tenth of the reciprocal rank by recency; phantoms are told as such.  A reflex, the record whose text is the query's very bits, comes first."""
    r = records(spark, sf_dir).select("id", "salience", "created_at", layer(F.col("id")).alias("dna"), pick(PHRASES, F.col("id")).alias("phrase"))
    p = B.with_bits(r.select("phrase").distinct(), F.col("phrase")).select("phrase", F.col("bits").alias("own"))  # a text's bits once
    near = p.crossJoin(F.broadcast(_asked(spark))).select("query", "phrase", F.round(B.tanimoto(F.col("own"), F.col("bits")), 9).alias("tanimoto"), threshold(F.col("words")).alias("least"), (F.col("own") == F.col("bits")).alias("reflex"))  # three queries
    j = r.join(near.where("tanimoto >= least"), "phrase")
    w = Window.partitionBy("query").orderBy(F.desc("created_at"), "id")
    # only the newest of each Tanimoto and intensity can be among the best
    j = j.withColumns({"intensity": F.col("salience") * 10, "product": F.round(F.col("tanimoto") * F.col("salience") * 10, 9)})
    best = j.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("reflex"), F.desc("product"), F.desc("created_at"), "id"))).where(F.col("i") <= LIMIT)
    best = best.withColumn("score", F.round(F.col("product") + 0.1 / (60 + F.row_number().over(w) - 1), 9))
    return best.select("query", "id", "tanimoto", F.round("intensity", 6).alias("intensity"), "score", F.when(F.col("dna") == "phantom", "[phantom]").otherwise(F.col("phrase")).alias("text"), "reflex")


def recall_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recall does to its ten best: each pair of one namespace is linked a little more, w + 0.05 x (1 - w)."""
    top = stored(recall.recall_fused(spark, sf_dir).select("query", "id")).join(records(spark, sf_dir).select("id", "namespace"), "id")
    pair = top.join(top.select("query", "namespace", F.col("id").alias("b")), ["query", "namespace"]).where("id < b").select("query", F.col("id").alias("a"), "b")  # ten rows a query
    w = connections(spark, sf_dir).groupBy("a", "b").agg(F.max("weight").alias("w"))
    return pair.join(w, ["a", "b"], "left").select("query", "a", "b", F.round(F.coalesce("w", F.lit(0.0)) + 0.05 * (1 - F.coalesce("w", F.lit(0.0))), 6).alias("weight"))


def recall_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall's ten best as lines for a prompt, best first, within a budget of tokens (as a hash with counts)."""
    top = stored(recall.recall_fused(spark, sf_dir).select("query", "id", "rank"))
    some = records(spark, sf_dir).join(F.broadcast(top.select("id").distinct()), "id", "left_semi")  # ten of each query
    j = top.join(texts._formatted(spark, sf_dir, some).select("id", "line"), "id").withColumn("tokens", T.token_estimate(F.col("line")))
    j = j.withColumn("upto", F.sum("tokens").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= texts.BUDGET)
    g = j.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"), F.count(F.lit(1)).alias("n"), F.max("upto").alias("tokens"))
    return g.select("query", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"), "n", "tokens")


def recall_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag signal over records that were there twenty days ago."""
    old = records(spark, sf_dir).where(F.col("created_at") <= NOW - 20 * DAY).select("id", "created_at")
    own = recall.tag_signal(spark, sf_dir, 1 << 30).join(old, "id")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return own.withColumn("i", F.row_number().over(w)).where(F.col("i") <= LIMIT).select("query", "id", "score", "created_at")


def contradiction_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of contested beliefs (unresolved, volatile, unsteady, or with evidence against them) that share a tag in their namespace: members, unresolved ones, conflict, volatility; the most volatile first, twenty."""
    b = beliefs.beliefs(spark, sf_dir).where((F.col("state") == "Unresolved") | (F.round("volatility", 9) >= 0.20) | (F.col("stability") <= 1) | (F.col("conflict") > 0))
    b = stored(b)
    t = beliefs.grouped(records(spark, sf_dir)).join(b.select("key"), "key").select("namespace", "key", F.explode("tags").alias("tag")).distinct()
    edges = t.select(F.concat_ws("\x01", F.lit("~"), "namespace", "tag").alias("a"), F.col("key").alias("b"))  # a tag is a node, so that beliefs needn't be paired
    root = components(edges).where(~F.col("node").startswith("~")).select(F.col("node").alias("key"), "root")
    c = b.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    g = c.groupBy("root").agg(F.min("key").alias("first"), F.min("namespace").alias("namespace"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("state") == "Unresolved", 1)).alias("unresolved"), F.sum("conflict").alias("conflict"), F.round(F.avg("volatility"), 6).alias("volatility"))
    return g.drop("root").orderBy(F.desc("volatility"), F.desc("conflict"), "first").limit(LIMIT)


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum over all records that changes with any of them and not with their order: equal ones need no rebuild."""
    r = records(spark, sf_dir).select(F.md5(F.concat_ws("|", F.col("id").cast("string"), "namespace", F.col("created_at").cast("bigint").cast("string"), F.coalesce(F.col("caused_by").cast("string"), F.lit("")), "content")).alias("h"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")).alias("low"), F.sum(F.conv(F.substring("h", 9, 8), 16, 10).cast("bigint")).alias("high"))


def knowledge_gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that go together twice or more although their phrases have few bits in common."""
    c = admin.cooccurrence(spark, sf_dir).where("n >= 2")
    d = B.with_bits(table(spark, sf_dir, "documents").select("doc_id"), pick(PHRASES, F.col("doc_id")))
    j = c.join(d.select(F.col("doc_id").alias("a"), F.col("bits").alias("x")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("bits").alias("y")), "b")
    return j.select("a", "b", "n", F.round(B.tanimoto(F.col("x"), F.col("y")), 6).alias("tanimoto")).where("tanimoto < 0.15")


#: Phases of a maintenance run in their order, and the query whose rows each reports; discovery's layers depend on one another, in this order.
PHASES = {
    "level_repair": (admin, "level_repair"), "decay": (admin, "decay_sweep"), "promotion": (admin, "guarded_promotion"), "epistemic": (admin, "epistemic_update"), "insights": (insights, "insight_stale"),
    "beliefs": (beliefs, "belief_resolution"), "concepts": (concepts, "concept_clusters"), "events": (causal, "causal_strength"),
    "consolidation": (admin, "merged_copies"), "cross_links": (admin, "indirect_links"), "tasks": (admin, "due_tasks"), "archive": (admin, "archive"),
}


def maintenance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report line for each phase: its place and how many rows it has to act on."""
    one = lambda i, name, m, f: m.QUERIES[f](spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("phase"), "n")
    return reduce(DataFrame.unionByName, [one(i, name, m, f) for i, (name, (m, f)) in enumerate(PHASES.items())])


_PB = f"ph AS (SELECT DISTINCT {_sql_pick(PHRASES, 'doc_id')} AS phrase FROM documents), pt AS (SELECT phrase, lower(trim(phrase, ' ')) AS tx FROM ph), {B.sql_bits('pb', 'pt', 'phrase', 'tx')}, pn AS (SELECT phrase, count(*) AS n FROM pb GROUP BY 1)"
_WORDS = ("the stable release", PHRASES[12], "the latency of calls is often measured in ms")  # without the leading question phrase
_QB = f"qt AS (SELECT * FROM (VALUES {', '.join(f'''({i}, '{w}')''' for i, w in enumerate(_WORDS))}) AS t(query, tx)), {B.sql_bits('qb', 'qt', 'query', 'tx')}, qn AS (SELECT query, count(*) AS m FROM qb GROUP BY 1)"
QUERIES = {f.__name__: f for f in (adaptive_retrieve, recall_activation, recall_text, recall_temporal, contradiction_clusters, corpus_fingerprint, knowledge_gap_pairs, maintenance_run)}
ORACLE_SQL = {
    "adaptive_retrieve": f"""WITH {RECORDS_SQL}, {_PB}, {_QB}, k AS (SELECT query, phrase, count(*) AS k FROM pb JOIN qb USING (bit) GROUP BY 1, 2),
s AS (SELECT query, phrase, round(k / (n + m - k), 9) AS tanimoto, n = m AND k = n AS reflex FROM k JOIN pn USING (phrase) JOIN qn USING (query) JOIN qt USING (query) WHERE round(k / (n + m - k), 9) >= CASE WHEN len(string_split(tx, ' ')) <= 2 THEN 0.22 WHEN len(string_split(tx, ' ')) <= 5 THEN 0.18 ELSE 0.15 END),
r AS (SELECT id, salience, created_at, {_LAYER} AS dna, {_sql_pick(PHRASES, 'id')} AS phrase FROM records), j AS (SELECT *, salience * 10 AS intensity, round(tanimoto * salience * 10, 9) AS product FROM r JOIN s USING (phrase)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY reflex DESC, product DESC, created_at DESC, id) AS i FROM j) WHERE i <= {LIMIT})
SELECT query, id, tanimoto, round(intensity, 6) AS intensity, round(product + 0.1e0 / (60 + row_number() OVER (PARTITION BY query ORDER BY created_at DESC, id) - 1), 9) AS score, CASE WHEN dna = 'phantom' THEN '[phantom]' ELSE phrase END AS text, reflex FROM t""",
    "recall_activation": f"{_RECALL}, top AS (SELECT query, recall.id, namespace FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM recall) recall JOIN records USING (id) WHERE rank <= {recall.K}) SELECT x.query, x.id AS a, y.id AS b, round(coalesce(e.weight, 0e0) + 0.05e0 * (1 - coalesce(e.weight, 0e0)), 6) AS weight FROM top x JOIN top y ON x.query = y.query AND x.namespace = y.namespace AND x.id < y.id LEFT JOIN e ON e.a = x.id AND e.b = y.id",
    "recall_text": f"""{_RECALL}, top AS (SELECT * FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM recall) WHERE rank <= {recall.K}), ln AS ({texts._LINE} SELECT id, line, tokens FROM k),
o AS (SELECT query, rank, line, tokens, sum(tokens) OVER (PARTITION BY query ORDER BY rank) AS upto FROM top JOIN ln ON ln.id = top.id) SELECT query, md5(string_agg(line, chr(10) ORDER BY rank)) AS text, count(*) AS n, CAST(max(upto) AS BIGINT) AS tokens FROM o WHERE upto <= {texts.BUDGET} GROUP BY 1""",
    "recall_temporal": f"WITH {RECORDS_SQL}, {recall._WORDS}, {recall._signal_sql('t', recall._TAGS, 1 << 30)}, o AS (SELECT query, t.id, score, created_at, row_number() OVER (PARTITION BY query ORDER BY score DESC, t.id) AS i FROM t JOIN records USING (id) WHERE created_at <= {NOW - 20 * DAY}e0) SELECT query, id, score, created_at FROM o WHERE i <= {LIMIT}",
    "contradiction_clusters": f"""{_B}, c AS (SELECT * FROM b WHERE state = 'Unresolved' OR round(volatility, 9) >= 0.2 OR stability <= 1 OR conflict > 0), t AS (SELECT DISTINCT namespace, key, unnest(tags) AS tag FROM g WHERE key IN (SELECT key FROM c)),
e AS (SELECT DISTINCT x.key AS a, y.key AS b FROM t x JOIN t y ON x.namespace = y.namespace AND x.tag = y.tag), reach AS (SELECT key AS a, key AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), m AS (SELECT a AS key, min(b) AS root FROM reach GROUP BY 1)
SELECT min(key) AS first, min(namespace) AS namespace, count(*) AS n, count(*) FILTER (WHERE state = 'Unresolved') AS unresolved, CAST(sum(conflict) AS BIGINT) AS conflict, round(avg(volatility), 6) AS volatility FROM c JOIN m USING (key) GROUP BY root ORDER BY 6 DESC, 5 DESC, 1 LIMIT {LIMIT}""",
    "corpus_fingerprint": f"WITH {RECORDS_SQL}, h AS (SELECT md5(concat_ws('|', CAST(id AS VARCHAR), namespace, CAST(CAST(created_at AS BIGINT) AS VARCHAR), coalesce(CAST(caused_by AS VARCHAR), ''), content)) AS h FROM records) SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS BIGINT) AS low, CAST(sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS BIGINT) AS high FROM h",
    "knowledge_gap_pairs": f"WITH {RECORDS_SQL}, {_PB}, co AS ({admin.ORACLE_SQL['cooccurrence']}), ov AS (SELECT x.phrase AS p, y.phrase AS q, count(*) AS k FROM pb x JOIN pb y USING (bit) GROUP BY 1, 2), f AS (SELECT a, b, co.n, {_sql_pick(PHRASES, 'a')} AS p, {_sql_pick(PHRASES, 'b')} AS q FROM co WHERE co.n >= 2), z AS (SELECT a, b, f.n, round(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 6) AS tanimoto FROM f JOIN pn x ON x.phrase = p JOIN pn y ON y.phrase = q LEFT JOIN ov ON ov.p = f.p AND ov.q = f.q) SELECT * FROM z WHERE tanimoto < 0.15",
    "maintenance_run": " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS step, '{name}' AS phase, count(*) AS n FROM ({m.ORACLE_SQL[f]})" for i, (name, (m, f)) in enumerate(PHASES.items())),
}
