"""The record view over the tables: what the engine's operators work on, as expressions that depend on the row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1735689600.0  # as_of, in seconds; never the clock
SEMANTIC = ("fact", "decision", "preference", "contradiction", "trend", "serendipity")
ORIGIN = ("recorded", "retrieved", "inferred", "generated")
AUTHORITY = {"user-telegram": 1.2, "user-confirmed": 1.2, "agent-interactive": 1.0, "system": 0.9, "agent": 0.85, "agent-autonomous": 0.75, "agent-worker": 0.7, "agent-inference": 0.65}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


PHRASES = (
    "I will fix the error in the server by friday", "Perhaps the database might be slow, but it works", "We prefer the stable release and like it",
    "My password: hunter22 opens the door", "Call +380991234567 or write to a.b@example.com", "The deploy was completed and approved yesterday",
    "A crash caused downtime and a rollback last week", "Important: the latency is 12.5 ms and 99 % of calls pass, tomorrow we measure again and often",
    "The api_key = abcdefghij0123456789klmn is secret", "what is the trend of the pattern this month", "My brother loves the garden and I am very happy",
    "wallet 0x0123456789abcdef0123456789abcdef01234567", "plain words that say nothing at all", "The café in Zürich has a naïve façade",
    "Emergency: critical danger, always urgent", "We went there on 2024-12-24 and next monday we go again",
)
EXTRA = ("frontend", "ui", "auth", "deploy", "release", "identity", "contact", "cache", "financial", "todo-item", "person", "outcome", "alerts")
KINDS = ("text", "code", "json", "text")
LINK_KINDS = ("associative", "causal", "reflective", "coactivation")
STEPS = (1, 20, 60)  # a record is linked to those so many ids further


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each document: its text and a phrase picked by the id; the other fields are arithmetic on the id, so that every branch of the rules occurs."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    last = F.lit(NOW) - (i * 131 % 400) * 10800
    tags = F.array("lang", "source", F.concat(F.lit("size"), F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("string")), pick(EXTRA, i))
    return d.select(
        F.col("doc_id").alias("id"), F.concat_ws("\n", "text", pick(PHRASES, i)).alias("content"), F.col("source").alias("namespace"),
        F.when(i % 53 == 0, F.array().cast("array<string>")).otherwise(tags).alias("tags"),
        (i % 4 + 1).cast("int").alias("level"), ((i * 37) % 101 / 100).alias("strength"), (i * 13 % 25).alias("activation_count"),
        (i * 7 % 11 / 10).alias("salience"), (last - (i * 17 % 29) * 86400).alias("created_at"),
        last.alias("last_activated"), pick(SEMANTIC, i).alias("semantic_type"),
        pick(ORIGIN, i).alias("source_type"), pick(tuple(AUTHORITY), i).alias("origin"), (i % 10 / 10).alias("trust_score"),
        (i % 9).alias("support"), (i % 4).alias("conflict"), ((i * 29) % 100 / 100).alias("confidence"), (i * 3 % 50 / 10).alias("velocity"),
        F.when(i % 97 == 0, i).when((i % 5 != 0) & (i >= 60), i - 20 * (1 + i % 3)).alias("caused_by"), ((i * 41) % 100 / 250).alias("volatility"), pick(KINDS, i).alias("content_type"),
    )


def _sql_pick(names, number: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({number} % {len(names)} + 1 AS INT))"


RECORDS_SQL = f"""records AS (SELECT doc_id AS id, concat_ws(chr(10), text, {_sql_pick(PHRASES, "doc_id")}) AS content, source AS namespace,
  CASE WHEN doc_id % 53 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, source, 'size' || CAST(least(CAST(floor(n_chars / 1000) AS BIGINT), 9) AS VARCHAR), {_sql_pick(EXTRA, "doc_id")}] END AS tags,
  doc_id % 4 + 1 AS level, (doc_id * 37) % 101 / 100 AS strength, doc_id * 13 % 25 AS activation_count, doc_id * 7 % 11 / 10 AS salience,
  {NOW}e0 - (doc_id * 131 % 400) * 10800 - (doc_id * 17 % 29) * 86400 AS created_at, {NOW}e0 - (doc_id * 131 % 400) * 10800 AS last_activated,
  {_sql_pick(SEMANTIC, "doc_id")} AS semantic_type, {_sql_pick(ORIGIN, "doc_id")} AS source_type, {_sql_pick(tuple(AUTHORITY), "doc_id")} AS origin,
  doc_id % 10 / 10 AS trust_score, doc_id % 9 AS support, doc_id % 4 AS conflict, (doc_id * 29) % 100 / 100 AS confidence, doc_id * 3 % 50 / 10 AS velocity,
  CASE WHEN doc_id % 97 = 0 THEN doc_id WHEN doc_id % 5 <> 0 AND doc_id >= 60 THEN doc_id - 20 * (1 + doc_id % 3) END AS caused_by, (doc_id * 41) % 100 / 250 AS volatility, {_sql_pick(KINDS, "doc_id")} AS content_type FROM documents)"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between records, in both directions: a, b, weight, kind."""
    i = F.col("id")
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).select("id", F.explode(F.array(*[F.lit(k) for k in STEPS])).alias("k"))
    e = e.select("id", (i + F.col("k")).alias("to"), (i * F.col("k") * 37 % 100 / 100).alias("weight"), pick(LINK_KINDS, i + F.col("k")).alias("kind"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("to")).distinct()
    return e.join(ids, "to").select(F.explode(F.array(F.struct(i.alias("a"), F.col("to").alias("b")), F.struct(F.col("to").alias("a"), i.alias("b")))).alias("e"), "weight", "kind").select("e.a", "e.b", "weight", "kind")


CONNECTIONS_SQL = f"""half AS (SELECT id, id + k AS b, id * k * 37 % 100 / 100 AS weight, {_sql_pick(LINK_KINDS, "(id + k)")} AS kind FROM (SELECT doc_id AS id, unnest({list(STEPS)}) AS k FROM documents)
  WHERE id + k IN (SELECT doc_id FROM documents)),
connections AS (SELECT id AS a, b, weight, kind FROM half UNION ALL SELECT b, id, weight, kind FROM half)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted undirected edges between suppliers and parts: a, b, weight, in both directions."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.least(F.lit(0.8), 0.2 + 0.15 * F.count(F.lit(1))).alias("weight"))
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return one.select(F.explode(F.array(F.struct(s.alias("a"), p.alias("b")), F.struct(p.alias("a"), s.alias("b")))).alias("e"), "weight").select("e.a", "e.b", "weight")


LINKS_SQL = """one AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, least(0.8e0, 0.2e0 + 0.15e0 * count(*)) AS weight FROM lineitem GROUP BY 1, 2),
links AS (SELECT s AS a, p AS b, weight FROM one UNION ALL SELECT p, s, weight FROM one)"""
