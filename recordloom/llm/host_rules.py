"""Quality rules by host.

Each document is held against the rules; a host's rate is the share of its documents that fail one.  Rates of small hosts are shrunk
towards the rest by a beta prior whose mean and strength are fitted to all hosts' rates by moments, less the variance that chance gives a rate: rate = (failed + a) / (n + a + b).
A host is bad from BAD on, suspect from SUSPECT on, else good.  A failed rule gives a document points, three if it is in SEVERE and else one; documents
of good hosts go with three points, of suspect hosts with two, of bad ones with one; a document that fails no rule always stays.

All is done with Spark's own functions; hosts are as many as the data have, so they are aggregated and joined as a table.

Defined cases: null text is treated as empty and fails the rule "wordless"; a null or empty host is a host of its own, ""; repeated rows and
rows without an id count like others; an empty table gives an empty result; with one host, or equal rates, the prior has strength
MOST; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SYMBOLS, VARIETY, LINES, LONG_WORDS, DIGITS = 0.1, 3.0, 0.5, 15.0, 0.5
SUSPECT, BAD, LEAST, MOST = 0.2, 0.5, 1.0, 10000.0
SEVERE = ("wordless", "symbols", "monotonous")
RULES = ("wordless", "symbols", "monotonous", "repeated_lines", "long_words", "digits")


def host_of(url: str) -> Column:
    """Lower-case host of a column of URLs."""
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def failures(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """doc_id, host, n_words, and for each rule whether the document fails it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce((host if host is not None else F.col("source")).cast("string"), F.lit("")).alias("host"), text.alias("t"))
    # one pass over the text makes the arrays, and all measures are of these
    own = own.withColumns({"w": F.filter(F.split("t", r"[ \n\t\r]+"), lambda x: x != ""), "l": F.split("t", "\n")})
    own = own.select("doc_id", "host", F.length("t").alias("n"), F.size("w").alias("nw"), F.size(F.array_distinct("w")).alias("dw"), F.size("l").alias("nl"), F.size(F.array_distinct("l")).alias("dl"),
                     F.length(F.translate("t", "#$%&*<>{}|\\^~=_+@", "")).alias("ns"), F.length(F.translate("t", "0123456789", "")).alias("nd"))
    n = F.greatest("n", F.lit(1))
    return own.select(
        "doc_id", "host", F.col("nw").cast("bigint").alias("n_words"),
        (F.col("nw") == 0).alias("wordless"),
        ((F.col("n") - F.col("ns")) / n > SYMBOLS).alias("symbols"),
        ((F.col("nw") >= 50) & (F.col("dw") / F.sqrt(F.greatest("nw", F.lit(1))) < VARIETY)).alias("monotonous"),
        ((F.col("nl") >= 4) & (F.col("dl") / F.col("nl") < LINES)).alias("repeated_lines"),
        ((F.col("nw") > 0) & (F.col("n") / F.greatest("nw", F.lit(1)) > LONG_WORDS)).alias("long_words"),
        ((F.col("n") - F.col("nd")) / n > DIGITS).alias("digits"),
    )


def host_rates(failed: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk), verdict."""
    hosts = failed.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("n_failed") > 0, 1).otherwise(0)).alias("failed"))
    rate = F.col("failed") / F.col("n")
    # a host's rate varies by chance too, the more the smaller it is: that isn't variance between hosts
    chance = F.avg(rate * (1 - rate) / F.col("n"))
    prior = hosts.agg(F.avg(rate).alias("m"), F.greatest(F.coalesce(F.var_pop(rate), F.lit(0.0)) - F.coalesce(chance, F.lit(0.0)), F.lit(0.0)).alias("v"))
    strength = F.when(F.col("v") > 1e-12, F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(MOST))
    prior = prior.select((F.col("m") * strength).alias("a"), strength.alias("s"))
    out = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", F.round((F.col("failed") + F.col("a")) / (F.col("n") + F.col("s")), 9))  # one row
    return out.select("host", "n", "failed", "rate", F.when(F.col("rate") >= BAD, "bad").when(F.col("rate") >= SUSPECT, "suspect").otherwise("good").alias("verdict"))


def verdicts(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """doc_id, host, n_words, n_failed, points, host_rate, host_verdict, keep of each row of docs."""
    f = failures(docs, host)
    slim = written(f.select("doc_id", "host", "n_words", sum(F.col(r).cast("int") for r in RULES).alias("n_failed"), sum(F.col(r).cast("int") * (3 if r in SEVERE else 1) for r in RULES).alias("points")), "rules")
    hosts = host_rates(slim).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    limit = F.when(F.col("host_verdict") == "bad", 1).when(F.col("host_verdict") == "suspect", 2).otherwise(3)
    return slim.join(hosts, F.col("host") == F.col("h")).select("doc_id", "host", "n_words", "n_failed", "points", "host_rate", "host_verdict", (F.col("points") < limit).alias("keep"))


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def page_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages: the text without tags, and the host of the URL."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return verdicts(p.select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"), "url"), host_of("url"))


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[ \n\t\r]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM t),
m AS (SELECT doc_id, host, length(t) AS n, len(w) AS nw, len(list_distinct(w)) AS dw, len(l) AS nl, len(list_distinct(l)) AS dl,
  length(translate(t, '#$%&*<>{{}}|\^~=_+@', '')) AS ns, length(translate(t, '0123456789', '')) AS nd FROM w),
g AS (SELECT doc_id, host, nw AS n_words,
  CAST(nw = 0 AS INT) + CAST((n - ns) / greatest(n, 1) > {SYMBOLS} AS INT) + CAST(nw >= 50 AND dw / sqrt(greatest(nw, 1)) < {VARIETY} AS INT) AS severe,
  CAST(nl >= 4 AND dl / nl < {LINES} AS INT) + CAST(nw > 0 AND n / greatest(nw, 1) > {LONG_WORDS} AS INT) + CAST((n - nd) / greatest(n, 1) > {DIGITS} AS INT) AS mild FROM m),
f AS (SELECT doc_id, host, n_words, severe + mild AS n_failed, 3 * severe + mild AS points FROM g),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE n_failed > 0) AS failed FROM f GROUP BY host),
p AS (SELECT avg(failed / n) AS m, greatest(coalesce(var_pop(failed / n), 0) - avg(failed / n * (1 - failed / n) / n), 0) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 1e-12 THEN least({MOST}, greatest({LEAST}, m * (1 - m) / v - 1)) ELSE {MOST} END AS s FROM p),
r AS (SELECT host, round((failed + m * s) / (n + s), 9) AS rate FROM h, s),
v AS (SELECT host, rate, CASE WHEN rate >= {BAD} THEN 'bad' WHEN rate >= {SUSPECT} THEN 'suspect' ELSE 'good' END AS verdict FROM r)
SELECT doc_id, host, n_words, n_failed, points, rate AS host_rate, verdict AS host_verdict,
  points < CASE verdict WHEN 'bad' THEN 1 WHEN 'suspect' THEN 2 ELSE 3 END AS keep
FROM f JOIN v USING (host)
"""
PAGES_SQL = ORACLE_SQL.replace(
    "SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents",
    "SELECT page_id AS doc_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host, coalesce(regexp_replace(html, '<[^>]*>', ' ', 'g'), '') AS t FROM pages",
)
