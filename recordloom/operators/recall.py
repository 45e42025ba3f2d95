"""Ranked retrieval: signals, their fusion by reciprocal ranks, and expansion along links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits as B
from ..functions import scalars as S
from ..functions.counting import stored
from ..sources.records import AUTHORITY, CONNECTIONS_SQL, LINKS_SQL, NOW, RECORDS_SQL, STEPS, connections, links, records, table
from .beliefs import _B, _H, _P

ASKED = ("en src1 size2", "de src3 the of and")
K, PER_SIGNAL, EXPANDED = 10, 40, 30
SIGNALS = ("bits", "ngrams", "tags")
TOP, BLOCK_ROWS = 20, 4096
BLOCK_BYTES, TILE = 16 << 20, 1 << 20  # of a large table's block as doubles; scores at a time


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "query int, q string").select("query", "q", F.array_distinct(F.split(F.lower("q"), " ")).alias("words"))


def _top(df: DataFrame, signal: str, n: int) -> DataFrame:
    # a rank filter over row_number, which Spark applies before the shuffle too
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return df.where("score > 0").withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n).select("query", "id", "score", "rank", F.lit(signal).alias("signal"))


def tag_signal(spark, sf_dir, n=PER_SIGNAL):
    """Jaccard of the query's words and the record's tags."""
    r = records(spark, sf_dir).select("id", F.transform("tags", F.lower).alias("tags")).crossJoin(F.broadcast(_queries(spark)))  # two rows
    return _top(r.select("query", "id", F.round(S.jaccard(F.col("words"), F.col("tags")), 9).alias("score")), "tags", n)


def token_signal(spark, sf_dir, n=PER_SIGNAL):
    """Jaccard of the query's words and the text's."""
    r = records(spark, sf_dir).select("id", S.tokens(F.col("content")).alias("own")).crossJoin(F.broadcast(_queries(spark)))
    return _top(r.select("query", "id", F.round(S.jaccard(F.col("words"), F.col("own")), 9).alias("score")), "tokens", n)


def tag_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_signal(spark, sf_dir, 20).select("query", "id", "score", "rank")


def token_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_signal(spark, sf_dir, 20).select("query", "id", "score", "rank")


def _unit(table: pa.Table) -> tuple[dict, np.ndarray]:
    """Rows of each vector length with their unit vectors, and the rows' ids; vectors that are zero or hold a null or an infinite part are left out."""
    ids = table["id"].combine_chunks()
    column = table["v"].combine_chunks()
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)
    start = np.concatenate([[0], np.cumsum(size)])
    out = {}
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        m = flat[start[rows][:, None] + np.arange(d)]
        norm = np.sqrt((m * m).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        out[int(d)] = rows[ok], m[ok] / norm[ok, None]
    return out, ids.fill_null(-(1 << 63)).to_numpy()  # null comes first, as in the order of Spark


def _block_pair(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best TOP of the right block for each row of the left one, equal scores by id; rows left without a positive score give none."""
    queries, _ = _unit(left)
    others, ids = _unit(right)
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for d, (rows, m) in queries.items():
        if d not in others or not others[d][0].size:
            continue
        cols, v = others[d]
        step = max(1, TILE // cols.size)
        for lo in range(0, rows.size, step):
            score = np.round(m[lo : lo + step] @ v.T, 6)
            least = np.partition(score, -TOP, axis=1)[:, -TOP] if cols.size > TOP else np.full(score.shape[0], -np.inf)
            r, c = np.nonzero((score >= least[:, None]) & (score > 0))
            value = score[r, c]
            order = np.lexsort((ids[cols[c]], -value, r))
            r, c, value = r[order], c[order], value[order]
            place = np.arange(r.size) - np.searchsorted(r, r)
            keep = place < TOP
            found.append((rows[lo + r[keep]], cols[c[keep]], value[keep]))
    q, c, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"row": left["row"].take(pa.array(q)), "query": left["id"].take(pa.array(q)), "vec_id": right["id"].take(pa.array(c)), "score": pa.array(value, pa.float64())})


def blocks(rows: int, numbers: int, cores: int) -> int:
    """Blocks on either side: few, so that little is shuffled, but four pairs for each core while blocks are larger than BLOCK_ROWS."""
    return max(1, -(-numbers * 8 // BLOCK_BYTES), min(-(-rows // BLOCK_ROWS), int(np.ceil(np.sqrt(4 * cores)))))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector the TOP nearest by cosine, itself among them: query, vec_id, score; a vector of another length or without length
    counts as 0.  All pairs are compared, by matrix products of blocks.  A vector is shuffled twice for each block, so these are as large as BLOCK_BYTES
    allows, and of about BLOCK_ROWS vectors only where there would be too few for all cores."""
    e = table(spark, sf_dir, "embeddings").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("v"))
    size = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    n = blocks(size[0], size[1], spark.sparkContext.defaultParallelism)
    own, every = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = e.select("*", own.alias("a"), every.alias("b"))
    right = e.select("*", own.alias("b"), every.alias("a"))
    best = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_block_pair, "row bigint, query bigint, vec_id bigint, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= TOP).select("query", "vec_id", "score")


def bit_signal(spark, sf_dir, n=PER_SIGNAL):
    """Tanimoto of the query's bits and the text's: counted where the text is, as a text's bits are many times the text."""
    hit = B.overlaps(records(spark, sf_dir).select("id", "content"), F.col("content"), list(ASKED))
    return _top(hit.select("query", "id", F.round(F.col("k") / (F.col("rn") + F.col("qn") - F.col("k")), 9).alias("score")), "bits", n)


def ngram_signal(spark, sf_dir, n=PER_SIGNAL):
    """Share of equal positions of the query's MinHash signature and the text's."""
    r = B.agreements(records(spark, sf_dir).select("id", "content"), F.col("content"), _queries(spark), F.col("q"))
    return _top(r.select("query", "id", F.round("share", 9).alias("score")), "ngrams", n)


def bit_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_signal(spark, sf_dir, 20).select("query", "id", "score", "rank")


def ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_signal(spark, sf_dir, 20).select("query", "id", "score", "rank")


def text_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's number of bits and their sum, and its similarity to the record before it in its namespace's numbering."""
    r = records(spark, sf_dir).select("id", "content")
    prev = r.select((F.col("id") + STEPS[1]).alias("pid"), F.col("content").alias("before"))
    t = B.pairs(r.join(prev, F.col("id") == F.col("pid"), "left"), F.col("content"), F.col("before"))
    alike = F.when((F.col("n") > 0) & (F.col("m") > 0), F.col("k") / F.greatest(F.col("n") + F.col("m") - F.col("k"), F.lit(1))).otherwise(0.0)
    return t.select("id", "n", "total", F.round(alike, 6).alias("tanimoto"), F.round(1 - alike, 6).alias("surprise"))


def fuse(signals: DataFrame, n_signals: int) -> DataFrame:
    """Sum of 1 / (61 + rank) over the lists, against the best that is possible."""
    return signals.groupBy("query", "id").agg(F.round(F.sum(1 / (61.0 + F.col("rank"))) / (n_signals / 61.0), 9).alias("fused"))


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, id, bits, ngrams, tags (rank in each signal, null where it isn't in it), fused, graph, cause (scores), pre (before trust), trust, score.

    Three signals fused, the best TOP_K live records of them; then records reached over two links (parent's score x weight x 0.6, from 0.05 on, thirty in
    all), then up to three causes upwards (x 0.8 x 0.9 for each step after the first), each at its best score."""
    lists = stored(bit_signal(spark, sf_dir).unionByName(ngram_signal(spark, sf_dir)).unionByName(tag_signal(spark, sf_dir)))  # PER_SIGNAL rows each
    r = records(spark, sf_dir).where(S.alive()).select("id", "strength", "caused_by", F.round(S.trust(NOW, AUTHORITY), 9).alias("trust"))
    r = stored(r)  # without texts, and read at each step
    w = Window.partitionBy("query").orderBy(F.desc("fused"), "id")
    ranks = lists.groupBy("query", "id").agg(*[F.max(F.when(F.col("signal") == s, F.col("rank"))).alias(s) for s in SIGNALS])
    hit = fuse(lists, len(SIGNALS)).join(r.select("id"), "id").withColumn("i", F.row_number().over(w)).where(F.col("i") <= K).drop("i").join(ranks, ["query", "id"])
    hit = stored(hit.select("query", "id", *SIGNALS, "fused"))  # K rows for each query
    live = r.select("id")
    e = connections(spark, sf_dir).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    seen, front, left = hit.select("query", "id"), hit.select("query", "id", F.col("fused").alias("score")), None
    reached = None
    for hop in (1, 2):
        n = e.join(F.broadcast(front.withColumnRenamed("id", "from")), F.col("a") == F.col("from")).select("query", F.col("b").alias("id"), F.round(F.col("score") * F.col("weight") * 0.6, 9).alias("score"))  # the front has K rows or EXPANDED for each query
        n = n.where("score >= 0.05").groupBy("query", "id").agg(F.max("score").alias("score")).join(F.broadcast(seen), ["query", "id"], "left_anti").join(live, "id")
        n = n.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
        n = n.where(F.col("i") <= EXPANDED) if left is None else n.join(F.broadcast(left), "query", "left").where(F.col("i") <= EXPANDED - F.coalesce("used", F.lit(0)))
        front = stored(n.select("query", "id", "score"))
        left = front.groupBy("query").agg(F.count(F.lit(1)).alias("used"))
        seen = seen.unionByName(front.select("query", "id"))
        reached = front if reached is None else reached.unionByName(front)
    found = hit.select("query", "id", F.col("fused").alias("score")).unionByName(reached)
    up = r.select(F.col("id").alias("child"), F.col("caused_by").alias("parent")).where("parent is not null and parent <> child")
    at, causes = found, None
    for depth in range(3):
        at = up.join(F.broadcast(at.withColumnRenamed("id", "child")), "child").select("query", F.col("parent").alias("id"), "score").join(live, "id").join(F.broadcast(seen), ["query", "id"], "left_anti")
        step = at.select("query", "id", F.round(F.col("score") * 0.8 * 0.9**depth, 9).alias("score"))
        causes = step if causes is None else causes.unionByName(step)
    causes = causes.groupBy("query", "id").agg(F.max("score").alias("cause"))
    all_ = hit.join(reached.withColumnRenamed("score", "graph"), ["query", "id"], "full_outer").join(causes, ["query", "id"], "full_outer")
    all_ = all_.withColumn("pre", F.coalesce("fused", "graph", "cause")).join(r.select("id", "strength", "trust"), "id")
    return all_.select("query", "id", *SIGNALS, "fused", "graph", "cause", "pre", "trust", F.round(F.col("pre") * F.col("strength") * F.col("trust"), 9).alias("score"))


def recall_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, id, score, rank: the ten best records of the whole recall for each query."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return recall(spark, sf_dir).select("query", "id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K)


def recall_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that the recall touches, with where its score comes from."""
    return recall(spark, sf_dir)


def overlays(matched: DataFrame, effects: DataFrame, cap: float) -> DataFrame:
    """matched (query, id, score, pos) with scores times the record's multiplier (1 if it has none), kept within the cap, in the new order; `pos` moves by two places at most.

    Nothing changes for queries with fewer than four records or none with a multiplier."""
    j = matched.join(effects, "id", "left").withColumn("m", F.coalesce("multiplier", F.lit(1.0)))
    w = Window.partitionBy("query")
    on = (F.count(F.lit(1)).over(w) >= 4) & (F.count("multiplier").over(w) > 0)
    new = F.when(on, F.round(F.greatest(F.least(F.col("score") * F.col("m"), F.col("score") * (1 + cap)), F.col("score") * (1 - cap)), 9)).otherwise(F.col("score"))
    return j.select("query", "id", new.alias("score"), "pos").groupBy("query").applyInPandas(_settle, "query int, id bigint, score double, pos int")


def _settle(pdf):
    """At most twenty rows: by score, then swapped back until none is more than two places from where it was."""
    rows = sorted(pdf[["query", "id", "score", "pos"]].itertuples(index=False), key=lambda r: (-r.score, r.pos))
    for _ in range(len(rows) ** 2):
        for i, r in enumerate(rows):
            if abs(i - r.pos) > 2:
                to = max(i - 1, r.pos) if i > r.pos else min(i + 1, r.pos)
                rows[i], rows[to] = rows[to], rows[i]
                break
        else:
            break
    out = pdf[["query", "id", "score", "pos"]].iloc[: len(rows)].copy()
    for k, name in enumerate(("query", "id", "score")):
        out[name] = [r[k] for r in rows]
    out["pos"] = range(len(rows))
    return out.astype({"pos": "int32"})


def _multipliers(spark, sf_dir) -> list[tuple[DataFrame, float]]:
    """Of beliefs, concepts, causal patterns and policy hints: id and multiplier, and the cap."""
    from . import beliefs as L
    from .concepts import concept_records

    rb = stored(L.record_beliefs(spark, sf_dir).select("id", "key", "state"))
    by = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col(c))
    one = rb.select("id", by({"Resolved": 1.05, "Singleton": 1.02, "Unresolved": 0.97, "Empty": 1.0}, "state").alias("multiplier"))
    two = concept_records(spark, sf_dir).select("id", F.when(F.col("state") == "Stable", 1.04).when(F.col("state") == "Candidate", 1.02).alias("multiplier")).where("multiplier is not null")
    p = L.patterns(spark, sf_dir).where("state = 'Stable'").select("cause", "effect")
    keys = p.select(F.col("effect").alias("k"), F.lit(1.03).alias("multiplier")).unionByName(p.select(F.col("cause").alias("k"), F.lit(1.01).alias("multiplier"))).groupBy("k").agg(F.max("multiplier").alias("multiplier"))
    three = rb.join(keys, F.col("key") == F.col("k")).select("id", "multiplier")
    h = L.hints(spark, sf_dir).select("cause", "effect", F.when(F.col("action").isin("prefer", "recommend") & (F.col("state") == "Stable"), 1.02).when(F.col("action").isin("prefer", "recommend") & (F.col("state") == "Candidate") & (F.col("policy") >= 0.70), 1.01).when((F.col("action") == "avoid") & (F.col("state") == "Stable"), 0.99).alias("m")).where("m is not null")
    hk = h.select(F.explode(F.array("cause", "effect")).alias("k"), "m").groupBy("k").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).select("k", F.when(F.col("lo") < 1, F.col("lo")).otherwise(F.col("hi")).alias("multiplier"))
    four = rb.join(hk, F.col("key") == F.col("k")).select("id", "multiplier")
    return [(one, 0.05), (two, 0.04), (three, 0.03), (four, 0.02)]


def overlay_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall's ten best after beliefs, concepts, causal patterns and policy hints have each moved them a little: query, id, score, pos (from 0), was."""
    base = stored(recall_fused(spark, sf_dir).select("query", "id", "score", (F.col("rank") - 1).cast("int").alias("pos")))
    out = base
    for effects, cap in _multipliers(spark, sf_dir):
        out = overlays(out, effects, cap)
    return out.join(base.select("query", "id", F.col("pos").alias("was")), ["query", "id"])


def belief_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ten best would score by their beliefs alone (x 1.10, 1.05, 0.95), and their rank then; a report, nothing moves."""
    from . import beliefs as L

    base = recall_fused(spark, sf_dir)
    m = F.element_at(F.create_map(*[F.lit(x) for kv in {"Resolved": 1.10, "Singleton": 1.05, "Unresolved": 0.95, "Empty": 1.0}.items() for x in kv]), F.col("state"))
    j = base.join(L.record_beliefs(spark, sf_dir).select("id", "state"), "id", "left").withColumn("shadow", F.round(F.col("score") * F.coalesce(m, F.lit(1.0)), 9))
    return j.select("query", "id", "rank", "score", "shadow", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shadow"), "rank")).alias("shadow_rank"))


def explain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each record stands: its belief and stance, the strongest pattern of that belief, the hints on it, its cause and the step above."""
    from . import beliefs as L

    b = L.record_beliefs(spark, sf_dir)
    p = L.patterns(spark, sf_dir).select(F.explode(F.array("cause", "effect")).alias("k"), F.round("strength", 6).alias("strength"), "cause", "effect").groupBy("k").agg(F.max("strength").alias("pattern"), F.count(F.lit(1)).alias("patterns"))
    h = L.hints(spark, sf_dir).select(F.explode(F.array("cause", "effect")).alias("hk"), "action").groupBy("hk").agg(F.count(F.lit(1)).alias("hints"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))
    r = records(spark, sf_dir).select("id", "caused_by")
    up = r.select(F.col("id").alias("pid"), F.col("caused_by").alias("above"))
    j = r.join(b, "id", "left").join(p, F.col("key") == F.col("k"), "left").join(h, F.col("key") == F.col("hk"), "left").join(up, F.col("caused_by") == F.col("pid"), "left")
    return j.select("id", "key", "stance", "state", "pattern", F.coalesce("patterns", F.lit(0)).alias("patterns"), F.coalesce("hints", F.lit(0)).alias("hints"), F.coalesce("actions", F.lit("")).alias("actions"), "caused_by", "above")


def hybrid_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag score plus 0.1 / (60 + rank by recency) among the records of the list."""
    t = tag_signal(spark, sf_dir).join(records(spark, sf_dir).select("id", "created_at"), "id")
    w = Window.partitionBy("query").orderBy(F.desc("created_at"), "id")
    return t.select("query", "id", F.round(F.col("score") + 0.1 / (60 + F.row_number().over(w) - 1), 9).alias("score"))


def graph_expand_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the suppliers of nation 7 along two hops of links: parent's score x weight x 0.6, from 0.05 on, best path, no way back."""
    e = links(spark, sf_dir)
    seen = table(spark, sf_dir, "supplier").where("s_nationkey = 7").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.lit(1.0).alias("score"), F.lit(0).alias("hop"))
    front = seen
    for hop in (1, 2):
        nxt = front.join(e, front["node"] == e["a"]).select(F.col("b").alias("node"), F.round(F.col("score") * F.col("weight") * 0.6, 9).alias("score"))
        front = nxt.where("score >= 0.05").groupBy("node").agg(F.max("score").alias("score")).join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def ancestor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three steps along the parent link: strength x 0.8 x 0.9 for each step after the first; a record that is its own parent ends the walk."""
    r = records(spark, sf_dir).where(S.alive()).select("id", "strength", "caused_by")
    up = r.select("id", F.col("caused_by").alias("parent"))
    at = r.select(F.col("id").alias("start"), F.col("caused_by").alias("node"), "strength", F.col("id").alias("child"))
    out = None
    for depth in (1, 2, 3):
        at = at.where("node <> child").join(up, F.col("node") == F.col("id")).select("start", "node", "strength", "parent")
        step = at.select("start", F.col("node").alias("ancestor"), F.lit(depth).alias("depth"), F.round(F.col("strength") * 0.8 * 0.9 ** (depth - 1), 9).alias("score"))
        out = step if out is None else out.unionByName(step)
        at = at.select("start", F.col("parent").alias("node"), "strength", F.col("node").alias("child"))
    return out


_WORDS = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {sorted(set(q.split()))})" for i, q in enumerate(ASKED)) + ") AS t(query, words))"
_JACCARD = "len(list_intersect(words, own)) / len(list_distinct(list_concat(words, own)))"


def _signal_sql(name: str, own: str, n: int) -> str:
    return f"""{name} AS (SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM (
  SELECT query, id, round({_JACCARD}, 9) AS score FROM (SELECT id, {own} AS own FROM records), queries) WHERE score > 0) WHERE rank < {n})"""


_TAGS, _TOKENS = "tags", "list_distinct(list_filter(string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda w: w <> ''))"
_TRUST = f"""least(greatest((coalesce(trust_score, 0.5e0) + greatest(0.2e0 * (1 - greatest(({NOW} - created_at) / 86400e0, 0) / 7e0), 0)) * CASE origin {" ".join(f"WHEN '{k}' THEN {v}" for k, v in AUTHORITY.items())} ELSE 0.85 END
  * CASE source_type WHEN 'recorded' THEN 1.0 WHEN 'retrieved' THEN 0.9 WHEN 'inferred' THEN 0.85 WHEN 'generated' THEN 0.8 ELSE 0.9 END, 0.05e0), 1e0)"""
_HOP = lambda n, prev, seen: f"h{n} AS (SELECT b AS node, max(round(score * weight * 0.6e0, 9)) AS score FROM {prev} JOIN links ON node = a WHERE round(score * weight * 0.6e0, 9) >= 0.05 AND b NOT IN (SELECT node FROM {seen}) GROUP BY b)"

_QC = "qc AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(ASKED)) + ") AS t(query, q))"
_A, _BB = B.permutations()
_BITS = f"{B.sql_bits('rb', 'records', 'id', '''lower(trim(content, ' '))''')}, {B.sql_bits('qb', 'qc', 'query', '''lower(trim(q, ' '))''')}, rn AS (SELECT id, count(*) AS rn FROM rb GROUP BY 1), qn AS (SELECT query, count(*) AS qn FROM qb GROUP BY 1)"
_SIGS = f"""perm AS (SELECT unnest({_A.tolist()}) AS a, unnest({_BB.tolist()}) AS b, unnest(range({B.HASHES})) AS k), {B.sql_shingles('rs1', 'records', 'id', 'content')}, rs AS (SELECT id, k, min((a * s + b) % {B.P}) AS v FROM rs1, perm GROUP BY 1, 2),
{B.sql_shingles('qs1', 'qc', 'query', 'q')}, qs AS (SELECT query, k, min((a * s + b) % {B.P}) AS v FROM qs1, perm GROUP BY 1, 2)"""
_RANKED = lambda name, body, n: f"{name} AS (SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM ({body}) WHERE score > 0) WHERE rank < {n})"
_BIT_BODY = "SELECT query, id, round(k / (rn + qn - k), 9) AS score FROM (SELECT query, id, count(*) AS k FROM rb JOIN qb USING (bit) GROUP BY 1, 2) JOIN rn USING (id) JOIN qn USING (query)"
_NGRAM_BODY = f"SELECT query, id, round(count(*) / {B.HASHES}, 9) AS score FROM rs JOIN qs USING (k, v) GROUP BY 1, 2"
_RECALL = f"""WITH RECURSIVE {RECORDS_SQL}, {CONNECTIONS_SQL}, {_WORDS}, {_QC}, {_BITS}, {_SIGS}, {_RANKED('l1', _BIT_BODY, PER_SIGNAL)}, {_RANKED('l2', _NGRAM_BODY, PER_SIGNAL)}, {_signal_sql('l3', _TAGS, PER_SIGNAL)},
r AS (SELECT id, strength, caused_by, round({_TRUST}, 9) AS trust FROM records WHERE strength >= 0.05), u AS (SELECT 1 AS s, query, id, rank FROM l1 UNION ALL SELECT 2, query, id, rank FROM l2 UNION ALL SELECT 3, query, id, rank FROM l3),
f AS (SELECT query, id, max(CASE WHEN s = 1 THEN rank END) AS bits, max(CASE WHEN s = 2 THEN rank END) AS ngrams, max(CASE WHEN s = 3 THEN rank END) AS tags, round(sum(1 / (61e0 + rank)) / (3 / 61e0), 9) AS fused FROM u GROUP BY 1, 2),
hit AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY query ORDER BY fused DESC, id) AS i FROM f WHERE id IN (SELECT id FROM r)) WHERE i <= {K}), e AS (SELECT a, b, max(weight) AS weight FROM connections GROUP BY 1, 2),
n1 AS (SELECT query, b AS id, max(round(fused * weight * 0.6e0, 9)) AS score FROM hit JOIN e ON a = hit.id WHERE round(fused * weight * 0.6e0, 9) >= 0.05 AND b IN (SELECT id FROM r) AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.query = hit.query AND h.id = e.b) GROUP BY 1, 2),
g1 AS (SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM n1) WHERE i <= {EXPANDED}), s1 AS (SELECT query, id FROM hit UNION ALL SELECT query, id FROM g1),
n2 AS (SELECT query, b AS id, max(round(score * weight * 0.6e0, 9)) AS score FROM g1 JOIN e ON a = g1.id WHERE round(score * weight * 0.6e0, 9) >= 0.05 AND b IN (SELECT id FROM r) AND NOT EXISTS (SELECT 1 FROM s1 h WHERE h.query = g1.query AND h.id = e.b) GROUP BY 1, 2),
g2 AS (SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS i FROM n2) z WHERE i <= {EXPANDED} - (SELECT count(*) FROM g1 WHERE g1.query = z.query)),
graph AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2), s2 AS (SELECT query, id FROM hit UNION ALL SELECT query, id FROM graph), found AS (SELECT query, id, fused AS score FROM hit UNION ALL SELECT query, id, score FROM graph),
up AS (SELECT id AS child, caused_by AS parent FROM r WHERE caused_by <> id AND caused_by IN (SELECT id FROM r)),
walk AS (SELECT query, parent AS id, score, 0 AS depth FROM found JOIN up ON child = found.id WHERE (query, parent) NOT IN (SELECT (query, id) FROM s2) UNION ALL SELECT query, parent, score, depth + 1 FROM walk JOIN up ON child = walk.id WHERE depth < 2 AND (query, parent) NOT IN (SELECT (query, id) FROM s2)),
cause AS (SELECT query, id, max(round(score * 0.8e0 * power(0.9e0, depth), 9)) AS cause FROM walk GROUP BY 1, 2),
out AS (SELECT coalesce(hit.query, graph.query, cause.query) AS query, coalesce(hit.id, graph.id, cause.id) AS id, bits, ngrams, tags, fused, graph.score AS graph, cause.cause AS cause FROM hit FULL JOIN graph ON graph.query = hit.query AND graph.id = hit.id FULL JOIN cause ON cause.query = coalesce(hit.query, graph.query) AND cause.id = coalesce(hit.id, graph.id)),
recall AS (SELECT query, out.id, bits, ngrams, tags, fused, graph, cause, coalesce(fused, graph, cause) AS pre, trust, round(coalesce(fused, graph, cause) * strength * trust, 9) AS score FROM out JOIN r ON r.id = out.id)"""
_LAYERS = _B.removeprefix(f"WITH RECURSIVE {RECORDS_SQL}, ")
_HINTS = _H.removeprefix(f"{_P}, ")
QUERIES = {f.__name__: f for f in (recall_fused, recall_trace, overlay_rerank, belief_shadow, explain_records, bit_topk, ngram_topk, text_bits, tag_jaccard_topk, token_jaccard_topk, cosine_topk, hybrid_recency, graph_expand_2hop, ancestor_walk)}
ORACLE_SQL = {
    "tag_jaccard_topk": f"WITH {RECORDS_SQL}, {_WORDS}, {_signal_sql('t', _TAGS, 20)} SELECT * FROM t",
    "token_jaccard_topk": f"WITH {RECORDS_SQL}, {_WORDS}, {_signal_sql('t', _TOKENS, 20)} SELECT * FROM t",
    "cosine_topk": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b)
SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM p WHERE score > 0) WHERE n <= {TOP}""",
    "recall_fused": f"{_RECALL} SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM recall) WHERE rank <= {K}",
    "recall_trace": f"{_RECALL} SELECT * FROM recall",
    "belief_shadow": f"""{_RECALL}, {_LAYERS}, top AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM recall), s AS (SELECT query, top.id, rank, score, round(score * CASE state WHEN 'Resolved' THEN 1.1e0 WHEN 'Singleton' THEN 1.05e0 WHEN 'Unresolved' THEN 0.95e0 ELSE 1e0 END, 9) AS shadow
FROM top LEFT JOIN g ON g.id = top.id LEFT JOIN b USING (key) WHERE rank <= {K}) SELECT *, row_number() OVER (PARTITION BY query ORDER BY shadow DESC, rank) AS shadow_rank FROM s""",
    "explain_records": f"""{_P}, pp AS (SELECT key, max(round(strength, 6)) AS pattern, count(*) AS patterns FROM (SELECT unnest([cause, effect]) AS key, strength FROM p) GROUP BY 1), {_HINTS}, hh AS (SELECT key, count(*) AS hints, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM (SELECT unnest([cause, effect]) AS key, action FROM h) GROUP BY 1)
SELECT r.id, g.key, CASE WHEN g.id IS NOT NULL THEN CASE WHEN g.semantic_type = 'contradiction' OR g.conflict > g.support THEN 'oppose' ELSE 'support' END END AS stance, CASE WHEN g.id IS NOT NULL THEN coalesce(b.state, 'Empty') END AS state, pattern, coalesce(patterns, 0) AS patterns, coalesce(hints, 0) AS hints, coalesce(actions, '') AS actions, r.caused_by, x.caused_by AS above
FROM records r LEFT JOIN g ON g.id = r.id LEFT JOIN b ON b.key = g.key LEFT JOIN pp ON pp.key = g.key LEFT JOIN hh ON hh.key = g.key LEFT JOIN records x ON x.id = r.caused_by""",
    "bit_topk": f"WITH {RECORDS_SQL}, {_QC}, {_BITS}, {_RANKED('t', _BIT_BODY, 20)} SELECT * FROM t",
    "ngram_topk": f"WITH {RECORDS_SQL}, {_QC}, {_SIGS}, {_RANKED('t', _NGRAM_BODY, 20)} SELECT * FROM t",
    "text_bits": f"""WITH {RECORDS_SQL}, {_QC}, {_BITS}, m AS (SELECT id, count(*) AS n, CAST(sum(bit) AS BIGINT) AS total FROM rb GROUP BY 1), j AS (SELECT x.id, count(*) AS k FROM rb x JOIN rb y ON y.id = x.id - {STEPS[1]} AND x.bit = y.bit GROUP BY 1),
t AS (SELECT r.id, coalesce(m.n, 0) AS n, coalesce(m.total, 0) AS total, coalesce(k / (m.n + p.n - k), 0e0) AS t FROM records r LEFT JOIN m USING (id) LEFT JOIN m p ON p.id = r.id - {STEPS[1]} LEFT JOIN j ON j.id = r.id) SELECT id, n, total, round(t, 6) AS tanimoto, round(1 - t, 6) AS surprise FROM t""",
    "hybrid_recency": f"""WITH {RECORDS_SQL}, {_WORDS}, {_signal_sql('t', _TAGS, PER_SIGNAL)}
SELECT query, id, round(score + 0.1e0 / (60 + row_number() OVER (PARTITION BY query ORDER BY created_at DESC, id) - 1), 9) AS score FROM t JOIN records USING (id)""",
    "graph_expand_2hop": f"""WITH {LINKS_SQL}, h0 AS (SELECT 's' || s_suppkey AS node, 1e0 AS score FROM supplier WHERE s_nationkey = 7), {_HOP(1, 'h0', 'h0')},
s1 AS (SELECT node FROM h0 UNION ALL SELECT node FROM h1), {_HOP(2, 'h1', 's1')}
SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2""",
    "ancestor_walk": f"""WITH RECURSIVE {RECORDS_SQL}, r AS (SELECT id, strength, caused_by FROM records WHERE strength >= 0.05),
w AS (SELECT r.id AS start, r.strength AS s, p.id AS node, p.caused_by AS up, 1 AS depth FROM r JOIN r p ON p.id = r.caused_by AND p.id <> r.id
  UNION ALL SELECT w.start, w.s, p.id, p.caused_by, depth + 1 FROM w JOIN r p ON p.id = w.up AND p.id <> w.node WHERE depth < 3)
SELECT start, node AS ancestor, depth, round(s * 0.8e0 * power(0.9e0, depth - 1), 9) AS score FROM w""",
}
