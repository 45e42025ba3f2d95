"""Mixing of overlapping sources to target weights by min-cost flow.

A document is a member of every source in its membership array (by default its source and its language), so sources overlap.
Sources are called family:name.  The budget is divided among the families by FAMILIES and within a family by tokens ** TEMPERATURE,
so that small languages repeat and the largest is cut; weights by source may be given instead.
Documents are aggregated by membership pattern, tokens per pattern being the capacity of one pass over it.  Flow goes from each
pattern, whose r-th pass costs r * r per token, to the sources that it is a member of, and on to the sources' quotas.  The
flow of least cost among the largest ones says how many tokens of each pattern count towards each source.

Documents of a pattern have a seeded order, by a hash of their id.  Those at the front get one copy more than the rest, up to
the place where the pattern's flow is used up (a document there counts as a whole, if more than half of it fits); where flow is divided among sources, the places in this order divide copies too.
Every place is found exactly: a table of tokens by 1/4096 of the hash range gives the part that holds it, and only that part
is put in order.  So no group of documents is ever sorted as a whole and the selection itself is a map.

What the driver holds grows with the number of patterns and sources, not with documents.

Defined cases: tokens of a text are ceil(bytes / 4), of null or empty text 0; a text without tokens, or that is a member of
nothing, is not selected; null members count for nothing; rows that repeat an id stand at one place of the order and are
treated alike, as are all rows without an id; quotas beyond what `passes` passes can give are met as far as possible; an empty
table gives an empty result; other columns are kept whatever their names, dotted ones too.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SEED, PASSES, TEMPERATURE, BUDGET, BIN_BITS = 20240, 4, 0.3, 1.0, 12
FAMILIES = {"lang": 0.7, "source": 0.3}


class Flow:
    """Min-cost max-flow by primal-dual phases: one blocking-flow computation for each distinct path cost."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y), self.cap.append(c), self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        """Total cost; afterwards cap[arc ^ 1] is the flow of an arc."""
        n, total = len(self.out), 0
        height = [0] * n
        while True:
            dist, heap = [float("inf")] * n, [(0, s)]
            dist[s] = 0
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    nd = d + self.cost[e] + height[x] - height[y]
                    if self.cap[e] and nd < dist[y]:
                        dist[y] = nd
                        heapq.heappush(heap, (nd, y))
            if dist[t] == float("inf"):
                return total
            far = max(d for d in dist if d < float("inf"))
            for x in range(n):
                height[x] += min(dist[x], far)
            total += (height[t] - height[s]) * self._saturate(s, t, height)

    def _saturate(self, s: int, t: int, height: list[int]) -> int:
        """Largest flow along arcs without reduced cost."""
        pushed = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                x = queue.popleft()
                for e in self.out[x]:
                    y = self.to[e]
                    if self.cap[e] and y not in level and self.cost[e] + height[x] == height[y]:
                        level[y] = level[x] + 1
                        queue.append(y)
            if t not in level:
                return pushed
            at = [0] * len(self.out)
            while True:
                path, x = [], s
                while x != t:
                    while at[x] < len(self.out[x]):
                        e = self.out[x][at[x]]
                        y = self.to[e]
                        if self.cap[e] and level.get(y) == level[x] + 1 and self.cost[e] + height[x] == height[y]:
                            break
                        at[x] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        x = self.to[e ^ 1]
                        at[x] += 1
                        continue
                    path.append(e)
                    x = y
                if x != t:
                    break
                f = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= f
                    self.cap[e ^ 1] += f
                pushed += f


def quotas(patterns: list[tuple[tuple[str, ...], int]], weights: dict[str, float] | None, budget: float, temperature: float, families: dict[str, float] | None = None) -> dict[str, int]:
    """Tokens wanted from each source: budget times all tokens, divided by weight.

    Where none are given, a source's weight is its family's share (alike for all families where `families` is None), divided in the family by tokens ** temperature."""
    size: dict[str, int] = {}
    for members, tokens in patterns:
        for m in members:
            size[m] = size.get(m, 0) + tokens
    if weights is None:
        kin = {k: k.partition(":")[0] for k in size}
        whole_kin: dict[str, float] = {}
        for k, v in size.items():
            whole_kin[kin[k]] = whole_kin.get(kin[k], 0.0) + v**temperature
        weights = {k: (1.0 if families is None else families.get(kin[k], 0.0)) * v**temperature / whole_kin[kin[k]] for k, v in size.items() if v}
    w = {k: v for k, v in weights.items() if v > 0}
    whole, all_w = int(budget * sum(t for _, t in patterns)), sum(w.values())
    out = {k: int(whole * v / all_w) for k, v in sorted(w.items())}
    for k in sorted(out, key=lambda k: (-(whole * w[k] / all_w - out[k]), k))[: whole - sum(out.values())]:
        out[k] += 1
    return out


def route(patterns: list[tuple[tuple[str, ...], int]], quota: dict[str, int], passes: int = PASSES) -> tuple[list[tuple[int, str, int]], int]:
    """(pattern number, source, tokens) of the flow, and its cost."""
    names = sorted(quota)
    base = 2 + len(patterns)
    flow, arcs = Flow(base + len(names)), []
    for i, (members, tokens) in enumerate(patterns):
        for r in range(1, passes + 1):
            flow.arc(0, 2 + i, tokens, r * r)
        arcs += [(i, m, flow.arc(2 + i, base + names.index(m), passes * tokens)) for m in members if m in quota]
    for j, m in enumerate(names):
        flow.arc(base + j, 1, quota[m])
    cost = flow.run(0, 1)
    return [(i, m, flow.cap[e ^ 1]) for i, m, e in arcs if flow.cap[e ^ 1]], cost


def memberships() -> Column:
    return F.array(F.concat(F.lit("source:"), F.col("source").cast("string")), F.concat(F.lit("lang:"), F.col("lang").cast("string")))


def keyed(docs: DataFrame, members: Column | None, seed: int) -> DataFrame:
    """The columns of docs, by number (c0, c1, ...), with __m (sorted members), __tok, __key (h, id): the place in the order."""
    names = docs.columns
    m = F.array_sort(F.array_distinct(F.filter(members if members is not None else memberships(), lambda x: x.isNotNull())))
    text = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint")), 1)
    key = F.struct(h.alias("h"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"))
    out = docs.select(*[F.col(f"`{c}`") for c in names], m, F.ceil(text / 4).cast("bigint"), key, F.col("doc_id").cast("bigint"))
    return out.toDF(*[f"c{i}" for i in range(len(names))], "__m", "__tok", "__key", "__doc")


def plan(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE, passes: int = PASSES, seed: int = SEED, members: Column | None = None, families: dict[str, float] | None = FAMILIES) -> DataFrame:
    """m, bucket, q0, k0, q1, k1: a document of pattern m gives bucket (q1 + 1 if its key <= k1 else q1) - (q0 + 1 if its key <= k0 else q0) copies."""
    spark = docs.sparkSession
    slim = written(keyed(docs, members, seed).select(F.col("__m").alias("m"), F.col("__tok").alias("tok"), F.col("__key").alias("key")).where("tok > 0 and size(m) > 0"), "tokens")
    part = F.shiftright(F.col("key.h"), 63 - BIN_BITS).alias("part")
    bins = written(slim.groupBy("m", part).agg(F.sum("tok").alias("tok")), "parts")
    found = sorted((tuple(r.m), int(r.tok)) for r in bins.groupBy("m").agg(F.sum("tok").alias("tok")).toLocalIterator())
    flows, _ = route(found, quotas(found, weights, budget, temperature, families), passes)
    rows, done = [], {}
    for i, bucket, f in flows:
        a = done.get(i, 0)
        done[i] = b = a + f
        t = found[i][1]
        rows.append((list(found[i][0]), bucket, a // t, a % t, b // t, b % t))
    # found in order of bucket names within a pattern, which is the order that divides the copies
    split = spark.createDataFrame(rows, "m array<string>, bucket string, q0 bigint, r0 bigint, q1 bigint, r1 bigint")
    want = spark.createDataFrame(sorted({(r[0], x) for r in ((tuple(r[0]), r[3], r[5]) for r in rows) for x in r[1:] if x}), "m array<string>, r bigint")
    upto = F.sum("tok").over(Window.partitionBy("m").orderBy("part"))
    inside = bins.select("m", "part", (upto - F.col("tok")).alias("start"), upto.alias("end")).join(want, "m").where("start < r and r <= end").select(F.col("m").alias("wm"), F.col("part").alias("wp"), "start", "r")
    spots = inside.select("wm", "wp", "start").distinct()
    ordered = slim.withColumn("part", part).join(spots, (F.col("m") == F.col("wm")) & (F.col("part") == F.col("wp"))).groupBy("m", "part", "start", "key").agg(F.sum("tok").alias("tok"))
    # twice the middle of each place: a document belongs to the side that holds more than half of it
    middle = 2 * (F.col("start") + F.sum("tok").over(Window.partitionBy("m", "part").orderBy("key"))) - F.col("tok")
    ordered = ordered.select("m", "part", "key", middle.alias("middle"))
    on = (F.col("m") == F.col("wm")) & (F.col("part") == F.col("wp")) & (F.col("middle") < 2 * F.col("r"))
    none = F.struct((F.shiftleft(F.max("wp"), 63 - BIN_BITS) - 1).alias("h"), F.lit((1 << 63) - 1).alias("id"))  # all of the parts before
    last = inside.drop("start").join(ordered, on, "left").groupBy(F.col("wm").alias("m"), "r").agg(F.coalesce(F.max("key"), none).alias("key"))
    last = written(last, "places")
    low, high = last.select(F.col("m").alias("m0"), F.col("r").alias("l0"), F.col("key").alias("k0")), last.select(F.col("m").alias("m1"), F.col("r").alias("l1"), F.col("key").alias("k1"))
    out = split.join(low, (F.col("m") == F.col("m0")) & (F.col("r0") == F.col("l0")), "left").join(high, (F.col("m") == F.col("m1")) & (F.col("r1") == F.col("l1")), "left")
    return written(out.select("m", "bucket", "q0", "k0", "q1", "k1"), "plan")


def _copies(p: str = "") -> Column:
    extra = lambda k: F.coalesce((F.col("__key") <= F.col(p + k)).cast("bigint"), F.lit(0))
    return F.col(p + "q1") + extra("k1") - F.col(p + "q0") - extra("k0")


def mixture(docs: DataFrame, chosen: DataFrame, seed: int = SEED, members: Column | None = None) -> DataFrame:
    """doc_id, bucket, copies, tokens (of one copy) for each document and source that it is selected for."""
    own = keyed(docs, members, seed).select(F.col("__doc").alias("doc_id"), "__m", "__tok", "__key").where("__tok > 0")
    return own.join(chosen, F.col("__m") == F.col("m")).select("doc_id", "bucket", _copies().alias("copies"), F.col("__tok").alias("tokens")).where("copies > 0")


def stage(docs: DataFrame, chosen: DataFrame, seed: int = SEED, members: Column | None = None) -> DataFrame:
    """The columns of docs, each row as often as the mixture takes it."""
    # flows of a pattern follow one another, so all its copies of a document are those up to the last place
    ends = chosen.groupBy("m").agg(F.max(F.struct("q1", F.coalesce(F.col("k1.h"), F.lit(-1)), "k1")).alias("e"))
    ends = ends.select(F.col("m").alias("__pm"), F.col("e.q1").alias("__p_q1"), F.col("e.k1").alias("__p_k1"), F.lit(0).alias("__p_q0"), F.lit(None).cast("struct<h:bigint,id:bigint>").alias("__p_k0"))
    own = keyed(docs, members, seed).where("__tok > 0").join(ends, F.col("__m") == F.col("__pm")).withColumn("__copies", _copies("__p_").cast("int")).where("__copies > 0")
    return own.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mixture(docs, plan(docs))
