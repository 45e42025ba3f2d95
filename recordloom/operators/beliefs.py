"""From records to beliefs, causal patterns between beliefs, policy hints and back: hypotheses, resolution, gates, suppression, feedback, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import text as T
from ..functions.counting import counted, layered, stored
from ..sources.records import NOW, RECORDS_SQL, records
from . import sqltext as Q

DAY, WEEK, CYCLE = 86400, 7 * 86400, 10 * 86400
BRIDGES = {"ui": "frontend", "auth": "authentication", "deploy": "release"}


def claim_key(mode: str) -> Column:
    """Coarse key of a claim.  standard, top_one, pair: namespace, that many first tags in order, type; bridge: the first three distinct tags after synonyms; semantic: namespace and type alone."""
    tags = F.array_sort("tags")
    if mode == "bridge":
        table = F.create_map(*[F.lit(x) for kv in BRIDGES.items() for x in kv])
        tags = F.array_sort(F.array_distinct(F.transform("tags", lambda t: F.coalesce(table[F.lower(F.trim(t))], F.lower(F.trim(t))))))
    parts = [F.col("namespace"), F.array_join(F.slice(tags, 1, {"standard": 3, "bridge": 3, "pair": 2, "top_one": 1}.get(mode, 1)), ","), F.col("semantic_type")]
    return F.concat_ws(":", *(parts if mode != "semantic" else (parts[0], parts[2])))


def fingerprint() -> Column:
    """Distinct tags in lower case, in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != ""))), " ")


def signature() -> Column:
    """What an effect looks like: its tags, or its type and text where it has none."""
    tags = F.array_sort(F.array_distinct(F.transform("tags", F.lower)))
    return F.when(F.size("tags") > 0, F.array_join(tags, "|")).otherwise(F.concat("semantic_type", F.lit(":"), F.lower("content")))


def claim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select("id", *[claim_key(m).alias(m) for m in ("standard", "top_one", "pair", "bridge", "semantic")], fingerprint().alias("fingerprint"), F.md5(signature()).alias("signature"), F.floor(F.col("created_at") / DAY).cast("bigint").alias("day"))


def grouped(r: DataFrame, mode: str = "semantic") -> DataFrame:
    """Live records with ten bytes of text or more, and their key; without tags only where the key has none."""
    r = r.where(S.alive() & (F.octet_length("content") >= 10))
    r = r if mode == "semantic" else r.where(F.size("tags") > 0)
    return r.select("*", claim_key(mode).alias("key"))


def hypotheses(g: DataFrame) -> DataFrame:
    """By key and stance, for keys with two records or more."""
    oppose = (F.col("semantic_type") == "contradiction") | (F.col("conflict") > F.col("support"))
    age = (F.lit(NOW) - F.max("last_activated")) / DAY
    h = g.withColumn("stance", F.when(oppose, "oppose").otherwise("support")).groupBy("key", "namespace", "semantic_type", "stance").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.avg("confidence").alias("conf"), F.sum("support").alias("support"), F.sum("conflict").alias("conflict"), F.sum("volatility").alias("vol"),
        F.exp(-F.greatest(age, F.lit(0.0)) / 14).alias("recency"), (1 / (1 + F.coalesce(F.var_samp("confidence"), F.lit(0.0)))).alias("consistency"),
    )
    score = (1 + F.log(1 + F.col("support"))) * F.col("conf") * F.col("recency") * F.col("consistency") - 0.35 * F.log(1 + F.col("conflict"))
    return h.withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 9))


def _resolved(h: DataFrame) -> DataFrame:
    order = F.struct(F.col("score"), F.col("stance"))  # "support" comes after "oppose" and so wins a tie
    b = h.groupBy("key", "namespace", "semantic_type").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_hyp"), F.max(F.struct(order.alias("o"), "conf", "n", "ids")).alias("one"), F.min("score").alias("low"),
        F.sum("support").alias("support"), F.sum("conflict").alias("conflict"), (F.sum("vol") / F.sum("n")).alias("volatility"),
    ).where("n >= 2")
    top = F.col("one.o.score")
    close = (top / (F.col("low") + 1e-6) < 1.15) & (top - F.col("low") < 0.10)
    b = b.withColumn("state", F.when(F.col("n_hyp") == 1, "Singleton").when(close, "Unresolved").otherwise("Resolved"))
    return b.withColumn("winner", F.when(F.col("state") != "Unresolved", F.col("one.o.stance")))


def beliefs(spark: SparkSession, sf_dir: str, mode: str = "semantic") -> DataFrame:
    return layered(spark, sf_dir, f"beliefs-{mode}", lambda: build_beliefs(spark, sf_dir, mode))


def build_beliefs(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """key, namespace, semantic_type, n, n_hyp, state, winner, score, confidence, support, conflict, stability, volatility.

    The cycle before is the same over the records that were there CYCLE seconds ago; a winner with the same records as then is stable for two cycles."""
    r = records(spark, sf_dir)
    old = _resolved(hypotheses(grouped(r.where(F.col("created_at") < NOW - CYCLE), mode))).where("winner is not null")
    old = old.select(F.col("key").alias("k"), F.struct("winner", "one.n", "one.ids").alias("was"))
    b = _resolved(hypotheses(grouped(r, mode))).join(old, F.col("key") == F.col("k"), "left")
    stability = F.when(F.col("winner").isNull(), 0.0).when(F.col("was") == F.struct("winner", "one.n", "one.ids"), 2.0).otherwise(1.0)
    return b.select("key", "namespace", "semantic_type", "n", "n_hyp", "state", "winner", F.col("one.o.score").alias("score"), F.col("one.conf").alias("confidence"), "support", "conflict", stability.alias("stability"), "volatility", F.col("was.winner").alias("before"))


def belief_resolution(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    return b.select("key", "n", "n_hyp", "state", "winner", *[F.round(c, 6).alias(c) for c in ("score", "confidence", "volatility")], "support", "conflict", "stability")


def belief_report(spark, sf_dir):
    """Counts of a rebuild: beliefs by state, new and gone ones, revisions, churn, mean stability."""
    b = beliefs(spark, sf_dir)
    old = _resolved(hypotheses(grouped(records(spark, sf_dir).where(F.col("created_at") < NOW - CYCLE)))).select(F.col("key").alias("k"))
    j = b.join(old, F.col("key") == F.col("k"), "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    here = F.col("key").isNotNull()
    revised = count(F.col("before").isNotNull() & (F.col("stability") < 2))
    return j.agg(count(here).alias("beliefs"), F.coalesce(F.sum("n_hyp"), F.lit(0)).alias("hypotheses"), *[count(F.col("state") == s).alias(s.lower()) for s in ("Resolved", "Unresolved", "Singleton")], count(here & F.col("k").isNull()).alias("created"), count(~here).alias("pruned"), revised.alias("revisions"), F.round(revised / F.greatest(count(here), F.lit(1)), 6).alias("churn"), F.round(F.avg("stability"), 6).alias("avg_stability"))


def belief_instability(spark, sf_dir):
    b = beliefs(spark, sf_dir)
    count = lambda c: F.count(F.when(c, 1))
    v = F.round("volatility", 9)
    return b.agg(F.count(F.lit(1)).alias("total"), count(v >= 0.20).alias("high"), count((v >= 0.05) & (v < 0.20)).alias("medium"), count(v < 0.05).alias("low"), count(F.col("stability") <= 1).alias("low_stability"), F.round(F.avg("volatility"), 6).alias("avg_volatility"), F.round(F.avg("stability"), 6).alias("avg_stability"))


def volatile_beliefs(spark, sf_dir):
    """The twenty most volatile from 0.20 on."""
    return beliefs(spark, sf_dir).select("key", "state", F.round("volatility", 6).alias("volatility")).where("volatility >= 0.20").orderBy(F.desc("volatility"), "key").limit(20)


def unstable_beliefs(spark, sf_dir):
    """The twenty least stable, the more volatile ones first."""
    return beliefs(spark, sf_dir).select("key", "state", "stability", F.round("volatility", 6).alias("volatility")).where("stability <= 1").orderBy("stability", F.desc("volatility"), "key").limit(20)


def beliefs_by_state(spark, sf_dir):
    return beliefs(spark, sf_dir).where("state = 'Resolved'").select("key", "winner", F.round("score", 6).alias("score"))


def record_beliefs(spark, sf_dir):
    """Each grouped record with its hypothesis and its belief's state."""
    oppose = (F.col("semantic_type") == "contradiction") | (F.col("conflict") > F.col("support"))
    g = grouped(records(spark, sf_dir)).select("id", "key", F.when(oppose, "oppose").otherwise("support").alias("stance"))
    b = beliefs(spark, sf_dir).select(F.col("key").alias("k"), "state", "winner")
    return g.join(b, F.col("key") == F.col("k"), "left").select("id", "key", "stance", F.coalesce("state", F.lit("Empty")).alias("state"), (F.col("stance") == F.col("winner")).alias("wins"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir, "patterns", lambda: build_patterns(spark, sf_dir))


def build_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal patterns between resolved beliefs of a namespace: explicit links and records that follow within seven days.

    Pairs of records aren't listed: each record is counted against each belief of its namespace.  Records without a resolved belief take no part.
    Columns: namespace, cause, effect, support, explicit, temporal, windows, causes, effects, lift, consistency, stability, variants, positive,
    negative, counter (explicit support of the cause's other effects), explicit_total, explicit_variants, strength, state."""
    known = beliefs(spark, sf_dir).where("state in ('Resolved', 'Singleton')").select(F.col("key").alias("k"))
    pos, neg = T.polarity(F.col("tags"), F.col("content"), F.col("semantic_type"), T.AMBIGUOUS)
    m = grouped(records(spark, sf_dir)).join(known, F.col("key") == F.col("k")).select("id", "namespace", "key", F.col("created_at").cast("bigint").alias("t"), "strength", "caused_by", pos.alias("pos"), neg.alias("neg"), F.md5(signature()).alias("sign"))
    m = stored(m)  # without texts, and read six times
    keys = m.select(F.col("namespace").alias("ns"), F.col("key").alias("other")).distinct()
    probe = m.select("id", "namespace", "key", "t").join(keys, F.col("namespace") == F.col("ns")).where("key <> other").drop("ns")
    ask = lambda x, strict, sign, side: F.struct(x.cast("bigint").alias("x"), F.lit(strict).alias("strict"), F.lit(sign).alias("sign"), F.lit(side).alias("side"))
    t = F.col("t")
    q = probe.select("id", "namespace", F.col("key").alias("own"), F.col("other").alias("key"), "t", F.explode(F.array(ask(t + WEEK, False, 1, "cause"), ask(t, False, -1, "cause"), ask(t, True, 1, "effect"), ask(t - WEEK, True, -1, "effect"))).alias("q")).select("id", "namespace", "own", "key", "t", "q.*")
    c = counted(m.select("namespace", "key", F.col("t").alias("x")), q, ["namespace", "key"], DAY)
    near = c.groupBy("id", "namespace", "own", "key", "side", "t").agg(F.sum(F.col("sign") * F.col("n")).alias("n")).where("n > 0")
    pick = lambda a, b: F.when(F.col("side") == "cause", F.col(a)).otherwise(F.col(b))
    near = near.select("id", "namespace", pick("own", "key").alias("cause"), pick("key", "own").alias("effect"), "side", "t", "n", F.lit(0).alias("told"))
    up = m.select(F.col("id").alias("cid"), F.col("namespace").alias("cns"), F.col("key").alias("ckey"), F.col("t").alias("ct"))
    told = m.where("caused_by is not null").join(up, (F.col("caused_by") == F.col("cid")) & (F.col("namespace") == F.col("cns"))).where("key <> ckey and id <> cid")
    inside = ((F.col("t") > F.col("ct")) & (F.col("t") - F.col("ct") <= WEEK)).cast("int")
    both = told.select("namespace", F.col("ckey").alias("cause"), F.col("key").alias("effect"), F.explode(F.array(F.struct(F.col("cid").alias("id"), F.lit("cause").alias("side"), F.col("ct").alias("t")), F.struct("id", F.lit("effect").alias("side"), "t"))).alias("e"), (-inside).alias("n"), F.lit(1).alias("told"))
    ends = near.unionByName(both.select("e.id", "namespace", "cause", "effect", "e.side", "e.t", "n", "told"))
    ends = stored(ends.groupBy("namespace", "cause", "effect", "side", "id", "t").agg(F.sum("n").alias("n"), F.sum("told").alias("told")))
    p = ["namespace", "cause", "effect"]
    later = counted(ends.where("side = 'cause'").select(*p, F.col("t").alias("x")), ends.where("side = 'effect'").select(*p, F.col("t").alias("x"), F.lit(True).alias("strict")), p, DAY).groupBy(*p).agg(F.sum("n").alias("later"))
    e = ends.join(m.select(F.col("id").alias("mid"), "strength", "pos", "neg", "sign"), F.col("id") == F.col("mid"))
    cause, effect = F.col("side") == "cause", F.col("side") == "effect"
    g = e.groupBy(*p).agg(
        F.sum(F.when(cause, F.col("told"))).alias("explicit"), F.sum(F.when(cause, F.col("n"))).alias("temporal"), F.count(F.when(cause, 1)).alias("causes"), F.count(F.when(effect, 1)).alias("effects"),
        F.size(F.collect_set(F.when(effect & (F.col("n") > 0), F.floor(F.col("t") / DAY)))).alias("windows"), F.countDistinct(F.when(effect, F.col("sign"))).alias("variants"),
        F.sum(F.when(effect, F.col("pos"))).alias("positive"), F.sum(F.when(effect, F.col("neg"))).alias("negative"), F.avg(F.when(effect, F.col("strength"))).alias("mean"), F.stddev_pop(F.when(effect, F.col("strength"))).alias("sd"),
    )
    total = records(spark, sf_dir).groupBy(F.col("namespace").alias("ns")).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("namespace", "cause")
    g = g.join(later, p, "left").join(total, F.col("namespace") == F.col("ns")).withColumn("support", F.col("explicit") + F.col("temporal"))
    g = g.withColumns({"explicit_total": F.sum("explicit").over(w), "explicit_variants": F.sum((F.col("explicit") > 0).cast("int")).over(w)})
    lift = F.least((F.col("support") / F.col("causes")) / (F.col("effects") / F.col("total")), F.lit(5.0)) / 5
    raw = F.coalesce("later", F.lit(0)) / (F.col("causes") * F.col("effects"))
    consistency = F.when((F.col("explicit") >= 2) & (raw < 0.60), 0.60).otherwise(raw)
    stability = F.when((F.col("effects") >= 2) & (F.col("mean") > 0), F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean"))).otherwise(0.5)
    g = g.withColumns({"lift": lift, "consistency": consistency, "stability": stability, "counter": F.col("explicit_total") - F.col("explicit")})
    full = 0.35 * F.col("lift") + 0.30 * F.col("consistency") + 0.20 * F.col("stability") + 0.15 * F.least(F.log2(F.col("support") + 1.0) / F.log2(F.lit(21.0)), F.lit(1.0))
    g = g.withColumn("strength", F.round(F.when(F.col("support") < 2, 0.3 * F.col("lift")).otherwise(full), 9))
    return g.withColumn("state", F.when(~(gate_support() & gate_repeated() & gate_counterfactual()), "Rejected").when(F.col("strength") >= 0.75, "Stable").when(F.col("strength") >= 0.50, "Candidate").otherwise("Rejected"))


def gate_support() -> Column:
    return F.col("support") >= 2


def gate_repeated(mode: str = "strict") -> Column:
    """Two explicit links or two days with evidence; in the mode "recovery" also a temporal cluster with a good outcome and nothing against it."""
    strict = (F.col("explicit") >= 2) | (F.col("windows") >= 2)
    clean = (F.col("temporal") >= 2) & (F.col("explicit") == 0) & (F.col("counter") == 0) & (F.col("variants") <= 1) & (F.col("negative") == 0) & (F.col("positive") >= 1)
    return strict | clean if mode == "recovery" else strict


def gate_counter() -> Column:
    return F.col("counter") <= F.col("support")


def gate_counterfactual() -> Column:
    """At most half of the evidence against it; one dominant explicit outcome; one kind of effect, unless its outcomes agree."""
    told = F.col("explicit") >= 2
    dominant = (F.col("explicit_variants") <= 1) | (F.col("explicit") / F.greatest("explicit_total", F.lit(1)) > 0.70)
    alike = ~(told & (F.col("explicit_variants") <= 1) & (F.col("variants") > 1))
    agreed = ~(told & (F.col("variants") > 1) & (F.col("positive") >= 2) & (F.col("negative") >= 2))
    return (F.col("counter") / F.greatest(F.col("support") + F.col("counter"), F.lit(1)) <= 0.50) & dominant & alike & agreed


_NUMBERS = ("support", "explicit", "temporal", "windows", "causes", "effects", "variants", "positive", "negative", "counter")


def causal_patterns(spark, sf_dir):
    p = patterns(spark, sf_dir)
    return p.select("namespace", "cause", "effect", *[F.col(c).cast("bigint").alias(c) for c in _NUMBERS], *[F.round(c, 6).alias(c) for c in ("lift", "consistency", "stability", "strength")], gate_support().alias("g_support"), gate_repeated().alias("g_repeated"), gate_repeated("recovery").alias("g_recovery"), gate_counter().alias("g_counter"), gate_counterfactual().alias("g_counterfactual"), "state")


PRESSURE = {"avoid": 1.30, "warn": 1.15, "verify_first": 1.00, "recommend": 0.85, "prefer": 0.75}
SAID = {
    "avoid": "Avoid: records of {c} in [{d}] have led to bad outcomes.", "verify_first": "Verify first: records of {c} in [{d}] show signs of risk.", "prefer": "Prefer: records of {c} in [{d}] have led to good outcomes.",
    "recommend": "Recommend: records of {c} in [{d}] show good signs.", "warn": "Warning: records of {c} in [{d}] have effects of unclear value.",
}


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir, "hints", lambda: build_hints(spark, sf_dir))


def build_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy hints from strong patterns: polarity of the effects, action, domain (two commonest tags of the cause's belief), scores, and state after the weaker of two conflicting hints is suppressed.

    Two hints of a namespace and domain conflict where one is for and one isn't and both come from the same cause."""
    g = grouped(records(spark, sf_dir)).select("key", F.explode("tags").alias("tag")).groupBy("key", "tag").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "tag"))).where("i <= 2")
    domain = g.groupBy(F.col("key").alias("dk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tag"))), lambda x: x["tag"]), "/").alias("domain"))
    b = beliefs(spark, sf_dir).select(F.col("key").alias("bk"), "confidence")
    p = patterns(spark, sf_dir).where((F.col("state") != "Rejected") & (F.col("strength") >= 0.65) & gate_counter())
    p = p.join(domain, F.col("cause") == F.col("dk"), "left").join(b.withColumnsRenamed({"bk": "ck", "confidence": "c1"}), F.col("cause") == F.col("ck")).join(b.withColumnsRenamed({"bk": "ek", "confidence": "c2"}), F.col("effect") == F.col("ek"))
    bad, good = (F.col("negative") > F.col("positive")) & (F.col("negative") >= 2), (F.col("positive") > F.col("negative")) & (F.col("positive") >= 2)
    much = F.col("strength") >= 0.75
    action = F.when(bad & much, "avoid").when(bad, "verify_first").when(good & much, "prefer").when(good, "recommend").otherwise("warn")
    risk = F.when(bad, F.col("strength") * 0.8).when(good, 0.0).otherwise(F.col("strength") * 0.3)
    confidence, utility = (F.col("c1") + F.col("c2")) / 2, F.least(F.col("stability") * F.col("consistency"), F.lit(1.0))
    h = p.select("namespace", F.coalesce("domain", F.lit("")).alias("domain"), "cause", "effect", action.alias("action"), confidence.alias("confidence"), utility.alias("utility"), risk.alias("risk"), F.round(0.35 * F.col("strength") + 0.25 * confidence + 0.20 * utility + 0.20 * F.col("consistency"), 9).alias("policy"))
    w = Window.partitionBy("namespace", "domain", "cause")
    favour = F.col("action").isin("prefer", "recommend")
    best_for, best_not = F.max(F.when(favour, F.struct("policy", "effect"))).over(w), F.max(F.when(~favour, F.struct("policy", "effect"))).over(w)
    h = h.withColumns({"best_for": best_for, "best_not": best_not})
    beaten = F.when(favour, F.col("best_not") > F.struct("policy", "effect")).otherwise(F.col("best_for") > F.struct("policy", "effect"))
    state = F.when(F.coalesce(beaten, F.lit(False)), "Suppressed").when(F.col("policy") >= 0.75, "Stable").when(F.col("policy") >= 0.50, "Candidate").otherwise("Rejected")
    return h.withColumn("state", state).drop("best_for", "best_not")


def policy_hints(spark, sf_dir):
    said = F.lit(None).cast("string")
    for a, text in SAID.items():
        one, two = text.split("{c}")
        two, three = two.split("{d}")
        said = F.when(F.col("action") == a, F.concat(F.lit(one), "cause", F.lit(two), "domain", F.lit(three))).otherwise(said)
    return hints(spark, sf_dir).select("namespace", "domain", "cause", "effect", "action", *[F.round(c, 6).alias(c) for c in ("confidence", "utility", "risk", "policy")], "state", said.alias("text"))


def policy_pressure(spark, sf_dir):
    """The ten areas with the greatest pressure: strengths of active hints by the weight of their action."""
    weight = F.create_map(*[F.lit(x) for kv in PRESSURE.items() for x in kv])
    active = F.col("state").isin("Stable", "Candidate")
    g = hints(spark, sf_dir).groupBy("namespace", "domain").agg(F.round(F.coalesce(F.sum(F.when(active, F.col("policy") * weight[F.col("action")])), F.lit(0.0)), 6).alias("pressure"), *[F.count(F.when(c, 1)).alias(n) for n, c in (("active", active), ("suppressed", F.col("state") == "Suppressed"), ("rejected", F.col("state") == "Rejected"))], F.max_by("action", F.when(active, F.struct("policy", "effect"))).alias("strongest"))
    return g.orderBy(F.desc("pressure"), F.desc("active"), "namespace", "domain").limit(10)


def policy_lifecycle(spark, sf_dir):
    """Hints and their mean strength by state, by action and over all."""
    g = hints(spark, sf_dir).cube("state", "action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("policy"), 6).alias("policy"))
    return g.select(F.coalesce("state", F.lit("all")).alias("state"), F.coalesce("action", F.lit("all")).alias("action"), "n", "policy")


def suppressed_hints(spark, sf_dir):
    return hints(spark, sf_dir).where("state in ('Suppressed', 'Rejected')").select("state", "namespace", "domain", "cause", "effect", F.round("policy", 6).alias("policy")).orderBy(F.desc("policy"), "cause", "effect").limit(20)


def surfaced_hints(spark, sf_dir):
    """Stable hints and strong candidates, strongest first: three of a domain at most, ten in all."""
    order = [F.desc("policy"), F.desc("confidence"), F.desc("risk"), "cause", "effect"]
    h = hints(spark, sf_dir).select("namespace", "domain", "cause", "effect", "action", "state", *[F.round(c, 6).alias(c) for c in ("policy", "confidence", "risk")])
    h = h.where("domain <> '' and (state = 'Stable' or (state = 'Candidate' and policy >= 0.70 and confidence >= 0.55))")
    h = h.withColumn("i", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).where("i <= 3")
    return h.drop("i").orderBy(*order).limit(10)


def belief_feedback(spark, sf_dir):
    """Each belief's confidence and volatility after the pull of the hints and patterns that it takes part in, both bounded."""
    weight = F.when(F.col("state") == "Stable", 1.0).when(F.col("state") == "Candidate", 0.6)
    turn = F.create_map(*[F.lit(x) for kv in {"avoid": -0.10, "verify_first": -0.06, "warn": -0.03, "prefer": 0.05, "recommend": 0.03}.items() for x in kv])
    h = hints(spark, sf_dir).withColumn("d", turn[F.col("action")] * F.col("policy") * weight).where("d is not null")
    h = h.select(F.explode(F.array_distinct(F.array("cause", "effect"))).alias("key"), "d", F.when(F.col("d") < 0, 0.01 * F.col("policy")).otherwise(-0.005 * F.col("policy")).alias("v"))
    s, press = F.col("strength"), F.col("counter") / F.greatest(F.col("support") + F.col("counter"), F.lit(1))
    by = lambda a, b, c: F.when(F.col("state") == "Stable", a).when(F.col("state") == "Candidate", b).otherwise(c)
    p = patterns(spark, sf_dir).select(F.explode(F.array("cause", "effect")).alias("key"), by(0.03 * s, 0.015 * s, -(0.02 + 0.04 * press)).alias("d"), by(-0.02 * s, -0.01 * s, 0.03 + 0.12 * press).alias("v"))
    pull = h.unionByName(p).groupBy(F.col("key").alias("k")).agg(F.sum("d").alias("d"), F.sum("v").alias("v"))
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    b = beliefs(spark, sf_dir).join(pull, F.col("key") == F.col("k"))
    return b.select("key", *[F.round(c, 6).alias(c) for c in ("confidence", "volatility")], F.round(clamp(F.col("confidence") + clamp(F.col("d"), -0.18, 0.08), 0.05, 1.0), 6).alias("new_confidence"), F.round(clamp(F.col("volatility") + clamp(F.col("v"), -0.06, 0.20), 0.0, 1.0), 6).alias("new_volatility"))


def governed_beliefs(spark, sf_dir):
    """After corrections: beliefs whose key's length is even are deprecated (half the confidence, unresolved, stability 0)."""
    out = F.length("key") % 2 == 0
    return beliefs(spark, sf_dir).select("key", F.when(out, "Unresolved").otherwise(F.col("state")).alias("state"), F.round(F.when(out, F.col("confidence") * 0.5).otherwise(F.col("confidence")), 6).alias("confidence"), F.when(out, 0.0).otherwise(F.col("stability")).alias("stability"))


def governed_patterns(spark, sf_dir):
    """After corrections: patterns of contradictions are invalidated and kept as such, those with a trend as their effect are retracted."""
    p = patterns(spark, sf_dir).where(~F.col("effect").endswith(":trend"))
    return p.select("cause", "effect", F.when(F.col("cause").endswith(":contradiction"), "Invalidated").otherwise(F.col("state")).alias("state"), F.round("strength", 6).alias("strength"))


_HYP = lambda name, cond: f"""{name}_h AS (SELECT key, namespace, semantic_type, stance, count(*) AS n, sum(id) AS ids, avg(confidence) AS conf, sum(support) AS support, sum(conflict) AS conflict, sum(volatility) AS vol,
  round(greatest((1 + ln(1 + sum(support))) * avg(confidence) * exp(-greatest(({NOW}e0 - max(last_activated)) / 86400, 0) / 14) / (1 + coalesce(var_samp(confidence), 0)) - 0.35e0 * ln(1 + sum(conflict)), 0), 9) AS score
  FROM (SELECT *, CASE WHEN semantic_type = 'contradiction' OR conflict > support THEN 'oppose' ELSE 'support' END AS stance FROM g WHERE {cond}) GROUP BY 1, 2, 3, 4),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, stance DESC) AS i FROM {name}_h),
{name}_b AS (SELECT key, any_value(namespace) AS namespace, any_value(semantic_type) AS semantic_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_hyp, max(score) AS score, max(CASE WHEN i = 1 THEN conf END) AS confidence, CAST(sum(support) AS BIGINT) AS support, CAST(sum(conflict) AS BIGINT) AS conflict, sum(vol) / sum(n) AS volatility,
  max(CASE WHEN i = 1 THEN stance END) AS top, max(CASE WHEN i = 1 THEN n END) AS top_n, max(CASE WHEN i = 1 THEN ids END) AS top_ids, CASE WHEN count(*) = 1 THEN 'Singleton' WHEN max(score) / (min(score) + 1e-6) < 1.15 AND max(score) - min(score) < 0.1 THEN 'Unresolved' ELSE 'Resolved' END AS state FROM {name}_o GROUP BY 1 HAVING sum(n) >= 2)"""  # noqa: E731
_B = f"""WITH RECURSIVE {RECORDS_SQL}, g AS (SELECT *, concat_ws(':', namespace, semantic_type) AS key FROM records WHERE strength >= 0.05 AND strlen(content) >= 10), {_HYP('cur', 'true')}, {_HYP('old', f'created_at < {NOW - CYCLE}e0')},
b AS (SELECT c.*, CASE WHEN c.state <> 'Unresolved' THEN c.top END AS winner, CASE WHEN o.state <> 'Unresolved' THEN o.top END AS before,
  CASE WHEN c.state = 'Unresolved' THEN 0e0 WHEN o.state <> 'Unresolved' AND o.top = c.top AND o.top_n = c.top_n AND o.top_ids = c.top_ids THEN 2e0 ELSE 1e0 END AS stability FROM cur_b c LEFT JOIN old_b o USING (key))"""
_POS, _NEG = Q.polarity("tags", "content", "semantic_type", T.AMBIGUOUS)
_SIGN = "CASE WHEN len(tags) > 0 THEN array_to_string(list_sort(list_distinct(list_transform(tags, lambda t: lower(t)))), '|') ELSE semantic_type || ':' || lower(content) END"
_P = f"""{_B}, m AS (SELECT id, namespace, key, CAST(created_at AS BIGINT) AS t, strength, caused_by, {_POS} AS pos, {_NEG} AS neg, md5({_SIGN}) AS sign FROM g WHERE key IN (SELECT key FROM b WHERE state <> 'Unresolved')),
pair AS (SELECT x.namespace, x.key AS cause, y.key AS effect, x.id AS a, y.id AS b, x.t AS ta, y.t AS tb, coalesce(y.caused_by = x.id, false) AS told FROM m x JOIN m y ON x.namespace = y.namespace AND x.key <> y.key AND (y.caused_by = x.id OR (y.t > x.t AND y.t - x.t <= {WEEK}))),
ea AS (SELECT DISTINCT namespace, cause, effect, a, ta FROM pair), eb AS (SELECT DISTINCT namespace, cause, effect, b, tb FROM pair),
later AS (SELECT ea.namespace, ea.cause, ea.effect, count(*) FILTER (WHERE tb > ta) AS later FROM ea JOIN eb USING (namespace, cause, effect) GROUP BY 1, 2, 3),
p1 AS (SELECT namespace, cause, effect, count(*) AS support, count(*) FILTER (WHERE told) AS explicit, count(*) FILTER (WHERE NOT told) AS temporal, count(DISTINCT CASE WHEN NOT told THEN tb // 86400 END) AS windows, count(DISTINCT a) AS causes, count(DISTINCT b) AS effects FROM pair GROUP BY 1, 2, 3),
p2 AS (SELECT eb.namespace, eb.cause, eb.effect, count(DISTINCT sign) AS variants, CAST(sum(pos) AS BIGINT) AS positive, CAST(sum(neg) AS BIGINT) AS negative, avg(strength) AS mean, stddev_pop(strength) AS sd FROM eb JOIN m ON m.id = eb.b GROUP BY 1, 2, 3),
p3 AS (SELECT *, CAST(sum(explicit) OVER (PARTITION BY namespace, cause) AS BIGINT) AS explicit_total, sum(CASE WHEN explicit > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY namespace, cause) AS explicit_variants, (SELECT count(*) FROM records r WHERE r.namespace = p1.namespace) AS total FROM p1 JOIN p2 USING (namespace, cause, effect) JOIN later USING (namespace, cause, effect)),
p4 AS (SELECT *, explicit_total - explicit AS counter, least((support / causes) / (effects / total), 5) / 5 AS lift, CASE WHEN explicit >= 2 AND later / (causes * effects) < 0.6 THEN 0.6e0 ELSE later / (causes * effects) END AS consistency,
  CASE WHEN effects >= 2 AND mean > 0 THEN greatest(0e0, 1 - sd / mean) ELSE 0.5e0 END AS stability FROM p3),
p5 AS (SELECT *, round(CASE WHEN support < 2 THEN 0.3e0 * lift ELSE 0.35e0 * lift + 0.3e0 * consistency + 0.2e0 * stability + 0.15e0 * least(log2(support + 1e0) / log2(21e0), 1) END, 9) AS strength, support >= 2 AS g_support, explicit >= 2 OR windows >= 2 AS g_repeated,
  explicit >= 2 OR windows >= 2 OR (temporal >= 2 AND explicit = 0 AND counter = 0 AND variants <= 1 AND negative = 0 AND positive >= 1) AS g_recovery, counter <= support AS g_counter,
  counter / greatest(support + counter, 1) <= 0.5 AND (explicit_variants <= 1 OR explicit / greatest(explicit_total, 1) > 0.7) AND NOT (explicit >= 2 AND explicit_variants <= 1 AND variants > 1) AND NOT (explicit >= 2 AND variants > 1 AND positive >= 2 AND negative >= 2) AS g_counterfactual FROM p4),
p AS (SELECT *, CASE WHEN NOT (g_support AND g_repeated AND g_counterfactual) THEN 'Rejected' WHEN strength >= 0.75 THEN 'Stable' WHEN strength >= 0.5 THEN 'Candidate' ELSE 'Rejected' END AS state FROM p5)"""
_H = f"""{_P}, tg AS (SELECT key, tag, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, tag) AS i FROM (SELECT key, unnest(tags) AS tag FROM g) GROUP BY 1, 2), dom AS (SELECT key, string_agg(tag, '/' ORDER BY i) AS domain FROM tg WHERE i <= 2 GROUP BY 1),
h1 AS (SELECT p.namespace, coalesce(domain, '') AS domain, cause, effect, strength, consistency, CASE WHEN negative > positive AND negative >= 2 THEN -1 WHEN positive > negative AND positive >= 2 THEN 1 ELSE 0 END AS pol, (x.confidence + y.confidence) / 2 AS confidence, least(p.stability * consistency, 1) AS utility
  FROM p LEFT JOIN dom ON dom.key = cause JOIN b x ON x.key = cause JOIN b y ON y.key = effect WHERE p.state <> 'Rejected' AND strength >= 0.65 AND g_counter),
h2 AS (SELECT *, CASE WHEN pol < 0 THEN CASE WHEN strength >= 0.75 THEN 'avoid' ELSE 'verify_first' END WHEN pol > 0 THEN CASE WHEN strength >= 0.75 THEN 'prefer' ELSE 'recommend' END ELSE 'warn' END AS action, CASE WHEN pol < 0 THEN strength * 0.8e0 WHEN pol > 0 THEN 0e0 ELSE strength * 0.3e0 END AS risk,
  round(0.35e0 * strength + 0.25e0 * confidence + 0.2e0 * utility + 0.2e0 * consistency, 9) AS policy FROM h1),
h AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM h2 z WHERE z.namespace = h2.namespace AND z.domain = h2.domain AND z.cause = h2.cause AND (z.pol > 0) <> (h2.pol > 0) AND (z.policy > h2.policy OR (z.policy = h2.policy AND z.effect > h2.effect))) THEN 'Suppressed'
  WHEN policy >= 0.75 THEN 'Stable' WHEN policy >= 0.5 THEN 'Candidate' ELSE 'Rejected' END AS state FROM h2)"""
_R6 = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
_FIRST = lambda n, tags="list_sort(tags)": f"array_to_string({tags}[1:{n}], ',')"
_BRIDGE = "list_sort(list_distinct(list_transform(tags, lambda t: CASE lower(trim(t)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRIDGES.items()) + " ELSE lower(trim(t)) END)))"
_W = "CASE action " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in PRESSURE.items()) + " END"
_TEXT = "CASE action " + " ".join("WHEN '" + k + "' THEN '" + v.replace("{c}", "' || cause || '").replace("{d}", "' || domain || '") + "'" for k, v in SAID.items()) + " END"
QUERIES = {f.__name__: f for f in (claim_keys, belief_resolution, belief_report, belief_instability, volatile_beliefs, unstable_beliefs, beliefs_by_state, record_beliefs, causal_patterns, policy_hints, policy_pressure, policy_lifecycle, suppressed_hints, surfaced_hints, belief_feedback, governed_beliefs, governed_patterns)}
ORACLE_SQL = {
    "claim_keys": f"WITH {RECORDS_SQL} SELECT id, concat_ws(':', namespace, {_FIRST(3)}, semantic_type) AS standard, concat_ws(':', namespace, {_FIRST(1)}, semantic_type) AS top_one, concat_ws(':', namespace, {_FIRST(2)}, semantic_type) AS pair, concat_ws(':', namespace, {_FIRST(3, _BRIDGE)}, semantic_type) AS bridge, concat_ws(':', namespace, semantic_type) AS semantic, array_to_string(list_sort(list_distinct(list_filter(list_transform(tags, lambda t: lower(trim(t))), lambda t: t <> ''))), ' ') AS fingerprint, md5({_SIGN}) AS signature, CAST(floor(created_at / 86400) AS BIGINT) AS day FROM records",
    "belief_resolution": f"{_B} SELECT key, n, n_hyp, state, winner, {_R6('score', 'confidence', 'volatility')}, support, conflict, stability FROM b",
    "belief_report": f"{_B} SELECT (SELECT count(*) FROM b) AS beliefs, (SELECT CAST(coalesce(sum(n_hyp), 0) AS BIGINT) FROM b) AS hypotheses, (SELECT count(*) FROM b WHERE state = 'Resolved') AS resolved, (SELECT count(*) FROM b WHERE state = 'Unresolved') AS unresolved, (SELECT count(*) FROM b WHERE state = 'Singleton') AS singleton, (SELECT count(*) FROM b WHERE key NOT IN (SELECT key FROM old_b)) AS created, (SELECT count(*) FROM old_b WHERE key NOT IN (SELECT key FROM b)) AS pruned, (SELECT count(*) FROM b WHERE before IS NOT NULL AND stability < 2) AS revisions, (SELECT round(count(*) FILTER (WHERE before IS NOT NULL AND stability < 2) / greatest(count(*), 1), 6) FROM b) AS churn, (SELECT round(avg(stability), 6) FROM b) AS avg_stability",
    "belief_instability": f"{_B}, v AS (SELECT *, round(volatility, 9) AS v FROM b) SELECT count(*) AS total, count(*) FILTER (WHERE v >= 0.2) AS high, count(*) FILTER (WHERE v >= 0.05 AND v < 0.2) AS medium, count(*) FILTER (WHERE v < 0.05) AS low, count(*) FILTER (WHERE stability <= 1) AS low_stability, round(avg(volatility), 6) AS avg_volatility, round(avg(stability), 6) AS avg_stability FROM v",
    "volatile_beliefs": f"{_B} SELECT key, state, round(volatility, 6) AS volatility FROM b WHERE round(volatility, 6) >= 0.2 ORDER BY 3 DESC, 1 LIMIT 20",
    "unstable_beliefs": f"{_B} SELECT key, state, stability, round(volatility, 6) AS volatility FROM b WHERE stability <= 1 ORDER BY 3, 4 DESC, 1 LIMIT 20",
    "beliefs_by_state": f"{_B} SELECT key, winner, round(score, 6) AS score FROM b WHERE state = 'Resolved'",
    "record_beliefs": f"{_B}, s AS (SELECT id, key, CASE WHEN semantic_type = 'contradiction' OR conflict > support THEN 'oppose' ELSE 'support' END AS stance FROM g) SELECT id, key, stance, coalesce(state, 'Empty') AS state, stance = winner AS wins FROM s LEFT JOIN b USING (key)",
    "causal_patterns": f"{_P} SELECT namespace, cause, effect, {', '.join(_NUMBERS)}, {_R6('lift', 'consistency', 'stability', 'strength')}, g_support, g_repeated, g_recovery, g_counter, g_counterfactual, state FROM p",
    "policy_hints": f"{_H} SELECT namespace, domain, cause, effect, action, {_R6('confidence', 'utility', 'risk', 'policy')}, state, {_TEXT} AS text FROM h",
    "policy_pressure": f"{_H} SELECT namespace, domain, round(coalesce(sum(policy * {_W}) FILTER (WHERE state IN ('Stable', 'Candidate')), 0e0), 6) AS pressure, count(*) FILTER (WHERE state IN ('Stable', 'Candidate')) AS active, count(*) FILTER (WHERE state = 'Suppressed') AS suppressed, count(*) FILTER (WHERE state = 'Rejected') AS rejected, arg_max(action, (policy, effect)) FILTER (WHERE state IN ('Stable', 'Candidate')) AS strongest FROM h GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 10",
    "policy_lifecycle": f"{_H} SELECT coalesce(state, 'all') AS state, coalesce(action, 'all') AS action, count(*) AS n, round(avg(policy), 6) AS policy FROM h GROUP BY CUBE (state, action)",
    "suppressed_hints": f"{_H} SELECT state, namespace, domain, cause, effect, round(policy, 6) AS policy FROM h WHERE state IN ('Suppressed', 'Rejected') ORDER BY 6 DESC, cause, effect LIMIT 20",
    "surfaced_hints": f"{_H}, k AS (SELECT namespace, domain, cause, effect, action, state, {_R6('policy', 'confidence', 'risk')} FROM h), s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY policy DESC, confidence DESC, risk DESC, cause, effect) AS i FROM k WHERE domain <> '' AND (state = 'Stable' OR (state = 'Candidate' AND policy >= 0.7 AND confidence >= 0.55))) SELECT namespace, domain, cause, effect, action, state, policy, confidence, risk FROM s WHERE i <= 3 ORDER BY policy DESC, confidence DESC, risk DESC, cause, effect LIMIT 10",
    "belief_feedback": f"""{_H}, d1 AS (SELECT cause, effect, policy, CASE action WHEN 'avoid' THEN -0.1e0 WHEN 'verify_first' THEN -0.06e0 WHEN 'warn' THEN -0.03e0 WHEN 'prefer' THEN 0.05e0 ELSE 0.03e0 END * policy * CASE state WHEN 'Stable' THEN 1e0 ELSE 0.6e0 END AS d FROM h WHERE state IN ('Stable', 'Candidate')),
d2 AS (SELECT unnest([cause, effect]) AS key, d, CASE WHEN d < 0 THEN 0.01e0 * policy ELSE -0.005e0 * policy END AS v FROM d1 UNION ALL SELECT unnest([cause, effect]), CASE state WHEN 'Stable' THEN 0.03e0 * strength WHEN 'Candidate' THEN 0.015e0 * strength ELSE -(0.02e0 + 0.04e0 * counter / greatest(support + counter, 1)) END,
  CASE state WHEN 'Stable' THEN -0.02e0 * strength WHEN 'Candidate' THEN -0.01e0 * strength ELSE 0.03e0 + 0.12e0 * counter / greatest(support + counter, 1) END FROM p), d AS (SELECT key, sum(d) AS d, sum(v) AS v FROM d2 GROUP BY 1)
SELECT key, {_R6('confidence', 'volatility')}, round(least(greatest(confidence + least(greatest(d, -0.18e0), 0.08e0), 0.05e0), 1e0), 6) AS new_confidence, round(least(greatest(volatility + least(greatest(v, -0.06e0), 0.2e0), 0e0), 1e0), 6) AS new_volatility FROM b JOIN d USING (key)""",
    "governed_beliefs": f"{_B} SELECT key, CASE WHEN length(key) % 2 = 0 THEN 'Unresolved' ELSE state END AS state, round(CASE WHEN length(key) % 2 = 0 THEN confidence * 0.5e0 ELSE confidence END, 6) AS confidence, CASE WHEN length(key) % 2 = 0 THEN 0e0 ELSE stability END AS stability FROM b",
    "governed_patterns": f"{_P} SELECT cause, effect, CASE WHEN ends_with(cause, ':contradiction') THEN 'Invalidated' ELSE state END AS state, round(strength, 6) AS strength FROM p WHERE NOT ends_with(effect, ':trend')",
}
