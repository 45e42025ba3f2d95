"""Keeping records: log and versions, pages and searches, tenants, retention, maintenance, audit, federated sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits as B
from ..functions import scalars as S
from ..functions import text as T
from ..functions.counting import neighbour
from ..sources.records import CONNECTIONS_SQL, NOW, PHRASES, RECORDS_SQL, _sql_pick, connections, pick, records, table
from ..sources.store import ancestors, checksum, replay
from . import sqltext as Q
from .beliefs import _B

DAY = 86400
RULES = {"cache": (1, 0), "outcome": (7, 20), "alerts": (14, 10), "deploy": (14, 5), "release": (30, 5), "contact": (1, 0)}  # tag: days, newest ones that stay
STATUS = ("active", "completed", "done", "open")


def layer(i: Column) -> Column:
    """The layer of a record: anchors of a person, merged anchors, phantoms without text, others."""
    return F.when(i % 17 == 0, "phantom").when(i % 13 == 0, "user_core").when(i % 31 == 0, "super_core").otherwise("general")


_LAYER = "CASE WHEN id % 17 = 0 THEN 'phantom' WHEN id % 13 = 0 THEN 'user_core' WHEN id % 31 = 0 THEN 'super_core' ELSE 'general' END"


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of two thirds of the documents and a log that stores the rest, changes some, deletes others, and has torn entries: what is alive, by length and hash of its text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("payload"))
    i = F.col("id")
    ops = F.array(F.when(i % 3 == 0, F.struct(F.lit(0).alias("k"), F.lit("store").alias("op"))), F.when(i % 4 == 1, F.struct(F.lit(1).alias("k"), F.lit("update").alias("op"))), F.when(i % 7 == 3, F.struct(F.lit(2).alias("k"), F.lit("delete").alias("op"))))
    log = d.select("id", "payload", F.explode(F.array_compact(ops)).alias("x")).select((i * 3 + F.col("x.k")).alias("seq"), "x.op", "id", F.when(F.col("x.op") == "update", F.concat("payload", F.lit("!"))).when(F.col("x.op") == "store", F.col("payload")).alias("payload"))
    log = log.withColumn("crc", checksum(F.col("payload")) + (F.col("seq") % 2001 == 2000).cast("bigint"))
    got = replay(d.where(i % 3 != 0), log, -1)
    return got.select("id", F.length("payload").cast("bigint").alias("chars"), F.md5("payload").alias("hash"))


def layers(spark, sf_dir):
    """Anchors and merged anchors, by the filter on their layer."""
    r = records(spark, sf_dir).select("id", layer(F.col("id")).alias("dna"), "created_at")
    return r.where("dna in ('user_core', 'super_core')")


def memory_page(spark, sf_dir):
    """The third page of fifty records, newest first, without phantoms, and how many there are in all."""
    r = records(spark, sf_dir).select("id", "created_at", layer(F.col("id")).alias("dna")).where("dna <> 'phantom'")
    page = r.orderBy(F.desc("created_at"), "id").offset(100).limit(50)
    return page.crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("total"))))  # one row


def memory_analytics(spark, sf_dir):
    """Records, oldest and newest by layer, and over all."""
    r = records(spark, sf_dir).select(layer(F.col("id")).alias("dna"), "created_at")
    return r.rollup("dna").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest")).select(F.coalesce("dna", F.lit("all")).alias("dna"), "n", "oldest", "newest")


def next_record(spark, sf_dir):
    """Each record's successor in the order of time, found in buckets of a day: the pointer that is written, and the step beyond it."""
    r = records(spark, sf_dir).select("id", F.col("created_at").cast("bigint").alias("t"))
    n = neighbour(r, [], "t", "id", DAY, after=True).select("id", F.col("near.tie").alias("next_id"))
    two = n.select(F.col("id").alias("mid"), F.col("next_id").alias("then_id"))
    return n.join(two, F.col("next_id") == F.col("mid"), "left").select("id", "next_id", "then_id")


def snapshot_diff(spark, sf_dir):
    """Of two versions of the documents, the second with an edited text and other members: what was added, deleted or modified, by comparing texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = d.where("doc_id % 11 <> 0").withColumnRenamed("text", "was")
    new = d.where("doc_id % 7 <> 0").withColumn("text", F.regexp_replace("text", r"\b(the|die|les|los) ", "$1  "))
    j = old.join(new, "doc_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("text").isNull(), "deleted").when(F.col("was") != F.col("text"), "modified")
    return j.select("doc_id", change.alias("change"), F.length("was").cast("bigint").alias("chars_was"), F.length("text").cast("bigint").alias("chars")).where("change is not null")


def _history(spark, sf_dir) -> DataFrame:
    """Suppliers stand for snapshots: each after the one or two before it, in three branches, some tagged."""
    s, i = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    parent = i - 1 - (F.col("s_nationkey") % 2)
    return s.select(i.alias("id"), F.when(parent >= 1, parent.cast("bigint")).alias("parent"), F.concat(F.lit("b"), (F.col("s_nationkey") % 3).cast("string")).alias("branch"), (i % 9 == 0).alias("tagged"))


def snapshot_history(spark, sf_dir):
    """What each branch's head reaches over parents."""
    h = _history(spark, sf_dir)
    heads = h.groupBy("branch").agg(F.max("id").alias("head"))
    out = None
    for b in ("b0", "b1", "b2"):
        mine = ancestors(h, heads.where(F.col("branch") == b).select(F.col("head").alias("id"))).select(F.lit(b).alias("branch"), "id")
        out = mine if out is None else out.unionByName(mine)
    return out


def snapshot_gc(spark, sf_dir):
    """Snapshots that neither a branch reaches nor a tag names."""
    h = _history(spark, sf_dir)
    live = ancestors(h, h.groupBy("branch").agg(F.max("id").alias("id")).select("id")).unionByName(h.where("tagged").select("id"))
    return h.select("id").join(live, "id", "left_anti")


def tenant_usage(spark, sf_dir):
    """Usage of each namespace, and whether it exceeds a quota of 50 records (0 for every third tenant, which is no limit)."""
    g = records(spark, sf_dir).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"), F.sum("activation_count").alias("activations"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    most = F.when(F.length("namespace") % 3 == 0, 0).otherwise(50)
    return g.withColumn("over_quota", (most > 0) & (F.col("n") >= most))


def tenant_rollup(spark, sf_dir):
    return records(spark, sf_dir).rollup("namespace", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("strength"), 6).alias("strength"))


def search(spark, sf_dir):
    """Records whose text holds "stable" or "deploy", of level 2 or more, with any of two tags, of two namespaces; strongest first, 20."""
    r = records(spark, sf_dir).where(T.has(F.lower("content"), ("stable", "deploy")) & (F.col("level") >= 2) & T.any_tag(F.col("tags"), ("en", "auth")) & F.col("namespace").isin("src0", "src1", "src2", "src5", "src9"))
    return r.select("id", "namespace", "level", "strength").orderBy(F.desc("strength"), "id").limit(20)


def point_get(spark, sf_dir):
    """One record by its id."""
    return records(spark, sf_dir).where("id = 42").select("id", "namespace", "level", F.md5("content").alias("content"))


def namespace_filter(spark, sf_dir):
    """Live records of a list of namespaces, by namespace."""
    return records(spark, sf_dir).where(F.col("namespace").isin("src1", "src3") & S.alive()).select("id", "namespace")


def updated_records(spark, sf_dir):
    """Partial updates: every tenth record gets another strength and marked salience; the newer row counts."""
    r = records(spark, sf_dir).select("id", "strength", "salience", F.lit(0).alias("seq"))
    new = r.where("id % 10 = 3").select("id", F.least(F.col("strength") + 0.1, F.lit(1.0)).alias("strength"), F.lit(0.9).alias("salience"), F.lit(1).alias("seq"))
    return r.unionByName(new).groupBy("id").agg(F.max(F.struct("seq", "strength", "salience")).alias("x")).select("id", F.round("x.strength", 6).alias("strength"), F.round("x.salience", 6).alias("salience"))


def high_salience(spark, sf_dir):
    return records(spark, sf_dir).where("salience >= 0.7").select("id", "salience", "namespace").orderBy(F.desc("salience"), "id").limit(50)


def salience_summary(spark, sf_dir):
    s = F.col("salience")
    count = lambda c: F.count(F.when(c, 1))
    return records(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), count(s >= 0.7).alias("high"), count((s >= 0.3) & (s < 0.7)).alias("medium"), count(s < 0.3).alias("low"), F.round(F.avg(s), 6).alias("avg"), F.max(s).alias("max"))


def level_repair(spark, sf_dir):
    """What becomes of identity records: kept with an identity tag or much use, else domain."""
    t = F.col("tags")
    keep = T.any_tag(t, T.IDENTITY_TAGS) | (~T.any_tag(t, T.NOT_IDENTITY) & (F.col("activation_count") >= 20) & (F.col("strength") >= 0.9))
    return records(spark, sf_dir).where("level = 4").select("id", F.when(keep, 4).otherwise(3).cast("bigint").alias("new_level"))


def guarded_promotion(spark, sf_dir):
    """Levels after promotion: working ones stay, identity needs twenty activations and a strength of 0.9; dead records go."""
    up = F.when(S.promotable(), F.col("level") + 1).otherwise(F.col("level"))
    back = ((F.col("level") == 1) & (up != 1)) | ((F.col("level") != 4) & (up == 4) & ((F.col("activation_count") < 20) | (F.col("strength") < 0.9)))
    return records(spark, sf_dir).where(S.alive()).select("id", F.col("level").cast("bigint").alias("level"), F.when(back, F.col("level")).otherwise(up).cast("bigint").alias("new_level"), S.promotable().alias("promotable"))


def epistemic_health(spark, sf_dir):
    """Health from confidence, evidence and volatility; the confidence that a source type starts with; the type's factor in trust."""
    sup, con = F.log(1.0 + F.col("support")), F.log(1.0 + F.col("conflict"))
    ratio = F.when(sup + con > 0, sup / (sup + con)).otherwise(0.5)
    start = F.create_map(*[F.lit(x) for kv in {"recorded": 0.90, "retrieved": 0.75, "inferred": 0.60, "generated": 0.50}.items() for x in kv])
    return records(spark, sf_dir).select("id", F.round(F.col("confidence") * ratio * (1 - F.col("volatility") * 0.5), 6).alias("health"), start[F.col("source_type")].alias("source_confidence"))


def epistemic_update(spark, sf_dir):
    """Evidence from a record's links within its namespace: conflicting where an end is a contradiction with two common tags or levels 1 and 4 meet on a common tag, else
    confirming where the link reinforces, types agree on a common tag, or two tags are common; and the volatility that the change gives."""
    e = connections(spark, sf_dir).groupBy("a", "b").agg(F.max(F.struct("weight", "kind")).alias("x"))
    r = records(spark, sf_dir).where(S.alive()).select("id", "namespace", "level", "semantic_type", "tags", "support", "conflict", "volatility")
    o = r.select(F.col("id").alias("b"), F.col("namespace").alias("ns2"), F.col("level").alias("level2"), F.col("semantic_type").alias("type2"), F.col("tags").alias("tags2"))
    shared = F.size(F.array_intersect("tags", "tags2"))
    against = (((F.col("semantic_type") == "contradiction") | (F.col("type2") == "contradiction")) & (F.col("shared") >= 2)) | ((F.col("shared") > 0) & (F.col("level") + F.col("level2") == 5) & F.col("level").isin(1, 4))
    binds = F.col("kind").isin("causal", "associative", "coactivation")
    for_ = ((F.col("semantic_type") == F.col("type2")) & (F.col("shared") > 0)) | binds | (F.col("shared") >= 2)
    j = e.select("a", "b", F.col("x.kind").alias("kind")).join(r, F.col("a") == F.col("id")).join(o, "b").where("namespace = ns2").withColumn("shared", shared).withColumns({"no": against, "yes": for_})
    g = j.groupBy("id").agg(F.count(F.when(~F.col("no") & F.col("yes"), 1)).alias("yes"), F.count(F.when(F.col("no"), 1)).alias("no"))
    k = r.select("id", "support", "conflict", "volatility").join(g.withColumnRenamed("id", "gid"), F.col("id") == F.col("gid"), "left").withColumns({"yes": F.coalesce("yes", F.lit(0)), "no": F.coalesce("no", F.lit(0))})
    moved = F.abs(F.col("yes") - F.col("support")) / F.greatest("support", "yes", F.lit(1)) * 0.2 + F.abs(F.col("no") - F.col("conflict")) / F.greatest("conflict", "no", F.lit(1)) * 0.8
    return k.select("id", F.col("yes").alias("confirming"), F.col("no").alias("conflicting"), F.round(0.3 * F.least(moved, F.lit(1.0)) + 0.7 * F.col("volatility"), 6).alias("volatility"))


def provenance(spark, sf_dir):
    """What is stamped on a record that has no such entries yet: source, verified, trust, volatility (as a map's entries in order)."""
    i = F.col("id")
    channel = pick(("telegram", "worker", "voice", "agent", "desktop", "system"), i)
    source = F.when(channel.isin(*T.INTERACTIVE), F.concat(F.lit("user-"), channel)).otherwise(channel)
    base = F.create_map(*[F.lit(x) for kv in {"agent": "0.50", "system": "0.60", "user-confirmed": "1.00", "agent-worker": "0.35"}.items() for x in kv])
    stamp = F.create_map(F.lit("source"), source, F.lit("verified"), source.startswith("user-").cast("string"), F.lit("trust_score"), F.coalesce(base[source], F.lit("0.50")), F.lit("volatility"), T.volatility_class(F.col("tags")))
    own = F.when(i % 4 == 0, F.create_map(F.lit("source"), F.lit("imported"))).otherwise(F.create_map().cast("map<string,string>"))
    both = F.map_concat(own, F.map_from_entries(F.filter(F.map_entries(stamp), lambda e: ~F.array_contains(F.map_keys(own), e["key"]))))
    return records(spark, sf_dir).select("id", F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("metadata"))


def archive(spark, sf_dir):
    """Records that retention takes: by rule, older than its days and not among its newest, unless salient or protected; and completed tasks of thirty days, protected or not."""
    i, age = F.col("id"), (F.lit(NOW) - F.col("created_at")) / DAY
    r = records(spark, sf_dir).where(S.alive()).select("id", "tags", "created_at", "salience", age.alias("age"), pick(STATUS, i).alias("status"))
    rule = F.create_map(*[x for k, (d, n) in RULES.items() for x in (F.lit(k), F.struct(F.lit(d).alias("days"), F.lit(n).alias("keep")))])
    t = r.select("id", "created_at", "salience", "age", "tags", F.explode(F.array_distinct(F.array_intersect("tags", F.array(*map(F.lit, RULES))))).alias("tag")).withColumn("rule", rule[F.col("tag")])
    most = max(n for _, n in RULES.values())
    newest = t.withColumn("i", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created_at"), "id"))).where(F.col("i") <= most).where(F.col("i") <= F.col("rule.keep")).select("id", "tag")
    old = t.where((F.col("age") > F.col("rule.days")) & (F.col("salience") < 0.70) & ~T.any_tag(F.col("tags"), T.PROTECTED)).join(F.broadcast(newest), ["id", "tag"], "left_anti")  # the rules' numbers bound it
    done = r.where(F.array_contains("tags", "todo-item") & F.col("status").isin("completed", "done", "cancelled", "archived") & (F.col("age") > 30) & (F.col("salience") < 0.70)).select("id", F.lit("completed").alias("why"))
    return old.select("id", F.col("tag").alias("why")).unionByName(done)


def retention_policy(spark, sf_dir):
    """Of each namespace the forty newest records that are at most forty days old and have a strength of 0.2."""
    r = records(spark, sf_dir).where((F.col("strength") >= 0.2) & ((F.lit(NOW) - F.col("created_at")) / DAY <= 40))
    return r.withColumn("i", F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("created_at"), "id"))).where("i <= 40").select("id", "namespace")


def due_tasks(spark, sf_dir):
    """Active tasks that are overdue, due today or tomorrow: urgent ones first, then by salience (a quarter more for overdue ones)."""
    i = F.col("id")
    due = ((i * 7) % 9 - 4).cast("int")  # days from now
    r = records(spark, sf_dir).where(F.array_contains("tags", "todo-item")).select("id", "salience", due.alias("due"), pick(STATUS, i).alias("status")).where("status = 'active' and due <= 1")
    return r.select("id", F.when(F.col("due") < 0, "overdue").when(F.col("due") == 0, "today").otherwise("tomorrow").alias("when"), F.when(F.col("due") == 1, 1).otherwise(0).cast("bigint").alias("urgency"), F.round(F.col("salience") + F.when(F.col("due") < 0, 0.25).otherwise(0.0), 6).alias("weight")).orderBy("urgency", F.desc("weight"), "id")


def reflection(spark, sf_dir):
    """Findings by kind and namespace: blocked tasks (overdue days, salience, weakness), contradictions, weak records; counts, the highest score and severity."""
    i = F.col("id")
    r = records(spark, sf_dir).select("id", "namespace", "salience", "strength", "semantic_type", "volatility", "conflict", "tags", (4 - (i * 7) % 9).alias("late"), pick(STATUS, i).alias("status"))
    one = r.where(F.array_contains("tags", "todo-item") & (F.col("status") == "active") & (F.col("late") >= 0)).select(F.lit("repeated_blocker").alias("kind"), "namespace", (F.col("late") + F.col("salience") + F.greatest(1 - F.col("strength"), F.lit(0.0))).alias("score"), F.when((F.col("late") >= 3) | (F.col("salience") >= 0.70), 3).when(F.col("late") >= 1, 2).otherwise(1).alias("sev"))
    two = r.where((F.col("semantic_type") == "contradiction") & (F.col("conflict") > 0)).select(F.lit("unresolved_contradiction").alias("kind"), "namespace", (F.col("volatility") + F.least(F.col("conflict").cast("double"), F.lit(1.5))).alias("score"), F.when((F.col("volatility") >= 0.45) | (F.col("conflict") >= 1), 3).otherwise(2).alias("sev"))
    three = r.where("strength < 0.15").select(F.lit("fading").alias("kind"), "namespace", (1 - F.col("strength")).alias("score"), F.lit(1).alias("sev"))
    g = one.unionByName(two).unionByName(three).groupBy("kind", "namespace").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("score"), F.max("sev").cast("bigint").alias("severity"))
    return g


def reflection_summary(spark, sf_dir):
    """The six weightiest findings: at most two blocked tasks, then by score."""
    g = reflection(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "namespace")))
    return g.where("kind <> 'repeated_blocker' or i <= 2").drop("i").orderBy(F.desc("score"), "kind", "namespace").limit(6)


def _cycles(spark, sf_dir) -> DataFrame:
    """A maintenance cycle for each day of events: churn of users, share of errors, seconds."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("events"), (F.count(F.when(F.col("event_type") == "error", 1)) / F.count(F.lit(1))).alias("rejected"), (F.count(F.when(F.col("event_type") == "signup", 1)) / F.count(F.lit(1))).alias("suppressed"), F.sum("value").alias("ms"), F.max_by("event_type", F.struct("value", "event_id")).alias("phase"))


def maintenance_trend(spark, sf_dir):
    """Means over the last 32 cycles, and the latest one's leading phase."""
    c = _cycles(spark, sf_dir).orderBy(F.desc("day")).limit(32)
    return c.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 6).alias(f"avg_{x}") for x in ("rejected", "suppressed", "ms", "events")], F.sum("events").alias("total_events"), F.max_by("phase", "day").alias("latest_phase"))


def trend_history(spark, sf_dir):
    return _cycles(spark, sf_dir).orderBy(F.desc("day")).limit(32).select(F.col("day").cast("string").alias("day"), "events", F.round("rejected", 6).alias("rejected"), F.round("ms", 6).alias("ms"), "phase")


def namespace_governance(spark, sf_dir):
    """Each namespace's state: live records, contradictions, volatile and salient ones, and whether it needs a look."""
    count = lambda c: F.count(F.when(c, 1))
    g = records(spark, sf_dir).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), count(S.alive()).alias("alive"), count(F.col("semantic_type") == "contradiction").alias("contradictions"), count(F.col("volatility") >= 0.2).alias("volatile"), count(F.col("salience") >= 0.7).alias("salient"))
    return g.withColumn("status", F.when(F.col("contradictions") / F.col("n") > 0.2, "review").when(F.col("volatile") / F.col("n") > 0.5, "watch").otherwise("ok"))


def namespace_digest(spark, sf_dir):
    """Pairs of namespaces with what they share: tags of three or more records each, and how similar these sets are."""
    t = records(spark, sf_dir).where(S.alive()).select("namespace", F.explode("tags").alias("tag")).groupBy("namespace", "tag").agg(F.count(F.lit(1)).alias("k")).where("k >= 3").select("namespace", "tag")
    n = t.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    j = t.join(t.select(F.col("namespace").alias("other"), F.col("tag").alias("tag2")), F.col("tag") == F.col("tag2")).where("namespace < other").groupBy("namespace", "other").agg(F.count(F.lit(1)).alias("shared"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    j = j.join(n, "namespace").join(n.select(F.col("namespace").alias("other"), F.col("n").alias("n2")), "other")
    return j.select("namespace", "other", "shared", "tags", F.round(F.col("shared") / (F.col("n") + F.col("n2") - F.col("shared")), 6).alias("jaccard"))


def health_digest(spark, sf_dir):
    """Issues over all records, the commonest first."""
    r = records(spark, sf_dir)
    age = (F.lit(NOW) - F.col("last_activated")) / DAY
    kinds = {"dead": ~S.alive(), "fading": S.alive() & (F.col("strength") < 0.15), "stale": S.alive() & (age >= 14), "volatile": F.col("volatility") >= 0.2, "contested": F.col("conflict") > F.col("support"), "contradiction": F.col("semantic_type") == "contradiction"}
    g = r.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()])
    return g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in kinds])).alias("x")).select("x.*").where("n > 0")


def _corrections(spark, sf_dir) -> DataFrame:
    """Errors stand for corrections in the governance log, of the record named by their key."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("bigint").alias("record"), "value")


def correction_log(spark, sf_dir):
    return _corrections(spark, sf_dir)


def correction_queue(spark, sf_dir):
    """Records that were corrected again and again, the most and worst first, and what is proposed; nothing is applied."""
    g = _corrections(spark, sf_dir).groupBy("record").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("latest"), F.round(F.sum("value"), 4).alias("weight")).where("n >= 2")
    return g.withColumn("proposal", F.when(F.col("n") >= 10, "retract").when(F.col("n") >= 4, "deprecate").otherwise("review")).orderBy(F.desc("n"), F.desc("weight"), "record").limit(20)


def corrected_beliefs(spark, sf_dir):
    """Beliefs of records named in the log."""
    from . import beliefs as L

    ids = _corrections(spark, sf_dir).select(F.col("record").alias("id")).distinct()
    return L.record_beliefs(spark, sf_dir).join(ids, "id", "left_semi").groupBy("key", "state").agg(F.count(F.lit(1)).alias("n"))


def audit_session(spark, sf_dir):
    """Audit entries of one session (user 7), with the first fifty characters of what they were about."""
    e = table(spark, sf_dir, "events").where("user_id = 7")
    return e.select("event_id", F.col("event_type").alias("action"), F.substring("props", 1, 50).alias("preview"))


def federated_mean(spark, sf_dir):
    """Mean of each position over the devices' own means, weighted by their rows; positions with fewer than three devices are left out."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    device = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return device.groupBy("pos").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("devices")).where("devices >= 3")


def private_gradient(spark, sf_dir, epsilon: float = 1.0, delta: float = 1e-5, sensitivity: float = 0.01):
    """Each device's mean per position with Laplace and with Gaussian noise, from seeded uniform numbers, and the masked shares whose sum over devices is the sum of means."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    d = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    u = lambda a, b: ((F.col("pos") * a + F.col("label") * b) % 10007 + 0.5) / 10007
    half = u(7919, 104729) - 0.5
    laplace = -(sensitivity / epsilon) * F.signum(half) * F.log(1 - 2 * F.abs(half))
    sigma = sensitivity * (2 * math.log(1.25 / delta)) ** 0.5 / epsilon
    gauss = sigma * F.sqrt(-2 * F.log(u(6101, 15485863))) * F.cos(2 * F.lit(3.141592653589793) * u(2741, 32452843))
    return d.select("label", "pos", F.round(F.col("m") + laplace, 6).alias("laplace"), F.round(F.col("m") + gauss, 6).alias("gauss"))


def secure_sum(spark, sf_dir):
    """Sum of the devices' shares by position, each masked so that masks cancel out over three devices or more."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    d = e.groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    n = d.groupBy(F.col("pos").alias("p")).agg(F.count(F.lit(1)).alias("k"), F.avg("label").alias("mid"))
    shares = d.join(n, F.col("pos") == F.col("p")).select("pos", "k", (F.col("s") + 1000 * (F.col("label") - F.col("mid"))).alias("share"))  # these masks add up to nothing
    return shares.groupBy("pos").agg(F.round(F.sum("share"), 4).alias("sum"), F.max("k").alias("devices")).where("devices >= 3")


def bit_frequencies(spark, sf_dir):
    """How often each bit of the phrases occurs among all records, as a share: a device's gradient."""
    r = B.with_bits(table(spark, sf_dir, "documents").select("doc_id"), pick(PHRASES, F.col("doc_id"))).select("doc_id", F.explode("bits").alias("bit"))
    total = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total"))
    return r.groupBy("bit").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(total)).select("bit", F.round(F.col("k") / F.col("total"), 6).alias("share"))  # one row


def phantom_exchange(spark, sf_dir):
    """Bit sets sent out with seeded noise (one bit of 29 dropped, its successor added) and taken in as phantoms without text: size before and after, and Tanimoto."""
    d = B.with_bits(table(spark, sf_dir, "documents").select("doc_id"), pick(PHRASES, F.col("doc_id")))
    noisy = F.array_distinct(F.transform("bits", lambda b: F.when((b * 31 + F.col("doc_id")) % 29 == 0, (b + 1) % B.RANGE).otherwise(b.cast("bigint"))))
    p = d.select("doc_id", F.col("bits").cast("array<bigint>").alias("bits"), noisy.alias("sent"))
    return p.select("doc_id", F.lit("phantom").alias("dna"), F.size("bits").cast("bigint").alias("n"), F.size("sent").cast("bigint").alias("sent"), F.round(B.tanimoto(F.col("bits"), F.col("sent")), 6).alias("tanimoto"))


def indirect_links(spark, sf_dir):
    """Records two links apart within a namespace and not linked themselves, and over how many others."""
    e = connections(spark, sf_dir).select("a", "b").distinct()
    r = records(spark, sf_dir).where(S.alive()).select("id", "namespace")
    ns = lambda d, c, name: d.join(r.select(F.col("id").alias(c), F.col("namespace").alias(name)), c)
    e = ns(ns(e, "a", "na"), "b", "nb").where("na = nb").select("a", "b")
    far = e.join(e.select(F.col("a").alias("mid"), F.col("b").alias("c")), F.col("b") == F.col("mid")).where("a < c").groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"))
    return far.join(e.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti")


def session_strengthening(spark, sf_dir):
    """Orders are sessions, parts of one brand their records: pairs of an order's parts grow to 1 - 0.95 ** times of being together."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    x = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand", F.col("l_partkey").alias("a"))
    j = x.join(x.select("l_orderkey", "p_brand", F.col("a").alias("b")), ["l_orderkey", "p_brand"]).where("a < b")  # an order has seven lines at most
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).select("a", "b", "times", F.round(1 - F.pow(F.lit(0.95), "times"), 6).alias("weight"))


def merged_copies(spark, sf_dir):
    """Records of a namespace with the same normal text become one: the most important stays, with the highest level, all tags, the strengths and activations combined, and the best origin."""
    degree = connections(spark, sf_dir).groupBy("a").agg(F.countDistinct("b").alias("degree"))
    text = F.trim(F.regexp_replace(F.lower(F.regexp_replace("content", r"\n[^\n]*$", "")), r"[^\p{L}\p{N}]+", " "))
    r = records(spark, sf_dir).withColumn("text", F.md5(text)).join(degree, F.col("id") == F.col("a"), "left")
    rank = F.create_map(*[F.lit(x) for kv in {"recorded": 3, "retrieved": 2, "inferred": 1, "generated": 0}.items() for x in kv])
    r = r.select("id", "namespace", "text", "level", "strength", "activation_count", "tags", rank[F.col("source_type")].alias("rank"), F.round(S.importance(F.coalesce("degree", F.lit(0))), 9).alias("imp"))
    g = r.groupBy("namespace", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("imp", (-F.col("id")).alias("neg"), "strength")).alias("x"), F.max("level").alias("level"), F.sum("strength").alias("all"), F.sum("activation_count").alias("activations"), F.max("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags")).where("n > 1")
    return g.select((-F.col("x.neg")).alias("keep"), "n", F.col("level").cast("bigint").alias("level"), F.round(F.least(F.col("x.strength") + 0.3 * (F.col("all") - F.col("x.strength")), F.lit(1.0)), 6).alias("strength"), "activations", F.col("rank").cast("bigint").alias("origin"), F.array_join("tags", ",").alias("tags"))


def anchor_synthesis(spark, sf_dir):
    """Pairs of neighbouring anchors merged into one: intensity saturates at ten, the sources go."""
    r = records(spark, sf_dir).select("id", layer(F.col("id")).alias("dna"), (F.col("salience") * 10).alias("i")).where("dna = 'user_core'")
    o = r.select((F.col("id") - 13).alias("pid"), F.col("id").alias("other"), F.col("i").alias("j"))
    j = r.where("id % 2 = 1").join(o, F.col("id") == F.col("pid"))
    hi, lo = F.greatest("i", "j"), F.least("i", "j")
    return j.select("id", "other", F.round(F.least(hi + lo / 2 * (1 - hi / 10), F.lit(10.0)), 6).alias("intensity"), F.lit(100.0).alias("stability"), F.lit("super_core").alias("dna"))


def decay_sweep(spark, sf_dir):
    """Intensity after a sweep: less by velocity x age / 30 days, not under 0.01; anchors, phantoms and young records are immune."""
    age = (F.lit(NOW) - F.col("created_at")) / DAY
    r = records(spark, sf_dir).select("id", layer(F.col("id")).alias("dna"), (F.col("salience") * 10).alias("i"), F.greatest(F.col("velocity") / 10, F.lit(0.01)).alias("v"), age.alias("age"))
    immune = F.col("dna").isin("user_core", "super_core", "phantom") | (F.col("age") <= 1) | (F.col("i") <= 0.01)
    return r.select("id", "dna", F.round("i", 6).alias("before"), F.round(F.when(immune, F.col("i")).otherwise(F.greatest(F.col("i") * (1 - F.col("v") * F.col("age") / 30), F.lit(0.01))), 6).alias("after"))


def cooccurrence(spark, sf_dir):
    """How often records go together: as successors in time, and in small layers of at most 100 of a namespace and day."""
    n = next_record(spark, sf_dir).where("next_id is not null").select(F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b"))
    r = records(spark, sf_dir).select("id", "namespace", F.floor(F.col("created_at") / DAY).alias("day"))
    small = r.groupBy("namespace", "day").agg(F.count(F.lit(1)).alias("k")).where("k between 2 and 100").select("namespace", "day")
    g = r.join(small, ["namespace", "day"])
    p = g.join(g.withColumnRenamed("id", "b"), ["namespace", "day"]).where("id < b").select(F.col("id").alias("a"), "b")  # larger groups say nothing and are passed over by rule
    return n.unionByName(p).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def synonym_candidates(spark, sf_dir):
    """Words that stand for each other: of phrases by neighbouring ids, words in one but not the other whose rarity is alike; the best partner of each, with confirmation of what was known."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split(F.lower(pick(PHRASES, F.col("doc_id"))), r"[^a-z]+"), lambda w: F.length(w) >= 3)).alias("w"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    freq = d.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")).crossJoin(F.broadcast(total)).select("t", "f", F.log(F.col("total") / F.col("f")).alias("idf"))  # one row
    gap = d.join(d.select((F.col("doc_id") - 1).alias("pid"), F.col("w").alias("v")), F.col("doc_id") == F.col("pid"))
    gap = gap.select(F.array_except("w", "v").alias("x"), F.array_except("v", "w").alias("y")).where("size(x) between 1 and 10 and size(y) between 1 and 10")
    p = gap.select(F.explode("x").alias("ta"), "y").select("ta", F.explode("y").alias("tb")).groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    j = p.join(freq.toDF("ta", "fa", "ia"), "ta").join(freq.toDF("tb", "fb", "ib"), "tb")
    ratio = F.when(F.greatest("ia", "ib") > 0, F.least("ia", "ib") / F.greatest("ia", "ib")).otherwise(0.0)
    j = j.withColumn("conf", F.round(F.least(F.col("n") / 10, F.lit(1.0)) * ratio, 9)).where((ratio >= 0.3) & (F.col("conf") >= 0.1))
    j = j.select(F.when(F.col("fa") >= F.col("fb"), F.col("tb")).otherwise(F.col("ta")).alias("token"), F.when(F.col("fa") >= F.col("fb"), F.col("ta")).otherwise(F.col("tb")).alias("canonical"), "conf")
    best = j.groupBy("token").agg(F.max_by(F.struct("canonical", "conf"), F.struct("conf", "canonical")).alias("x")).select("token", "x.*")
    old = freq.where("f % 2 = 0").select(F.col("t").alias("o"), F.lit(0.3).alias("was"))
    k = best.join(old, F.col("token") == F.col("o"), "full_outer")
    now = F.when(F.col("token").isNotNull() & F.col("o").isNotNull(), F.least(F.col("was") + 0.15, F.lit(1.0))).when(F.col("token").isNotNull(), F.col("conf")).otherwise(F.col("was") * 0.92)
    return k.select(F.coalesce("token", "o").alias("token"), "canonical", F.round(now, 6).alias("confidence")).where("confidence >= 0.05")


_R = f"WITH {RECORDS_SQL} "
_RC = f"WITH RECURSIVE {RECORDS_SQL}, {CONNECTIONS_SQL} "
_T = lambda *t: f"list_has_any(tags, [{', '.join(map(Q.q, t))}])"
_HIST = "h AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey - 1 - s_nationkey % 2 >= 1 THEN CAST(s_suppkey - 1 - s_nationkey % 2 AS BIGINT) END AS parent, 'b' || s_nationkey % 3 AS branch, s_suppkey % 9 = 0 AS tagged FROM supplier)"
_WALK = "w AS (SELECT branch, max(id) AS id FROM h GROUP BY 1 UNION SELECT w.branch, h.parent FROM w JOIN h USING (id) WHERE h.parent IS NOT NULL)"
_STAT = _sql_pick(STATUS, "id")
_CYC = "c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') / count(*) AS rejected, count(*) FILTER (WHERE event_type = 'signup') / count(*) AS suppressed, sum(value) AS ms, arg_max(event_type, (value, event_id)) AS phase FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 32)"
_COR = "c AS (SELECT event_id, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS record, value FROM events WHERE event_type = 'error')"
_DEV = "e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)"
_REFL = f"""{_R}, r AS (SELECT *, 4 - (id * 7) % 9 AS late, {_STAT} AS status FROM records),
f AS (SELECT 'repeated_blocker' AS kind, namespace, late + salience + greatest(1 - strength, 0) AS score, CASE WHEN late >= 3 OR salience >= 0.7 THEN 3 WHEN late >= 1 THEN 2 ELSE 1 END AS sev FROM r WHERE list_contains(tags, 'todo-item') AND status = 'active' AND late >= 0
UNION ALL SELECT 'unresolved_contradiction', namespace, volatility + least(conflict, 1.5e0), CASE WHEN volatility >= 0.45 OR conflict >= 1 THEN 3 ELSE 2 END FROM r WHERE semantic_type = 'contradiction' AND conflict > 0 UNION ALL SELECT 'fading', namespace, 1 - strength, 1 FROM r WHERE strength < 0.15),
g AS (SELECT kind, namespace, count(*) AS n, round(max(score), 6) AS score, CAST(max(sev) AS BIGINT) AS severity FROM f GROUP BY 1, 2)"""
_CHAN = _sql_pick(("telegram", "worker", "voice", "agent", "desktop", "system"), "id")
_UNI = lambda a, b: f"((pos * {a} + label * {b}) % 10007 + 0.5e0) / 10007"
_PB = f"p AS (SELECT doc_id, lower(trim({_sql_pick(PHRASES, 'doc_id')}, ' ')) AS tx FROM documents), {B.sql_bits('pb', 'p', 'doc_id', 'tx')}"
QUERIES = {f.__name__: f for f in (store_scan, layers, memory_page, memory_analytics, next_record, snapshot_diff, snapshot_history, snapshot_gc, tenant_usage, tenant_rollup, search, point_get, namespace_filter, updated_records, high_salience, salience_summary, level_repair, guarded_promotion, epistemic_health, epistemic_update, provenance, archive, retention_policy, due_tasks, reflection, reflection_summary, maintenance_trend, trend_history, namespace_governance, namespace_digest, health_digest, correction_log, correction_queue, corrected_beliefs, audit_session, federated_mean, private_gradient, secure_sum, bit_frequencies, phantom_exchange, indirect_links, session_strengthening, merged_copies, anchor_synthesis, decay_sweep, cooccurrence, synonym_candidates)}
ORACLE_SQL = {
    "store_scan": """WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS p FROM documents), l AS (SELECT id * 3 AS seq, 'store' AS op, id, p FROM d WHERE id % 3 = 0 UNION ALL SELECT id * 3 + 1, 'update', id, p || '!' FROM d WHERE id % 4 = 1 UNION ALL SELECT id * 3 + 2, 'delete', id, NULL FROM d WHERE id % 7 = 3),
g AS (SELECT * FROM l WHERE seq < coalesce((SELECT min(seq) FROM l WHERE seq % 2001 = 2000), 9223372036854775807)), o AS (SELECT id, arg_max(op, seq) AS op, arg_max(coalesce(p, ''), seq) AS p FROM g GROUP BY 1),
x AS (SELECT coalesce(o.id, d.id) AS id, CASE WHEN o.op IS NOT NULL THEN o.p ELSE d.p END AS p FROM (SELECT * FROM d WHERE id % 3 <> 0) d FULL JOIN o ON o.id = d.id WHERE coalesce(o.op, '') <> 'delete') SELECT id, length(p) AS chars, md5(p) AS hash FROM x""",
    "layers": _R + f"SELECT * FROM (SELECT id, {_LAYER} AS dna, created_at FROM records) WHERE dna IN ('user_core', 'super_core')",
    "memory_page": _R + f", r AS (SELECT id, created_at, {_LAYER} AS dna FROM records) SELECT *, (SELECT count(*) FROM r WHERE dna <> 'phantom') AS total FROM r WHERE dna <> 'phantom' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100",
    "memory_analytics": _R + f", r AS (SELECT {_LAYER} AS dna, created_at FROM records) SELECT coalesce(dna, 'all') AS dna, count(*) AS n, min(created_at) AS oldest, max(created_at) AS newest FROM r GROUP BY ROLLUP (dna)",
    "next_record": _R + "SELECT id, lead(id) OVER w AS next_id, lead(id, 2) OVER w AS then_id FROM records WINDOW w AS (ORDER BY created_at, id)",
    "snapshot_diff": """WITH o AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id % 11 <> 0), n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\b(the|die|les|los) ', '\\1  ', 'g') AS t FROM documents WHERE doc_id % 7 <> 0)
SELECT * FROM (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'deleted' WHEN o.t <> n.t THEN 'modified' END AS change, length(o.t) AS chars_was, length(n.t) AS chars FROM o FULL JOIN n ON o.doc_id = n.doc_id) WHERE change IS NOT NULL""",
    "snapshot_history": f"WITH RECURSIVE {_HIST}, {_WALK} SELECT branch, id FROM w",
    "snapshot_gc": f"WITH RECURSIVE {_HIST}, {_WALK} SELECT id FROM h WHERE NOT tagged AND id NOT IN (SELECT id FROM w)",
    "tenant_usage": _R + "SELECT namespace, count(*) AS n, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(activation_count) AS BIGINT) AS activations, min(created_at) AS oldest, max(created_at) AS newest, length(namespace) % 3 <> 0 AND count(*) >= 50 AS over_quota FROM records GROUP BY 1",
    "tenant_rollup": _R + "SELECT namespace, level, count(*) AS n, round(avg(strength), 6) AS strength FROM records GROUP BY ROLLUP (namespace, level)",
    "search": _R + f"SELECT id, namespace, level, strength FROM records WHERE (contains(lower(content), 'stable') OR contains(lower(content), 'deploy')) AND level >= 2 AND {_T('en', 'auth')} AND namespace IN ('src0', 'src1', 'src2', 'src5', 'src9') ORDER BY strength DESC, id LIMIT 20",
    "point_get": _R + "SELECT id, namespace, level, md5(content) AS content FROM records WHERE id = 42",
    "namespace_filter": _R + "SELECT id, namespace FROM records WHERE namespace IN ('src1', 'src3') AND strength >= 0.05",
    "updated_records": _R + "SELECT id, round(CASE WHEN id % 10 = 3 THEN least(strength + 0.1e0, 1) ELSE strength END, 6) AS strength, round(CASE WHEN id % 10 = 3 THEN 0.9e0 ELSE salience END, 6) AS salience FROM records",
    "high_salience": _R + "SELECT id, salience, namespace FROM records WHERE salience >= 0.7 ORDER BY salience DESC, id LIMIT 50",
    "salience_summary": _R + "SELECT count(*) AS n, count(*) FILTER (WHERE salience >= 0.7) AS high, count(*) FILTER (WHERE salience >= 0.3 AND salience < 0.7) AS medium, count(*) FILTER (WHERE salience < 0.3) AS low, round(avg(salience), 6) AS avg, max(salience) AS max FROM records",
    "level_repair": _R + f"SELECT id, CAST(CASE WHEN {_T(*T.IDENTITY_TAGS)} OR (NOT {_T(*T.NOT_IDENTITY)} AND activation_count >= 20 AND strength >= 0.9) THEN 4 ELSE 3 END AS BIGINT) AS new_level FROM records WHERE level = 4",
    "guarded_promotion": _R + ", p AS (SELECT id, level, activation_count, strength, activation_count >= 5 AND strength >= 0.7 AND level < 4 AS promotable FROM records WHERE strength >= 0.05), u AS (SELECT *, CASE WHEN promotable THEN level + 1 ELSE level END AS up FROM p) SELECT id, level, CASE WHEN (level = 1 AND up <> 1) OR (level <> 4 AND up = 4 AND (activation_count < 20 OR strength < 0.9)) THEN level ELSE up END AS new_level, promotable FROM u",
    "epistemic_health": _R + "SELECT id, round(confidence * CASE WHEN ln(1 + support) + ln(1 + conflict) > 0 THEN ln(1 + support) / (ln(1 + support) + ln(1 + conflict)) ELSE 0.5e0 END * (1 - volatility * 0.5e0), 6) AS health, CASE source_type WHEN 'recorded' THEN 0.9e0 WHEN 'retrieved' THEN 0.75e0 WHEN 'inferred' THEN 0.6e0 ELSE 0.5e0 END AS source_confidence FROM records",
    "epistemic_update": _RC + """, e AS (SELECT a, b, arg_max(kind, (weight, kind)) AS kind FROM connections GROUP BY 1, 2), r AS (SELECT * FROM records WHERE strength >= 0.05),
j AS (SELECT x.id, x.semantic_type = 'contradiction' OR y.semantic_type = 'contradiction' AS con, x.semantic_type = y.semantic_type AS same, len(list_intersect(x.tags, y.tags)) AS k, x.level AS l1, y.level AS l2, kind FROM e JOIN r x ON x.id = a JOIN r y ON y.id = b AND x.namespace = y.namespace),
m AS (SELECT *, (con AND k >= 2) OR (k > 0 AND ((l1 = 1 AND l2 = 4) OR (l1 = 4 AND l2 = 1))) AS no FROM j), g AS (SELECT id, count(*) FILTER (WHERE NOT no AND ((same AND k > 0) OR kind IN ('causal', 'associative', 'coactivation') OR k >= 2)) AS yes, count(*) FILTER (WHERE no) AS no FROM m GROUP BY 1),
n AS (SELECT r.id, support, conflict, volatility, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no FROM r LEFT JOIN g USING (id))
SELECT id, yes AS confirming, no AS conflicting, round(0.3e0 * least(abs(yes - support) / greatest(support, yes, 1) * 0.2e0 + abs(no - conflict) / greatest(conflict, no, 1) * 0.8e0, 1) + 0.7e0 * volatility, 6) AS volatility FROM n""",
    "provenance": _R + f", c AS (SELECT id, CASE WHEN {_CHAN} IN ('desktop', 'telegram', 'voice') THEN 'user-' || {_CHAN} ELSE {_CHAN} END AS s, CASE WHEN {Q.any_tag('tags', T.STABLE)} THEN 'stable' WHEN {Q.any_tag('tags', T.VOLATILE)} THEN 'volatile' ELSE 'moderate' END AS v FROM records) SELECT id, 'source=' || CASE WHEN id % 4 = 0 THEN 'imported' ELSE s END || ';trust_score=' || CASE s WHEN 'system' THEN '0.60' ELSE '0.50' END || ';verified=' || CASE WHEN starts_with(s, 'user-') THEN 'true' ELSE 'false' END || ';volatility=' || v AS metadata FROM c",
    "archive": _R + f""", a AS (SELECT *, ({NOW}e0 - created_at) / 86400 AS age, {_STAT} AS status FROM records WHERE strength >= 0.05), rules AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {d}, {n})" for k, (d, n) in RULES.items())}) AS t(tag, days, keep)),
t AS (SELECT DISTINCT id, created_at, salience, age, {Q.any_tag('tags', T.PROTECTED)} AS safe, tag, days, keep FROM (SELECT *, unnest(tags) AS tag FROM a) JOIN rules USING (tag)), n AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY created_at DESC, id) AS i FROM t)
SELECT id, tag AS why FROM n WHERE i > keep AND age > days AND salience < 0.7 AND NOT safe UNION ALL SELECT id, 'completed' FROM a WHERE list_contains(tags, 'todo-item') AND status IN ('completed', 'done') AND age > 30 AND salience < 0.7""",
    "retention_policy": _R + f"SELECT id, namespace FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id) AS i FROM records WHERE strength >= 0.2 AND ({NOW}e0 - created_at) / 86400 <= 40) WHERE i <= 40",
    "due_tasks": _R + f""", d AS (SELECT id, salience, (id * 7) % 9 - 4 AS due FROM records WHERE list_contains(tags, 'todo-item') AND {_STAT} = 'active') SELECT id, CASE WHEN due < 0 THEN 'overdue' WHEN due = 0 THEN 'today' ELSE 'tomorrow' END AS "when", CAST(CASE WHEN due = 1 THEN 1 ELSE 0 END AS BIGINT) AS urgency, round(salience + CASE WHEN due < 0 THEN 0.25e0 ELSE 0e0 END, 6) AS weight FROM d WHERE due <= 1""",
    "reflection": f"{_REFL} SELECT * FROM g",
    "reflection_summary": f"{_REFL}, i AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, namespace) AS i FROM g) SELECT kind, namespace, n, score, severity FROM i WHERE kind <> 'repeated_blocker' OR i <= 2 ORDER BY score DESC, kind, namespace LIMIT 6",
    "maintenance_trend": f"WITH {_CYC} SELECT count(*) AS n, round(avg(rejected), 6) AS avg_rejected, round(avg(suppressed), 6) AS avg_suppressed, round(avg(ms), 6) AS avg_ms, round(avg(events), 6) AS avg_events, CAST(sum(events) AS BIGINT) AS total_events, arg_max(phase, day) AS latest_phase FROM c",
    "trend_history": f"WITH {_CYC} SELECT strftime(day, '%Y-%m-%d') AS day, events, round(rejected, 6) AS rejected, round(ms, 6) AS ms, phase FROM c",
    "namespace_governance": _R + ", g AS (SELECT namespace, count(*) AS n, count(*) FILTER (WHERE strength >= 0.05) AS alive, count(*) FILTER (WHERE semantic_type = 'contradiction') AS contradictions, count(*) FILTER (WHERE volatility >= 0.2) AS volatile, count(*) FILTER (WHERE salience >= 0.7) AS salient FROM records GROUP BY 1) SELECT *, CASE WHEN contradictions / n > 0.2 THEN 'review' WHEN volatile / n > 0.5 THEN 'watch' ELSE 'ok' END AS status FROM g",
    "namespace_digest": _R + ", t AS (SELECT namespace, tag FROM (SELECT namespace, unnest(tags) AS tag FROM records WHERE strength >= 0.05) GROUP BY 1, 2 HAVING count(*) >= 3), n AS (SELECT namespace, count(*) AS n FROM t GROUP BY 1), j AS (SELECT x.namespace, y.namespace AS other, count(*) AS shared, string_agg(x.tag, ',' ORDER BY x.tag) AS tags FROM t x JOIN t y ON x.tag = y.tag AND x.namespace < y.namespace GROUP BY 1, 2) SELECT j.namespace, other, shared, tags, round(shared / (a.n + b.n - shared), 6) AS jaccard FROM j JOIN n a ON a.namespace = j.namespace JOIN n b ON b.namespace = other",
    "health_digest": _R + f", i AS (SELECT unnest([CASE WHEN strength < 0.05 THEN 'dead' END, CASE WHEN strength >= 0.05 AND strength < 0.15 THEN 'fading' END, CASE WHEN strength >= 0.05 AND ({NOW}e0 - last_activated) / 86400 >= 14 THEN 'stale' END, CASE WHEN volatility >= 0.2 THEN 'volatile' END, CASE WHEN conflict > support THEN 'contested' END, CASE WHEN semantic_type = 'contradiction' THEN 'contradiction' END]) AS issue FROM records) SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY 1",
    "correction_log": f"WITH {_COR} SELECT * FROM c",
    "correction_queue": f"WITH {_COR}, g AS (SELECT record, count(*) AS n, max(us) AS latest, round(sum(value), 4) AS weight FROM c GROUP BY 1 HAVING count(*) >= 2) SELECT *, CASE WHEN n >= 10 THEN 'retract' WHEN n >= 4 THEN 'deprecate' ELSE 'review' END AS proposal FROM g ORDER BY n DESC, weight DESC, record LIMIT 20",
    "corrected_beliefs": f"{_B}, {_COR}, k AS (SELECT DISTINCT record FROM c) SELECT key, coalesce(state, 'Empty') AS state, count(*) AS n FROM g LEFT JOIN b USING (key) WHERE id IN (SELECT record FROM k) GROUP BY 1, 2",
    "audit_session": "SELECT event_id, event_type AS action, substr(props, 1, 50) AS preview FROM events WHERE user_id = 7",
    "federated_mean": f"WITH {_DEV}, d AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM e GROUP BY 1, 2) SELECT CAST(pos AS INT) AS pos, round(sum(m * n) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n, count(*) AS devices FROM d GROUP BY 1 HAVING count(*) >= 3",
    "private_gradient": f"WITH {_DEV}, d AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m, {_UNI(7919, 104729)} - 0.5e0 AS h FROM e GROUP BY 1, 2) SELECT label, CAST(pos AS INT) AS pos, round(m - 0.01e0 * sign(h) * ln(1 - 2 * abs(h)), 6) AS laplace, round(m + {0.01 * (2 * math.log(1.25 / 1e-5)) ** 0.5!r} * sqrt(-2 * ln({_UNI(6101, 15485863)})) * cos(2 * pi() * {_UNI(2741, 32452843)}), 6) AS gauss FROM d",
    "secure_sum": f"WITH {_DEV}, d AS (SELECT label, pos, sum(CAST(x AS DOUBLE)) AS s FROM e GROUP BY 1, 2) SELECT CAST(pos AS INT) AS pos, round(sum(s), 4) AS sum, count(*) AS devices FROM d GROUP BY 1 HAVING count(*) >= 3",
    "bit_frequencies": f"WITH {_PB} SELECT CAST(bit AS INT) AS bit, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM pb GROUP BY 1",
    "phantom_exchange": f"WITH {_PB}, s AS (SELECT DISTINCT doc_id, CASE WHEN (bit * 31 + doc_id) % 29 = 0 THEN (bit + 1) % {B.RANGE} ELSE bit END AS bit FROM pb), n AS (SELECT doc_id, count(*) AS n FROM pb GROUP BY 1), m AS (SELECT doc_id, count(*) AS sent FROM s GROUP BY 1), k AS (SELECT doc_id, count(*) AS k FROM pb JOIN s USING (doc_id, bit) GROUP BY 1) SELECT doc_id, 'phantom' AS dna, n, sent, round(coalesce(k, 0) / (n + sent - coalesce(k, 0)), 6) AS tanimoto FROM n JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)",
    "indirect_links": _RC + ", r AS (SELECT id, namespace FROM records WHERE strength >= 0.05), e AS (SELECT DISTINCT a, b FROM connections JOIN r x ON x.id = a JOIN r y ON y.id = b AND x.namespace = y.namespace) SELECT x.a, y.b AS c, count(*) AS n FROM e x JOIN e y ON x.b = y.a WHERE x.a < y.b AND (x.a, y.b) NOT IN (SELECT (a, b) FROM e) GROUP BY 1, 2",
    "session_strengthening": "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT x.p AS a, y.p AS b, count(*) AS times, round(1 - power(0.95e0, count(*)), 6) AS weight FROM l x JOIN l y ON x.o = y.o AND x.p_brand = y.p_brand AND x.p < y.p GROUP BY 1, 2",
    "merged_copies": _RC + """, r AS (SELECT *, md5(trim(regexp_replace(lower(regexp_replace(content, '\\n[^\\n]*$', '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS text, CASE source_type WHEN 'recorded' THEN 3 WHEN 'retrieved' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END AS rank,
  round(0.4e0 * strength + 0.25e0 * level / 4 + 0.2e0 * least(coalesce(degree, 0) / 50, 1) + 0.15e0 * least(activation_count / 20, 1) + 0.1e0 * salience, 9) AS imp FROM records LEFT JOIN (SELECT a, count(DISTINCT b) AS degree FROM connections GROUP BY 1) ON a = id),
o AS (SELECT *, row_number() OVER (PARTITION BY namespace, text ORDER BY imp DESC, id) AS i FROM r), g AS (SELECT namespace, text, count(*) AS n, max(CASE WHEN i = 1 THEN id END) AS keep, max(CASE WHEN i = 1 THEN strength END) AS own, max(level) AS level, sum(strength) AS s, CAST(sum(activation_count) AS BIGINT) AS activations, CAST(max(rank) AS BIGINT) AS origin, list_sort(list_distinct(flatten(list(tags)))) AS tags FROM o GROUP BY 1, 2 HAVING count(*) > 1)
SELECT keep, n, level, round(least(own + 0.3e0 * (s - own), 1), 6) AS strength, activations, origin, array_to_string(tags, ',') AS tags FROM g""",
    "anchor_synthesis": _R + f", r AS (SELECT id, salience * 10 AS i FROM records WHERE {_LAYER} = 'user_core') SELECT x.id, y.id AS other, round(least(greatest(x.i, y.i) + least(x.i, y.i) / 2 * (1 - greatest(x.i, y.i) / 10), 10), 6) AS intensity, 100e0 AS stability, 'super_core' AS dna FROM r x JOIN r y ON y.id = x.id + 13 WHERE x.id % 2 = 1",
    "decay_sweep": _R + f", r AS (SELECT id, {_LAYER} AS dna, salience * 10 AS i, greatest(velocity / 10, 0.01e0) AS v, ({NOW}e0 - created_at) / 86400 AS age FROM records) SELECT id, dna, round(i, 6) AS before, round(CASE WHEN dna <> 'general' OR age <= 1 OR i <= 0.01 THEN i ELSE greatest(i * (1 - v * age / 30), 0.01e0) END, 6) AS after FROM r",
    "cooccurrence": _R + ", o AS (SELECT id, lead(id) OVER (ORDER BY created_at, id) AS b, namespace, floor(created_at / 86400) AS day FROM records), s AS (SELECT namespace, day FROM o GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 100), g AS (SELECT o.id, namespace, day FROM o JOIN s USING (namespace, day)), p AS (SELECT least(id, b) AS a, greatest(id, b) AS b FROM o WHERE b IS NOT NULL UNION ALL SELECT x.id, y.id FROM g x JOIN g y USING (namespace, day) WHERE x.id < y.id) SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2",
    "synonym_candidates": f"""WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower({_sql_pick(PHRASES, 'doc_id')}), '[^a-z]+'), lambda w: length(w) >= 3)) AS w FROM documents), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT t, count(*) AS f, ln((SELECT n FROM n) / count(*)) AS idf FROM (SELECT unnest(w) AS t FROM d) GROUP BY 1),
g AS (SELECT list_filter(x.w, lambda t: NOT list_contains(y.w, t)) AS x, list_filter(y.w, lambda t: NOT list_contains(x.w, t)) AS y FROM d x JOIN d y ON y.doc_id = x.doc_id + 1), u AS (SELECT ta, unnest(y) AS tb FROM (SELECT unnest(x) AS ta, y FROM g WHERE len(x) BETWEEN 1 AND 10 AND len(y) BETWEEN 1 AND 10)),
p AS (SELECT ta, tb, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT CASE WHEN a.f >= b.f THEN tb ELSE ta END AS token, CASE WHEN a.f >= b.f THEN ta ELSE tb END AS canonical, CASE WHEN greatest(a.idf, b.idf) > 0 THEN least(a.idf, b.idf) / greatest(a.idf, b.idf) ELSE 0 END AS ratio, p.n FROM p JOIN f a ON a.t = ta JOIN f b ON b.t = tb),
k AS (SELECT token, canonical, round(least(n / 10, 1) * ratio, 9) AS conf FROM c WHERE ratio >= 0.3), b AS (SELECT token, canonical, conf FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY conf DESC, canonical DESC) AS i FROM k WHERE conf >= 0.1) WHERE i = 1), o AS (SELECT t FROM f WHERE f % 2 = 0)
SELECT * FROM (SELECT coalesce(token, t) AS token, canonical, round(CASE WHEN token IS NOT NULL AND t IS NOT NULL THEN 0.45e0 WHEN token IS NOT NULL THEN conf ELSE 0.3e0 * 0.92e0 END, 6) AS confidence FROM b FULL JOIN o ON token = t) WHERE confidence >= 0.05""",
}
