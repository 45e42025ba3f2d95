"""What the engine reads from texts: guards, rules on tags, salience, anchors, claims, time phrases, normal forms, preambles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.counting import stored
from ..sources.records import CONNECTIONS_SQL, ORIGIN, PHRASES, RECORDS_SQL, SEMANTIC, _sql_pick, connections, pick, records, table
from . import sqltext as Q

CHANNELS = ("desktop", "worker", "telegram", "cron")
ENDINGS = ("", " x", "-1", "!")
LINKS = ("https://www.nature.com/a", "http://sub.bbc.com:8080/b/c", "ncbi.nlm.nih.gov/x", "https://WWW.reddit.com", "m.example.org/p", "https://example.net/q", "")
OVERRIDES = {"example.net": 0.6, "nature.com": 0.99}
CANON = {"cafe": "coffee", "the": "det", "und": "and", "la": "the", "et": "and"}
SYNONYMS = {"garden": ("yard", "plot"), "crash": ("failure",), "release": ("deploy", "ship"), "trend": ("pattern", "tendency")}
ONTOLOGY = {"dog": "mammal", "cat": "mammal", "mammal": "animal", "animal": "thing", "car": "vehicle", "vehicle": "thing", "garden": "place", "place": "thing"}
BUDGET, SEEN = 4000, "2024-12-20"


def guard_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text holds a phone number or address (contact), a wallet (financial), a password or key (credential)."""
    return records(spark, sf_dir).select("id", F.array_join(T.guard_tags(F.col("content")), ",").alias("guards")).where("guards <> ''")


def store_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a record stored through a channel, whether it may be acted on and whether a person must approve; null where nothing is sensitive."""
    r = records(spark, sf_dir).select("id", T.any_tag(F.col("tags"), T.SENSITIVE).alias("tagged"), T.sensitive(F.col("content")).alias("found"), pick(CHANNELS, F.col("id")).alias("channel"))
    there = F.col("channel").isin(*T.INTERACTIVE)
    return r.select("id", "channel", F.when(F.col("tagged") | F.col("found"), there).alias("actionable"), (F.col("tagged") & ~there).alias("needs_approval"))


def tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on tags, and whether a namespace, an origin and a type are valid."""
    i, t = F.col("id"), F.col("tags")
    ns = F.concat(F.coalesce("namespace", F.lit("")), pick(ENDINGS, i))
    return records(spark, sf_dir).select(
        "id", T.any_tag(t, T.SKIPPED).alias("skip_consolidation"), T.any_tag(t, T.PROTECTED).alias("archive_protected"), T.volatility_class(t).alias("volatility"),
        ns.rlike("^[A-Za-z0-9_-]{1,64}$").alias("namespace_ok"), pick((*ORIGIN, "other"), i).isin(*ORIGIN).alias("source_ok"), pick((*SEMANTIC, "note"), i).isin(*SEMANTIC).alias("semantic_ok"),
    )


def url_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credibility of a page's own domain and of one it might link to."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.domain(F.col("url")).alias("domain"), T.credibility(F.col("url"), OVERRIDES).alias("own"), T.credibility(pick(LINKS, F.col("page_id")), OVERRIDES).alias("linked"))


def _scored(spark, sf_dir) -> DataFrame:
    """id, content, x (intensity), e (entropy of the words), legacy, critical: words are counted in Python, as on the JVM a lambda is interpreted for each."""
    r = records(spark, sf_dir).select("id", "content")
    return T.word_scores(r)


def salience_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("id", "legacy", F.round("x", 6).alias("intensity"), F.round("e", 6).alias("entropy"), T.salience(F.round("x", 6), F.round("e", 6)).alias("salience"), "critical")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of each text, why it is an anchor if it is, and the layer that it goes to; records whose id ends in 0 are pinned."""
    s = _scored(spark, sf_dir).select("id", T.anchor_impact(F.col("content")).alias("impact"), T.anchor_trigger(F.col("content"), F.col("x"), F.col("id") % 10 == 0).alias("trigger"))
    return s.select("id", F.round("impact", 6).alias("impact"), "trigger", F.when(F.col("trigger").isNotNull(), "user_core").otherwise("general").alias("dna"))


def geometric_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record the geometric mean of the weights of its links, links without weight counting in the root only."""
    g = connections(spark, sf_dir).groupBy(F.col("a").alias("id")).agg(F.collect_list("weight").alias("l"))
    return g.select("id", F.round(T.resonance(F.col("l")), 6).alias("resonance"))


def _said(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "conversations"), F.col("conv_id") * 7 + F.col("turn")
    return c.select("conv_id", "turn", "role", F.concat_ws("\n", "text", pick(PHRASES, n)).alias("text"), F.date_add(F.lit(SEEN).cast("date"), (F.col("conv_id") % 30).cast("int")).alias("day"))


def experience_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commitments, doubts and claims in what assistants say, a sentence of four words or more each."""
    s = _said(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("n", "text"))
    low, kind, sure = F.col("low"), F.col("kind"), F.col("certainty")
    s = s.withColumn("low", F.lower("text")).select("*", T.claim_kind(low).alias("kind"), T.certainty(low).alias("certainty"))
    base = F.create_map(*[F.lit(x) for kv in T.BASE_CONFIDENCE.items() for x in kv])
    return s.select(
        "conv_id", "turn", F.col("n").cast("bigint").alias("n"), "kind", F.when(kind == "claim", sure).alias("certainty"), F.when(kind == "claim", T.semantic_type(low)).alias("semantic_type"),
        F.when(kind != "uncertainty", F.array_join(T.topic_tags(low), ",")).alias("tags"), F.when(kind == "commitment", T.deadline(low)).alias("deadline"), F.when(kind == "claim", F.least(base[sure], F.lit(T.CEILING))).alias("confidence"), "text",
    )


def claim_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be stored: confidence under the ceiling for generated records, level at most 3 for them, and none that contradicts recorded evidence (0.15 volatility instead)."""
    made, against = F.col("source_type") == "generated", F.col("conflict") > F.col("support")
    blocked = made & against
    return records(spark, sf_dir).select(
        "id", F.when(made, F.least("confidence", F.lit(T.CEILING))).otherwise(F.col("confidence")).alias("confidence"), F.when(made, F.least("level", F.lit(3))).otherwise(F.col("level")).cast("bigint").alias("level"), (~blocked).alias("stored"), F.when(blocked, 0.15).otherwise(0.0).alias("volatility_delta"),
    )


def risk_class(alerts: Column, contradictions: Column, generated: Column) -> Column:
    return (
        F.when(alerts >= 10, "pause")
        .when((alerts >= 5) | (contradictions >= 0.30) | (generated >= 0.85), "restrict")
        .when((contradictions >= 0.15) | (generated >= 0.70), "monitor")
        .otherwise("safe")
    )


def plasticity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By namespace and level: share of generated records, of contradictions, alerts (generated, against the evidence, sure of itself), risk, and how many new records a call may make of three."""
    made = F.col("source_type") == "generated"
    count = lambda c: F.sum(c.cast("int"))
    g = records(spark, sf_dir).groupBy("namespace", "level").agg(F.count(F.lit(1)).alias("n"), count(made).alias("g"), count(F.col("semantic_type") == "contradiction").alias("c"), count(made & (F.col("conflict") > F.col("support")) & (F.col("confidence") >= 0.5)).alias("alerts"))
    g = g.select("namespace", F.col("level").cast("bigint").alias("level"), (F.col("g") / F.col("n")).alias("generated"), (F.col("c") / F.col("n")).alias("contradicted"), "alerts")
    risk = risk_class(F.col("alerts"), F.col("contradicted"), F.col("generated"))
    score = 0.40 * F.col("generated") + 0.35 * F.col("contradicted") + 0.25 * F.least(F.col("alerts") / 10, F.lit(1.0))
    return g.withColumn("risk", risk).select("namespace", "level", F.round("generated", 6).alias("generated"), F.round("contradicted", 6).alias("contradicted"), "alerts", F.round(score, 6).alias("score"), "risk", F.when(F.col("risk") == "pause", 0).when(F.col("risk") == "restrict", 1).otherwise(3).cast("bigint").alias("max_new"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the text cleaned, as relation text, and projected by a dictionary; the family relation; the phrase sharpened as a query; estimated tokens."""
    c = F.col("content")
    r = records(spark, sf_dir).select("id", "content", T.relation_text(c).alias("relation"))
    return r.select(
        "id", F.md5(T.cleaned(c)).alias("cleaned"), F.md5("relation").alias("relation"), T.family_relation(F.col("relation")).alias("family"), F.md5(T.project(c, CANON)).alias("projected"),
        T.sharpened(pick(PHRASES, F.col("id"))).alias("sharpened"), T.token_estimate(c).alias("tokens"),
    )


def time_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with its time phrases resolved as seen from a day (as a hash), the first date then in it and its weight with a half-life of ten days, and the days of "last week" where it speaks of that."""
    day = F.col("day")
    s = _said(spark, sf_dir).select("conv_id", "turn", "day", F.lower("text").alias("low"), T.resolve_time(F.col("text"), day).alias("resolved"))
    s = s.withColumn("first", T.first_date(F.col("resolved")))
    week = F.sequence(F.date_sub(day, 7), F.date_sub(day, 1))
    return s.select(
        "conv_id", "turn", F.md5("resolved").alias("resolved"), F.col("first").cast("string").alias("first_date"), F.round(T.half_life(F.col("first"), day, 10.0), 6).alias("weight"),
        F.when(F.col("low").contains("last week"), F.array_join(F.transform(week, lambda d: d.cast("string")), ",")).alias("dates"), T.last_weekday(day, "friday").cast("string").alias("last_friday"), T.next_weekday(day, "monday").cast("string").alias("next_monday"),
    )


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase's words with their synonyms, all ancestors in the ontology, and those beneath them (two steps each way)."""
    pair = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    own = F.filter(F.split(F.lower(F.concat_ws(" ", pick(PHRASES, F.col("doc_id")), pick(tuple(ONTOLOGY), F.col("doc_id")))), r"[^a-z0-9]+"), lambda w: w != "")
    up = pair(ONTOLOGY)
    down: dict[str, list[str]] = {}
    for k, v in ONTOLOGY.items():
        down.setdefault(v, []).append(k)
    syn = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    low = F.create_map(*[x for k, v in down.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    none = F.array().cast("array<string>")
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(own).alias("w"))
    flat = lambda c, m: F.flatten(F.transform(c, lambda x: F.coalesce(m[x], none)))
    one = F.array_compact(F.transform("w", lambda x: up[x]))
    d = d.select("doc_id", "w", flat(F.col("w"), syn).alias("s"), one.alias("u1"), flat(F.col("w"), low).alias("d1"))
    d = d.select("doc_id", "w", "s", F.array_union("u1", F.array_compact(F.transform("u1", lambda x: up[x]))).alias("u"), F.array_union("d1", flat(F.col("d1"), low)).alias("d"))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    return d.select("doc_id", text(F.array_union("w", "s")).alias("synonyms"), text(F.array_union("w", "u")).alias("upward"), text(F.array_union("w", "d")).alias("downward"), text(F.array_distinct(F.flatten(F.array("w", "s", "u", "d")))).alias("combined"), F.array_contains("u", "animal").alias("is_animal"))


def _formatted(spark, sf_dir, some: DataFrame | None = None) -> DataFrame:
    """Records, or some of them, as lines.  Those without a cause go by their own id, as all nulls would be one task's."""
    every = records(spark, sf_dir)
    r = every if some is None else some
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    source = F.when(F.col("source_type") != "recorded", F.concat(F.lit(" ["), "source_type", F.lit("]"))).otherwise("")
    kind = F.when(F.col("semantic_type") != "fact", F.concat(F.lit(" {"), "semantic_type", F.lit("}"))).otherwise("")
    fence = lambda name, lang: F.concat(F.lit(f"  - [{name}]"), source, kind, tags, F.lit(f"\n```{lang}\n"), "content", F.lit("\n```"))
    base = F.when(F.col("content_type") == "code", fence("CODE", "")).when(F.col("content_type") == "json", fence("JSON", "json")).otherwise(F.concat(F.lit("  - "), "content", source, kind, tags))
    cause = every.select(F.col("id").alias("parent"), F.lit(False).alias("none"), F.substring("content", 1, 120).alias("preview"))
    up = (F.coalesce("caused_by", "id") == F.col("parent")) & (F.col("caused_by").isNull() == F.col("none"))
    j = r.select("id", "namespace", "level", "strength", "caused_by", base.alias("base")).join(cause, up, "left")
    return j.select("id", "namespace", "level", "strength", F.concat("base", F.when(F.col("preview").isNotNull(), F.concat(F.lit("\n    ^ because: "), "preview")).otherwise("")).alias("line"))


def record_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as a line for a prompt (as a hash), with labels, tags and the beginning of its cause, and its estimated tokens."""
    return _formatted(spark, sf_dir).select("id", F.md5("line").alias("line"), T.token_estimate(F.col("line")).alias("tokens"))


def preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By namespace and level the lines, strongest records first, that fit a budget of tokens: a quarter for level 4, a quarter for each other; as a hash with count and tokens."""
    high = max(128, int(BUDGET * 0.25))
    most = F.when(F.col("level") == 4, high).otherwise((BUDGET - high) // 3)
    w = Window.partitionBy("namespace", "level").orderBy(F.desc("strength"), "id").rowsBetween(Window.unboundedPreceding, 0)
    f = _formatted(spark, sf_dir).withColumn("tokens", T.token_estimate(F.col("line")))
    # a line has a token at least, so only that many of a group can fit; the last that fits is found without the lines
    first = Window.partitionBy("namespace", "level").orderBy(F.desc("strength"), "id")
    place = F.struct(F.col("strength").isNull(), -F.col("strength"), "id")
    few = f.select("namespace", "level", "strength", "id", "tokens").withColumn("i", F.row_number().over(first)).where(F.col("i") <= max(high, (BUDGET - high) // 3))
    last = stored(few.withColumn("upto", F.sum("tokens").over(w)).where(F.col("upto") <= most).groupBy(F.col("namespace").alias("ns"), F.col("level").alias("lv")).agg(F.max(place).alias("last")))  # a row for each group
    some = records(spark, sf_dir).join(F.broadcast(last), F.col("namespace").eqNullSafe(F.col("ns")) & F.col("level").eqNullSafe(F.col("lv")) & (place <= F.col("last")), "left_semi")
    f = _formatted(spark, sf_dir, some).withColumn("tokens", T.token_estimate(F.col("line")))
    f = f.withColumn("upto", F.sum("tokens").over(w)).where(F.col("upto") <= most)
    g = f.groupBy("namespace", "level").agg(F.array_sort(F.collect_list(F.struct("upto", (-F.col("strength")).alias("s"), "id", "line"))).alias("l"), F.count(F.lit(1)).alias("n"), F.max("upto").alias("tokens"))
    return g.select("namespace", F.col("level").cast("bigint").alias("level"), F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"), "n", "tokens")


def chunks(text: Column, most: int = 1000) -> Column:
    """Texts over `most` bytes in parts of about that size, cut at line ends, and at blank lines after 100 bytes; others as they are."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    full = lambda s, x: F.octet_length(s["now"]) + F.octet_length(x) > most
    put = lambda s: F.concat(s["done"], F.array(s["now"]))
    glue = lambda now, x: F.when(now == "", x).otherwise(F.concat(now, F.lit("\n"), x))

    def step(s, x):
        blank = F.when(F.octet_length(s["now"]) > 100, F.struct(put(s).alias("done"), F.lit("").alias("now"))).otherwise(s)
        line = F.when(full(s, x), F.struct(put(s).alias("done"), x.alias("now"))).otherwise(F.struct(s["done"].alias("done"), glue(s["now"], x).alias("now")))
        return F.when(x == "", blank).otherwise(line)

    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    parts = F.aggregate(lines, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(put(s)))
    return F.when((F.octet_length(text) > most) & (F.size(parts) > 1), parts).otherwise(F.array(text))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n, chunk: records as they are taken in, long ones in parts."""
    return records(spark, sf_dir).select("id", F.posexplode(chunks(T.cleaned(F.col("content")))).alias("n", "chunk"))


_R = f"WITH {RECORDS_SQL} "
_SAID = f"""WITH said AS (SELECT conv_id, turn, role, concat_ws(chr(10), text, {_sql_pick(PHRASES, "(conv_id * 7 + turn)")}) AS text, DATE '{SEEN}' + CAST(conv_id % 30 AS INT) AS day FROM conversations)"""
_SCORED = f"{_R}, s AS (SELECT id, content, {Q.words('content')} AS w FROM records), x AS (SELECT *, {Q.intensity('w', Q.match('content', '[0-9]'))} AS x FROM s)"
_DOMAIN = lambda u: f"string_split(regexp_replace(lower(string_split(regexp_replace({u}, '^https?://', ''), '/')[1]), '^www\\.', ''), ':')[1]"
_TABLE = lambda d, t: "CASE " + d + " " + " ".join(f"WHEN {Q.q(k)} THEN {v}e0" for k, v in t.items()) + " END"
_SCORE = lambda u: f"CASE WHEN {u} = '' THEN 0.5e0 ELSE coalesce({_TABLE(_DOMAIN(u), OVERRIDES)}, {_TABLE(_DOMAIN(u), T.CREDIBLE)}, CASE WHEN len(string_split({_DOMAIN(u)}, '.')) > 2 THEN {_TABLE(f'''array_to_string(string_split({_DOMAIN(u)}, '.')[-2:], '.')''', T.CREDIBLE)} END, 0.5e0) END"
_NS = f"coalesce(namespace, '') || {_sql_pick(ENDINGS, 'id')}"
_LINE = f"""{_R}, b AS (SELECT *, CASE WHEN source_type <> 'recorded' THEN ' [' || source_type || ']' ELSE '' END || CASE WHEN semantic_type <> 'fact' THEN ' {{' || semantic_type || '}}' ELSE '' END
  || CASE WHEN len(tags) > 0 THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END AS label FROM records),
f AS (SELECT b.id, b.namespace, b.level, b.strength, CASE b.content_type WHEN 'code' THEN '  - [CODE]' || label || chr(10) || '```' || chr(10) || b.content || chr(10) || '```'
  WHEN 'json' THEN '  - [JSON]' || label || chr(10) || '```json' || chr(10) || b.content || chr(10) || '```' ELSE '  - ' || b.content || label END
  || CASE WHEN p.content IS NOT NULL THEN chr(10) || '    ^ because: ' || substr(p.content, 1, 120) ELSE '' END AS line FROM b LEFT JOIN records p ON p.id = b.caused_by),
k AS (SELECT *, CAST(floor(len({Q.blanks('line')}) * 1.3e0) AS BIGINT) AS tokens FROM f)"""
_ALPHA = f"translate(lower(w), {Q.q(T.ACCENTS[0])}, {Q.q(T.ACCENTS[1])})"
_UP = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ONTOLOGY.items()) + " END"
_DOWN = "CASE x " + " ".join(f"WHEN '{p}' THEN {sorted(k for k, v in ONTOLOGY.items() if v == p)}" for p in sorted(set(ONTOLOGY.values()))) + " ELSE CAST([] AS VARCHAR[]) END"
_SYN = "CASE x " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in SYNONYMS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
_MAP = lambda c, e: f"list_filter(list_transform({c}, lambda x: {e}), lambda y: y IS NOT NULL)"
_FLAT = lambda c, e: f"flatten(list_transform({c}, lambda x: {e}))"
_TEXT = lambda *c: f"array_to_string(list_sort(list_distinct({c[0] if len(c) == 1 else 'flatten([' + ', '.join(c) + '])'})), ' ')"

QUERIES = {f.__name__: f for f in (guard_tags, store_guard, tag_rules, url_credibility, salience_scores, anchors, geometric_resonance, experience_events, claim_guards, plasticity_risk, normal_forms, time_phrases, query_expansion, record_format, preamble, text_chunks)}
ORACLE_SQL = {
    "guard_tags": f"{_R}SELECT id, guards FROM (SELECT id, array_to_string(list_filter([CASE WHEN {Q.match('content', T.PHONE)} OR {Q.match('content', T.EMAIL)} THEN 'contact' END, CASE WHEN {Q.match('content', T.WALLET)} THEN 'financial' END, CASE WHEN {Q.match('content', '(?i)' + T.PASSWORD)} OR {Q.match('content', T.API_KEY)} THEN 'credential' END], lambda x: x IS NOT NULL), ',') AS guards FROM records) WHERE guards <> ''",
    "store_guard": f"{_R}, g AS (SELECT id, {Q.any_tag('tags', T.SENSITIVE)} AS t, {Q.sensitive('content')} AS f, {_sql_pick(CHANNELS, 'id')} AS channel FROM records) SELECT id, channel, CASE WHEN t OR f THEN channel IN ('desktop', 'telegram', 'voice') END AS actionable, t AND channel NOT IN ('desktop', 'telegram', 'voice') AS needs_approval FROM g",
    "tag_rules": f"{_R}SELECT id, {Q.any_tag('tags', T.SKIPPED)} AS skip_consolidation, {Q.any_tag('tags', T.PROTECTED)} AS archive_protected, CASE WHEN {Q.any_tag('tags', T.STABLE)} THEN 'stable' WHEN {Q.any_tag('tags', T.VOLATILE)} THEN 'volatile' ELSE 'moderate' END AS volatility, {Q.match(_NS, '^[A-Za-z0-9_-]{1,64}$')} AS namespace_ok, id % 5 < 4 AS source_ok, id % 7 < 6 AS semantic_ok FROM records",
    "url_credibility": f"SELECT page_id, {_DOMAIN('url')} AS domain, {_SCORE('url')} AS own, {_SCORE(_sql_pick(LINKS, 'page_id'))} AS linked FROM pages",
    "salience_scores": f"""{_SCORED}, c AS (SELECT id, unnest({Q.blanks('content')}) AS word FROM records), n AS (SELECT id, word, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT id, sum(k) AS n, count(*) AS d FROM n GROUP BY 1),
e AS (SELECT id, CASE WHEN max(d) > 1 THEN -sum(k / n.n * log2(k / n.n)) / log2(max(d)) ELSE 0e0 END AS e FROM (SELECT n.id, k, t.n, d FROM n JOIN t USING (id)) n GROUP BY 1)
SELECT x.id, round(0.5e0 + CAST({Q.count_in('w', T.IDENTITY_WORDS)} > 0 AS INT) + 1.5e0 * CAST({Q.match('content', '[0-9]')} AS INT) + least(0.5e0 * ({' + '.join(f'CAST({Q.count_in("w", k)} > 0 AS INT)' for k in T.INTENSE)}), 1e0), 2) AS legacy,
round(x, 6) AS intensity, round(coalesce(e, 0e0), 6) AS entropy, round(least(greatest((0.5e0 * round(x, 6) + 0.3e0 * round(coalesce(e, 0e0), 6) + 0.2e0) * 2.5e0, 0e0), 10e0), 2) AS salience, {Q.count_in('w', [w for k, v in T.EMOTIONS if v >= 2.5 for w in k])} > 0 AS critical FROM x LEFT JOIN e USING (id)""",
    "anchors": f"""{_SCORED}, t AS (SELECT id, {Q.impact('content')} AS impact, CASE WHEN strlen(content) >= 20 THEN CASE WHEN id % 10 = 0 THEN 'explicit' WHEN x >= 3.5 THEN 'intensity' WHEN {Q.impact('content')} >= 1.3e0 OR {Q.has('content', T.PIN_MARKS)} THEN 'structural' END END AS trigger FROM x)
SELECT id, round(impact, 6) AS impact, trigger, CASE WHEN trigger IS NOT NULL THEN 'user_core' ELSE 'general' END AS dna FROM t""",
    "claim_guards": f"{_R}SELECT id, CASE WHEN source_type = 'generated' THEN least(confidence, 0.7e0) ELSE confidence END AS confidence, CASE WHEN source_type = 'generated' THEN least(level, 3) ELSE level END AS level, NOT (source_type = 'generated' AND conflict > support) AS stored, CASE WHEN source_type = 'generated' AND conflict > support THEN 0.15e0 ELSE 0e0 END AS volatility_delta FROM records",
    "plasticity_risk": f"""{_R}, g AS (SELECT namespace, level, count(*) FILTER (WHERE source_type = 'generated') / count(*) AS generated, count(*) FILTER (WHERE semantic_type = 'contradiction') / count(*) AS contradicted, count(*) FILTER (WHERE source_type = 'generated' AND conflict > support AND confidence >= 0.5) AS alerts FROM records GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN alerts >= 10 THEN 'pause' WHEN alerts >= 5 OR contradicted >= 0.3e0 OR generated >= 0.85e0 THEN 'restrict' WHEN contradicted >= 0.15e0 OR generated >= 0.7e0 THEN 'monitor' ELSE 'safe' END AS risk FROM g)
SELECT namespace, level, round(generated, 6) AS generated, round(contradicted, 6) AS contradicted, alerts, round(0.4e0 * generated + 0.35e0 * contradicted + 0.25e0 * least(alerts / 10, 1), 6) AS score, risk, CAST(CASE risk WHEN 'pause' THEN 0 WHEN 'restrict' THEN 1 ELSE 3 END AS BIGINT) AS max_new FROM k""",
    "record_format": f"{_LINE} SELECT id, md5(line) AS line, tokens FROM k",
    "preamble": f"""{_LINE}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY namespace, level ORDER BY strength DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT namespace, level, md5(string_agg(line, chr(10) ORDER BY upto, strength DESC, id)) AS text, count(*) AS n, CAST(max(upto) AS BIGINT) AS tokens FROM u WHERE upto <= CASE WHEN level = 4 THEN {max(128, int(BUDGET * 0.25))} ELSE {(BUDGET - max(128, int(BUDGET * 0.25))) // 3} END GROUP BY 1, 2""",
    "experience_events": f"""{_SAID}, p AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?\\n]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: len({Q.blanks('s')}) >= 4) AS l FROM said WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, unnest(l) AS text, unnest(range(len(l))) AS n FROM p), c AS (SELECT *, lower(text) AS low FROM e),
k AS (SELECT *, CASE WHEN {Q.has('low', T.COMMIT)} THEN 'commitment' WHEN ({Q.has('low', T.HEDGE)} OR {Q.has('low', T.SPECULATIVE)}) AND {Q.has('low', T.CONTRAST)} THEN 'uncertainty' ELSE 'claim' END AS kind,
  CASE WHEN {Q.has('low', T.SPECULATIVE)} THEN 'speculative' WHEN {Q.has('low', T.HEDGE)} THEN 'hedged' ELSE 'asserted' END AS sure FROM c)
SELECT conv_id, turn, n, kind, CASE WHEN kind = 'claim' THEN sure END AS certainty, CASE WHEN kind = 'claim' THEN CASE WHEN {Q.has('low', ('prefer', 'like', 'перевагу', 'подобається'))} THEN 'preference' WHEN {Q.has('low', ('trend', 'pattern', 'завжди', 'зазвичай', 'often'))} THEN 'trend' ELSE 'fact' END END AS semantic_type,
CASE WHEN kind <> 'uncertainty' THEN array_to_string(list_filter([{', '.join(f"CASE WHEN {Q.has('low', [k for k, x in T.TOPICS if x == t])} THEN '{t}' END" for t in dict.fromkeys(t for _, t in T.TOPICS))}], lambda x: x IS NOT NULL), ',') END AS tags,
CASE WHEN kind = 'commitment' THEN coalesce({', '.join(f"CASE WHEN contains(low, '{m}') THEN '{m}' END" for m in T.DEADLINES)}) END AS deadline, CASE WHEN kind = 'claim' THEN CASE sure WHEN 'asserted' THEN 0.5e0 WHEN 'hedged' THEN 0.4e0 ELSE 0.3e0 END END AS confidence, text FROM k""",
    "normal_forms": f"""{_R}, a AS (SELECT id, content, trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) AS core, lower({_sql_pick(PHRASES, 'id')}) AS ph FROM records),
b AS (SELECT *, CASE WHEN core = '' THEN ' ' ELSE ' ' || core || ' ' END AS rel, coalesce({', '.join(f"CASE WHEN starts_with(ph, {Q.q(p)}) THEN {Q.q(p)} END" for p in T.ASKING)}) AS lead,
  regexp_replace(array_to_string(list_transform(string_split_regex(content, '\\r?\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS cl FROM a)
SELECT id, md5(regexp_replace(regexp_replace(cl, '^\\n+', ''), '([^\\n])\\n$', '\\1')) AS cleaned, md5(rel) AS relation, coalesce({', '.join(f"CASE WHEN contains(rel, 'my {p}') THEN 'family.{k}' END" for p, k in T.FAMILY)}) AS family,
md5(array_to_string(list_transform({Q.blanks('content')}, lambda w: coalesce({'CASE ' + _ALPHA + ' ' + ' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CANON.items()) + ' END'}, lower(w))), ' ')) AS projected,
CASE WHEN lead IS NOT NULL AND trim(substr(ph, length(lead) + 1)) <> '' THEN trim(substr(ph, length(lead) + 1)) ELSE ph END AS sharpened, CAST(floor(len({Q.blanks('content')}) * 1.3e0) AS BIGINT) AS tokens FROM b""",
    "time_phrases": f"""{_SAID}, r AS (SELECT conv_id, turn, day, lower(text) AS low, {Q.resolve('text', 'day')} AS resolved FROM said), f AS (SELECT *, TRY_CAST(nullif(regexp_extract(resolved, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE) AS first FROM r)
SELECT conv_id, turn, md5(resolved) AS resolved, strftime(first, '%Y-%m-%d') AS first_date, round(CASE WHEN first > day THEN 1e0 ELSE power(2e0, -(day - first) / 10e0) END, 6) AS weight,
CASE WHEN contains(low, 'last week') THEN array_to_string(list_transform(range(7), lambda i: strftime(day - 7 + CAST(i AS INT), '%Y-%m-%d')), ',') END AS dates, strftime({Q.last_day('day', 'friday')}, '%Y-%m-%d') AS last_friday, strftime({Q.next_day('day', 'monday')}, '%Y-%m-%d') AS next_monday FROM f""",
    "query_expansion": f"""WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower({_sql_pick(PHRASES, 'doc_id')} || ' ' || {_sql_pick(tuple(ONTOLOGY), 'doc_id')}), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents),
e AS (SELECT doc_id, w, {_FLAT('w', _SYN)} AS s, {_MAP('w', _UP)} AS u1, {_FLAT('w', _DOWN)} AS d1 FROM d), f AS (SELECT doc_id, w, s, list_concat(u1, {_MAP('u1', _UP)}) AS u, list_concat(d1, {_FLAT('d1', _DOWN)}) AS d FROM e)
SELECT doc_id, {_TEXT('w', 's')} AS synonyms, {_TEXT('w', 'u')} AS upward, {_TEXT('w', 'd')} AS downward, {_TEXT('w', 's', 'u', 'd')} AS combined, list_contains(u, 'animal') AS is_animal FROM f""",
    "geometric_resonance": f"""WITH {CONNECTIONS_SQL} SELECT a AS id, round(CASE WHEN count(*) FILTER (WHERE weight > 0) = 0 THEN 0e0 ELSE exp(coalesce(sum(ln(CASE WHEN weight > 0 THEN weight END)), 0) / count(*)) END, 6) AS resonance FROM connections GROUP BY 1""",
}
