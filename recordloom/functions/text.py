"""Rules on text as column expressions: guards, salience, anchors, claims, time phrases, normal forms.  All on the JVM but the counts of words in word_scores."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import small_batches

PHONE = r"(?:\+?[0-9]{1,3}[.\s-]?)?\(?[0-9]{2,4}\)?[.\s-]?[0-9]{3,4}[.\s-]?[0-9]{2,4}"
EMAIL = r"[A-Za-z0-9.%_+-]+@[A-Za-z0-9-.]+\.[A-Za-z]{2,}"
WALLET = r"(?:T[A-Za-z0-9]{33}|0x[A-Fa-f0-9]{40}|[13][1-9A-HJ-NP-Za-km-z]{25,34})"
API_KEY = r"(?:secret|token|api[-_]?key|sk-)[\s=:]+[0-9A-Z_a-z-]{20,}"
PASSWORD = r"(?:пароль|passwd|password)[\s=:]+\S+"
SENSITIVE = ("financial", "credential", "wallet")
INTERACTIVE = ("desktop", "telegram", "voice")
IDENTITY_TAGS = ("user-profile", "identity")
STABLE = tuple("contact|credential|financial|identity|person".split("|"))
VOLATILE = tuple("cache|scheduled-task|todo-item|web-search-cache".split("|"))
NOT_IDENTITY = tuple("action-plan|autonomous-goal|autonomous-outcome|cache|consolidated-meta|outcome|plan|proactive-session|reflection|research-finding|research-project|scheduled-task|session-reflection|session-summary|web-search-cache".split("|"))
SKIPPED = tuple("contact|credential|extracted-fact|financial|health-metric|identity|person|scheduled-task|session-summary|todo-item|user-profile".split("|"))
PROTECTED = tuple("contact|extracted-fact|health-metric|identity|person|relationship".split("|"))

IDENTITY_WORDS = tuple("am|i|me|mine|my|мене|мені|моя|моє|мої|мій|я".split("|"))
FACT_WORDS = ("рік", "року", "років", "year", "years", "народив", "born")
INTENSE = tuple(tuple(k.split("|")) for k in ("важливо|завжди|критично|ненавиджу|ніколи|обожнюю", "always|critical|hate|important|love|never", "very|дуже"))
EMOTIONS = tuple((tuple(k.split("|")), w) for k, w in (
    ("adore|cherish|love|treasure", 2.0),
    ("excited|happy|joy|thrilled", 1.5),
    ("кохаю|люблю|радий|щасливий", 2.0),
    ("despise|fear|hate|terrified", 2.0),
    ("angry|devastated|furious", 1.8),
    ("боюся|злий|ненавиджу|сумний", 2.0),
    ("critical|danger|emergency|urgent", 3.0),
    ("критично|небезпека|терміново", 3.0),
    ("confidential|key|password|secret", 2.5),
    ("ключ|пароль|таємниця", 2.5),
))
METRICS = r"[0-9]+[.]?[0-9]*\s*(?:%|fps|gb|hz|kb|mb|ms)"
PIN_MARKS = ("Anchor:", "Important:", "Critical:", "Identity:")

HEDGE = tuple("appears|arguably|i believe|i think|likely|may|might|not sure|perhaps|possibly|probably|seems|uncertain|здається|мабуть|можливо|напевно|не впевнений|не знаю|не певен|очевидно|схоже".split("|"))
SPECULATIVE = tuple("could be|i guess|i suppose|might be|possibly|speculate|theoretically|може бути|можливо що|припускаю|теоретично".split("|"))
CONTRAST = tuple("actually|but|contrary|false|however|incorrect|instead|not true|rather|wrong|але|навпаки|насправді|не буде|не є|однак|помилково|проте|хибно".split("|"))
COMMIT = tuple("going to|i'll|intend to|let me|plan to|promise|shall|will|буду|виправлю|встановлю|запущу|збираюсь|зобов'яжусь|зроблю|обіцяю|планую".split("|"))
DEADLINES = tuple("today|tomorrow|next week|this week|by friday|сьогодні|завтра|наступного тижня|цього тижня".split("|"))
TOPICS = tuple(tuple(k.split(">")) for k in "health>health|medical>medical|code>code|error>debug|bug>debug|memory>memory|deploy>ops|server>ops|database>data|здоров>health|код>code|помилка>debug".split("|"))
BASE_CONFIDENCE = {"asserted": 0.5, "hedged": 0.4, "speculative": 0.3}
CEILING = 0.7

NEGATIVE = tuple("bug|conflict|contradiction|crash|downtime|error|fail|failure|incident|outage|regression|revert|risk|rollback|vulnerability".split("|"))
AMBIGUOUS = (*NEGATIVE, "noise", "review")
POSITIVE = tuple("approved|completed|deployed|faster|fixed|healthy|improve|improvement|optimized|reliable|resolved|secure|stable|success".split("|"))
ASKING = tuple("що таке|що це|який|яка|яке|які|як|де|коли|хто|чому|what is|what are|how to|where is|who is|tell me about|розкажи про".split("|"))
ACCENTS = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýÿþ", "aaaaaaaceeeeiiiidnoooooouuuuyyt")


def has(text: Column, words) -> Column:
    """Whether any of the strings occurs in the text, inside words too."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def hits(text: Column, words) -> Column:
    """How many of the strings occur in the text."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def any_tag(tags: Column, own) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in own]))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def count_in(own: Column, words_) -> Column:
    return F.size(F.filter(own, lambda w: w.isin(*words_)))


def guard_tags(text: Column) -> Column:
    """Of contact, financial, credential those whose pattern the text matches."""
    flags = [(text.rlike(PHONE) | text.rlike(EMAIL), "contact"), (text.rlike(WALLET), "financial"), (text.rlike("(?iu)" + PASSWORD) | text.rlike(API_KEY), "credential")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in flags]))


def sensitive(text: Column) -> Column:
    return text.rlike(EMAIL) | text.rlike(WALLET) | text.rlike(API_KEY) | text.rlike("(?iu)" + PASSWORD)


def volatility_class(tags: Column) -> Column:
    return F.when(any_tag(tags, STABLE), "stable").when(any_tag(tags, VOLATILE), "volatile").otherwise("moderate")


def salience_legacy(text: Column, own: Column) -> Column:
    """0.5, 1 for a word of identity, 1.5 for a digit, up to 1 for intensifiers."""
    kinds = sum(((count_in(own, k) > 0).cast("int") for k in INTENSE), F.lit(0))
    return F.round(0.5 + (count_in(own, IDENTITY_WORDS) > 0).cast("int") + 1.5 * text.rlike("[0-9]").cast("int") + F.least(0.5 * kinds, F.lit(1.0)), 2)


def intensity(text: Column, own: Column) -> Column:
    out = (count_in(own, IDENTITY_WORDS) > 0).cast("double") + (text.rlike("[0-9]") | (count_in(own, FACT_WORDS) > 0)).cast("double")
    for kind, weight in EMOTIONS:
        out = out + weight * count_in(own, kind)
    return out + F.least(0.5 * sum((count_in(own, k) for k in INTENSE), F.lit(0)), F.lit(2.0))


def with_entropy(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the Shannon entropy of the words between white space, over the most that so many distinct words can have; 0 for fewer than two.

    In steps, as an expression that a lambda refers to is evaluated for each element unless it is a column."""
    df = df.withColumn("_words", F.array_sort(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")))
    n, w = F.size("_words"), F.col("_words")
    # the runs of the sorted words are their counts
    first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (F.get(w, i - 1) != F.get(w, F.greatest(i - 2, F.lit(0))))))
    df = df.withColumns({"_first": first, "_n": n})
    ends = F.concat(F.slice("_first", F.lit(2), F.greatest(F.size("_first"), F.lit(1))), F.array(F.col("_n") + 1))
    h = F.aggregate(F.zip_with("_first", ends, lambda a, b: (b - a) / F.col("_n")), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return df.withColumn(out, F.when(F.size("_first") > 1, h / F.log2(F.size("_first").cast("double"))).otherwise(0.0)).drop("_words", "_first", "_n")


_GROUPS = (IDENTITY_WORDS, FACT_WORDS, *(k for k, _ in EMOTIONS), *INTENSE)


def _counts(batches):
    """The last column (the text in lower case) replaced by how many of its words are of each of _GROUPS, and the entropy of the words of the text before it."""
    groups = [frozenset(g) for g in _GROUPS]
    some, word = frozenset().union(*groups), re.compile(r"\w+")  # letters, digits and underscores of any script
    for batch in batches:
        n, e = [], []
        for text, low in zip(batch.column(1), batch.column(2), strict=True):
            found = Counter(filter(some.__contains__, word.findall(low.as_py() or "")))
            n.append([sum(found[w] for w in found if w in g) for g in groups])
            k = np.fromiter(Counter(re.split(r"[ \t\n\r]+", (text.as_py() or "").strip(" \t\n\r"))).values(), float)
            p = k / k.sum()
            e.append(float(-(p * np.log2(p)).sum() / np.log2(p.size)) if p.size > 1 else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.list_(pa.int32())), pa.array(e, pa.float64())], names=["id", "content", "k", "e"])


def word_scores(r: DataFrame) -> DataFrame:
    """r (id, content) with x, legacy and critical, as of intensity, salience_legacy and safety_critical, and e, the Shannon entropy of the words
    between white space over the most that so many distinct words can have, 0 for fewer than two; one pass over each text in Python."""
    small_batches(r.sparkSession)
    c = r.select("id", "content", F.lower("content")).mapInArrow(_counts, "id bigint, content string, k array<int>, e double")
    n, at = (lambda i: F.get("k", F.lit(i))), {"identity": 0, "facts": 1, "emotions": 2, "intense": 2 + len(EMOTIONS)}
    some, digit = (lambda i: (n(i) > 0).cast("int")), F.col("content").rlike("[0-9]")
    kinds = range(at["intense"], at["intense"] + len(INTENSE))
    legacy = F.round(0.5 + some(at["identity"]) + 1.5 * digit.cast("int") + F.least(0.5 * sum((some(i) for i in kinds), F.lit(0)), F.lit(1.0)), 2)
    x = some(at["identity"]).cast("double") + (digit | (n(at["facts"]) > 0)).cast("double")
    for j, (_, weight) in enumerate(EMOTIONS):
        x = x + weight * n(at["emotions"] + j)
    x = x + F.least(0.5 * sum((n(i) for i in kinds), F.lit(0)), F.lit(2.0))
    critical = sum((n(at["emotions"] + j) for j, (_, weight) in enumerate(EMOTIONS) if weight >= 2.5), F.lit(0)) > 0
    return c.select("id", "content", "e", x.alias("x"), legacy.alias("legacy"), critical.alias("critical"))


def salience(intensity_: Column, entropy_: Column) -> Column:
    return F.round(F.least(F.greatest((0.5 * intensity_ + 0.3 * entropy_ + 0.2) * 2.5, F.lit(0.0)), F.lit(10.0)), 2)


def resonance(similarities: Column) -> Column:
    """nth root of the product of the positive ones, where n counts all; 1 for none, 0 if none is positive."""
    good = F.filter(similarities, lambda x: x > 0)
    logs = F.aggregate(good, F.lit(0.0), lambda s, x: s + F.log(x.cast("double")))
    return F.when(F.size(similarities) == 0, 1.0).when(F.size(good) == 0, 0.0).otherwise(F.exp(logs / F.size(similarities)))


def safety_critical(own: Column) -> Column:
    return count_in(own, [w for kind, weight in EMOTIONS if weight >= 2.5 for w in kind]) > 0


def anchor_impact(text: Column) -> Column:
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return F.when(F.length(text) > 150, 1.0).when(F.length(text) > 80, 0.5).otherwise(0.0) + F.when(digits >= 2, 0.3).otherwise(0.0) + F.when(text.rlike("(?i)" + METRICS), 0.5).otherwise(0.0)


def anchor_trigger(text: Column, intensity_: Column, pinned: Column) -> Column:
    """Why a text becomes an anchor: explicit, intensity, structural; null if it doesn't.  Texts under 20 bytes never do."""
    why = F.when(pinned, "explicit").when(intensity_ >= 3.5, "intensity").when((anchor_impact(text) >= 1.3) | has(text, PIN_MARKS), "structural")
    return F.when(F.octet_length(text) >= 20, why)


def sentences(text: Column) -> Column:
    """Parts between . ! ? and line ends with four words or more."""
    parts = F.transform(F.split(text, r"[.!?\n]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 4)


def certainty(low: Column) -> Column:
    return F.when(has(low, SPECULATIVE), "speculative").when(has(low, HEDGE), "hedged").otherwise("asserted")


def claim_kind(low: Column) -> Column:
    unsure = has(low, HEDGE) | has(low, SPECULATIVE)
    return F.when(has(low, COMMIT), "commitment").when(unsure & has(low, CONTRAST), "uncertainty").otherwise("claim")


def deadline(low: Column) -> Column:
    return F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in DEADLINES])


def topic_tags(low: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(t)) for k, t in TOPICS])))


def semantic_type(low: Column) -> Column:
    return (
        F.when(has(low, COMMIT), "decision")
        .when(has(low, ("prefer", "like", "перевагу", "подобається")), "preference")
        .when(has(low, ("trend", "pattern", "завжди", "зазвичай", "often")), "trend")
        .otherwise("fact")
    )


def polarity(tags: Column, content: Column, kind: Column, negative=NEGATIVE) -> tuple[Column, Column]:
    """Positive and negative signals: keywords in tags and text, two negative ones for a contradiction."""
    low, t = F.lower(content), F.transform(tags, F.lower)
    in_tags = lambda own: F.size(F.filter(t, lambda x: has(x, own)))
    return in_tags(POSITIVE) + hits(low, POSITIVE), in_tags(negative) + hits(low, negative) + F.when(kind == "contradiction", 2).otherwise(0)


def relation_text(text: Column) -> Column:
    """Lower-case ASCII letters and digits between single blanks, one at either end; one blank for none."""
    core = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(core == "", " ").otherwise(F.concat(F.lit(" "), core, F.lit(" ")))


FAMILY = tuple(f"{k}>{k}".split(">")[:2] for k in "brother|sister|mother|father|mom>mother|dad>father|wife|husband|son|daughter|grandmother|grandfather".split("|"))


def family_relation(relation: Column) -> Column:
    return F.coalesce(*[F.when(relation.contains(f"my {p}"), F.lit(f"family.{k}")) for p, k in FAMILY])


def cleaned(text: Column) -> Column:
    """Lines with single blanks inside; a run of blank lines is one, those at the start go."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    out = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"^\n+", ""), r"([^\n])\n$", "$1")


def sharpened(query: Column) -> Column:
    """In lower case, without one leading question phrase if something is left."""
    low = F.lower(query)
    first = F.coalesce(*[F.when(low.startswith(p), F.lit(p)) for p in ASKING])
    rest = F.trim(F.substr(low, F.length(first) + 1))
    return F.when(first.isNotNull() & (rest != ""), rest).otherwise(low)


def fold_accents(text: Column) -> Column:
    lower, base = ACCENTS
    return F.translate(text, lower + "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", base + "aaaaaaaceeeeiiiidnoooooouuuuyt")


def project(text: Column, dictionary: dict[str, str]) -> Column:
    """Each word replaced by its canonical form, looked up without accents; others in lower case."""
    known = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    own = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(own, lambda w: F.coalesce(known[fold_accents(F.lower(w))], F.lower(w))), " ")


def token_estimate(text: Column) -> Column:
    return F.floor(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) * 1.3).cast("bigint")


DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
OFFSETS = {"today": 0, "now": 0, "yesterday": -1, "tomorrow": 1, "day before yesterday": -2, "day after tomorrow": 2}
RANGES = {"last week": (-7, -1), "this week": (-6, 0), "next week": (1, 7), "last month": (-30, -1), "this month": (-29, 0), "last year": (-365, -1), "past week": (-7, 0), "past month": (-30, 0), "recently": (-7, 0), "lately": (-14, 0)}
PARTS = {"morning": "morning", "this morning": "morning", "afternoon": "afternoon", "this afternoon": "afternoon", "evening": "evening", "this evening": "evening", "tonight": "night", "last night": "night"}


def last_weekday(day: Column, name: str) -> Column:
    """The latest one strictly before the day."""
    return F.next_day(F.date_sub(day, 8), name[:3])


def next_weekday(day: Column, name: str) -> Column:
    return F.next_day(day, name[:3])


def time_phrases(day: Column) -> list[tuple[str, Column]]:
    """Phrases, longest first, and what stands for each, seen from a day."""
    iso = lambda d: d.cast("string")
    out = {k: iso(F.date_add(day, n)) for k, n in OFFSETS.items()}
    out |= {k: F.concat(iso(F.date_add(day, a)), F.lit(" to "), iso(F.date_add(day, b))) for k, (a, b) in RANGES.items()}
    out |= {f"last {d}": iso(last_weekday(day, d)) for d in DAYS} | {f"next {d}": iso(next_weekday(day, d)) for d in DAYS}
    out |= {k: F.concat(iso(day), F.lit(" " + v)) for k, v in PARTS.items()}
    return sorted(out.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def resolve_time(text: Column, day: Column) -> Column:
    for phrase, value in time_phrases(day):
        text = F.regexp_replace(text, F.lit("(?i)" + phrase), value)
    return text


def first_date(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def half_life(day: Column, today: Column, days: float) -> Column:
    ago = F.datediff(today, day)
    return F.when(ago < 0, 1.0).otherwise(F.pow(F.lit(2.0), -ago / days))


CREDIBLE = {
    "pubmed.ncbi.nlm.nih.gov": 0.95, "ncbi.nlm.nih.gov": 0.95, "who.int": 0.95, "cdc.gov": 0.95, "mayoclinic.org": 0.90, "clevelandclinic.org": 0.90, "hopkinsmedicine.org": 0.90, "medlineplus.gov": 0.90,
    "sciencedirect.com": 0.85, "nature.com": 0.90, "bmj.com": 0.90, "thelancet.com": 0.90, "webmd.com": 0.70, "healthline.com": 0.65, "medicalnewstoday.com": 0.65, "arxiv.org": 0.90, "scholar.google.com": 0.85,
    "wikipedia.org": 0.75, "britannica.com": 0.85, "bbc.com": 0.80, "reuters.com": 0.85, "apnews.com": 0.85, "npr.org": 0.80, "nytimes.com": 0.80, "wsj.com": 0.80, "economist.com": 0.85, "bloomberg.com": 0.80,
    "stackoverflow.com": 0.75, "github.com": 0.70, "docs.rs": 0.80, "docs.python.org": 0.85, "developer.mozilla.org": 0.85, "rust-lang.org": 0.85, "reddit.com": 0.40, "quora.com": 0.35, "twitter.com": 0.30, "x.com": 0.30,
    "facebook.com": 0.25, "instagram.com": 0.25, "tiktok.com": 0.20, "youtube.com": 0.40, "medium.com": 0.50, "linkedin.com": 0.50,
}


def domain(url: Column) -> Column:
    host = F.element_at(F.split(F.regexp_replace(url, "^https?://", ""), "/"), 1)
    return F.element_at(F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), ":"), 1)


def credibility(url: Column, overrides: dict[str, float]) -> Column:
    """Score of a URL's domain: an override, the domain's own, that of its last two labels, 0.5."""
    d = domain(url)
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
    labels = F.split(d, r"\.")
    parent = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), "."))
    tries = ([table(overrides)[d]] if overrides else []) + [table(CREDIBLE)[d], table(CREDIBLE)[F.coalesce(parent, F.lit(""))], F.lit(0.5)]
    return F.when(url == "", 0.5).otherwise(F.coalesce(*tries))
