"""Pieces of SQL for DuckDB that stand beside the column expressions of functions.text."""

from __future__ import annotations

from ..functions import text as T


def q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def has(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def hits(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(w)}) AS INT)" for w in words) + ")"


def any_tag(tags: str, own) -> str:
    return f"list_has_any({tags}, [{', '.join(map(q, own))}])"


def words(col: str) -> str:
    return f"list_filter(string_split_regex(lower({col}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def blanks(col: str) -> str:
    """Words between white space."""
    return f"list_filter(string_split_regex({col}, '\\s+'), lambda w: w <> '')"


def count_in(own: str, kind) -> str:
    return f"len(list_filter({own}, lambda w: w IN ({', '.join(map(q, kind))})))"


def match(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def sensitive(col: str) -> str:
    return "(" + " OR ".join(match(col, p) for p in (T.EMAIL, T.WALLET, T.API_KEY, "(?i)" + T.PASSWORD)) + ")"


def intensity(w: str, digits: str) -> str:
    return (
        f"(CAST({count_in(w, T.IDENTITY_WORDS)} > 0 AS INT) + CAST({digits} OR {count_in(w, T.FACT_WORDS)} > 0 AS INT) + "
        + " + ".join(f"{x}e0 * {count_in(w, kind)}" for kind, x in T.EMOTIONS)
        + f" + least(0.5e0 * ({' + '.join(count_in(w, k) for k in T.INTENSE)}), 2e0))"
    )


def impact(col: str) -> str:
    return f"(CASE WHEN length({col}) > 150 THEN 1e0 WHEN length({col}) > 80 THEN 0.5e0 ELSE 0e0 END + CASE WHEN length({col}) - length(translate({col}, '0123456789', '')) >= 2 THEN 0.3e0 ELSE 0e0 END + CASE WHEN {match(col, '(?i)' + T.METRICS)} THEN 0.5e0 ELSE 0e0 END)"


def last_day(day: str, name: str) -> str:
    return f"CAST({day} - CAST((isodow({day}) - {T.DAYS.index(name) + 1} + 6) % 7 + 1 AS INT) AS DATE)"


def next_day(day: str, name: str) -> str:
    return f"CAST({day} + CAST(({T.DAYS.index(name) + 1} - isodow({day}) + 6) % 7 + 1 AS INT) AS DATE)"


def resolve(col: str, day: str) -> str:
    plus = lambda n: f"strftime({day} + CAST({n} AS INT), '%Y-%m-%d')"
    out = {k: plus(n) for k, n in T.OFFSETS.items()} | {k: f"{plus(a)} || ' to ' || {plus(b)}" for k, (a, b) in T.RANGES.items()}
    out |= {f"last {d}": f"strftime({last_day(day, d)}, '%Y-%m-%d')" for d in T.DAYS} | {f"next {d}": f"strftime({next_day(day, d)}, '%Y-%m-%d')" for d in T.DAYS}
    out |= {k: f"{plus(0)} || ' {v}'" for k, v in T.PARTS.items()}
    for phrase, value in sorted(out.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        col = f"regexp_replace({col}, '(?i){phrase}', {value}, 'g')"
    return col


def polarity(tags: str, content: str, kind: str, negative=T.NEGATIVE) -> tuple[str, str]:
    t = lambda own: f"len(list_filter({tags}, lambda t: {has('lower(t)', own)}))"
    low = f"lower({content})"
    return f"({t(T.POSITIVE)} + {hits(low, T.POSITIVE)})", f"({t(negative)} + {hits(low, negative)} + CASE WHEN {kind} = 'contradiction' THEN 2 ELSE 0 END)"
