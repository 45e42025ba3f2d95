"""Scores of a record as column expressions, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_STRENGTH = 0.05


def importance(connections: Column) -> Column:
    """Weighted sum of strength, level, connections, activations and salience; the weights add up to 1.1."""
    cap = lambda c, most: F.least(c / most, F.lit(1.0))
    return 0.40 * F.col("strength") + 0.25 * F.col("level") / 4 + 0.20 * cap(connections, 50) + 0.15 * cap(F.col("activation_count"), 20) + 0.10 * F.least(F.greatest(F.col("salience"), F.lit(0.0)), F.lit(1.0))


def decayed() -> Column:
    """Strength after one decay step: the level's rate, nearer to 0.999 with each of the first ten activations, plus a little for salience."""
    base = F.element_at(F.array(*[F.lit(x) for x in (0.80, 0.90, 0.95, 0.99)]), F.col("level"))
    rate = F.least(base + (0.999 - base) * F.least(F.col("activation_count") / 10, F.lit(1.0)), F.lit(0.999))
    return F.col("strength") * F.least(rate + 0.03 * F.least(F.greatest(F.col("salience"), F.lit(0.0)), F.lit(1.0)), F.lit(0.999))


def alive() -> Column:
    return F.col("strength") >= MIN_STRENGTH


def promotable() -> Column:
    return (F.col("activation_count") >= 5) & (F.col("strength") >= 0.7) & (F.col("level") < 4)


def trust(now: float, authority: dict[str, float]) -> Column:
    """(trust score + boost for the fresh) x authority of the origin x factor of the source type, within 0.05 and 1."""
    age = F.greatest((F.lit(now) - F.col("created_at")) / 86400, F.lit(0.0))
    boost = F.greatest(0.2 * (1 - age / 7.0), F.lit(0.0))
    known = F.create_map(*[F.lit(x) for kv in authority.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in (("recorded", 1.0), ("retrieved", 0.9), ("inferred", 0.85), ("generated", 0.8)) for x in kv])
    value = (F.coalesce("trust_score", F.lit(0.5)) + boost) * F.coalesce(known[F.col("origin")], F.lit(0.85)) * F.coalesce(kind[F.col("source_type")], F.lit(0.9))
    return F.least(F.greatest(value, F.lit(0.05)), F.lit(1.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
