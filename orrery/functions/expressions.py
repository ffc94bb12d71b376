"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score of each confidence level, and of each tier of an unpersisted edge.
LEVELS = {"EXTRACTED": 0.95, "INFERRED": 0.65, "AMBIGUOUS": 0.25}
TIERS = {"high": "EXTRACTED", "medium": "INFERRED", "low": "AMBIGUOUS"}


def case(value: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def level_score(level: Column) -> Column:
    return case(level, LEVELS)


def tier_level(tier: Column) -> Column:
    return case(tier, TIERS)


def evidence_level(n: Column) -> Column:
    """3 or more pieces of evidence: EXTRACTED; any: INFERRED; none: AMBIGUOUS."""
    return F.when(n >= 3, "EXTRACTED").when(n >= 1, "INFERRED").otherwise("AMBIGUOUS")


def edge_score(score: Column, level: Column) -> Column:
    """A missing score falls back to the level's; null when both are missing."""
    return F.coalesce(score, level_score(level))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, empty) -> Column:
    """part / whole, or ``empty`` for an empty whole: callers differ in what an empty whole means."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def slug(heading: Column) -> Column:
    kept = F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(kept), r"\s+", "-"), "-+", "-")


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def version_key(version: Column) -> Column:
    """Major, minor and patch as a comparable struct; missing parts count as 0, an unparsable version is null."""
    number = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(version, number, i), F.lit("")).cast("int"), F.lit(0))
    return F.when(version.rlike(r"^v?\d"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def age_days(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 8.64e10


def freshness(days: Column) -> Column:
    return F.when(days > 90, "stale").when(days > 30, "aging").otherwise("fresh")


def estimated_tokens(text: Column, rate: float = 4.0) -> Column:
    return F.ceil(F.length(text) / rate)


def hue(index: Column, total: Column) -> Column:
    return F.pmod(F.round(index / total * 360), F.lit(360)).cast("int")


def radius(degree: Column) -> Column:
    return F.round(F.lit(4) + F.lit(16) * F.ln(F.lit(1) + degree) / F.ln(F.lit(1001)))


def opacity(score: Column) -> Column:
    return F.lit(0.1) + F.lit(0.7) * clamp(score, 0.0, 1.0)
