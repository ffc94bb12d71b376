"""Drift that is none: comments, white space, marks that don't matter, and imports in another order, by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a scanner meets first wins: a string (kept, with what it holds) or a comment (dropped). Strings by language, then
#: comments; languages that aren't here are read like TypeScript.
DOUBLE, SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\z)"
SCANNERS = {
    "typescript": (DOUBLE, SINGLE, r"`(?:\\.|[^`\\])*`", C_COMMENT),
    "python": (r'""".*?"""', r"'''.*?'''", DOUBLE, SINGLE, r"#[^\n]*"),
    "go": (DOUBLE, r"'(?:\\.|[^'\\\n])+'", r"`[^`]*`", C_COMMENT),
    "java": (r'""".*?"""', DOUBLE, SINGLE, C_COMMENT),
    "rust": (DOUBLE, r"'(?:\\.|[^'\\\n])'", C_COMMENT),
}
SAME_AS = {"javascript": "typescript", "kotlin": "java"}
#: What an import looks like in each language.
IMPORTS = {
    "typescript": r"import\s+(?:type\s+)?(?:\{[^}]+\}|[\w*]+)\s+from\s+['\"][^'\"]+['\"]",
    "python": r"(?:from\s+\S+\s+import\s+.+|import\s+\S+)",
    "go": r"import\s+(?:\"[^\"]+\"|[\w.]+)",
    "java": r"import\s+(?:static\s+)?[\w.]+\s*;?",
    "rust": r"use\s+[\w:]+(?:::\{[^}]+\})?",
}


def by_language(language: Column, of) -> Column:
    """``of(name)`` for the language's scanner."""
    names = F.coalesce(F.lower(language), F.lit("typescript"))
    out = None
    for name in SCANNERS:
        if name != "typescript":
            hit = names.isin(name, *[k for k, v in SAME_AS.items() if v == name])
            out = F.when(hit, of(name)) if out is None else out.when(hit, of(name))
    return out.otherwise(of("typescript"))


def without_comments(text: Column, language: Column) -> Column:
    """A text without comments; a comment's mark inside a string is part of the string. One pass from left to right."""

    def scan(name: str) -> Column:
        *strings, comment = SCANNERS[name]
        return F.regexp_replace(text, f"(?s)({'|'.join(strings)})|{comment}", "$1")

    return by_language(language, scan)


def normal(text: Column, language: Column) -> Column:
    """A text without comments, runs of white space as one space; no semicolons and trailing commas where they don't matter."""
    flat = F.regexp_replace(without_comments(text, language), r"\s+", " ")
    commas = F.regexp_replace(flat, r",\s*([}\])])", "$1")
    loose = {"typescript": F.replace(commas, F.lit(";"), F.lit("")), "go": commas}
    return F.trim(by_language(language, lambda name: loose.get(name, flat)))


def noise(items: DataFrame) -> DataFrame:
    """``items`` (old, new, language, ...) with a ``reason`` to leave them out: formatting, imports, or null for real drift.

    Formatting: equal but for comments, white space and marks that don't matter. Imports: the same bag of imports, not
    empty, in another order, and equal in all else. Where a side is null or empty the item is real.
    """
    language = F.col("language")
    bag = lambda c: F.array_sort(by_language(language, lambda name: F.regexp_extract_all(c, F.lit(IMPORTS[name]), F.lit(0))))
    rest = lambda c: normal(by_language(language, lambda name: F.regexp_replace(c, IMPORTS[name], " ")), language)
    there = (F.length("old") > 0) & (F.length("new") > 0)
    old, new = F.col("old"), F.col("new")
    same = (F.size(bag(old)) > 0) & (bag(old) == bag(new)) & (rest(old) == rest(new))
    return items.withColumn("reason", F.when(there & (normal(old, language) == normal(new, language)), "formatting").when(there & same, "imports"))
