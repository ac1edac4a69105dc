"""Citations such as [3] in generated text: one form, only known numbers, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

BULLET = r"^\s*[-*•]\s+"


def normalize_citations(c: Column | str) -> Column:
    """Citations in corner brackets become square ones."""
    return F.regexp_replace(col(c), r"【\s*(\d+)\s*】", "[$1]")


def validate(markdown: Column | str, allowed: Column | str) -> Column:
    """struct(markdown, bullets, uncited_bullets, invalid_citations) after unknown citations are taken out.

    `allowed` is an array of numbers. Each line is split at its citations, and put together
    again from what may stay.
    """
    known = F.transform(F.coalesce(col(allowed), F.array().cast("array<int>")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]")))
    units = lambda line: F.regexp_extract_all(line, F.lit(r"(\[\d+\]|\[|[^\[]+)"), F.lit(1))
    plain = lambda u: F.regexp_replace(u, r"^\[0*(\d+)\]$", "[$1]")
    unknown = lambda u: u.rlike(r"^\[\d+\]$") & ~F.array_contains(known, plain(u))
    lines = F.split(F.coalesce(normalize_citations(markdown), F.lit("")), "\r\n|\n")
    kept = F.transform(lines, lambda line: F.rtrim(F.array_join(F.filter(units(line), lambda u: ~unknown(u)), "")))
    bullets = F.filter(kept, lambda line: line.rlike(BULLET))
    return F.struct(
        F.trim(F.array_join(kept, "\n")).alias("markdown"),
        F.size(bullets).alias("bullets"),
        F.size(F.filter(bullets, lambda line: ~line.rlike(r"\[\d+\]"))).alias("uncited_bullets"),
        F.aggregate(lines, F.lit(0), lambda n, line: n + F.size(F.filter(units(line), unknown))).alias("invalid_citations"),
    )
