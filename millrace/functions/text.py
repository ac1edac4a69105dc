"""Text expressions: whitespace, fillers, lists stored as text, tokens, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value.
FILLERS = ("none", "nan", "n/a", "null", "[]", "")
#: Words that the lexical index leaves out.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "of", "at",
    "by", "for", "with", "about", "into", "to", "from", "in", "on", "is",
    "are", "was", "were", "be", "been", "being", "it", "its", "this", "that",
    "these", "those", "as", "i", "me", "my", "we", "our", "you", "your",
)
#: Fixed value: a lexical token, with inner punctuation so that c++, gpt-4 and node.js stay whole.
TOKEN = r"([a-z0-9][a-z0-9+#.\-]*)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of white space and invisible characters as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(col(c), r"(?U)[\s​‌‍﻿]+", " "))


def clean(c: Column | str) -> Column:
    """Normalised text, or an empty string for null and for words that stand for nothing."""
    text = F.coalesce(normalize_whitespace(col(c).cast("string")), F.lit(""))
    return F.when(F.lower(text).isin(*FILLERS), F.lit("")).otherwise(text)


def nonblank(c: Column) -> Column:
    return F.when(c != "", c)


def first_nonblank(*cols: Column) -> Column:
    """The first column that is neither null nor empty; an empty string if there is none."""
    return F.coalesce(*(nonblank(c) for c in cols), F.lit(""))


def clean_list(c: Column | str) -> Column:
    """Items of an array of strings, normalised, without empty ones; null is empty."""
    items = F.coalesce(col(c), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.coalesce(normalize_whitespace(x), F.lit(""))), lambda x: x != "")


def list_from_text(c: Column | str) -> Column:
    """An array from the printed form of a list of strings ("['a', 'b']"); other text is its only item, null and blank none.

    Items are quoted strings or bare words; a list that is neither is kept whole.
    """
    text = F.trim(F.coalesce(col(c), F.lit("")))
    quoted = F.regexp_extract_all(text, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,\[\]'"]+)"""), F.lit(1))
    bare = F.transform(quoted, lambda x: F.when(x.rlike(r"""^(['"]).*\1$"""), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    items = F.transform(bare, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    looks = text.rlike(r"""(?s)^\[\s*(?:(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,\[\]'"]+)\s*(?:,\s*|(?=\])))*\]$""")
    return clean_list(F.when(text == "", F.array().cast("array<string>")).when(looks, items).otherwise(F.array(text)))


def tokenize(c: Column | str) -> Column:
    """Lexical tokens in order, repeats kept.

    Stop words are left out before dots and hyphens are stripped from the ends, so "the." stays
    as "the"; what is left must have two characters or more.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(1))
    kept = F.filter(found, lambda t: ~t.isin(*STOPWORDS))
    return F.filter(F.transform(kept, lambda t: F.btrim(t, F.lit(".-"))), lambda t: F.length(t) > 1)


def strip_html(c: Column | str) -> Column:
    """Text of a piece of markup: scripts, styles, comments and tags off, the common references decoded."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0*39;|&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&hellip;", "…"), ("&amp;", "&")):
        text = F.regexp_replace(text, name, value)
    return normalize_whitespace(text)
