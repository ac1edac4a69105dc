"""Amounts, rounds and the confidence in what was extracted about them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, normalize_whitespace

#: Approximate dollars of one unit, for ranking only.
USD_PER = {
    "USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CAD": 0.73, "AUD": 0.66, "CHF": 1.12,
    "INR": 0.012, "JPY": 0.0067, "SGD": 0.74, "SEK": 0.095, "DKK": 0.145, "NOK": 0.093,
    "ILS": 0.27, "BRL": 0.18, "KRW": 0.00073, "CNY": 0.14, "AED": 0.27,
}
#: Names of rounds.
ROUND_NAMES = ("pre-seed", "seed", "series a", "series b", "series c", "series d", "series e", "series f", "growth", "bridge", "angel", "debt", "grant", "other")
#: Fixed value: titles that may tell of funding.
FUNDING_TITLE = (
    r"(?i)\b(raises?|raised|raising|funding|series [a-e]\b|seed round|pre-seed|"
    r"valuation|secures?|closes? .{0,30}round|led by|investment|invests?)\b"
)
#: Fixed value: titles of roundups, lists, reports and rumours, which announce no single round.
NOT_A_ROUND = (
    r"(?i)\b(roundup|round-up|round up|wrap|wrap-up|recap|biggest (funding )?rounds?|top \d+|"
    r"\d+ (companies|startups|deals|rounds)|this week'?s|the week'?s|weekly|monthly|quarterly|"
    r"q[1-4]\b|in talks|talks to|reportedly|report says|is said to|seeks|seeking|could raise|"
    r"may raise|plans? to raise|looks? to raise|eyes|explores?|considering|timeline|unicorn board|"
    r"here'?s who|who'?s raising|the state of)\b"
)


def is_funding_title(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(FUNDING_TITLE)


def is_single_announcement(c: Column | str) -> Column:
    return ~F.coalesce(col(c), F.lit("")).rlike(NOT_A_ROUND)


def amount_usd(amount: Column | str, currency: Column | str) -> Column:
    """Whole dollars by the fixed rates; null without an amount or for another currency."""
    rates = F.create_map(*(F.lit(x) for pair in USD_PER.items() for x in pair))
    return F.bround(col(amount).cast("double") * F.try_element_at(rates, col(currency)), 0)


def round_name(c: Column | str) -> Column:
    """A round's canonical name; "other" for unknown ones, null for none."""
    text = F.regexp_replace(F.replace(F.lower(F.trim(col(c))), F.lit("_"), F.lit(" ")), r"\s+", " ")
    text = F.regexp_replace(text, r"^series[\s-]*([a-f])$", "series $1")
    text = F.regexp_replace(text, "preseed|pre seed", "pre-seed")
    return F.when(F.trim(col(c)) == "", None).when(text.isin(*ROUND_NAMES), text).when(text.isNotNull(), "other")


def currency_code(c: Column | str) -> Column:
    text = F.upper(F.trim(col(c)))
    return F.when(text != "", F.substring(text, 1, 3))


def names(c: Column | str, most: int = 12) -> Column:
    """Normalised names of a list, the first twelve; null is empty."""
    items = F.filter(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.slice(F.transform(items, normalize_whitespace), 1, most)


def amount_forms(amount: Column | str) -> Column:
    """The ways in which an amount may stand in a text, lower-cased."""
    amount = col(amount)
    plain = F.format_number(amount, 0)
    out = F.array(plain)
    for unit, word in ((1e3, "thousand"), (1e6, "million"), (1e9, "billion")):
        n = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", amount / F.lit(unit)), "0+$", ""), r"\.$", "")
        forms = [F.concat(n, F.lit(x)) for x in (f" {word}", word[0], f" {word[0]}", *(["bn"] if word == "billion" else []))]
        out = F.when(amount >= unit, F.array(plain, *forms)).otherwise(out)
    return out


def confidence(company: Column | str, amount: Column | str, text: Column | str) -> Column:
    """high: company and amount stand in the text; medium: the company does; else low."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    named = (F.coalesce(col(company), F.lit("")) != "") & low.contains(F.lower(col(company)))
    seen = F.exists(amount_forms(amount), lambda x: low.contains(x))
    return F.when(~F.coalesce(named, F.lit(False)), "low").when(col(amount).isNull(), "medium").when(seen, "high").otherwise("medium")


def round_summary() -> Column:
    """A sentence about a round, from its columns."""
    usd, amount = F.col("amount_usd"), F.col("amount")
    said = F.when(usd != 0, F.concat(F.lit("$"), F.format_number(usd, 0))).when((amount != 0) & (F.col("currency") != ""), F.concat(F.format_number(amount, 0), F.lit(" "), F.col("currency"))).otherwise("an undisclosed amount")
    lead = F.array_join(F.slice(F.col("lead_investors"), 1, 3), ", ")
    parts = (
        F.concat(F.coalesce(F.col("company"), F.lit("?")), F.lit(" raised "), said),
        F.when(F.col("round") != "", F.concat(F.lit("("), F.col("round"), F.lit(")"))),
        F.when(lead != "", F.concat(F.lit("led by "), lead)),
        F.concat(F.lit("on "), F.date_format("announced_at", "yyyy-MM-dd")),
    )
    return F.concat(F.concat_ws(" ", *parts), F.lit("."))


def format_money(c: Column | str) -> Column:
    """$1.2B, $3.4M, $5K, $6; a dash for null and zero."""
    x = col(c)
    short = lambda unit, mark: F.concat(F.lit("$"), F.regexp_replace(F.format_string("%.1f", x / F.lit(unit)), r"\.0$", ""), F.lit(mark))
    return F.when(x >= 1e9, short(1e9, "B")).when(x >= 1e6, short(1e6, "M")).when(x >= 1e3, short(1e3, "K")).when(x > 0, F.concat(F.lit("$"), F.format_number(x, 0))).otherwise("—")
