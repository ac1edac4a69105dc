"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: (verdict, host and path); the longest that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: One of these blocks a url.
STRICT = ("ads-track", "adserver", "casino", "doubleclick", "escort", "hardcore", "jackpot", "malware", "phishing", "porn", "porno", "viagra", "warez", "xxx")
#: Two different ones of these block a url.
SOFT = ("ad", "ads", "adult", "affiliate", "banner", "bet", "bonus", "click", "coupon", "crack", "dating", "free", "loan", "lottery", "nude", "pills", "poker", "popup", "promo", "redirect", "sex", "sponsor", "track", "tracker", "win")
SOFT_HITS = 2
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_INNER = frozenset(ascii_lowercase + "0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


@lru_cache(8)
def _by_host(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    """Host -> its rules as (rule, path, verdict), the longest first."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in sorted(rules, key=lambda x: -len(x[1])):
        host, _, path = rule.partition("/")
        out.setdefault(host, []).append((rule, f"/{path}", verdict))
    return out


def fitting_rule(host: str, path: str, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[str, str] | None:
    """The longest rule that fits, with its verdict; looked up by the host and each of its parents."""
    by_host, best, at = _by_host(rules), None, host
    while at:
        for rule, start, verdict in by_host.get(at, ()):
            if path.startswith(start):
                if best is None or len(rule) > len(best[0]):
                    best = rule, verdict
                break
        at = at.partition(".")[2]
    return best


@lru_cache(8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in soft:
        found.add_word(word, (word, False))
    for word in strict:
        found.add_word(word, (word, True))
    found.make_automaton()
    return found


def weigh(url: str | None, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Strict hits and distinct soft terms of a whole url. A hit has no ASCII letter or digit beside it."""
    low = (url or "").translate(_LOWER)
    hits, terms = 0, set()
    for end, (word, is_strict) in _automaton(strict, soft).iter(low):
        start = end + 1 - len(word)
        if (start and low[start - 1] in _INNER) or (end + 1 < len(low) and low[end + 1] in _INNER):
            continue
        if is_strict:
            hits += 1
        else:
            terms.add(word)
    return hits, len(terms)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """(page_id, url, ...) -> (page_id, host, path, rule, verdict, strict_hits, soft_hits), a row per row, without a shuffle.

    The longest fitting rule decides; where none fits, one strict hit or `soft_hits` distinct
    soft ones block. A null url, or one without "://", has empty host and path, fits no
    rule, and is judged by its terms (null: allowed). Only page_id and url are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                fits = fitting_rule(host, path, rules)
                hard, mild = weigh(url, strict, soft)
                verdict = fits[1] if fits else "block" if hard or mild >= soft_hits else "allow"
                out.append((host, path, fits[0] if fits else None, verdict, hard, mild))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *(pa.array(x, pa.string()) for x in cols[:4]), *(pa.array(x, pa.int32()) for x in cols[4:])],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def oracle() -> str:
    """DuckDB SQL for judge_urls over the table pages."""
    lower = f"'{ascii_uppercase}', '{ascii_lowercase}'"
    has = lambda words: f"regexp_matches(low, '(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)')"
    fits = []
    for verdict, rule in sorted(RULES, key=lambda x: -len(x[1])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + f" WHEN {has(STRICT)} OR {' + '.join(f'{has([w])}::INT' for w in SOFT)} >= {SOFT_HITS} THEN 'block' ELSE 'allow' END"
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), {lower}) AS low, strpos(coalesce(url, ''), '://') AS cut, coalesce(url, '') AS url FROM pages
), b AS (
  SELECT page_id, low, CASE WHEN cut > 0 THEN substr(url, cut + 3) ELSE '' END AS rest FROM a
), c AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM b
)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM c"""
