"""Keys and hashes that make ingestion idempotent: urls, names, document keys, companies, rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, first_nonblank, nonblank

#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "ref", "ref_src", "mc_cid", "mc_eid", "igshid")
#: Words of a company's legal form.
LEGAL_FORMS = ("inc", "llc", "ltd", "corp", "co", "gmbh", "plc")
#: Hosts that never identify a company, and suffixes of two labels.
SHARED_HOSTS = (
    "ycombinator.com", "github.com", "gitlab.com", "linkedin.com", "twitter.com", "x.com",
    "medium.com", "substack.com", "notion.site", "notion.so", "google.com", "docs.google.com",
    "apps.apple.com", "play.google.com", "producthunt.com", "huggingface.co", "youtube.com",
    "youtu.be", "discord.gg", "discord.com", "apple.com", "vercel.app", "netlify.app",
    "webflow.io", "framer.website", "framer.ai", "carrd.co", "gumroad.com", "typeform.com",
)
PUBLIC_SUFFIXES = ("co.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.sg", "org.uk", "ac.uk")

_URL = r"(?is)^https?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _web(c: Column | str) -> Column:
    return F.trim(F.coalesce(col(c), F.lit("")))


def url_host(c: Column | str) -> Column:
    """Lower-cased host of a web url without a leading www., with its port; empty if it is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(_web(c), _URL, 1)), r"^www\.", "")


def canonical_url(c: Column | str) -> Column:
    """https, plain host, no fragment, no tracking or empty parameters, no trailing slash; empty for anything but a web url.

    Parameters are decoded and encoded again, so that spellings of one url agree.
    """
    url = _web(c)
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), r"/+$", "")
    pairs = F.split(F.regexp_extract(url, _URL, 3), "&")
    name = lambda p: F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))
    kept = F.filter(pairs, lambda p: p.rlike("^[^=]*=.+") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
    again = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    query = F.array_join(F.transform(kept, lambda p: F.concat(again(F.substring_index(p, "=", 1)), F.lit("="), again(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)))), "&")
    whole = F.concat(F.lit("https://"), url_host(c), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(r"(?i)^https?://"), whole).otherwise("")


def name_key(c: Column | str) -> Column:
    """A company's name without a final bracket and legal forms, as lower-case ASCII letters and digits only."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s*\([^)]*\)\s*$", "")
    text = F.regexp_replace(F.lower(text), rf"(?U)\b({'|'.join(LEGAL_FORMS)})\b\.?", " ")
    return F.regexp_replace(F.replace(text, F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", "")


def registered_domain(c: Column | str) -> Column:
    """The last two labels of a url's host, three below a public suffix of two; empty for shared hosts and for no web url."""
    parts = F.split(F.regexp_replace(url_host(c), ":.*$", ""), r"\.")
    n = F.size(parts)
    last = lambda k: F.array_join(F.slice(parts, -k, k), ".")
    domain = F.when(n < 2, "").when((n >= 3) & F.when(n >= 2, last(2)).isin(*PUBLIC_SUFFIXES), F.when(n >= 3, last(3))).otherwise(F.when(n >= 2, last(2)))
    return F.when(domain.isin(*SHARED_HOSTS), "").otherwise(F.coalesce(domain, F.lit("")))


def company_slug(directory_slug: Column | str, domain: Column | str, key: Column | str) -> Column:
    """A company's slug from its strongest identity."""
    by_domain = F.concat(F.lit("d-"), F.regexp_replace(col(domain), "[^a-z0-9]+", "-"))
    return F.when(col(directory_slug) != "", F.concat(F.lit("yc-"), col(directory_slug))).when(col(domain) != "", by_domain).otherwise(F.concat(F.lit("n-"), col(key)))


def _lower(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))


def _prefixed(prefix: str, key: Column) -> Column:
    return F.when(key != "", F.concat(F.lit(prefix), key))


def doc_key(kind: Column | str = "type") -> Column:
    """The unique key of a document by its type; null where it has nothing to be keyed on. Needs the fields of all types."""
    listed = F.coalesce(*(F.when(F.lower(F.col(f)).contains("ycombinator.com"), nonblank(F.lower(F.regexp_extract(f, r"/companies/([^/?#]+)", 1)))) for f in ("company_url", "url")))
    source = F.coalesce(nonblank(_lower("source")), F.lit("manual"))
    source = F.when(source == "ycombinator", "yc").when(source == "startupsavant", "savant").otherwise(source)
    startup = F.coalesce(F.concat(F.lit("startup:yc:"), listed), F.when(name_key("name") != "", F.concat(F.lit("startup:"), source, F.lit(":"), name_key("name"))))
    page = canonical_url(first_nonblank(F.col("article_url"), F.col("url"), F.col("link")))
    feed = F.concat(F.lit("article:"), F.coalesce(nonblank(_lower("source")), F.lit("unknown")), F.lit(":"), name_key("title"))
    article = F.when(page != "", F.concat(F.lit("article:"), page)).when(name_key("title") != "", feed)
    launch = F.when((_lower("platform") == "yc") & F.col("yc_launch_id").isNotNull(), F.concat(F.lit("launch:yc:"), F.col("yc_launch_id").cast("string")))
    launch = launch.when((_lower("platform") == "hn") & (F.coalesce(F.col("hn_id").cast("string"), F.lit("")) != ""), F.concat(F.lit("launch:hn:"), F.col("hn_id").cast("string")))
    out = F.when(col(kind) == "startup", startup).when(col(kind) == "article", article).when(col(kind) == "launch", launch)
    for name, prefix, field in (("repo", "repo:gh:", "full_name"), ("model", "model:hf:", "hf_id"), ("paper", "paper:arxiv:", "arxiv_id")):
        out = out.when(col(kind) == name, _prefixed(prefix, _lower(field)))
    return out


def round_key(c: Column | str) -> Column:
    """A company key for matching rounds: a final "ai" of longer keys goes, as outlets differ in it."""
    return F.when(col(c).endswith("ai") & (F.length(col(c)) > 4), F.regexp_replace(col(c), "ai$", "")).otherwise(col(c))


def round_id(company_key: Column | str, name: Column | str, announced_at: Column | str) -> Column:
    """Identity of a round: company, name and month."""
    month = F.coalesce(F.date_format(col(announced_at), "yyyy-MM"), F.lit("undated"))
    return F.substring(F.sha1(F.concat_ws("|", col(company_key), F.coalesce(col(name), F.lit("")), month)), 1, 16)
