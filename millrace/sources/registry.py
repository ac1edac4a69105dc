"""Every configured feed by name, and how its raw items are fetched."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from . import normalizers as N
from .base import Source, get

TOPICS = ("llm", "generative-ai", "ai-agents", "rag")


def parse_feed(content: bytes) -> list[dict]:
    """Entries of RSS or Atom XML, as fields of the RSS schema."""
    out = []
    for node in ET.fromstring(content).iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        own: dict = {"tags": []}
        for child in node:
            tag, text = child.tag.rpartition("}")[2], (child.text or "").strip()
            if tag == "category":
                own["tags"].append({"term": child.get("term") or text})
            elif tag == "link":
                own.setdefault("link", child.get("href") or text)
            elif tag in ("pubDate", "published"):
                own["published"] = text
            elif tag in ("creator", "author"):
                own["author"] = text or "".join(child.itertext()).strip()
            elif tag in ("description", "summary"):
                own["summary"] = text
            elif tag == "encoded":
                own["content"] = [{"value": text}]
            elif tag in ("title", "updated"):
                own[tag] = text
        out.append(own)
    return out


def _when(text: str | None) -> datetime | None:
    for read in (lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")), parsedate_to_datetime):
        try:
            found = read(text)
            return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
        except (TypeError, ValueError, AttributeError):
            continue
    return None


def pages(url: str, read: Callable[[bytes], list[dict]], dated: str, most: int, param: str, first: int, size: dict | None = None) -> Callable:
    """Pages of a feed, newest first, until one is empty or wholly older than the window."""

    def fetch(since: datetime | None) -> Iterator[dict]:
        for n in range(first, first + most):
            items = read(get(url, ({param: n} if n != 1 else {}) | (size or {}) or None))
            if not items:
                return
            yield from items
            dates = [d for d in (_when(i.get(dated) or i.get("updated")) for i in items) if d]
            if since is not None and dates and max(dates) < since:
                return

    return fetch


def weekly_windows(since: datetime, until: datetime) -> list[tuple[datetime, datetime]]:
    """Windows of seven days; a rest of less than a day belongs to the last."""
    out, start = [], since
    while start < until:
        end = min(start + timedelta(days=7), until)
        if until - end < timedelta(days=1):
            end = until
        out.append((start, end))
        start = end
    return out


def _github(since: datetime | None) -> Iterator[dict]:
    until = datetime.now(timezone.utc)
    for start, end in weekly_windows(since or until - timedelta(days=7), until):
        window = f"{start.date()}..{end.date()}"
        for topic in TOPICS:
            params = {"q": f"topic:{topic} created:{window} stars:>=5", "sort": "stars", "order": "desc", "per_page": 50}
            for item in json.loads(get("https://api.github.com/search/repositories", params, {"Accept": "application/vnd.github+json"})).get("items", []):
                yield item | {"_window": window}


def _hacker_news(since: datetime | None) -> Iterator[dict]:
    after = int((since or datetime.now(timezone.utc) - timedelta(days=7)).timestamp())
    for n in range(5):
        got = json.loads(get("https://hn.algolia.com/api/v1/search_by_date", {"tags": "show_hn", "numericFilters": f"created_at_i>{after}", "hitsPerPage": 200, "page": n}))
        yield from (h | {"_kind": "Show HN"} for h in got.get("hits") or [])
        if n + 1 >= got.get("nbPages", 0):
            break
    got = json.loads(get("https://hn.algolia.com/api/v1/search", {"query": "Launch HN", "restrictSearchableAttributes": "title", "tags": "story", "numericFilters": f"created_at_i>{after}", "hitsPerPage": 200}))
    yield from (h | {"_kind": "Launch HN"} for h in got.get("hits") or [] if (h.get("title") or "").lower().startswith("launch hn"))


def _papers(since: datetime | None) -> Iterator[dict]:
    today = datetime.now(timezone.utc).date()
    day: date = since.date() if since else today - timedelta(days=7)
    while day <= today:
        try:
            yield from json.loads(get("https://huggingface.co/api/daily_papers", {"date": day.isoformat()}))
        except OSError:  # a day that fails must not end the rest
            pass
        day += timedelta(days=1)


def _whole(url: str, params: dict | None = None, wrap: Callable[[bytes], list[dict]] = json.loads) -> Callable:
    return lambda since: iter(wrap(get(url, params, timeout=120)))


def build_sources() -> dict[str, Source]:
    """All feeds by name."""

    def news(name: str, url: str, tag: str, most: int) -> Source:
        return Source(name, "article", tag, N.RSS, N.rss(tag), pages(url, parse_feed, "published", most, "paged", 1))

    search = "https://news.google.com/rss/search"
    query = {"q": '"AI startup" raises when:7d', "hl": "en-US", "gl": "US", "ceid": "US:en"}
    launches = pages("https://www.ycombinator.com/launches.json", lambda b: json.loads(b).get("hits") or [], "created_at", 5, "page", 0)
    every = [
        Source("yc_oss", "startup", "ycombinator", N.YC_COMPANY, N.yc_companies, _whole("https://yc-oss.github.io/api/companies/all.json"), "weekly", None),
        Source("startupsavant", "startup", "startupsavant", N.PAGE, N.listing, _whole("https://startupsavant.com/startups-to-watch/ai", wrap=lambda b: [{"html": b.decode("utf-8", "replace")}]), "monthly", None),
        Source("yc_launches", "launch", "ycombinator", N.YC_LAUNCH, N.yc_launches, launches),
        Source("hn_launches", "launch", "hackernews", N.HN, N.hacker_news, _hacker_news),
        news("techcrunch_ai", "https://techcrunch.com/category/artificial-intelligence/feed/", "techcrunch", 5),
        news("crunchbase_news", "https://news.crunchbase.com/feed/", "crunchbase", 5),
        news("eu_startups", "https://www.eu-startups.com/feed/", "eu-startups", 8),
        Source("google_news", "article", "googlenews", N.RSS, N.google_news, _whole(search, query, parse_feed), without_duplicates=N.without_known_titles),
        Source("github_new", "repo", "github", N.GITHUB, N.github, _github),
        Source("hf_models", "model", "huggingface", N.HF_MODEL, N.hf_models, _whole("https://huggingface.co/api/models", {"sort": "trendingScore", "limit": 50}), "daily", None),
        Source("hf_papers", "paper", "huggingface", N.HF_PAPER, N.hf_papers, _papers),
    ]
    return {s.name: s for s in every}


def select(names: list[str] | None = None, schedule: str | None = None) -> dict[str, Source]:
    """Feeds by name or by schedule; unknown names are an error."""
    every = build_sources()
    if names:
        if unknown := set(names) - every.keys():
            raise KeyError(f"no such sources: {sorted(unknown)}")
        every = {n: every[n] for n in names}
    return {n: s for n, s in every.items() if schedule is None or s.schedule == schedule}
