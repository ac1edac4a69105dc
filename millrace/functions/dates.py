"""Instants and ISO weeks. Every stored date is a UTC timestamp; the session's time zone is UTC."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Field that dates a document, by type.
EVENT_FIELDS = {
    "article": ("published_date", "published_at"),
    "repo": ("created_at",),
    "startup": ("launched_at",),
    "launch": ("launched_at",),
    "model": ("created_at",),
    "paper": ("published_at",),
}


def parse_datetime(c: Column | str) -> Column:
    """Instant of text in ISO 8601 (with or without zone, then UTC), RFC 2822 or unix seconds; null if it is none of them."""
    text = F.trim(col(c).cast("string"))
    mail = F.trim(F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", ""))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    formats = [F.try_to_timestamp(mail, F.lit(f"d MMM yyyy {clock} {zone}")) for clock in ("HH:mm:ss", "HH:mm") for zone in ("Z", "z")]
    plain = F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss"))
    unix = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((text.try_cast("decimal(28,6)") * 1000000).try_cast("long")))
    return F.coalesce(iso, unix, *formats, plain)


def event_at(kind: Column | str, fields: set[str] | None = None) -> Column:
    """When what a document describes happened, by its type; never the time it was fetched."""
    out = None
    for name, own in EVENT_FIELDS.items():
        own = [f for f in own if fields is None or f in fields]
        value = F.coalesce(*(F.when(F.col(f).cast("string") != "", F.col(f).cast("string")) for f in own), F.lit(None).cast("string"))
        found = parse_datetime(value)
        out = F.when(col(kind) == name, found) if out is None else out.when(col(kind) == name, found)
    return out.otherwise(parse_datetime("event_at")) if fields is None or "event_at" in fields else out


def first_seen(now: Column, fields: set[str]) -> Column:
    """When a document was first stored: the first of its own marks that reads as an instant, else now."""
    return F.coalesce(*(parse_datetime(f) for f in ("first_seen_at", "inserted_at", "scraped_at") if f in fields), now.cast("timestamp"))


def week_id(c: Column | str) -> Column:
    """ISO week such as 2026-W02."""
    c = col(c)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def week_start(c: Column | str) -> Column:
    """Monday 00:00 UTC of the instant's week."""
    return F.date_trunc("week", col(c))


def week_of(day: date) -> str:
    year, week, _ = day.isocalendar()
    return f"{year}-W{week:02d}"


def week_bounds(week: str) -> tuple[datetime, datetime]:
    """First instant of an ISO week, and of the next."""
    if not re.fullmatch(r"\d{4}-W\d{2}", week):
        raise ValueError(f"a week looks like 2026-W37, not {week!r}")
    monday = date.fromisocalendar(int(week[:4]), int(week[6:]), 1)
    start = datetime(monday.year, monday.month, monday.day, tzinfo=timezone.utc)
    return start, start + timedelta(days=7)


def previous_weeks(week: str, n: int) -> list[str]:
    start = week_bounds(week)[0].date()
    return [week_of(start - timedelta(weeks=i)) for i in range(1, n + 1)]


def resolve_week(spec: str, today: date | None = None) -> str:
    """A week from "current", "previous" or its own name."""
    today = today or datetime.now(timezone.utc).date()
    back = {"current": 0, "previous": 1}.get(spec)
    if back is None:
        week_bounds(spec)
        return spec
    return week_of(today - timedelta(weeks=back))
