"""Runs of feeds into the document table, each with its record."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import VersionedTable, prepare, upsert
from .base import Source

COUNTS = ("fetched", "new", "changed", "unchanged", "skipped", "errors")


def run_source(source: Source, raw: Callable[[], DataFrame], table: VersionedTable, dry_run: bool = False, now: datetime | None = None) -> dict:
    """One feed's raw items (value: JSON text) into the table; a failure is recorded, not raised.

    Items that can't be read and documents without identity are errors; what the feed leaves out
    is skipped. A dry run counts what it would write as new.
    """
    now = now or datetime.now(timezone.utc)
    record: dict = {"source": source.name, "type": source.kind, "started_at": now, "dry_run": dry_run, "status": "running", **dict.fromkeys(COUNTS, 0)}
    try:
        got = raw().cache()
        record["fetched"] = got.count()
        unreadable = got.where(F.from_json("value", "map<string,string>").isNull()).count()
        docs = prepare(source.normalize(source.parse(got)), source.kind, source.tag).cache()
        total, keyless = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_key").isNull())).first()
        keyed = docs.where("doc_key IS NOT NULL")
        existing = table.read() if table.version() is not None else None
        if source.without_duplicates is not None and existing is not None:
            keyed = source.without_duplicates(keyed, existing)
        wanted = keyed.count()
        record["errors"] = unreadable + keyless
        record["skipped"] = record["fetched"] - unreadable - total + (total - keyless - wanted)
        if dry_run:
            record["new"] = wanted
        elif wanted:
            merged = upsert(existing if existing is not None else keyed.limit(0), keyed, now)
            outcomes = {r["outcome"]: r["count"] for r in merged.groupBy("outcome").count().collect()}
            record |= {k: outcomes.get(k, 0) for k in ("new", "changed", "unchanged")}
            table.replace(merged.drop("outcome"))
        record["status"] = "ok"
    except Exception as e:  # one feed's failure must not end the others
        record |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:2000]}
    record["finished_at"] = datetime.now(timezone.utc)
    record["duration_s"] = round((record["finished_at"] - now).total_seconds(), 1)
    return record


def run_sources(sources: dict[str, Source], raw: Callable[[Source], DataFrame], table: VersionedTable, dry_run: bool = False) -> list[dict]:
    return [run_source(s, lambda s=s: raw(s), table, dry_run) for s in sources.values()]


def format_run(record: dict) -> str:
    """A run in one line."""
    counts = " ".join(f"{k}={record[k]}" for k in COUNTS)
    return f"{record['source']:<16} {record['status'].upper():<7} {counts} {record['duration_s']}s" + (f"  {record['error']}" if record.get("error") else "")
