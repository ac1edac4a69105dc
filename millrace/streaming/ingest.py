"""Streams into tables: idempotent keyed upserts, weekly windows, latest state."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parts import BucketTable
from ..operators.store import VersionedTable, upsert


def upsert_stream(prepared: DataFrame, table: VersionedTable | BucketTable, checkpoint: str, available_now: bool = True, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> StreamingQuery:
    """Upsert each micro-batch of prepared documents into a table.

    In a table of buckets a batch rewrites just those its keys fall into, and its number is committed with them: a batch that is run again after
    a crash is not merged twice. A versioned table is rewritten whole; there a repeated batch finds its rows unchanged.
    """

    def step(batch: DataFrame, number: int) -> None:
        now = clock()
        if isinstance(table, BucketTable):
            table.merge(batch, now, f"{checkpoint}#{number}")
            return
        if batch.isEmpty():
            return
        existing = table.read() if table.version() is not None else batch.limit(0)
        table.replace(upsert(existing, batch, now).drop("outcome"))

    writer = prepared.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def once_per_key(documents: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream without repeats of a document's key and text, remembered for as long as sources are read back."""
    return documents.withWatermark("event_at", late).dropDuplicatesWithinWatermark(["doc_key", "content_hash"])


def weekly_counts(events: DataFrame, ts: str, *by: str, late: str = "1 day") -> DataFrame:
    """(window, by ..., n) in weeks from Monday 00:00 UTC; works on streams and on tables."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, "7 days", "7 days", "4 days"), *by).agg(F.count(F.lit(1)).alias("n"))
