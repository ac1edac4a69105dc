"""Sliding-log rate limiting: at most so many accepted events in any window, where rejected ones don't count.

Acceptance depends on what was accepted before, so a count over a window is not it. The state of a
client is the times of its accepted events in the window, at most `most` of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST, WINDOW_S = 20, 60
#: How far behind the newest hit of its client a hit may come.
LATE_S = 3600


def limit_times(times: list[float], most: int = MOST, window: float = WINDOW_S, log: deque | None = None) -> list[bool]:
    """Whether each event (seconds, ascending) is accepted; `log` has earlier accepted ones and is carried on. No limit at 0 or below."""
    log = deque() if log is None else log
    out = []
    for t in times:
        while log and t - log[0] > window:
            log.popleft()
        ok = most <= 0 or len(log) < most
        if ok and most > 0:
            log.append(t)
        out.append(ok)
    return out


def limit_batch(events: DataFrame, key: str, ts: str, tie: str, most: int = MOST, window: float = WINDOW_S) -> DataFrame:
    """events with `accepted`; each client's events in the order of time, then of `tie`.

    Clients are dealt and sorted by the engine and read as a stream of batches, so that no client has to
    fit into memory; the state of one client is carried from batch to batch.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, accepted boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, log = object(), deque()
        for pdf in frames:
            accepted = []
            seconds = pdf[ts].astype("datetime64[us]").astype("int64") / 1e6
            for client, t in zip(pdf[key], seconds, strict=True):
                if client != held:
                    held, log = client, deque()
                accepted += limit_times([t], most, window, log)
            yield pdf.assign(accepted=accepted)

    return events.repartition(key).sortWithinPartitions(key, ts, tie).mapInPandas(run, schema)


class Log:
    """A client's accepted hits (microseconds, id), for hits that come in any order.

    A hit is accepted unless it would make more than `most` accepted ones lie within some `window`; for hits in the order of time that is the rule
    of limit_times. A hit that is accepted already is the same hit again. Hits more than `late` behind the newest are rejected, so older entries are
    forgotten. What is rejected stays so, since the log only grows where hits can still come.
    """

    def __init__(self, most: int, window: float, late: float, entries: Iterable[tuple[int, str]] = (), newest: int | None = None):
        self.most, self.window, self.late = most, round(window * 1e6), round(late * 1e6)
        self.entries: list[tuple[int, str]] = sorted(entries)
        self.newest = newest if newest is not None else (self.entries[-1][0] if self.entries else None)

    def judge(self, t: int | None, name: str) -> bool:
        if self.most <= 0:
            return True
        if t is None:
            return False
        self.newest = t if self.newest is None else max(self.newest, t)
        first = self.newest - self.late - self.window
        if self.entries and self.entries[0][0] < first:
            del self.entries[: bisect_left(self.entries, (first, ""))]
        at = bisect_left(self.entries, (t, name))
        if at < len(self.entries) and self.entries[at] == (t, name):
            return True
        if t < self.newest - self.late:
            return False
        near = [x for x, _ in self.entries[max(0, at - self.most) : at]] + [t] + [x for x, _ in self.entries[at : at + self.most]]
        if any(b - a <= self.window for a, b in zip(near, near[self.most :])):
            return False
        self.entries.insert(at, (t, name))
        return True


def _judged(events: DataFrame, key: str, ts: str, arrival: str | None, name: str | None) -> DataFrame:
    """(key, at, came, name, hit): microseconds of the hit and of its arrival, its id as text, and the whole row."""
    own = F.col(name).cast("string") if name else F.uuid()
    came = F.col(arrival) if arrival else F.col(ts)
    return events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.unix_micros(came.cast("timestamp")).alias("came"), F.coalesce(own, F.lit("")).alias("name"), F.struct(*events.columns).alias("hit"))


def limit_arrivals(events: DataFrame, key: str, ts: str, arrival: str, name: str, most: int = MOST, window: float = WINDOW_S, late: float = LATE_S) -> DataFrame:
    """events with `accepted`, each client's hits judged in the order of arrival, then of their id; see Log. Hits without a time are rejected.

    Clients are dealt and sorted by the engine and read as a stream of batches: memory holds one client's log.
    """
    rows = _judged(events, key, ts, arrival, name).repartition("key").sortWithinPartitions("key", "came", "name")
    schema = rows.select("hit").withColumn("accepted", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, log = object(), None
        for b in batches:
            accepted = []
            for client, at, own in zip(*(b.column(c).to_pylist() for c in ("key", "at", "name")), strict=True):
                if log is None or client != held:
                    held, log = client, Log(most, window, late)
                accepted.append(log.judge(at, own))
            yield pa.RecordBatch.from_arrays([b.column("hit"), pa.array(accepted, pa.bool_())], names=["hit", "accepted"])

    return rows.mapInArrow(run, schema).select("hit.*", "accepted")


class _Limiter(StatefulProcessor):
    """The log of each client as list state; a timer ends it once nothing that may still come can meet it."""

    def __init__(self, most: int, window: float, late: float, ttl: float):
        self.most, self.window, self.late, self.ttl = most, window, late, round(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at bigint, name string", self.ttl)
        self.newest = handle.getValueState("newest", "at bigint", self.ttl)

    def _read(self) -> Log:
        newest = self.newest.get()
        return Log(self.most, self.window, self.late, [tuple(r) for r in self.log.get()], newest[0] if newest else None)

    def _keep(self, log: Log) -> None:
        if log.newest is not None:
            self.newest.update((log.newest,))
            self.log.put(log.entries) if log.entries else self.log.clear()

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        log = self._read()
        log.entries = sorted({*log.entries, (initialState["at"], initialState["name"])})
        log.newest = max(x for x in (log.newest, initialState["newest"]) if x is not None)
        self._keep(log)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        log = self._read()
        for r in sorted(rows, key=lambda r: (r["came"] is not None, r["came"] or 0, r["name"])):
            yield Row(hit=r["hit"], accepted=log.judge(r["at"], r["name"]))
        self._keep(log)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.log.clear()
        self.newest.clear()
        return iter(())


def limit_stream(
    events: DataFrame, key: str, ts: str, most: int = MOST, window: float = WINDOW_S, late: float = LATE_S, name: str | None = None, arrival: str | None = None, ttl: float = 7 * 86_400, initial: DataFrame | None = None
) -> DataFrame:
    """events of a stream with `accepted`: every hit is judged, late ones against the log that is kept (see Log), each micro-batch in the order of arrival.

    There is no watermark, and no hit is dropped. A client's log ends after `ttl` seconds without a hit. `initial` is what limit_arrivals made of
    earlier hits: its accepted ones are what the stream goes on from. Without `name` every row is a hit of its own. State needs the RocksDB store, and
    timers wait for the next batch with hits: both are set for the session.
    """
    conf = events.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers of the clock would ask for one after the other, and a run over what is there never end
    rows = _judged(events, key, ts, arrival, name)
    schema = rows.select("hit").withColumn("accepted", F.lit(True)).schema
    before = None
    if initial is not None:
        known = initial.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(name or ts).cast("string").alias("name"), "accepted")
        newest = known.groupBy("key").agg(F.max("at").alias("newest"))
        kept = known.where("accepted").select("key", "at", "name").distinct().join(newest, "key").where(F.col("at") >= F.col("newest") - round((late + window) * 1e6))
        before = kept.groupBy("key")
    judged = rows.groupBy("key").transformWithState(_Limiter(most, window, late, ttl), schema, "append", "processingTime", before)
    return judged.select("hit.*", "accepted")
