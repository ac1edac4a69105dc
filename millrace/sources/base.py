"""Feeds as Spark data sources: fetching is apart from normalising.

`fetch` yields raw items as JSON text (this needs a network, or a folder of saved payloads);
`normalize` is a projection and filter over the raw table, so it runs inside the engine and is
tested on saved payloads.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

AGENT = "millrace/1.0"


def get(url: str, params: dict | None = None, headers: dict | None = None, timeout: float = 30, tries: int = 3, opener: Callable = urllib.request.urlopen, wait: Callable = time.sleep) -> bytes:
    """Body of a web page; too many requests and server errors are tried again after 1, 2, 4 ... seconds."""
    request = urllib.request.Request(f"{url}?{urlencode(params)}" if params else url, headers={"User-Agent": AGENT, **(headers or {})})
    for attempt in range(tries):
        try:
            with opener(request, timeout=timeout) as response:
                return response.read()
        except urllib.error.HTTPError as e:
            if attempt + 1 == tries or e.code != 429 and e.code < 500:
                raise
        except urllib.error.URLError:
            if attempt + 1 == tries:
                raise
        wait(2**attempt)
    raise RuntimeError("unreachable")


@dataclass(frozen=True)
class Source:
    """A feed: how raw items are fetched and how a raw table becomes documents of one type."""

    name: str
    kind: str
    tag: str
    schema: str
    normalize: Callable[[DataFrame], DataFrame]
    fetch: Callable[[datetime | None], Iterable[dict]]
    schedule: str = "daily"
    window_days: int | None = 7
    #: (documents, known documents) -> documents without what another source already has
    without_duplicates: Callable[[DataFrame, DataFrame], DataFrame] | None = field(default=None)

    def default_since(self, now: datetime | None = None) -> datetime | None:
        if self.window_days is None:
            return None
        return (now or datetime.now(timezone.utc)) - timedelta(days=self.window_days)

    def parse(self, raw: DataFrame) -> DataFrame:
        """Raw items (value: JSON text) as columns of the feed's schema."""
        return raw.select(F.from_json("value", self.schema).alias("r")).select("r.*")


class FeedPartition(InputPartition):
    def __init__(self, name: str, since: str | None):
        self.name, self.since = name, since


class FeedReader(DataSourceReader):
    """One partition a feed: raw items as JSON text."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [FeedPartition(n, self.options.get("since")) for n in self.options["name"].split(",")]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        from .stream import sources_of

        source = sources_of(self.options)[partition.name]
        since = datetime.fromisoformat(partition.since) if partition.since else source.default_since()
        for item in source.fetch(since):
            yield partition.name, json.dumps(item)


class FeedDataSource(DataSource):
    """spark.read.format("feed").option("name", "hf_models,hf_papers").load() -> (source, value)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "source string, value string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        from .stream import FeedStreamReader

        return FeedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedDataSource)
