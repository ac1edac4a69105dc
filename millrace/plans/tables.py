"""Queries over tables that are kept: merges in buckets, replaced weeks, streams into tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import entities, inference, trends
from ..operators.edges import Edges
from ..operators.models import HashingEmbedder
from ..operators.parts import BucketTable, PartTable
from ..operators.store import work_dir
from ..sources.base import register
from ..streaming import ingest, limits
from .registry import query, table

FIRST = datetime(2024, 1, 1, tzinfo=timezone.utc)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, d: str, name: str, files: int = 8) -> DataFrame:
    """A table as a stream of its files; as a pattern, since a stream takes no single file."""
    return spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", files).parquet(f"{d}/{name}.parque[t]")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_key"), "doc_id", F.sha1("text").alias("content_hash"))


@query(
    """WITH old AS (SELECT doc_id::VARCHAR AS k, sha1(text) AS h FROM documents WHERE lang <> 'es'),
new AS (SELECT doc_id::VARCHAR AS k, sha1(replace(text, 'License', 'Licence')) AS h, doc_id % 5 AS batch FROM documents WHERE source <> 'src1')
SELECT coalesce(new.k, old.k) AS doc_key, coalesce(new.h, old.h) AS content_hash, CASE WHEN old.k IS NULL THEN DATE '2024-01-02' + batch::INT ELSE DATE '2024-01-01' END AS first_seen,
  CASE WHEN new.k IS NULL THEN DATE '2024-01-01' ELSE DATE '2024-01-02' + batch::INT END AS last_seen FROM old FULL JOIN new ON old.k = new.k"""
)
def bucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Documents met again in five batches, each merged into the buckets of its keys: the table is that of one big upsert."""
    docs = table(spark, d, "documents")
    kept = BucketTable(spark, scratch(spark, "documents"), buckets=16)
    kept.merge(_keyed(docs.where("lang <> 'es'")), FIRST)
    again = docs.where("source <> 'src1'").withColumn("text", F.replace("text", F.lit("License"), F.lit("Licence")))
    for k in range(5):
        kept.merge(_keyed(again.where(F.col("doc_id") % 5 == k)), FIRST + timedelta(days=1 + k), f"batch {k}")
    return kept.read().select("doc_key", "content_hash", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"))


@query("SELECT doc_id::VARCHAR AS doc_key, sha1(text) AS content_hash, DATE '2024-01-01' AS first_seen FROM documents")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream of files, each micro-batch merged into a table of buckets."""
    stream = stream_of(spark, d, "documents").select("doc_id", "text")
    at = scratch(spark, "stream")
    kept = BucketTable(spark, f"{at}/documents", buckets=16)
    ingest.upsert_stream(_keyed(stream), kept, f"{at}/checkpoint", clock=lambda: FIRST).awaitTermination()
    return kept.read().select("doc_key", "content_hash", F.to_date("first_seen_at").alias("first_seen"))


@query(
    """WITH t AS (SELECT event_type AS topic, strftime(ts, '%G-W%V') AS week, count(*) AS n FROM events
  WHERE NOT (strftime(ts, '%G-W%V') = '2024-W03' OR strftime(ts, '%G-W%V') = '2024-W02' AND user_id % 2 = 1) GROUP BY ALL)
SELECT topic, week, n::BIGINT AS doc_count FROM t"""
)
def trends_recount(spark: SparkSession, d: str) -> DataFrame:
    """Weeks counted again after all documents of one of them and some of another are gone: the emptied week's rows vanish."""
    events = table(spark, d, "events").select(F.col("event_type").alias("topic"), dates.week_id("ts").alias("week"), (F.col("user_id") % 3).cast("string").alias("type"), "user_id")
    kept = PartTable(spark, scratch(spark, "weekly"), "week")
    kept.replace(trends.count_weekly(events), None, ("topic",))
    left = events.where("week = '2024-W02' AND user_id % 2 = 0")
    kept.replace(trends.count_weekly(left), ["2024-W02", "2024-W03"], ("topic",))
    return kept.read().select("topic", "week", "doc_count")


@query()
def rate_limit_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Clicks judged as they arrive, two a minute for each client: late and repeated ones against the log of those accepted."""
    clicks = table(spark, d, "clicks").select("click_id", "client_id", "ts", "arrived_at")
    return limits.limit_arrivals(clicks, "client_id", "ts", "arrived_at", "click_id", 2, 60, 600)


@query("SELECT doc_id::VARCHAR AS doc_key, source, sha1(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def feed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents as saved payloads of feeds, one a language, played as a stream of feeds into a table of buckets."""
    at = scratch(spark, "feeds")
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    item = F.to_json(F.struct(F.col("doc_id").alias("id"), "source", F.sha1("text").alias("hash")))
    docs.select(F.concat(F.lit("feed_"), F.coalesce("lang", F.lit("none"))).alias("feed"), item.alias("value")).write.partitionBy("feed").text(f"{at}/saved")
    feeds = sorted(r[0] for r in docs.select(F.concat(F.lit("feed=feed_"), F.coalesce("lang", F.lit("none")))).distinct().collect())  # a feed a language
    register(spark)
    stream = spark.readStream.format("feed").option("name", ",".join(feeds)).option("payloads", f"{at}/saved").option("log", f"{at}/log").load()
    read = stream.select(F.from_json("value", "id long, source string, hash string").alias("r"))
    kept = BucketTable(spark, f"{at}/documents", buckets=16)
    ingest.upsert_stream(read.select(F.col("r.id").cast("string").alias("doc_key"), "r.source", F.col("r.hash").alias("content_hash")), kept, f"{at}/checkpoint", clock=lambda: FIRST).awaitTermination()
    return kept.read().select("doc_key", "source", "content_hash")


@query(
    """WITH l AS (SELECT source AS entity_id, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS page FROM documents WHERE source IS NOT NULL)
SELECT entity_id, page::INT AS page, count(*) AS links, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM l GROUP BY ALL"""
)
def entity_pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each source as pages of a hundred links, whatever their number."""
    edges = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("entity_id"), "doc_id", F.col("lang").alias("type"))
    return entities.paged_links(edges, 100).select("entity_id", "page", F.size("links").cast("long").alias("links"), "first_doc", "last_doc")


class _Refusing(HashingEmbedder):
    """A stand-in for a model that fails on some texts, and with them on their whole batch."""

    def embed(self, texts: list[str], prefix: str = "passage: "):
        if any("License" in t for t in texts):
            raise RuntimeError("a text that breaks the model")
        return super().embed(texts, prefix)


@query(
    """SELECT lang, count(*) FILTER (contains(text, 'License')) AS failed, count(*) FILTER (NOT contains(text, 'License')) AS embedded,
  count(*) FILTER (regexp_full_match(text, '\\s*')) AS blank FROM (SELECT lang, coalesce(text, '') AS text FROM documents) GROUP BY lang"""
)
def embedding_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Documents embedded by a model that fails on some: each costs its own row only, blank ones have the zero vector."""
    docs = table(spark, d, "documents")
    good, bad = inference.embed(docs, _Refusing(16), wait=lambda s: None, carry=("lang",))
    rows = good.select("lang", F.lit(0).alias("bad"), (F.col("attempts") == 0).alias("blank")).unionByName(bad.select("lang", F.lit(1).alias("bad"), F.lit(False).alias("blank")))
    return rows.groupBy("lang").agg(F.sum("bad").alias("failed"), F.count_if(F.col("bad") == 0).alias("embedded"), F.count_if("blank").alias("blank"))


@query(
    """WITH e AS (SELECT DISTINCT doc_id, unnest(string_split(lower(source || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'edited' ELSE lang END), ' ')) AS entity_id FROM documents WHERE doc_id % 5 <> 0 AND source IS NOT NULL AND lang IS NOT NULL)
SELECT entity_id, count(*) AS degree FROM e GROUP BY entity_id"""
)
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of a graph after two edits of its documents: a third mention something else, a fifth mention nothing any more."""
    docs = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    said = lambda text: docs.select("doc_id", F.explode(F.split(F.lower(F.concat_ws(" ", "source", text)), " ")).alias("entity_id"))
    kept = Edges(spark, scratch(spark, "graph"), 16)
    kept.apply(docs, said(F.col("lang")))
    kept.apply(docs.where("doc_id % 3 = 0"), said(F.lit("edited")))
    kept.apply(docs.where("doc_id % 5 = 0"), said(F.lit("x")).limit(0))
    return kept.degrees.read().select("entity_id", "degree")
