"""The query surface over a pipeline's tables: validated requests in, plans out."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.doctext import TYPE_NAMES, document_text, document_title, document_url
from ..operators import blocks, companies, dense, entities, graph, rag, trends
from ..operators.search import Engine, Filters
from ..operators.store import VersionedTable
from .pipeline import Pipeline
from .requests import CompaniesRequest, DocumentsRequest, FundingRequest, SimilarRequest, TrendsRequest, VelocityRequest


@dataclass(frozen=True)
class SearchRequest:
    """A search with its bounds; unknown fields and values out of bounds are errors."""

    query: str
    type: str | None = None
    location: str | None = None
    since_days: int | None = None
    top_k: int = 10
    use_keyword: bool = True
    use_semantic: bool = True
    use_graph: bool = True

    def __post_init__(self):
        if not isinstance(self.query, str) or not 1 <= len(self.query.strip()) <= 500:
            raise ValueError("query: 1 to 500 characters")
        if self.type is not None and self.type not in TYPE_NAMES:
            raise ValueError(f"type: one of {TYPE_NAMES}")
        if self.since_days is not None and not 1 <= self.since_days <= 365:
            raise ValueError("since_days: 1 to 365")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k: 1 to 50")

    @classmethod
    def parse(cls, raw: dict) -> SearchRequest:
        if unknown := raw.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return cls(**raw)


#: Request types by the name of what answers them.
REQUESTS = {"similar": SimilarRequest, "documents": DocumentsRequest, "funding": FundingRequest, "companies": CompaniesRequest, "trends": TrendsRequest, "velocity": VelocityRequest}


class Api:
    """Reads whole versions of the tables; reload() moves to the newest ones at once."""

    def __init__(self, pipeline: Pipeline, now: datetime | None = None):
        self.pipeline, self.now = pipeline, now or datetime.now(timezone.utc)
        self.reload()

    def reload(self) -> None:
        p = self.pipeline
        docs = p.documents().withColumns({"title": F.coalesce("title", document_title()), "link_url": document_url()})
        index = blocks.load(p.spark, f"{p.path}/bm25")
        engine = Engine(docs, index, p.table("vectors").read(), p.embedder.query, p.table("mentions").read())
        self.docs, self.engine = docs, engine

    def _table(self, name: str) -> DataFrame:
        return VersionedTable(self.pipeline.spark, f"{self.pipeline.path}/{name}").read()

    @staticmethod
    def public(docs: DataFrame) -> DataFrame:
        """Documents as they are shown: no vectors, no entities."""
        return docs.drop("embedding", "entities")

    def search(self, request: SearchRequest) -> DataFrame:
        filters = Filters(request.type, request.location, request.since_days, self.now)
        return self.public(self.engine.search(request.query, filters, request.top_k, keyword=request.use_keyword, semantic=request.use_semantic, graph_=request.use_graph))

    def similar(self, doc_id: str, top_k: int = 10) -> DataFrame:
        """Documents of the same type nearest to one's description asked as a query."""
        own = self.docs.where(F.col("doc_id") == doc_id).select("type", document_text().alias("text")).first()
        if own is None:
            raise KeyError(doc_id)
        vectors = self._table("vectors")
        hits = dense.search(vectors, self.pipeline.embedder.query(own["text"]), top_k, (F.col("type") == own["type"]) & (F.col("doc_id") != doc_id))
        return self.public(self.docs.join(F.broadcast(hits), "doc_id")).orderBy(F.desc("score"), "doc_id")

    def documents(self, kind: str | None = None, source: str | None = None, since_days: int | None = None, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page of documents, newest first, and the total."""
        found = self.docs
        if kind:
            found = found.where(F.col("type") == kind)
        if source:
            found = found.where(F.col("source") == source)
        if since_days:
            found = found.where(F.col("event_at") >= F.lit(self.now - timedelta(days=since_days)))
        page = found.orderBy(F.desc_nulls_last("event_at"), F.desc_nulls_last("first_seen_at") if "first_seen_at" in found.columns else "doc_id", "doc_id")
        return self.public(page.offset(offset).limit(limit)), found.agg(F.count(F.lit(1)).alias("total"))

    def document(self, doc_id: str) -> dict:
        row = self.public(self.docs.where(F.col("doc_id") == doc_id)).first()
        if row is None:
            raise KeyError(doc_id)
        return row.asDict(recursive=True)

    def funding(self, since_days: int | None = None, least_usd: float | None = None, name: str | None = None, limit: int = 20) -> DataFrame:
        found = self._table("funding_rounds").where(F.col("confidence").isin("high", "medium"))
        if since_days:
            found = found.where(F.col("announced_at") >= F.lit(self.now - timedelta(days=since_days)))
        if least_usd is not None:
            found = found.where(F.col("amount_usd") >= least_usd)
        if name:
            found = found.where(F.col("round") == name.lower())
        return found.orderBy(F.desc_nulls_last("amount_usd"), F.desc_nulls_last("announced_at"), "_id").limit(limit)

    def companies(self, text: str | None = None, sort: str = "funding", limit: int = 20, offset: int = 0) -> DataFrame:
        return companies.page(self._table("companies"), text, sort, limit, offset)

    def company(self, slug: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self._table("companies").where(F.col("slug") == slug).isEmpty():
            raise KeyError(slug)
        return companies.detail(self._table("companies"), self._table("funding_rounds"), self.public(self.docs), slug)

    def trends(self, week: str, limit: int = 20) -> DataFrame:
        return trends.rising(self.pipeline.parts("topic_weekly", "week").read(), week, limit)

    def velocity(self, kind: str = "repo", days: int = 14, limit: int = 20) -> DataFrame:
        """What gains fastest, with its documents where they exist."""
        if kind not in trends.VELOCITY_METRIC:
            raise ValueError(f"no velocity of {kind!r}")
        snaps = self.pipeline.parts("metric_snapshots", "date").read().where(F.col("type") == kind)
        rows = trends.velocity(snaps, trends.VELOCITY_METRIC[kind], trends.VELOCITY_FLOOR[kind], self.now.date(), days, limit)
        return rows.join(self.docs.select(F.col("doc_id"), "title", "link_url"), "doc_id", "left").orderBy(F.desc("gained"), "doc_id")

    def digests(self, limit: int = 12) -> DataFrame:
        """The newest weeks' digests without their sections."""
        return self.pipeline.digests().list(limit)

    def digest(self, week: str | None = None) -> dict:
        """One week's digest, or the latest; a KeyError if there is none."""
        return self.pipeline.digests().latest() if week is None else self.pipeline.digests().week(week)

    def entity_documents(self, entity_id: str, page: int = 0) -> DataFrame:
        """A page of the documents that mention an entity, however many there are."""
        return self.public(entities.documents_of(self._table("entity_pages"), self.docs, entity_id, page))

    def entities(self, kind: str | None = None, limit: int = 10) -> DataFrame:
        return entities.top_entities(self._table("canonical_entities"), limit, kind)

    def neighbourhood(self, name: str) -> DataFrame:
        return graph.neighbourhood(self.docs, self._table("mentions"), name)

    def graph_views(self) -> None:
        """The graph as views `vertices` and `edges` for ad-hoc SQL."""
        self._table("vertices").createOrReplaceTempView("vertices")
        self._table("mentions").createOrReplaceTempView("edges")

    def chat(self, question: str, history: list[dict] | None = None) -> dict:
        return rag.answer(question, self.engine, self._table("funding_rounds"), self.now, history=history)

    def ask(self, path: str, raw: dict):
        """One of similar, documents, funding, companies, trends, velocity by a request's raw fields; a KeyError for any other."""
        request = REQUESTS[path].parse(raw)
        return getattr(self, path)(**vars(request))

    def meta(self) -> dict:
        """Counts by type (zeros too), the newest event, and index sizes."""
        spark = self.pipeline.spark
        known = F.broadcast(spark.createDataFrame([(t,) for t in TYPE_NAMES], "type string"))
        counts = self.docs.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(known, "type", "right").fillna(0, ["n"])
        newest = self.docs.agg(F.max("event_at").alias("newest")).first()["newest"]
        return {"counts": {r["type"]: r["n"] for r in counts.collect()}, "newest": newest, "vectors": self._table("vectors").count(), "lexical": self.engine.index.lengths.count()}
