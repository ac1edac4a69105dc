"""The derivation pipeline: stages in order over versioned tables, each redoing only what is stale."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import previous_weeks, week_bounds, week_of
from ..functions.doctext import FIELDS, document_text, document_title, with_fields
from ..operators import blocks, bm25, companies, digest, edges, entities, funding, graph, inference, store, trends
from ..operators.models import Embedder, HashingEmbedder, LanguageModel, PatternRecogniser, Recogniser
from ..operators.parts import PartTable

STAGES = ("refresh", "entities", "embed", "index", "snapshots", "funding", "companies", "trends", "graph")
DERIVED = {"entities": entities.ENTITIES, "entities_hash": "string", "embedding": "array<float>", "embedding_hash": "string", "funding_hash": "string", "funding_extraction_version": "string"}


@dataclass
class Pipeline:
    """Tables under one folder, with the models that stages use."""

    spark: SparkSession
    path: str
    recogniser: Recogniser = field(default_factory=PatternRecogniser)
    embedder: Embedder = field(default_factory=HashingEmbedder)
    extractor: funding.Extractor = field(default_factory=funding.PatternExtractor)
    today: date = field(default_factory=lambda: datetime.now(timezone.utc).date())
    funding_limit: int = 40

    def table(self, name: str) -> store.VersionedTable:
        return store.VersionedTable(self.spark, f"{self.path}/{name}")

    def parts(self, name: str, by: str) -> PartTable:
        return PartTable(self.spark, f"{self.path}/{name}", by)

    def documents(self) -> DataFrame:
        docs = with_fields(self.table("documents").read(), FIELDS | DERIVED)
        return docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.sha1("doc_key"))

    def _save(self, name: str, df: DataFrame) -> int:
        self.table(name).replace(df)
        return self.table(name).read().count()

    # each stage returns counts

    def refresh(self, force: bool = False) -> dict:
        docs, report = store.refresh_hashes(self.documents())
        counts = report.first().asDict()
        self._save("documents", docs)
        return counts

    def entities(self, force: bool = False) -> dict:
        docs = self.documents()
        fresh = entities.extract(docs.withColumn("text", document_text()), self.recogniser, force)
        joined = docs.join(fresh.select("doc_id", F.col("entities").alias("_e"), F.col("entities_hash").alias("_h"), F.lit(True).alias("_new")), "doc_id", "left")
        out = joined.withColumns({"entities": F.coalesce("_e", "entities"), "entities_hash": F.when(F.col("_new"), F.col("_h")).otherwise(F.col("entities_hash"))})
        done = out.where("_new").count()
        self._save("documents", out.drop("_e", "_h", "_new"))
        edges = entities.mentions(self.documents())
        self._save("mentions", edges)
        self._save("entity_pages", entities.paged_links(edges))
        return {"extracted": done, "entities": self._save("canonical_entities", entities.canonical(edges))}

    def embed(self, force: bool = False) -> dict:
        docs = self.documents()
        todo = F.lit(True) if force else entities.stale("embedding_hash", "content_hash")
        fresh, failed = inference.embed(docs.where(todo).select("doc_id", document_text().alias("text")), self.embedder)
        joined = docs.join(fresh.select("doc_id", F.col("embedding").alias("_v"), F.lit(True).alias("_new")), "doc_id", "left")
        out = joined.withColumns({"embedding": F.when(F.col("_new"), F.col("_v")).otherwise(F.col("embedding")), "embedding_hash": F.when(F.col("_new"), F.col("content_hash")).otherwise(F.col("embedding_hash"))})
        self._save("documents", out.select(*docs.columns))
        # texts that no vector could be made of stay stale, and are tried again by the next run
        return {"embedded": fresh.count(), "failed": self._save("embedding_errors", failed)}

    def index(self, force: bool = False) -> dict:
        docs = self.documents().withColumn("text", document_text())
        blocks.write(bm25.build(docs.select("doc_id", "type", "text"), written=True), f"{self.path}/bm25")
        return {"vectors": self._save("vectors", docs.where("embedding IS NOT NULL").select("doc_id", "type", "embedding")), "lexical": self.table("bm25/lengths").read().count()}

    def snapshots(self, force: bool = False) -> dict:
        taken = store.snapshots(self.documents(), self.today)
        self.parts("metric_snapshots", "date").replace(taken, [self.today], ("doc_id",))
        return {r["type"]: r["count"] for r in taken.groupBy("type").count().collect()}

    def funding(self, force: bool = False) -> dict:
        docs = self.documents()
        said = store.keep(funding.read(docs, self.extractor, self.funding_limit, force), "read")
        fresh = funding.rounds_of(said)
        known = self.table("funding_rounds")
        rounds = fresh if known.version() is None else known.read().unionByName(fresh)
        merged = funding.merge(funding.purge(funding.merge(rounds), docs), fill=False)
        n = self._save("funding_rounds", merged)
        # read are now those the pattern leaves out and those the extractor answered for; others wait for a later run
        answered = said.where("NOT failed").select(F.col("doc_id").alias("_id"))  # at most the limit
        left_out = funding.candidates(docs, force).where(~F.coalesce("passes", F.lit(False))).select(F.col("doc_id").cast("string").alias("_id"))
        done = answered.unionByName(left_out).distinct().withColumn("_done", F.lit(True))
        marked = docs.join(done, F.col("doc_id").cast("string") == F.col("_id"), "left")
        read = F.coalesce("_done", F.lit(False))
        marks = {"funding_hash": F.when(read, F.col("content_hash")).otherwise(F.col("funding_hash")), "funding_extraction_version": F.when(read, F.lit(funding.VERSION)).otherwise(F.col("funding_extraction_version"))}
        self._save("documents", marked.withColumns(marks).select(*docs.columns))
        return {"rounds": n, "read": said.where("NOT failed").count(), "failed": said.where("failed").count()}

    def companies(self, force: bool = False) -> dict:
        docs, rounds = self.documents(), self.table("funding_rounds")
        found = rounds.read() if rounds.version() is not None else self.spark.createDataFrame([], funding.ROUND)
        built = companies.build(docs.where("type = 'startup'").withColumn("website", F.lit(None).cast("string")), docs.where("type = 'launch'"), found)
        return {"companies": self._save("companies", built)}

    def trends(self, force: bool = False) -> dict:
        week = week_of(self.today)
        table = self.parts("topic_weekly", "week")
        table.replace(trends.topic_weekly(self.documents(), week), [week, *previous_weeks(week, trends.TRAILING_WEEKS - 1)], ("topic",))
        weekly = table.read()
        return {"rows": weekly.count(), "rising": trends.rising(weekly, week, 10).count()}

    def graph(self, force: bool = False) -> dict:
        docs, found = self.documents(), self.table("canonical_entities").read()
        nodes = graph.vertices(docs.withColumn("title", document_title()), found)
        counts = F.create_map(F.lit("mention_count"), F.col("mention_count").cast("string"), F.lit("document_count"), F.col("document_count").cast("string"))
        own = edges.vertices(docs).select("node_id", "properties").unionByName(found.select(F.col("entity_id").alias("node_id"), counts.alias("properties")))
        return {"vertices": self._save("vertices", nodes.join(own, "node_id", "left"))}

    def digests(self) -> digest.DigestStore:
        return digest.DigestStore(self.spark, f"{self.path}/digests")

    def digest(self, force: bool = False, writer: LanguageModel | None = None) -> dict:
        """The current week's digest, stored unless nothing it is made of has changed."""
        week, rounds = week_of(self.today), self.table("funding_rounds")
        found = rounds.read() if rounds.version() is not None else self.spark.createDataFrame([], funding.ROUND)
        start, end = week_bounds(week)
        return {"week": week, "digest": self.digests().make(self.documents(), found, week, start, end, datetime.now(timezone.utc), writer, force)}

    def run(self, stages: tuple[str, ...] = STAGES, force: bool = False) -> dict:
        """Stages in the fixed order; the first that fails ends the run, which is recorded."""
        record: dict = {"started_at": datetime.now(timezone.utc), "status": "ok", "stages": {}}
        for name in (s for s in STAGES if s in stages):
            began = time.time()
            step: Callable[[bool], dict] = getattr(self, name)
            try:
                record["stages"][name] = {"counts": step(force), "seconds": round(time.time() - began, 1)}
            except Exception as e:  # recorded for whoever looks into the run
                record |= {"status": "failed", "failed": name, "error": f"{type(e).__name__}: {e}"[:2000], "traceback": traceback.format_exc()[-2000:]}
                break
        record["finished_at"] = datetime.now(timezone.utc)
        return record
