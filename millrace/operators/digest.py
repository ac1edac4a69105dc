"""The weekly digest: selection, numbering, writing and checking."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import money
from ..functions.citations import validate
from ..functions.doctext import document_context, document_title, document_url, label_for
from .models import ExtractiveWriter, LanguageModel
from .parts import PartTable

PROMPT_VERSION = "digest-v1"
#: Sections in order, with their titles; the most of each, or of a type in the last.
SECTIONS = (("launches", "Launches"), ("funding", "Funding"), ("open_source", "Open source & models"))
CAPS = {"launches": 10, "funding": 10, "repo": 5, "model": 3, "paper": 4}


def first_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows, numbered by pos from 1; a sort with a limit comes first, so the window sees k rows."""
    return df.orderBy(*order).limit(k).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def funding_articles(rounds: DataFrame, articles: DataFrame, start: datetime, end: datetime, cap: int = CAPS["funding"]) -> DataFrame:
    """The week's rounds, largest first, each by its first article not taken yet; then other articles with funding titles, newest first.

    Which article a round gets depends on the rounds before it. Only the first `cap` rounds that get one count, and until then fewer than `cap` articles are
    taken. So a round without one has all its articles among fewer than `cap`, and of rounds with the same articles (as a set) no more than there are articles
    get one: of each set that many are kept, and those of sets beyond `cap` articles always get one. What `_first_placed` holds is bounded by `cap`.
    """
    week = articles.where((F.col("event_at") >= F.lit(start)) & (F.col("event_at") < F.lit(end)))
    own = rounds.where((F.col("announced_at") >= F.lit(start)) & (F.col("announced_at") < F.lit(end)) & F.col("confidence").isin("high", "medium"))
    known = articles.select(F.col("doc_id").cast("string").alias("doc_id"))
    links = own.select("_id", "amount_usd", "company", money.round_summary().alias("round_summary"), F.posexplode("source_doc_ids").alias("at", "doc_id")).join(known, "doc_id")
    few = links.groupBy("_id", "amount_usd", "company", "round_summary").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
    placed = _first_placed(few, cap)
    first = articles.drop("round_summary").withColumn("doc_id", F.col("doc_id").cast("string")).join(F.broadcast(placed), "doc_id").drop("round_amount_usd")
    rest = week.drop("round_summary").withColumn("doc_id", F.col("doc_id").cast("string")).where(money.is_funding_title("title")).join(F.broadcast(placed.select("doc_id")), "doc_id", "left_anti")
    rest = first_k(rest, cap, F.desc("event_at"), F.coalesce("title", F.lit("")), "doc_id").withColumn("pos", F.col("pos") + 1_000_000).withColumn("round_summary", F.lit(None).cast("string"))
    return first_k(first.unionByName(rest), cap, "pos")


def _first_placed(few: DataFrame, cap: int) -> DataFrame:
    """(doc_id, round_summary, round_amount_usd, pos): the first `cap` rounds (_id, amount_usd, company, round_summary, ids) that get an article, in order.

    Each takes the first of its ids that is not taken. Tasks replay their own sorted rows first, which drops what can't count in any order of the whole;
    one task replays what they leave.
    """
    order = (F.when(F.isnan("amount_usd"), None).otherwise(F.col("amount_usd")).desc_nulls_last(), F.asc_nulls_last("company"), F.asc_nulls_last("_id"))
    row = few.schema

    def cut(batches):
        """Of sorted rows those that may count: of a set of articles as many as it has (`cap` at most), until `cap` rounds are placed."""
        seen, taken = {}, set()
        for b in batches:
            keep = []
            for i, ids in enumerate(b.column("ids").to_pylist() if len(taken) < cap else ()):
                if len(taken) >= cap:
                    break
                same = frozenset(ids)
                if seen.get(same, 0) >= len(same):
                    continue
                seen[same] = seen.get(same, 0) + 1
                keep.append(i)
                doc = next((d for d in ids if d not in taken), None)
                if doc is not None:
                    taken.add(doc)
            yield b.take(pa.array(keep, pa.int64()))

    def replay(batches):
        taken, out = set(), []
        for b in batches:
            for r in b.to_pylist():
                doc = next((d for d in r["ids"] if d not in taken), None)
                if doc is not None and len(out) < cap:
                    taken.add(doc)
                    usd = r["amount_usd"]
                    out.append({"doc_id": doc, "round_summary": r["round_summary"], "round_amount_usd": float(usd) if usd is not None and usd == usd else 0.0, "pos": len(out) + 1})
        schema = pa.schema([("doc_id", pa.string()), ("round_summary", pa.string()), ("round_amount_usd", pa.float64()), ("pos", pa.int32())])
        yield pa.RecordBatch.from_pylist(out, schema)

    left = few.sortWithinPartitions(*order).mapInArrow(cut, row)
    return left.repartition(1).sortWithinPartitions(*order).mapInArrow(replay, "doc_id string, round_summary string, round_amount_usd double, pos int")


def select_week(docs: DataFrame, rounds: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The week's documents with section and n, the citation number across sections. Needs the fields of all types."""
    week = docs.where((F.col("event_at") >= F.lit(start)) & (F.col("event_at") < F.lit(end))).withColumn("doc_id", F.col("doc_id").cast("string"))
    zero = lambda c: F.desc(F.coalesce(F.col(c), F.lit(0)))
    text = lambda *cs: F.coalesce(*(F.col(c) for c in cs), F.lit(""))
    kinds = lambda *k: week.where(F.col("type").isin(*k))
    launches = first_k(kinds("launch", "startup"), CAPS["launches"], zero("points"), F.desc("event_at"), text("title", "name"), "doc_id")
    funding = funding_articles(rounds, docs.where(F.col("type") == "article"), start, end)
    repos = first_k(kinds("repo"), CAPS["repo"], zero("stars"), text("full_name"), "doc_id")
    models = first_k(kinds("model"), CAPS["model"], zero("trending_score"), text("hf_id"), "doc_id")
    papers = first_k(kinds("paper"), CAPS["paper"], zero("upvotes"), text("title"), "doc_id")
    parts = [(launches, 0, 0), (funding, 1, 0), (repos, 2, 0), (models, 2, 1), (papers, 2, 2)]
    out = None
    for df, section, part in parts:
        own = df.withColumns({"_section": F.lit(section), "_part": F.lit(part), "section": F.lit(SECTIONS[section][0])})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.withColumn("n", F.row_number().over(Window.orderBy("_section", "_part", "pos"))).drop("_part", "pos")


def input_hash(selection: DataFrame) -> DataFrame:
    """One row (input_hash): the same documents with the same texts have the same hash."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("content_hash", F.lit("")))
    return selection.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("input_hash"))


def sources(selection: DataFrame, max_chars: int = 320) -> DataFrame:
    """(section, n, doc_id, type, title, url, event_at, block): numbered sources with what a writer is shown."""
    out = selection.withColumns({"_title": document_title("type"), "_url": document_url(), "_context": document_context("type", max_chars)})
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), label_for("type"), F.lit(": "), "_title", F.lit("\n"), "_context", F.when(F.col("_url") != "", F.concat(F.lit("\nSource URL: "), "_url")).otherwise(""))
    return out.select("_section", "section", "n", "doc_id", "type", F.col("_title").alias("title"), F.col("_url").alias("url"), "event_at", block.alias("block"))


def section_prompts(numbered: DataFrame) -> DataFrame:
    """(section, prompt, allowed): the sources of each section in order, and their numbers."""
    blocks = F.array_sort(F.collect_list(F.struct("n", "block")))
    return numbered.groupBy("_section", "section").agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("prompt"), F.array_sort(F.collect_list("n")).alias("allowed"))


def write(prompts: DataFrame, writer: LanguageModel | None = None) -> DataFrame:
    """(section, markdown, bullets, uncited_bullets, invalid_citations): each section written, and its citations checked."""
    own = writer or ExtractiveWriter()

    @F.udf("string")
    def generate(prompt: str) -> str:  # a call a section, three a week
        return own.generate(prompt)

    return prompts.withColumn("v", validate(generate("prompt"), "allowed")).select("_section", "section", "v.*").orderBy("_section").drop("_section")


def generate(docs: DataFrame, rounds: DataFrame, week: str, start: datetime, end: datetime, existing: DataFrame | None = None, writer: LanguageModel | None = None, force: bool = False) -> tuple[dict | None, str]:
    """A week's digest and how it came about: generated, unchanged (same inputs and prompts), or empty."""
    selection = select_week(docs, rounds, start, end).cache()
    counts = {r["section"]: r["count"] for r in selection.groupBy("section").count().collect()}
    if not counts:
        return None, "empty"
    key = input_hash(selection).first()[0]
    if existing is not None and not force:
        old = existing.where(F.col("week") == week).first()
        if old is not None and old["input_hash"] == key and old["prompt_version"] == PROMPT_VERSION:
            return old.asDict(), "unchanged"
    numbered = sources(selection)
    listed = [r.asDict() for r in numbered.select("section", "n", "doc_id", "type", "title", "url", "event_at").orderBy("n").collect()]  # at most 32
    written = {r["section"]: r.asDict() for r in write(section_prompts(numbered), writer).collect()}
    sections = [
        {"key": k, "title": title, "markdown": written.get(k, {}).get("markdown", ""), "bullets": written.get(k, {}).get("bullets", 0), "sources": [{n: v for n, v in s.items() if n != "section"} for s in listed if s["section"] == k]}
        for k, title in SECTIONS
    ]
    warnings = {w: sum(x[w] for x in written.values()) for w in ("invalid_citations", "uncited_bullets")}
    return {
        "week": week, "week_start": start, "week_end": end, "prompt_version": PROMPT_VERSION, "input_hash": key,
        "input_doc_ids": [s["doc_id"] for s in listed], "counts": {k: counts.get(k, 0) for k, _ in SECTIONS}, "sections": sections, "warnings": warnings,
    }, "generated"


#: A digest as it is stored: one row a week.
STORED = (
    "week string, week_start timestamp, week_end timestamp, generated_at timestamp, prompt_version string, input_hash string, input_doc_ids array<string>, counts map<string,bigint>, "
    "sections array<struct<key:string,title:string,markdown:string,bullets:bigint,sources:array<struct<n:bigint,doc_id:string,type:string,title:string,url:string,event_at:timestamp>>>>, warnings map<string,bigint>"
)


class DigestStore:
    """Digests by week. One is written only if its inputs or its prompts differ from those of the stored one; the latest version of a week stays readable while it is replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, PartTable(spark, path, "week")

    def read(self) -> DataFrame:
        return self.table.read() if self.table.exists() else self.spark.createDataFrame([], STORED)

    def put(self, made: dict, generated_at: datetime, force: bool = False) -> str:
        """Store a digest of generate(): stored, or unchanged where the week has one of the same inputs and prompts."""
        if not force and self.table.exists():
            old = self.table.read(parts=[made["week"]]).select("input_hash", "prompt_version").first()
            if old is not None and (old["input_hash"], old["prompt_version"]) == (made["input_hash"], made["prompt_version"]):
                return "unchanged"
        names = [f.name for f in StructType.fromDDL(STORED)]
        row = made | {"generated_at": generated_at, "input_doc_ids": [str(i) for i in made["input_doc_ids"]], "sections": [s | {"sources": [x | {"doc_id": str(x["doc_id"])} for x in s["sources"]]} for s in made["sections"]]}
        self.table.replace(self.spark.createDataFrame([tuple(row[n] for n in names)], STORED), [made["week"]], ("week",), ("input_hash",))
        return "stored"

    def make(self, docs: DataFrame, rounds: DataFrame, week: str, start: datetime, end: datetime, generated_at: datetime, writer: LanguageModel | None = None, force: bool = False) -> str:
        """Generate a week's digest and store it: stored, unchanged, or empty. An unchanged week costs a selection and no call of the writer."""
        existing = self.table.read(parts=[week]) if self.table.exists() else None
        made, how = generate(docs, rounds, week, start, end, existing, writer, force)
        return how if how != "generated" else self.put(made, generated_at, force)

    def list(self, limit: int = 12) -> DataFrame:
        """(week, week_start, week_end, generated_at, counts, bullets) of the newest weeks; bullets are those of all sections."""
        if not 1 <= limit <= 52:
            raise ValueError("limit: 1 to 52")
        return self.summaries().orderBy(F.desc("week_start")).limit(limit)

    def summaries(self) -> DataFrame:
        bullets = F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(s["bullets"], F.lit(0)))
        return self.read().select("week", "week_start", "week_end", "generated_at", "counts", bullets.alias("bullets"))

    def latest(self) -> dict:
        row = self.read().orderBy(F.desc("week_start")).first()
        if row is None:
            raise KeyError("no digest has been generated yet")
        return row.asDict(recursive=True)

    def week(self, week: str) -> dict:
        row = self.table.read(parts=[week]).first() if self.table.exists() else None
        if row is None:
            raise KeyError(f"no digest for {week}")
        return row.asDict(recursive=True)
