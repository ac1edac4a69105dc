"""Entities of documents: extraction of what is stale, cleaning, and the canonical index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import PatternRecogniser, Recogniser
from .shared import keep

#: Types of quantities, and generic words, that make bad graph nodes.
EXCLUDED_TYPES = ("CARDINAL", "ORDINAL", "QUANTITY", "DATE", "TIME", "PERCENT", "MONEY")
GENERIC = (
    "ai", "the ai", "llm", "llms", "api", "apis", "saas", "ml", "nlp",
    "app", "apps", "inc", "inc.", "llc", "ltd", "co", "corp", "company",
    "startup", "startups", "platform", "technology", "technologies",
    "software", "data", "cloud", "open", "first", "one", "new", "series",
)
#: Documents that an entity's list holds at most, and links a page of those that have more.
MAX_LISTED, PAGE = 10_000, 1000
EDGE = r""" .,;:–—"'()\[\]-"""
ENTITIES = "array<struct<entity_text:string,entity_type:string,count:bigint>>"


def stale(derived: Column | str, current: Column | str) -> Column:
    """Whether something was never derived, or from another text: missing and different alike."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (derived, current))
    return a.isNull() | ~a.eqNullSafe(b)


def normalize_entity(c: Column | str) -> Column:
    """One space between words, no leading article, no possessive, no punctuation at the ends."""
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    text = F.regexp_replace(text, r"(?i)^(the|a|an)\s+", "")
    text = F.regexp_replace(text, r"['’]s$", "")
    return F.regexp_replace(text, f"^[{EDGE}]+|[{EDGE}]+$", "")


def is_useful(text: Column | str, kind: Column | str) -> Column:
    """Not a quantity, two to sixty characters, not generic, with a letter."""
    text, kind = (F.col(x) if isinstance(x, str) else x for x in (text, kind))
    return ~kind.isin(*EXCLUDED_TYPES) & F.length(text).between(2, 60) & ~F.lower(text).isin(*GENERIC) & text.rlike(r"\p{L}")


def clean_entities(c: Column | str) -> Column:
    """An entity array with normalised names, and the useful ones only; nothing is counted again."""
    named = F.transform(c, lambda e: F.struct(normalize_entity(e["entity_text"]).alias("entity_text"), e["entity_type"].alias("entity_type"), e["count"].cast("long").alias("count")))
    return F.filter(named, lambda e: is_useful(e["entity_text"], e["entity_type"]))


def extract(docs: DataFrame, recogniser: Recogniser | None = None, force: bool = False) -> DataFrame:
    """(doc_id, text, content_hash, entities_hash) -> (doc_id, entities, entities_hash) of what is stale.

    The recogniser is made once per task; the filter stands before the Python node.
    """
    own = recogniser or PatternRecogniser()
    todo = docs if force else docs.where(stale("entities_hash", "content_hash"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [[{"entity_text": t, "entity_type": k, "count": n} for t, k, n in own.entities(x)] if isinstance(x, str) and x.strip() else [] for x in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "entities": found, "entities_hash": pdf.content_hash})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = todo.select("doc_id", "text", "content_hash").mapInPandas(run, f"doc_id {kind}, entities {ENTITIES}, entities_hash string")
    return got.withColumn("entities", clean_entities("entities"))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, type, entity_id, entity_text, entity_type, count): an edge per document and entity entry."""
    one = docs.select("doc_id", "type", F.explode("entities").alias("e")).select("doc_id", "type", "e.*")
    one = one.where("entity_text <> '' AND entity_type <> ''")
    return one.withColumn("entity_id", F.sha1(F.concat_ws("|", F.lower("entity_text"), "entity_type")))


def canonical(edges: DataFrame, listed: int = MAX_LISTED) -> DataFrame:
    """(entity_id, entity_text, entity_type, mention_count, document_count, mentioned_in): entities by folded name and type.

    The shown name is the one that most entries have, then the smallest. Two levels of
    aggregation, so that an entity of very many documents is counted in parts. The list of documents is
    null for entities of more than `listed` documents, which would not fit into a row; `paged_links` has
    the links of all of them.
    """
    by_name = edges.groupBy("entity_id", "entity_type", "entity_text").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.coalesce("count", F.lit(1))).alias("mentions"))
    # the smallest name of those with most entries: entries are negated, so that a minimum finds it
    named = by_name.groupBy("entity_id", "entity_type").agg(F.min(F.struct((-F.col("entries")).alias("n"), "entity_text"))["entity_text"].alias("entity_text"), F.sum("mentions").alias("mention_count"))
    links = edges.select("entity_id", "doc_id", "type").distinct()
    counts = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("document_count"))
    few = links.join(counts.where(F.col("document_count") <= listed), "entity_id", "left_semi")
    lists = few.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "type"))).alias("mentioned_in"))
    return named.join(counts, "entity_id").join(lists, "entity_id", "left").select("entity_id", "entity_text", "entity_type", "mention_count", "document_count", "mentioned_in")


def paged_links(edges: DataFrame, size: int = PAGE) -> DataFrame:
    """(entity_id, page, first_doc, last_doc, links): every link of every entity, `size` of them a page, in the order of doc_id.

    Links are ranged by entity and document, so that an entity of any size lies in as many tasks as it takes; a link's number is its place in
    its task plus what the tasks before have of the entity. The pages of an entity are full but for the last.
    """
    links = edges.select("entity_id", "doc_id", "type").distinct().repartitionByRange("entity_id", "doc_id").sortWithinPartitions("entity_id", "doc_id", "type")
    links = keep(links.withColumn("_task", F.spark_partition_id()), "links")
    here = links.groupBy("entity_id", "_task").agg(F.count(F.lit(1)).alias("n"))
    tasks = Window.partitionBy("entity_id").orderBy("_task")
    # an entity goes on into a task for at most two entities a task, the first and the last, so this is no larger than twice the number of tasks
    before = here.withColumn("_before", F.coalesce(F.sum("n").over(tasks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before > 0").select("entity_id", "_task", "_before")
    place = F.row_number().over(Window.partitionBy("entity_id", "_task").orderBy("doc_id", "type")) - 1 + F.coalesce("_before", F.lit(0))
    numbered = links.join(F.broadcast(before), ["entity_id", "_task"], "left").withColumn("page", F.floor(place / F.lit(size)).cast("int"))
    link = F.struct("doc_id", "type")
    return numbered.groupBy("entity_id", "page").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.array_sort(F.collect_list(link)).alias("links"))


def page_of(pages: DataFrame, entity_id: str, page: int) -> DataFrame:
    """(doc_id, type) of one page of an entity: a row of a table of pages, for joins with documents page by page."""
    return pages.where((F.col("entity_id") == entity_id) & (F.col("page") == page)).select(F.explode("links").alias("l")).select("l.*")


def documents_of(pages: DataFrame, docs: DataFrame, entity_id: str, page: int) -> DataFrame:
    """The documents of one page of an entity, in the order of doc_id; a page is small enough to be broadcast."""
    return docs.join(F.broadcast(page_of(pages, entity_id, page).select("doc_id").distinct()), "doc_id", "left_semi").orderBy("doc_id")


def top_entities(canonical_: DataFrame, limit: int = 10, kind: str | None = None) -> DataFrame:
    found = canonical_ if kind is None else canonical_.where(F.col("entity_type") == kind)
    return found.orderBy(F.desc("mention_count"), "entity_text").limit(limit)


def by_type(entities: DataFrame) -> DataFrame:
    """(doc_id, names): entity names by type, in order, as a map."""
    one = entities.select("doc_id", F.posexplode("entities").alias("pos", "e"))
    listed = one.groupBy("doc_id", F.col("e.entity_type").alias("kind")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("e.entity_text").alias("t")))), lambda x: x["t"]).alias("names"))
    return listed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "names"))).alias("names"))
