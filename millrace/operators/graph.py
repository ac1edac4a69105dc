"""Documents connected by shared entities: two-hop expansion over flat edges, and the graph's tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEGREE, SHOWN = 25, 8
#: Scores that agree to this many digits are ties; sums of doubles differ beyond by the order of their parts.
DIGITS = 9


def _distinct_at_least(c: str, about: int) -> Column:
    """An aggregate that is never above the number of distinct values: the bits that their hashes set, of two or more for each of `about` values."""
    words = about // 32 + 1
    place = F.pmod(F.xxhash64(c), F.lit(64 * words))
    bits = [F.bit_count(F.coalesce(F.bit_or(F.when(F.floor(place / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")))), F.lit(0).cast("long"))) for w in range(words)]
    return reduce(add, bits)


def expand(edges: DataFrame, seeds: DataFrame, n_docs: DataFrame, top_k: int = 20, max_degree: int = MAX_DEGREE, kind: str | None = None) -> DataFrame:
    """(doc_id, score, shared): neighbours of the seeds by the rarity of shared entities.

    `edges` is (doc_id, entity_id, entity_text, [type]), `seeds` (doc_id), `n_docs` one row (n).
    Entities of one document, or of more than `max_degree`, don't count: nearly all hubs go where their edges are read, by
    a bound that a few bits an entity give, and the others by their exact degree. What is broadcast are entities of the seeds. Ties go to the smaller doc_id.
    """
    kept = [c for c in ("type",) if c in edges.columns]
    seeds = F.broadcast(seeds.select("doc_id").distinct())
    touched = F.broadcast(edges.join(seeds, "doc_id", "left_semi").select("entity_id").distinct())
    near = edges.join(touched, "entity_id", "left_semi")
    few = F.broadcast(near.groupBy("entity_id").agg(_distinct_at_least("doc_id", max_degree).alias("least")).where(F.col("least") <= max_degree).select("entity_id"))
    near = near.join(few, "entity_id", "left_semi").dropDuplicates(["doc_id", "entity_id"])
    degree = near.groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree").between(2, max_degree))
    weighed = near.join(degree, "entity_id").join(seeds, "doc_id", "left_anti").crossJoin(F.broadcast(n_docs))
    if kind is not None:
        weighed = weighed.where(F.col("type") == kind)
    return (
        weighed.groupBy("doc_id", *kept)
        .agg(
            F.sum(F.log1p(F.greatest("n", F.lit(1)) / F.col("degree"))).alias("score"),
            F.slice(F.array_sort(F.collect_set("entity_text")), 1, SHOWN).alias("shared"),
        )
        .orderBy(F.desc(F.round("score", DIGITS)), "doc_id")
        .limit(top_k)
    )


def vertices(docs: DataFrame, canonical: DataFrame) -> DataFrame:
    """(node_id, label, name): a vertex for each document and each entity."""
    return docs.select(F.col("doc_id").cast("string").alias("node_id"), F.col("type").alias("label"), F.col("title").alias("name")).unionByName(
        canonical.select(F.col("entity_id").alias("node_id"), F.lit("entity").alias("label"), F.col("entity_text").alias("name"))
    )


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): vertices by label, and edges."""
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "label", "n").unionByName(
        edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.lit("mentions").alias("label"), "n")
    )


def neighbourhood(docs: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(entity_text, entity_type, doc_id, title): entities of the startup of that name (any case), and their other documents."""
    own = F.broadcast(docs.where((F.col("type") == "startup") & (F.lower("name") == name.lower())).select(F.col("doc_id").alias("_own")).limit(1))
    mine = edges.join(own, edges.doc_id == own._own).select("entity_id", "_own")
    others = edges.join(F.broadcast(mine), "entity_id").where("doc_id <> _own")
    return others.join(docs.select("doc_id", "title"), "doc_id").select("entity_text", "entity_type", "doc_id", "title").distinct()
