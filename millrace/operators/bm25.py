"""Okapi BM25 as tables: postings, document lengths, term statistics, and one row about the corpus.

An index is built once, can be saved as versioned Parquet, and serves any number of
queries: a query's few terms are broadcast against the postings, summed up by document, restricted
to what filters allow, and only then cut to the best.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, TOKEN, tokenize
from .store import keep

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf, length of the document), lengths(doc_id, length, [type]), terms(term, df, idf), corpus(n, avgdl)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame

    TABLES = ("postings", "lengths", "terms", "corpus")


def _counted(docs: DataFrame, kept: list[str], text: str) -> DataFrame:
    """(term, doc_id, [type], length, tf, first): a row for each term of each row of docs, one without a term if it has none; one of its rows is the first.

    A row's tokens, those of functions.text.tokenize, are counted where the row is read, so that nothing is shuffled by document.
    """
    ids = ["doc_id", *kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, stop = re.compile(TOKEN).findall, frozenset(STOPWORDS)
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            at, terms, times, lengths, first = [], [], [], [], []
            for row, lowered in enumerate(b.column("lowered").to_pylist()):
                own: dict[str, int] = {}
                for token, n in Counter(found(lowered)).items():
                    if token not in stop and len(term := token.strip(".-")) > 1:
                        own[term] = own.get(term, 0) + n
                size = len(own) or 1
                at += [row] * size
                terms += own or [None]
                times += own.values() or [0]
                lengths += [sum(own.values())] * size
                first += [True] + [False] * (size - 1)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(b.column(c).take(place) for c in ids), pa.array(lengths, pa.int32()), pa.array(times, pa.int64()), pa.array(first, pa.bool_())],
                names=["term", *ids, "length", "tf", "first"],
            )

    rows = docs.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(*ids, F.lower(F.col(text)).alias("lowered"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    counted = rows.mapInArrow(count, f"term string, {kinds}, length int, tf long, first boolean")
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return counted
    return counted.groupBy("term", *ids, "length").agg(F.sum("tf").alias("tf"), F.max("first").alias("first"))  # equal rows are one document


def build(docs: DataFrame, text: str = "text", written: bool = False) -> Index:
    """Index of (doc_id, text, [type]). Documents whose text is blank are left out; those without tokens count in n and the mean length.

    `written`: postings and lengths are stored first, so that no text is cut twice; without it an index is a plan.
    """
    kept = [c for c in ("type",) if c in docs.columns]
    counted = _counted(docs, kept, text)
    if written:
        counted = keep(counted, "postings")
    postings = counted.where("term IS NOT NULL").select("term", "doc_id", "tf", "length")
    lengths = counted.where("first").select("doc_id", *kept, "length")
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"))
    raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    by_term = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(corpus)).select("term", "df", raw.alias("raw"))
    mean = by_term.agg(F.avg("raw").alias("mean"))
    # a term in more than half of the documents gets a small part of the mean instead
    terms = by_term.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, lengths, terms, corpus)


def query_terms(spark, query: str) -> DataFrame:
    """(term, times) of a query; a repeated word counts as often."""
    return spark.range(1).select(F.explode(tokenize(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))


def scores(index: Index, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of the documents that have a term of the query."""
    spark = index.postings.sparkSession
    asked = F.broadcast(query_terms(spark, query))
    found = index.postings.join(asked, "term").join(F.broadcast(index.terms.join(asked.select("term"), "term")), "term")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    return found.crossJoin(F.broadcast(index.corpus)).groupBy("doc_id").agg(F.sum(part).alias("score"))


def search(index: Index, query: str, top_k: int = 20, kind: str | None = None, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score): the best documents with a score above zero; ties go to the smaller doc_id.

    The type and `allowed` (doc_id) restrict before the cut, so a filtered query still gets its best.
    """
    found = scores(index, query, k1, b).where("score > 0")
    if kind is not None:
        found = found.join(index.lengths.where(F.col("type") == kind).select("doc_id"), "doc_id", "left_semi")
    if allowed is not None:
        found = found.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return found.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(top_k)
