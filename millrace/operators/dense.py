"""Exact dense retrieval: inner products of unit vectors, filtered before the cut."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays in double."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def nearest(vectors: DataFrame, query: Sequence[float], top_k: int) -> DataFrame:
    """(doc_id, score) of the best of (doc_id, embedding): each batch of vectors is one matrix, each task keeps its best, and these are merged.

    Vectors that are null, hold nulls or have another length take no part. Products and sums are in double, row by row, so that equal vectors score alike.
    """
    asked, columns = np.asarray(query, np.float64), vectors.select("doc_id", "embedding")
    schema = columns.select("doc_id").withColumn("score", F.lit(0.0)).schema

    def best(rows: pa.Table) -> pa.Table:
        rounded = pa.array(np.round(rows["score"].to_numpy(), 9))
        order = pc.sort_indices(rows.append_column("_by", rounded), [("_by", "descending"), ("doc_id", "ascending")])
        return rows.take(order[:top_k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            lists = b.column("embedding")
            fits = pc.fill_null(pc.equal(pc.list_value_length(lists), len(asked)), False)
            b = b.filter(fits)
            flat = b.column("embedding").flatten()
            matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(asked))
            scores = (matrix * asked).sum(axis=1)
            if flat.null_count:
                scores[np.asarray(pc.is_null(flat)).reshape(matrix.shape).any(axis=1)] = np.nan
            rows = pa.table({"doc_id": b.column("doc_id"), "score": scores}).filter(pa.array(~np.isnan(scores)))
            held = best(rows if held is None else pa.concat_tables([held, rows]))
        if held is not None and held.num_rows:
            yield from held.combine_chunks().to_batches()

    if not len(asked):
        return vectors.sparkSession.createDataFrame([], schema)
    return columns.where("embedding IS NOT NULL").mapInArrow(run, schema).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(top_k)


def search(vectors: DataFrame, query: Sequence[float], top_k: int = 20, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): the nearest vectors of (doc_id, embedding, ...); ties go to the smaller doc_id."""
    if where is not None:
        vectors = vectors.where(where)
    if allowed is not None:
        vectors = vectors.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return nearest(vectors, query, top_k)


def similar(vectors: DataFrame, doc_id: int | str, top_k: int = 10, same: str | None = "type") -> DataFrame:
    """(doc_id, score): the documents nearest to one of them, itself left out; of its own type where `same` names that column."""
    own = vectors.where((F.col("doc_id") == doc_id) & F.col("embedding").isNotNull()).first()
    others = vectors.where(F.col("doc_id") != doc_id)
    if own is None:
        return nearest(others.limit(0), [0.0], top_k)
    return nearest(others.where(F.col(same) == own[same]) if same else others, own["embedding"], top_k)


def decode(c: Column | str) -> Column:
    """Little-endian 32-bit floats of a binary column as an array; for vectors stored outside."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return run(c)


def encode(c: Column | str) -> Column:
    """An array of floats as little-endian 32-bit binary."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(c)
