"""Exact top-k by inner product: global score histograms are refined until they locate each kth score.

Queries are taken in blocks of bounded size, which are sent to all tasks; candidates are
never moved. A pass scores everything against the block. Each task counts, in the bins of
the query's present range, the k best of its own scores (the k best of all are among them); the
counts are added up, and the bin that holds the kth score becomes the next range. Once a bin
is one score wide, a last pass keeps what lies above it, and of the ties the smallest ids.
"""

from __future__ import annotations

import math
import operator
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, shared_dir

K, EVERY, SCALE = 10, 100, 1024
#: Queries sent to the tasks at a time, in expectation; bins of a range; candidates scored at a time.
BLOCK, BINS, ROWS = 2048, 2048, 2048
#: The length of a vector from which a product of two may reach 2^53.
LARGE = 2.0**26.5


def integer_vectors(batch: pa.RecordBatch, scale: int = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and vectors of floor(scale * x) as doubles, of the rows of (vec_id, embedding) that take part."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    known = np.asarray(ids.is_valid()) & (sizes >= 0)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(float("nan")))  # without the items of null rows
    starts = np.r_[0, np.cumsum(np.maximum(sizes, 0))[:-1]].astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    numbers = np.asarray(ids.fill_null(0))
    out = {}
    for dim in np.unique(sizes[known]).tolist():
        rows = np.flatnonzero(known & (sizes == dim))
        x = flat[starts[rows][:, None] + np.arange(dim)[None, :]]
        fine = np.isfinite(x).all(1)
        if fine.any():
            out[dim] = numbers[rows[fine]], np.floor(x[fine] * scale)
    return out


def _largest(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in [x for _, x in integer_vectors(b, scale).values()]:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max(initial=0))])], names=["norm"])


def _tops(batches: Iterator[pa.RecordBatch], block: dict, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of all rows of a task: (dimension, ids, scores by candidate and query), some candidates at a time; own pairs are -inf."""
    for b in batches:
        for dim, (ids, x) in integer_vectors(b, scale).items():
            if dim in block:
                names, q = block[dim][:2]
                for i in range(0, len(ids), ROWS):
                    s = x[i : i + ROWS] @ q.T
                    s[ids[i : i + ROWS, None] == names[None, :]] = -np.inf
                    yield dim, ids[i : i + ROWS], s


def exact_top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): each query's k best, all if fewer.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows with
    another vec_id and the same number of components. Ties go to the smaller vec_id. Vectors
    that are null, or hold null or non-finite components, and rows without a vec_id take no
    part. Of repeated query ids the smallest vector that takes part asks; repeated candidates count each.
    An empty table gives an empty one. Pairs of vectors whose scores can reach 2^53, where doubles are no longer exact, are scored in whole numbers of any
    size instead, each task keeping its best k; a score beyond the range of long is its nearest end.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    norm = vectors.mapInArrow(lambda it: _largest(it, scale), "norm double").agg(F.max("norm")).first()[0] or 0.0
    if norm >= LARGE:
        return _with_large(vectors, k, every, scale, block, bins)
    asking = vectors.where(f"vec_id % {every} = 0 AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asking = keep(asking, "queries")
    blocks = max(1, -(-asking.count() // block))
    path = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for n in range(blocks):
        rows = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow()
        own = {}
        for b in rows.combine_chunks().to_batches():
            own |= {dim: (*found, np.ceil(np.sqrt((found[1] ** 2).sum(1)) * norm) + 1) for dim, found in integer_vectors(b, scale).items()}
        if own:
            _answer(vectors, own, k, scale, bins).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def whole_numbers(vector: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) of each component, whatever its size."""
    return [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in vector]


def _with_large(vectors: DataFrame, k: int, every: int, scale: int, block: int, bins: int) -> DataFrame:
    """The same of tables with vectors so large that products may not be exact in double: pairs without them as ever, all others in whole numbers."""
    spark = vectors.sparkSession
    fine = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"
    # a vector is large if a component or the sum of their squares is, as far as doubles tell, with room for rounding
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda n, x: n + (x * scale) * (x * scale)))
    told = keep(vectors.where(fine).withColumn("large", size >= LARGE / 2), "told")
    asking = keep(told.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "large")).alias("q")).select("vec_id", "q.embedding", "q.large"), "queries")
    asked = asking.where("NOT large").select("vec_id", "embedding")
    found = _small(asked, told.where("NOT large").select("vec_id", "embedding"), k, scale, block, bins)
    blocks = max(1, -(-asking.count() // block))
    for n in range(blocks):
        own = [(r["vec_id"], whole_numbers(r["embedding"], scale), r["large"]) for r in asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()]
        sent = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[int, int]]] = {}
            for b in batches:
                for vec_id, vector, large in zip(*(b.column(c).to_pylist() for c in ("vec_id", "embedding", "large")), strict=True):
                    x = whole_numbers(vector, scale)
                    for name, q, own_large in sent.value:
                        if name != vec_id and len(q) == len(x) and (large or own_large):
                            score = min(max(sum(map(operator.mul, q, x)), -(1 << 63)), (1 << 63) - 1)
                            held = best.setdefault(name, [])
                            held.append((-score, vec_id))
                            if len(held) >= 4 * k:
                                held.sort()
                                del held[k:]
            rows = [(name, v, -s) for name, held in best.items() for s, v in sorted(held)[:k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], names=["query_id", "vec_id", "score"])

        found = found.unionByName(told.mapInArrow(run, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _small(asking: DataFrame, candidates: DataFrame, k: int, scale: int, block: int, bins: int) -> DataFrame:
    """(query_id, vec_id, score) of some queries among some candidates, all small."""
    spark = asking.sparkSession
    norm = candidates.unionByName(asking).mapInArrow(lambda it: _largest(it, scale), "norm double").agg(F.max("norm")).first()[0] or 0.0
    blocks = max(1, -(-asking.count() // block))
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for n in range(blocks):
        own = {}
        for b in asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).toArrow().combine_chunks().to_batches():
            own |= {dim: (*found, np.ceil(np.sqrt((found[1] ** 2).sum(1)) * norm) + 1) for dim, found in integer_vectors(b, scale).items()}
        if own:
            out = out.unionByName(_answer(candidates, own, k, scale, bins).drop("rank"))
    return out


def _answer(vectors: DataFrame, own: dict, k: int, scale: int, bins: int) -> DataFrame:
    """Top k of one block of queries: dimension -> (ids, vectors, bounds of the scores)."""
    spark = vectors.sparkSession
    ids = np.concatenate([x[0] for x in own.values()])
    at = {dim: slice(end - len(x[0]), end) for (dim, x), end in zip(own.items(), np.cumsum([len(x[0]) for x in own.values()]).tolist(), strict=True)}
    bound = np.concatenate([x[2] for x in own.values()])
    low, high, width = -bound, bound + 1, np.ceil((2 * bound + 1) / bins)
    above, done = np.zeros(len(ids)), np.zeros(len(ids), bool)  # scores above the range; whether it is one score wide
    sent = spark.sparkContext.broadcast(own)
    while not done.all():
        state = spark.sparkContext.broadcast((low, high, width))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            low, high, width = state.value
            best: dict[int, np.ndarray] = {}
            for dim, _, s in _tops(batches, sent.value, scale):
                s = np.vstack([best[dim], s]) if dim in best else s
                best[dim] = np.partition(s, len(s) - k, axis=0)[-k:] if len(s) > k else s
            for dim, s in best.items():
                bin_ = np.floor((s - low[at[dim]]) / width[at[dim]])
                ok = np.isfinite(s) & (bin_ >= 0) & (bin_ < bins) & (s < high[at[dim]])
                query = np.broadcast_to(np.arange(at[dim].start, at[dim].stop), s.shape)[ok]
                cell, n = np.unique(query * bins + bin_[ok].astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // bins), pa.array(cell % bins), pa.array(n.astype(np.int64))], names=["query", "bin", "n"])

        counted = vectors.mapInArrow(count, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")))
        want = spark.createDataFrame([(i, float(k - a)) for i, a in enumerate(above.tolist())], "query long, want double")
        kth = (
            counted.withColumn("upto", upto)
            .join(F.broadcast(want), "query")
            .withColumn("reached", F.col("upto") >= F.col("want"))
            .groupBy("query")
            .agg(F.max(F.when(F.col("reached"), F.struct("bin", (F.col("upto") - F.col("n")).alias("over")))).alias("kth"))
            .collect()
        )  # a row a query of the block
        reached = {r["query"]: r["kth"] for r in kth if r["kth"] is not None}
        for i in np.flatnonzero(~done).tolist():
            if i not in reached:  # fewer than k candidates: all of them
                low[i], done[i] = -np.inf, True
                continue
            low[i] += reached[i]["bin"] * width[i]
            high[i] = low[i] + width[i]
            above[i] += reached[i]["over"]
            done[i], width[i] = width[i] <= 1, np.ceil(width[i] / bins)
        width[done] = 1
    edge = spark.sparkContext.broadcast(low)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, ties = edge.value, {}
        for dim, names, s in _tops(batches, sent.value, scale):
            r, c = np.nonzero((s >= low[at[dim]]) & np.isfinite(s))
            query, vec, score = ids[at[dim]][c], names[r], s[r, c].astype(np.int64)
            tied = s[r, c] == low[at[dim]][c]
            if (~tied).any():
                yield pa.RecordBatch.from_arrays([pa.array(x[~tied]) for x in (query, vec, score)], names=["query_id", "vec_id", "score"])
            if tied.any():
                held = [np.concatenate([a, x[tied]]) for a, x in zip(ties[dim], (query, vec, score), strict=True)] if dim in ties else [x[tied] for x in (query, vec, score)]
                order = np.lexsort((held[1], held[0]))
                held = [x[order] for x in held]
                first = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
                place = np.arange(len(held[0])) - np.repeat(first, np.diff(np.r_[first, len(held[0])]))
                ties[dim] = [x[place < k] for x in held]
        for held in ties.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return vectors.mapInArrow(take, "query_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
