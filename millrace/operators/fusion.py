"""Reciprocal rank fusion of ranked channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
WEIGHTS = {"keyword": 0.5, "semantic": 1.0, "graph": 0.5}
#: Ties go to the channel that comes first here, then to the better rank in it.
ORDER = ("keyword", "semantic", "graph")


def ranked(hits: DataFrame, channel: str) -> DataFrame:
    """(doc_id, channel, rank, score) of hits (doc_id, score): ranks from 1 by falling score, ties by doc_id.

    The window has no partition, since a channel holds its few best only.
    """
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return hits.select("doc_id", F.lit(channel).alias("channel"), "score").withColumn("rank", place)


def fuse(channels: dict[str, DataFrame], top_k: int | None = None, k: int = K, weights: dict[str, float] | None = None, tie: bool = False) -> DataFrame:
    """(doc_id, rrf_score, ranks, channel_scores) of channels (doc_id, score), by falling score: each adds weight / (k + rank).

    With `tie`, a column _tie tells the order of documents with equal scores.
    """
    weights = WEIGHTS | (weights or {})
    rows = reduce(DataFrame.unionByName, (ranked(hits, name) for name, hits in channels.items()))
    weight = F.create_map(*(F.lit(x) for name in channels for x in (name, float(weights.get(name, 1.0)))))
    order = F.create_map(*(F.lit(x) for i, name in enumerate(channels) for x in (name, ORDER.index(name) if name in ORDER else len(ORDER) + i)))
    fused = rows.groupBy("doc_id").agg(
        F.sum(weight[F.col("channel")] / (k + F.col("rank"))).alias("rrf_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score")))).alias("channel_scores"),
        F.min(F.struct(order[F.col("channel")].alias("order"), "rank")).alias("_tie"),
    )
    fused = fused.orderBy(F.desc(F.round("rrf_score", 12)), "_tie", "doc_id")
    fused = fused.limit(top_k) if top_k else fused
    return fused if tie else fused.drop("_tie")
