"""BM25 served from blocks: postings laid by term and range of documents, with the largest part of a score in each block.

Documents are dealt into ranges by the hash of their id. A block is the postings of one term in one range; files are ordered by term and range with small row groups, so
that a query's terms and ranges reach the scan as statistics. A range's bound is the sum of its blocks' largest parts over the query's terms. Ranges
are scored in the order of bounds until none that is left can hold a document of the best k: the result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .bm25 import K1, B, Index
from .store import VersionedTable, keep

#: Documents a range, in expectation; ranges that a first, second, ... round scores; the last round takes all that may count.
RANGE, ROUNDS = 256, (4, 32, 256, 2048)
#: Scores are ordered as rounded to nine places, so bounds give way by a little more.
SLACK = 1e-8
LAYOUT = {"parquet.block.size": str(256 << 10), "parquet.page.row.count.limit": "2000"}


@dataclass(frozen=True)
class Blocks:
    """postings(term, range, doc_id, tf, length), blocks(term, range, n, top), terms(term, df, idf), lengths(doc_id, length, [type]), corpus(n, avgdl, ranges)."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    lengths: DataFrame
    corpus: DataFrame

    TABLES = ("postings", "blocks", "terms", "lengths", "corpus")

    def search(self, query: str, top_k: int = 20, kind: str | None = None, allowed: DataFrame | None = None, read: list | None = None) -> DataFrame:
        """(doc_id, score): the documents bm25.search gives. Takes the query's terms, then `top_k` rows a round, to the driver.

        `read`, if given, gets the (terms, ranges) of each round.
        """
        spark = self.postings.sparkSession
        schema = self.postings.select("doc_id").withColumn("score", F.lit(0.0)).schema
        asked = {r["term"]: r["times"] for r in spark.range(1).select(F.explode(tokenize(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times")).collect()}
        idf = {r["term"]: r["idf"] for r in self.terms.where(F.col("term").isin(*asked)).collect()} if asked else {}
        weight = {t: asked[t] * v for t, v in idf.items()}
        if not weight:
            return spark.createDataFrame([], schema)
        weigh = F.lit(0.0)
        for t, w in weight.items():
            weigh = F.when(F.col("term") == t, F.lit(float(w))).otherwise(weigh)
        own = F.col("term").isin(*weight)
        bounds = self.blocks.where(own).groupBy("range").agg(F.sum(F.greatest(weigh, F.lit(0.0)) * F.col("top")).alias("bound"))
        bounds = keep(bounds.where("bound > 0"), "bounds")
        (avgdl,) = self.corpus.select("avgdl").first()
        norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(avgdl))
        restrict = None if kind is None else self.lengths.where(F.col("type") == kind).select("doc_id")
        best: list[tuple] = []
        least, last = 0.0, None
        for n in (*ROUNDS, None):
            left = bounds.where(F.col("bound") >= least - SLACK) if len(best) >= top_k else bounds
            if last is not None:  # bounds of the rounds before are at `last` or above, ties by range
                left = left.where((F.col("bound") < last[0]) | (F.col("bound") == last[0]) & (F.col("range") > last[1]))
            left = left.orderBy(F.desc("bound"), "range")
            found = self.postings.where(own)
            if n is None:
                found = found.join(left.select("range"), "range", "left_semi")
            else:
                ranges = left.limit(n).collect()
                if not ranges:
                    break
                last = (ranges[-1]["bound"], ranges[-1]["range"])
                found = found.where(F.col("range").isin(*(r["range"] for r in ranges)))
                if read is not None:
                    read.append((list(weight), [r["range"] for r in ranges]))
            scored = found.groupBy("doc_id").agg(F.sum(weigh * F.col("tf") * (K1 + 1) / norm).alias("score")).where("score > 0")
            for only in (restrict, allowed):
                if only is not None:
                    scored = scored.join(only.select("doc_id"), "doc_id", "left_semi")
            best += scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(top_k).collect()
            best = sorted(best, key=lambda r: (-round(r["score"], 9), r["doc_id"]))[:top_k]
            least = best[-1]["score"] if len(best) >= top_k else 0.0
            if n is not None and len(ranges) < n:
                break
        return spark.createDataFrame([tuple(r) for r in best], schema)


def write(index: Index, path: str, range_docs: int = RANGE) -> Blocks:
    """Lay an index out in blocks below path, each table as a version beside the one before."""
    spark = index.postings.sparkSession
    row = index.corpus.first()
    ranges, avgdl = max(1, -(-row["n"] // range_docs)), row["avgdl"] or 0.0
    dealt = index.postings.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
    laid = dealt.select("term", "range", "doc_id", "tf", "length").repartitionByRange("term", "range").sortWithinPartitions("term", "range", "doc_id")
    _put(spark, laid, f"{path}/postings")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(avgdl)))
    written = VersionedTable(spark, f"{path}/postings").read()
    tops = written.groupBy("term", "range").agg(F.count(F.lit(1)).alias("n"), F.max(part).alias("top"))
    _put(spark, tops.repartitionByRange("term", "range").sortWithinPartitions("term", "range"), f"{path}/blocks")
    _put(spark, index.terms.repartitionByRange("term").sortWithinPartitions("term"), f"{path}/terms")
    _put(spark, index.lengths, f"{path}/lengths")
    _put(spark, spark.createDataFrame([(row["n"], float(avgdl), ranges)], "n long, avgdl double, ranges int"), f"{path}/corpus")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Blocks:
    return Blocks(*(VersionedTable(spark, f"{path}/{name}").read() for name in Blocks.TABLES))


def _put(spark: SparkSession, df: DataFrame, path: str) -> None:
    VersionedTable(spark, path).replace(df, options=LAYOUT)
