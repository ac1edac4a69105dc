"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean, discard, keep


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .union(least.select("a", F.col("m").alias("b")))
    )


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(a, b) links of one comparable type -> (node, root): each linked node with the least node it can reach, but for these themselves.

    Nodes without links are absent; self-links, repeated links and either direction are
    allowed. A star's centre is found by a grouped minimum, so no task needs all neighbours of
    one node. Each round is written to the shared folder in place of the one before; the rounds end when the links no
    longer change. The result is a kept table.
    """
    now = keep(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if sign == seen or sign[0] == 0:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out.kept_at = now.kept_at
            return out
        seen, before = sign, now
        now = keep(_small_star(_large_star(now).distinct()).distinct(), name)
        discard(before)
        clean(links.sparkSession)
