"""Importance resampling towards a target distribution, with hashed word n-gram features counted in word tries.

A path of a trie is a run of consecutive words; its node holds how often the run occurred and the state of the
CRC-32 of the run's bytes, from which the states of longer runs go on. Each task has a trie of its own, adds its counts up in
buckets, and only bucket totals are merged. Scoring walks the same paths through a trie whose nodes hold gains.

The draw is a Gumbel top-k: weight plus noise that depends on the doc_id alone, so it can be repeated.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep

BUCKETS = 10_000
#: A trie that holds more nodes is emptied into the bucket totals; a text is read in chunks of so many bytes.
NODES, CHUNK = 400_000, 1 << 22
#: Lower-cases A-Z; all but letters, digits and bytes of other characters becomes a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Trie(dict):
    """(node, word) -> node below it; words below the root are keys by themselves."""

    def __init__(self, gains: np.ndarray | None = None, buckets: int = BUCKETS):
        super().__init__()
        self.gains, self.buckets = gains, buckets
        self.crc: list[int] = []
        self.count = np.zeros(0, np.int64)
        self.gain: list[int] = []

    def __missing__(self, key) -> int:
        below = isinstance(key, tuple)
        crc = zlib.crc32(b" " + key[1], self.crc[key[0]]) if below else zlib.crc32(key)
        node = self[key] = len(self.crc)
        self.crc.append(crc)
        if self.gains is not None:
            self.gain.append(int(self.gains[crc % self.buckets]))
        return node

    def walk(self, words: list[bytes], longest: int, old: int = 0) -> list[np.ndarray]:
        """The nodes of all runs of 1 to `longest` words, by length; runs that end within the first `old` words are left out."""
        nodes = list(map(self.__getitem__, words))
        out = [np.asarray(nodes[old:], np.int64)]
        for n in range(2, longest + 1):
            nodes = list(map(self.__getitem__, zip(nodes, words[n - 1 :])))
            out.append(np.asarray(nodes[max(0, old - n + 1) :], np.int64))
        return out

    def add(self, nodes: np.ndarray) -> None:
        own = np.bincount(nodes, minlength=len(self.crc))
        own[: len(self.count)] += self.count
        self.count = own

    def pour(self, totals: np.ndarray) -> None:
        """Adds the counts to the totals of their buckets and empties the trie."""
        np.add.at(totals, np.asarray(self.crc, np.int64) % self.buckets, self.count)
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.crc, self.gain, self.count = [], [], np.zeros(0, np.int64)


def chunks(text: bytes | None, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in bounded lists, and how many of them the list before has already brought."""
    text, start, carry = text or b"", 0, []
    while start < len(text):
        stop = min(len(text), start + CHUNK)
        while stop < len(text) and WORDS[text[stop]] != 32:
            stop += 1
        words = carry + text[start:stop].translate(WORDS).split()
        if words:
            yield words, len(carry)
        carry, start = words[len(words) - longest + 1 :] if longest > 1 else [], stop


def bucket_totals(rows: DataFrame, longest: int = 1, buckets: int = BUCKETS, column: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trie, totals = Trie(buckets=buckets), np.zeros(buckets, np.int64)
        for b in batches:
            held = []
            for text in b.column(0).cast(pa.binary()).to_pylist():
                for words, old in chunks(text, longest):
                    held += trie.walk(words, longest, old)
                    if sum(map(len, held)) > NODES or len(trie) > NODES:
                        trie.add(np.concatenate(held))
                        held = []
                        if len(trie) > NODES:
                            trie.pour(totals)
            if held:
                trie.add(np.concatenate(held))
        trie.pour(totals)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    return rows.select(column).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from two tables of totals; they have a row a bucket at most, and so fit the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, rows in ((s, source), (t, target)):
        for r in rows.collect():
            into[r["bucket"]] = r["n"]
    whole, wanted = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (whole + float(buckets)) / ((a + 1.0) * (wanted + float(buckets))))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1, column: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight: the floored mean of the gains of a text's features, 0 if it has none."""
    schema = docs.withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")}).schema
    place = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trie = Trie(gain, len(gain))
        for b in batches:
            n_words, n_features, weight = [], [], []
            for text in b.column(place).cast(pa.binary()).to_pylist():
                words_here = features = total = 0
                for words, old in chunks(text, longest):
                    words_here += len(words) - old
                    nodes = trie.walk(words, longest, old)
                    features += sum(map(len, nodes))
                    own = trie.gain
                    total += sum(own[k] for x in nodes for k in x.tolist())
                    if len(trie) > NODES:
                        trie.empty()
                n_words.append(words_here)
                n_features.append(features)
                weight.append(total // features if features else 0)
            cols = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, schema)


def noise(doc_id, seed: int):
    """floor(-1000 ln(-ln u)) with u drawn from the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each document: rank 1, 2, ... of the `percent` in a hundred that are drawn, null of others.

    docs and target have texts in `column`; runs of 1 to `longest` words are features. Drawn from are the documents with `least_words`
    words or more: the highest scores, ties to the smaller doc_id (null ids first), then to the larger weight and number of features; rows
    that are equal in all of these share no rank, and any of them gets the better one. Null and empty texts have no features, weight 0, and are
    not drawn. Other columns of docs, whatever their names, are not touched. An empty table gives an empty one; with an empty target all t are 0.

    A score is a whole number in a range that doubles bound (some 10^5 values for any input), so ranks come from
    counts by score and the order inside one score, and no task gets all documents.
    """
    gain = gains(bucket_totals(docs, longest, buckets, column), bucket_totals(target, longest, buckets, column), buckets)
    scored = weights(docs.select("doc_id", F.col(column).alias("text")), gain, longest).drop("text")
    scored = keep(scored.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")), "scored")
    counts = {r["score"]: r["n"] for r in scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, above, drawn = sum(counts.values()) * percent // 100, 0, []
    wanted = left
    for score in sorted(counts, reverse=True):
        if above >= wanted:
            break
        drawn.append((score, above))
        above += counts[score]
    spark = docs.sparkSession
    starts = spark.createDataFrame(drawn, "score long, above long")
    near = (F.col("n_words") >= least_words) & (F.col("score") >= (drawn[-1][0] if drawn else 1 << 62))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), F.desc("weight"), F.desc("n_features")))
    first = scored.where(near).join(F.broadcast(starts), "score").withColumn("rank", place + F.col("above"))
    first = first.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return first.select(*columns, F.col("rank").cast("long").alias("rank")).unionByName(rest)


def oracle(percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS) -> str:
    """DuckDB SQL for resample() with single words; CRC-32 is worked out word by word."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH steps AS (SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS t FROM (SELECT unnest(range(256)) AS k)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
f AS (SELECT r, unnest(w) AS word FROM d),
b AS (SELECT unnest({words}) AS word FROM benchmark),
v AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM f UNION ALL SELECT word FROM b)),
c AS (SELECT word, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS bucket FROM v, steps),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (word) GROUP BY bucket),
g AS (SELECT k AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({buckets})) AS k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k),
w AS (SELECT r, sum(gain)::BIGINT AS total FROM f JOIN c USING (word) JOIN g USING (bucket) GROUP BY r),
q AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight,
  floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN w USING (r)),
p AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY weight + noise DESC, doc_id NULLS FIRST, weight DESC, n_features DESC) AS place FROM q)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= {least_words} AND place <= (SELECT count(*) FROM q WHERE n_features >= {least_words}) * {percent} // 100 THEN place END AS rank FROM p"""
