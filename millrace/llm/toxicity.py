"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text's vector has all of its words (runs of letters, lower-cased): (1 + ln tf) * sqrt(idf), so that the
product of two vectors carries the idf once. Words, and beginnings of words of four to eight
letters, that mark toxic examples weigh more, by the logarithm of their lift; a beginning that
marks nothing has no weight. Document frequencies are counted over all documents. A word that no
example has counts in a text's length as one that no document has.

Examples are the distinct texts of a bounded sample of labelled rows. Features that many examples have
are kept as rows of a matrix and scored for all examples at once. Of the others the index stores, for each
feature and block of examples, the largest weight; with the exact part they bound a block's cosines. A text first visits the blocks of largest
bound, then all whose bound reaches the kth cosine found so far, so its neighbours are exact;
examples that tie with the kth vote too. Votes are weighted by cosine and drawn towards
the rate of toxic examples. Scores are calibrated by a monotone map, learned on votes that each
part of the examples gets from a model of the others.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .common import U64, clean, discard, forget, keep, unused

#: Distinct labelled texts that are learned from at most (those of smallest text hash); all of the corpus is counted and scored.
SAMPLE_ROWS = 2560
NEAREST, REJECT, PULL = 15, 0.7, 0.3
#: A feature marks toxic texts if this many have it, with this likelihood ratio; copies of a line count once.
LEAST_TEXTS, LEAST_RATIO = 3, 15.0
BEGINNINGS, INDEX_BLOCK, FIRST_BLOCKS, FOLDS = (4, 5, 6, 7, 8), 256, 2, 4
#: Features that more than this part of the examples have are scored from full rows; it changes cost, not results.
FULL = 8
#: The score where nothing is labelled.
NO_LABELS = 0.05
#: Parts in which a task sends its document frequencies.
FREQUENCY_PARTS = 16
LETTERS = re.compile(r"[^\W\d_]+")
TRAINING = "pmod(crc32(cast(doc_id as string)), 3) <> 1"


def beginnings(run: str) -> list[str]:
    """Beginnings of a run of letters, marked by a hyphen."""
    return [f"{run[:n]}-" for n in BEGINNINGS if len(run) >= n]


def features(token: str) -> list[str]:
    """Of one white-space-delimited, lower-cased token: its runs of letters, and their beginnings."""
    return [f for run in LETTERS.findall(token) for f in (run, *beginnings(run))]


class Vocabulary:
    """The examples' words by sorted hash, and the beginnings that mark toxic examples; numbered in this order."""

    def __init__(self, hashes: np.ndarray, heads: list[str]):
        self.hashes, self.heads = hashes, {h: len(hashes) + i for i, h in enumerate(heads)}

    def __len__(self) -> int:
        return len(self.hashes) + len(self.heads)

    def word(self, run: str) -> int | None:
        h = xxhash.xxh64_intdigest(run)
        at = int(self.hashes.searchsorted(U64(h)))
        return at if at < len(self.hashes) and int(self.hashes[at]) == h else None


class _Tokens(dict):
    """token -> number, with the numbers of each token's features; words that the vocabulary lacks get numbers beyond it. Emptied when it grows beyond its bound."""

    def __init__(self, vocabulary: Vocabulary, bound: int = 100_000):
        super().__init__()
        self.vocabulary, self.bound = vocabulary, bound
        self.number = dict(zip(vocabulary.hashes.tolist(), range(len(vocabulary.hashes)), strict=True))
        self.starts = {h[: BEGINNINGS[0]] for h in vocabulary.heads}  # what a word with a marked beginning starts with
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.unknown: dict[str, int] = {}
        self.ends, self.flat = array("i", [0]), array("i")  # where a token's features end, token by token

    def __missing__(self, token: str) -> int:
        heads, flat = self.vocabulary.heads, self.flat
        for run in (token,) if token.isalpha() else LETTERS.findall(token):
            n = self.number.get(xxhash.xxh64_intdigest(run))
            flat.append(len(self.vocabulary.hashes) + len(heads) + self.unknown.setdefault(run, len(self.unknown)) if n is None else n)
            if run[: BEGINNINGS[0]] in self.starts:
                flat.extend(heads[h] for h in beginnings(run) if h in heads)
        self.ends.append(len(flat))
        self[token] = number = len(self.ends) - 2
        return number

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's features, ascending, and their occurrences."""
        if len(self) > self.bound:
            self.reset()
        words = (text or "").lower().split()
        token, ends = np.fromiter(map(self.__getitem__, words), np.int32, len(words)), np.frombuffer(self.ends, np.int32)
        at, _ = _spread(ends[token], ends[token + 1])
        f, tf = np.unique(np.frombuffer(self.flat, np.int32)[at] if len(at) else at, return_counts=True)
        return f.astype(np.int64), tf


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that little text is held as Python strings."""
    return (b.slice(i, rows) for b in batches for i in range(0, max(1, b.num_rows), rows))


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of several ranges one behind the other, and of each the number of its range."""
    size = stop - start
    ends = np.cumsum(size, dtype=np.int32)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int32) + np.repeat(start - ends + size, size), np.repeat(np.arange(len(size), dtype=np.int32), size)


class Index:
    """Block-max inverted index of unit vectors of examples: (id, share of toxic labels, features, occurrences)."""

    def __init__(self, examples: list[tuple[int | None, float, np.ndarray, np.ndarray]], weight: np.ndarray, unknown: float):
        self.weight, self.unknown = weight, unknown
        rows = []
        for n, (id_, share, f, tf) in enumerate(examples):
            often = int(f[tf.argmax()]) if len(f) else 0
            f, w = self.vector(f, tf)
            if len(f):
                rows.append(((share == 0, often, n), id_, share, f, w))
        rows.sort(key=lambda r: r[0])  # like beside like (of one label, then of one language), so that blocks' bounds are tight
        self.ids = [r[1] for r in rows]
        self.labels = np.array([r[2] for r in rows], float)
        self.base = float(np.mean([share for _, share, _, _ in examples])) if examples else NO_LABELS
        sizes = [len(r[3]) for r in rows]
        f = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64)
        value = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0)
        example = np.repeat(np.arange(len(rows)), sizes)
        many = np.flatnonzero(np.bincount(f, minlength=len(weight)) * FULL > len(rows))
        #: Of each feature its row in the matrix, or -1; features' weights by example.
        self.row = np.full(len(weight), -1, np.int32)
        self.row[many] = np.arange(len(many))
        self.full = np.zeros((len(many), len(rows)))
        inside = self.row[f] >= 0
        self.full[self.row[f[inside]], example[inside]] = value[inside]
        f, value, example = f[~inside], value[~inside], example[~inside]
        order = np.argsort(f, kind="stable")  # within a feature examples ascend
        self.example, self.value = example[order], value[order]
        f, block = f[order], self.example // INDEX_BLOCK
        #: Where each cell (feature, block) starts among the postings, its block and largest weight; and the cells of each feature.
        first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (block[1:] != block[:-1])]) if len(f) else np.zeros(0, np.int64)
        self.starts = np.r_[first, len(f)].astype(np.int32)
        self.block = block[first]
        self.bound = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(f[first], np.arange(len(weight) + 1)).astype(np.int32)
        self.blocks = -(-len(rows) // INDEX_BLOCK)

    def vector(self, f: np.ndarray, tf: np.ndarray, rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Features of weight above zero and their weights in the unit vector; words beyond the vocabulary, and what `rest` has of them, only lengthen it."""
        known = int(np.searchsorted(f, len(self.weight)))
        w = 1 + np.log(tf)
        w[:known] *= self.weight[f[:known]]
        w[known:] *= self.unknown
        size = math.sqrt(float(w @ w) + rest * self.unknown**2)
        f, w = f[:known], w[:known]
        if not w.all():
            f, w = f[w > 0], w[w > 0]
        return f, w / size if size > 0 else w

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above zero with a unit vector, and all that tie with the kth: numbers and cosines, largest first."""
        if not len(f) or not self.ids:
            return np.zeros(0, np.int64), np.zeros(0)
        row = self.row[f]
        inside = row >= 0
        cosine, edge = w[inside] @ self.full[row[inside]], 0.0
        f, w = f[~inside], w[~inside]
        cell, which = _spread(self.cells[f], self.cells[f + 1])
        block, factor = self.block[cell], w[which]
        bound = np.bincount(block, factor * self.bound[cell], self.blocks) + np.maximum.reduceat(cosine, np.arange(0, len(cosine), INDEX_BLOCK))
        now = np.zeros(self.blocks, bool)
        now[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        open_ = ~now & (bound > 0)
        while now.any():  # the most promising blocks, then all others that may hold an example as near as the kth so far
            take = now[block]
            at, of = _spread(self.starts[cell[take]], self.starts[cell[take] + 1])
            cosine += np.bincount(self.example[at], factor[take][of] * self.value[at], len(cosine))
            if np.count_nonzero(cosine) >= k:
                edge = float(np.partition(cosine, len(cosine) - k)[len(cosine) - k])
            now, open_ = open_ & (bound >= edge - 1e-9), np.zeros(self.blocks, bool)
        n = np.flatnonzero((cosine > 0) & (cosine >= edge - 1e-9))
        n = n[np.lexsort((n, -cosine[n]))]
        return n, cosine[n]

    def vote(self, f: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[float, np.ndarray, np.ndarray]:
        """The neighbours' weighted share of toxic labels, drawn towards the base rate; neighbours and cosines."""
        n, s = self.nearest(f, w, k)
        return float(((s * self.labels[n]).sum() + PULL * self.base) / (s.sum() + PULL)), n, s


def calibration(votes: np.ndarray, shares: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """A monotone map from votes to probabilities by pooling adjacent violators: places and values between which to interpolate."""
    order = np.lexsort((shares, votes))
    pools: list[list[float]] = []  # sum of votes, sum of labels, number
    for v, y in zip(votes[order].tolist(), shares[order].tolist(), strict=True):
        pools.append([v, y, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    v, y, n = np.array(pools).T
    return v / n, np.maximum.accumulate((y + base) / (n + 1))


class Model:
    """What scores a text: vocabulary, index and calibration; it is broadcast, its size bounded by the sample."""

    def __init__(self, vocabulary: Vocabulary, index: Index, places: np.ndarray, values: np.ndarray):
        self.vocabulary, self.index, self.places, self.values = vocabulary, index, places, values

    def calibrated(self, vote: float) -> float:
        return min(1.0, max(0.0, float(np.interp(vote, self.places, self.values)))) if self.index.ids else NO_LABELS

    def scorer(self, k: int = NEAREST):
        """A function from (f, tf, rest) of _vectors to (score, evidence, cosines); equal vectors that come soon after one another are scored once."""
        seen: dict[bytes, tuple[float, list, list]] = {}

        def score(f: bytes, tf: bytes, rest: float) -> tuple[float, list, list]:
            key = xxhash.xxh3_128_digest(b"%d %r " % (len(f), rest) + f + tf)
            if key not in seen:
                own = self.index.vector(np.cumsum(np.frombuffer(f, np.int32)), np.frombuffer(tf, np.int32), rest)
                vote, n, s = self.index.vote(*own, k)
                if len(seen) > 2000:
                    seen.clear()
                seen[key] = self.calibrated(vote), [self.index.ids[i] for i in n.tolist()], s.tolist()
            return seen[key]

        return score


def _judged(b: pa.RecordBatch, judge) -> list[tuple[float, list, list]]:
    return [judge(*x) for x in zip(b.column("f").to_pylist(), b.column("tf").to_pylist(), b.column("rest").to_pylist(), strict=True)]


def _sampled(docs: DataFrame, labels: DataFrame, training: str, sample_rows: int) -> DataFrame:
    """(doc_id, text, share, fold) of distinct labelled texts, those of smallest hash: share of their labelled documents that are toxic."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(training)
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2")).distinct()
    chosen = (
        hashed.join(known, "doc_id").groupBy("h", "h2").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("share"))
        .orderBy("h", "h2").limit(sample_rows)
    )  # bounded, so it can be broadcast
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.where((F.xxhash64("text") == F.col("h")) & (F.xxhash64("text", F.lit(1)) == F.col("h2"))).dropDuplicates(["h", "h2"])
    return texts.repartition(4 * FOLDS, "h").select("h", "doc_id", "text", "share", F.pmod("h2", F.lit(FOLDS)).cast("int").alias("fold"))


def _marks(sample: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Features that may mark toxic examples, and by fold (the last: none) their boosts when that fold is left out."""
    toxic = F.col("share") > 0.5

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, kind in zip(b.column("text").to_pylist(), b.column("kind").to_pylist(), strict=True):
                seen.update({(f, kind) for token in set((text or "").lower().split()) for f in features(token)})
        rows = list(seen.items())
        for i in range(0, len(rows), 100_000):
            part = rows[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for (f, _), _ in part], pa.string()), pa.array([kind for (_, kind), _ in part], pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["feature", "kind", "n"])

    kinds = sample.select("text", (F.col("fold") * 2 + toxic.cast("int")).alias("kind"))
    totals = np.zeros(2 * FOLDS, np.int64)
    for r in kinds.groupBy("kind").count().collect():
        totals[r["kind"]] = r["count"]
    rows = kinds.mapInArrow(count, "feature string, kind int, n long")
    found = rows.groupBy("feature").agg(*(F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(2 * FOLDS)))
    ones, zeros = (sum((F.col(f"n{2 * i + j}") for i in range(1, FOLDS)), F.col(f"n{j}")) for j in (1, 0))
    found = found.where((ones >= LEAST_TEXTS) & (ones * int(totals[0::2].sum()) > zeros * int(totals[1::2].sum())))
    lines = sample.where(toxic).select(F.explode(F.split("text", "\n")).alias("text"), F.lit(0).alias("kind")).distinct()
    lines = lines.mapInArrow(count, "feature string, kind int, n long").groupBy("feature").agg(F.sum("n").alias("lines")).where(F.col("lines") >= LEAST_TEXTS)
    got = found.join(lines, "feature").orderBy("feature").toArrow()  # as many as a bounded sample can hold
    names = got.column("feature").to_pylist()
    by_kind = np.array([got.column(f"n{i}").to_numpy() for i in range(2 * FOLDS)], float).reshape(2 * FOLDS, -1)
    distinct = got.column("lines").to_numpy().astype(float)
    boosts = []
    for fold in [*range(FOLDS), None]:
        rest = [i for i in range(FOLDS) if i != fold]
        x, y = np.minimum(by_kind[[2 * i + 1 for i in rest]].sum(0), distinct), by_kind[[2 * i for i in rest]].sum(0)
        n1, n0 = (float(totals[[2 * i + j for i in rest]].sum()) for j in (1, 0))
        boosts.append(boost(x, y, n1, n0))
    use = np.flatnonzero(np.max(boosts, axis=0) > 0) if names else np.zeros(0, np.int64)
    return [names[i] for i in use.tolist()], [b[use] for b in boosts]


def boost(x: np.ndarray, y: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Logarithm of the lift of features that x of n1 toxic and y of n0 clean examples have; 0 where that may be chance."""
    if not n1 or not len(x):
        return np.zeros(len(x))
    share = (x + y) / (n1 + n0)

    def term(seen: np.ndarray, want: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(want, 1e-9)), 0.0)

    ratio = 2 * (term(x, share * n1) + term(y, share * n0) + term(n1 - x, (1 - share) * n1) + term(n0 - y, (1 - share) * n0))
    lift = (x / n1) / ((y + 0.5) / (n0 + 1))
    return np.where((x >= LEAST_TEXTS) & (ratio >= LEAST_RATIO) & (lift > 1), np.log(np.maximum(lift, 1)), 0.0)


def _vectors(docs: DataFrame, vocabulary: Vocabulary, columns: list[str]) -> DataFrame:
    """(text, ...) -> (row, f, tf, rest): these columns of each row, the steps between the ascending numbers of its text's features in the vocabulary, their occurrences, and what its other words add to the square of its length.

    Written once, so that counting and scoring don't cut texts again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tokens = _Tokens(vocabulary)
        for b in _slices(batches):
            f, tf, rest = [], [], []
            for text in (b.column("row").field("text") if "text" in columns else b.column("text")).to_pylist():
                own, times = tokens.counts(text)
                known = int(np.searchsorted(own, len(vocabulary)))
                f.append(np.diff(own[:known], prepend=0).astype(np.int32).tobytes())  # steps compress well
                tf.append(times[:known].astype(np.int32).tobytes())
                rest.append(float(np.square(1 + np.log(times[known:])).sum()))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(f, pa.binary()), pa.array(tf, pa.binary()), pa.array(rest, pa.float64())], names=["row", "f", "tf", "rest"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *([] if "text" in columns else ["text"]))
    kind = StructType([rows.schema["row"], StructField("f", BinaryType()), StructField("tf", BinaryType()), StructField("rest", DoubleType())])
    return keep(rows.mapInArrow(run, kind), "vectors", "zstd")


def _frequencies(vectors: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """By feature the number of documents that have it, and the number of documents."""
    part = -(-(size + 1) // FREQUENCY_PARTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(part * FREQUENCY_PARTS, np.int64)
        for b in _slices(batches):
            f = [np.cumsum(np.frombuffer(x, np.int32)) for x in b.column("f").to_pylist()]
            df[:size] += np.bincount(np.concatenate(f) if f else np.zeros(0, np.int64), minlength=size)
            df[-1] += b.num_rows
        if df[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(FREQUENCY_PARTS), pa.int32()), pa.array([x.tobytes() for x in df.reshape(FREQUENCY_PARTS, part)], pa.binary())], names=["part", "df"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for x in t.column("df"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"part": t.column("part")[:1], "df": pa.array([total.tobytes()], pa.binary())})

    parts = vectors.select("f").mapInArrow(count, "part int, df binary").groupBy("part").applyInArrow(add, "part int, df binary").orderBy("part").toArrow()
    df = np.frombuffer(b"".join(parts.column("df").to_pylist()), np.int64) if len(parts) else np.zeros(part * FREQUENCY_PARTS, np.int64)
    return df[:size], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, training: str = TRAINING, sample_rows: int = SAMPLE_ROWS, k: int = NEAREST) -> Model:
    """A model from the labelled rows of `docs` for which the SQL condition `training` holds."""
    return _learned(docs, labels, training, sample_rows, k, ["doc_id"])[0]


def _learned(docs: DataFrame, labels: DataFrame, training: str, sample_rows: int, k: int, columns: list[str]) -> tuple[Model, DataFrame]:
    """The model, and the vectors of docs with these columns of theirs.

    A doc_id labelled more than once is toxic if any of its labels says so; texts that several
    documents have count once, with their share of toxic labels.
    """
    spark = docs.sparkSession
    sample = keep(_sampled(docs, labels, training, sample_rows), "sample")
    marked, boosts = _marks(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update(xxhash.xxh64_intdigest(run) for token in set(text.lower().split()) for run in LETTERS.findall(token))
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen, U64, len(seen)).view(np.int64))], names=["word"])

    words = sample.select("text").mapInArrow(hashed, "word long").distinct().toArrow().column("word").to_numpy().astype(np.int64).view(U64)
    vocabulary = Vocabulary(np.sort(words), [m for m in marked if m.endswith("-")])
    place = np.array([vocabulary.heads[m] if m.endswith("-") else vocabulary.word(m) for m in marked], np.int64)
    vectors = _vectors(docs, vocabulary, columns)
    df, total = _frequencies(vectors, len(vocabulary))
    idf = np.sqrt(np.log((1 + total) / (1 + df)) + 1e-3)
    unknown = math.sqrt(math.log(1 + total) + 1e-3)

    def weights(fold: int) -> np.ndarray:
        w = (np.arange(len(vocabulary)) < len(vocabulary.hashes)).astype(float)
        w[place] = np.where(boosts[fold] > 0, boosts[fold] + (place < len(vocabulary.hashes)), w[place])
        return w * idf

    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(vocabulary)
        for b in batches:
            own = [tokens.counts(t) for t in b.column("text").to_pylist()]
            binary = [pa.array([x.astype(np.int32).tobytes() for x in part], pa.binary()) for part in (zip(*own) if own else ((), ()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "doc_id", "share", "fold")), *binary], names=["h", "doc_id", "share", "fold", "f", "tf"])

    rows = sample.mapInArrow(count, f"h long, doc_id {kind}, share double, fold int, f binary, tf binary").orderBy("h").toArrow().to_pydict()
    examples = [(d, s, *(np.frombuffer(x, np.int32).astype(np.int64) for x in own)) for d, s, *own in zip(rows["doc_id"], rows["share"], rows["f"], rows["tf"], strict=True)]
    folds = np.array(rows["fold"], np.int64)
    shared = spark.sparkContext.broadcast((examples, folds, [weights(i) for i in range(FOLDS)], unknown))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, folds, weights, unknown = shared.value
        for b in batches:
            for fold in b.column("id").to_pylist():
                index = Index([e for e, n in zip(examples, folds.tolist(), strict=True) if n != fold], weights[fold], unknown)
                own = [examples[i] for i in np.flatnonzero(folds == fold).tolist()]
                votes = [index.vote(*index.vector(f, tf), k)[0] for _, _, f, tf in own]
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array([e[1] for e in own], pa.float64())], names=["vote", "share"])

    got = spark.range(0, FOLDS, 1, FOLDS).mapInArrow(cross, "vote double, share double").toArrow() if examples else pa.table({"vote": pa.array([], pa.float64()), "share": pa.array([], pa.float64())})
    shared.unpersist()
    discard(sample)
    index = Index(examples, weights(FOLDS), unknown)
    return Model(vocabulary, index, *calibration(got.column("vote").to_numpy(), got.column("share").to_numpy(), index.base)), vectors


def score(docs: DataFrame, labels: DataFrame, training: str = TRAINING, sample_rows: int = SAMPLE_ROWS, k: int = NEAREST, reject: float = REJECT) -> DataFrame:
    """(doc_id, text, ...), (doc_id, toxic, ...) -> (doc_id, score, predicted, evidence, cosines), a row per row.

    The score is between 0 and 1 and depends on the text alone: equal texts have equal scores, and other
    doc_ids change no score as long as the same texts are learned from. Null, empty and other texts that
    share no word with an example have the calibrated base rate. evidence has the doc_ids of the nearest
    examples, the nearest first (of a text that several documents have, the smallest). With no labels
    every score is 0.05. Null labels and labels of unknown documents are left out; repeated rows are scored each;
    an empty table gives an empty one.
    """
    model, vectors = _learned(docs, labels, training, sample_rows, k, ["doc_id"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value.scorer(k)
        for b in _slices(batches):
            got = _judged(b, judge)
            s = np.array([x[0] for x in got])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= reject).astype(np.int32)), pa.array([x[1] for x in got], pa.list_(b.schema.field("doc_id").type)), pa.array([x[2] for x in got], pa.list_(pa.float64()))],
                names=["doc_id", "score", "predicted", "evidence", "cosines"],
            )

    return vectors.select("row.doc_id", "f", "tf", "rest").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<{kind}>, cosines array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, training: str = TRAINING, sample_rows: int = SAMPLE_ROWS, k: int = NEAREST, reject: float = REJECT) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay. Rows are judged by their texts, so repeated ids are judged each."""
    (h,) = unused(docs, "__hash")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    model, vectors = _learned(hashed, labels, training, sample_rows, k, [h])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value.scorer(k)
        for b in _slices(batches):
            toxic = pa.array([x[0] >= reject for x in _judged(b, judge)], pa.bool_())
            yield b.select(["row"]).filter(toxic)

    gone = keep(vectors.mapInArrow(run, vectors.select("row").schema).select("row.*").distinct(), "toxic")
    discard(vectors)  # only the rejected texts' hashes stay
    sent.unpersist()
    clean(docs.sparkSession)
    return hashed.join(gone.hint("merge"), h, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
