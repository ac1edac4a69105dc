"""Language-model scores from a log-frequency Bloom filter of quantised bigram and trigram counts.

Texts are read once and kept as chunks of numbered tokens. Each chunk sends its distinct words,
bigrams and trigrams, with their counts in training rows, to the blocks of a hash space. A block
adds the counts up, enters its n-grams into a filter of its own, and answers every chunk by
probing it; so the filter lies in blocks of bounded size, whatever the corpus, and nothing that grows with
it is broadcast or sent to the driver. The answers go back to their chunks, which score their tokens.

The filter: an n-gram that occurs c times has the largest level whose least count is at most c
(1, 2, 3, 4, 6, 8, 12, 16, ...), and is entered once for every level up to its own. A count is read back by
probing levels upwards until one is missing, as the least of the last level found. Words are counted exactly.

The model: P1(w) is the smoothed share of all tokens (the base score's, one class for all unknown
words). P2(w | v) = m * c(v w) / c(v) + (1 - m) * P1(w), P3(w | u v) = m * c(u v w) / c(u v) + (1 - m) * P2(w | v),
with n-grams' counts at their least and the history u v at its most, so that the probabilities
of all words add up to one at most (but for the filter's false positives). The weight m = (c - 1) / (c - 1 + K)
of a history that occurs c times leaves out its present occurrence, as each training text is in the
counts itself. K is learned for each order from all training rows: with it, the mean weight is
the share of tokens whose n-gram occurs elsewhere too.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keep, mix, word_chunks

ALPHA = 0.1
#: Tokens of a chunk, about; n-grams that a block receives, in expectation; bits of the filter for each entry, and probes.
CHUNK, BLOCK_ITEMS, BITS, PROBES = 1 << 20, 1 << 20, 7.2, 5
#: Hash of the end of a text, which also stands before its first word. No word has a line break.
END = xxhash.xxh64_intdigest(b"\n")
#: Least counts of the levels from 0, and their greatest.
LEAST = np.array(sorted({0, *(1 << i for i in range(52)), *(3 << i for i in range(50))}), np.int64)
MOST = np.r_[LEAST[1:] - 1, LEAST[-1]]
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 10) = 0"


class _Ids(dict):
    """word -> small number, with the words' hashes by number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = array("Q", [END])
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its history and that of its last word."""
    with np.errstate(over="ignore"):
        return mix(first * U64(0x9E3779B97F4A7C15) ^ second)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compress well where they are small or sorted."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind)


def _small(counts: np.ndarray) -> bytes:
    """Counts as a byte each, those of 255 and more behind them."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def _from_small(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data[:n], np.uint8).astype(np.uint32)
    counts[counts == 255] = np.frombuffer(data[n:], np.uint32)
    return counts


CHUNKS = "chunk long, rids array<long>, ids array<{}>, held array<boolean>, sizes array<int>, silent array<int>, before long, words binary, tokens binary"


def chunked(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(rid, doc_id, text, held_out) -> chunks of whole texts, or of parts of long ones.

    A part that goes on with a text starts with the token before it, which is silent: it is neither counted
    nor scored again; `before` is the hash of what stands before the chunk's first token.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        ids, rows, tokens, before = _Ids(), [], [], END

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            rid, doc_id, held, size, silent = zip(*rows)
            cols = [
                pa.array([(part << 32) + serial]), *(pa.array([list(x)], pa.list_(t)) for x, t in ((rid, pa.int64()), (doc_id, schema.field("doc_id").type), (held, pa.bool_()), (size, pa.int32()), (silent, pa.int32()))),
                pa.array(np.array([before], U64).view(np.int64)), pa.array([np.array(ids.hashes, U64).tobytes()], pa.binary()), pa.array([_planes(np.concatenate(tokens).astype(np.uint32))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "rids", "ids", "held", "sizes", "silent", "before", "words", "tokens"])

        n = 0
        for b in batches:
            for rid, doc_id, held, text in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "held_out", "text")), strict=True):
                rows.append([rid, doc_id, held, 0, 0])
                last = [b"\n", b"\n"]
                for words in _parts(text, chunk):
                    if n >= chunk:  # within a text
                        yield flush(b.schema)
                        serial += 1
                        before = xxhash.xxh64_intdigest(last[0])
                        ids, rows, tokens = _Ids(), [[rid, doc_id, held, 1, 1]], []
                        tokens.append(np.array([ids[last[1]]], np.int64))
                        n = 1
                    tokens.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                    rows[-1][3] += len(words)
                    n += len(words)
                    last = [*last, *words[-2:]][-2:]
                if n >= chunk:
                    yield flush(b.schema)
                    serial += 1
                    ids, rows, tokens, before, n = _Ids(), [], [], END, 0
        if rows:
            yield flush(b.schema)

    return docs.mapInArrow(run, CHUNKS.format(kind))


def _parts(text: str | None, size: int) -> Iterator[list[bytes]]:
    """A text's words in lists of bounded size, and the end mark."""
    for words in word_chunks(text):
        for i in range(0, len(words), size):
            yield words[i : i + size]
    yield [b"\n"]


class Grams:
    """A chunk's tokens as numbers of its distinct words, bigrams and trigrams, sorted by hash, with their counts in training rows."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["words"], U64)
        token = _from_planes(row["tokens"], np.uint32).astype(np.int64)
        sizes, silent = np.array(row["sizes"], np.int64), np.array(row["silent"], bool)
        starts = np.cumsum(sizes) - sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.counted = np.ones(len(token), bool)
        self.counted[starts[silent]] = False
        weight = self.counted & ~np.array(row["held"], bool)[self.row]
        w = words[token]
        v = np.r_[U64(0), w[:-1]]
        v[starts] = END
        if len(v) and silent[0]:
            v[0] = np.array([row["before"]], np.int64).view(U64)[0]
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        #: By kind: sorted hashes, and counts.
        self.hashes, self.counts = {1: words[order]}, {1: np.bincount(place[token], weight, len(words)).astype(np.uint32)}
        self.word, self.first = place[token], np.full(len(token), place[0])
        inside = np.ones(len(token), bool)
        inside[starts] = False
        at = np.flatnonzero(inside)  # has a token before it
        self.first[at] = self.word[at - 1]
        both = pair(v, w)
        self.hashes[2], self.second = np.unique(both, return_inverse=True)
        self.counts[2] = np.bincount(self.second, weight, len(self.hashes[2])).astype(np.uint32)
        self.at = at
        self.hashes[3], self.third = np.unique(pair(both[at - 1] ^ U64(0x5851F42D4C957F2D), w[at]), return_inverse=True)
        self.counts[3] = np.bincount(self.third, weight[at], len(self.hashes[3])).astype(np.uint32)


def block_bits(kind: int, bits: int) -> int:
    """Words are fewer than n-grams, so they have fewer blocks."""
    return max(0, bits - 3) if kind == 1 else bits


def _messages(grams: Grams, chunk: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row per kind and block: words with whole hashes, n-grams with 32 bits below those that name the block."""
    for kind in (1, 2, 3):
        hashes, own = grams.hashes[kind], block_bits(kind, bits)
        block = (hashes >> U64(63 - own) >> U64(1)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(block)].tolist() if len(starts) else []
        keys = hashes if kind == 1 else (hashes >> U64(32 - own)).astype(np.uint32)
        if ends:
            parts = [pa.array([pack(x[i:j]) for i, j in zip(starts.tolist(), ends, strict=True)], pa.binary()) for x, pack in ((keys, _planes), (grams.counts[kind], _small))]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(ends), pa.int64()), pa.array([kind] * len(ends), pa.int32()), pa.array(block[starts], pa.int64()), *parts], names=["chunk", "kind", "block", "keys", "counts"])


def _positions(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """Bit places of entries (block-local keys, level) in a filter of `size` bits, one array a probe."""
    with np.errstate(over="ignore"):
        h = mix(keys.astype(U64) ^ (U64(level) << U64(40)))
        low, high = h & U64(0xFFFFFFFF), h >> U64(32) | U64(1)
        for i in range(PROBES):
            yield (((low + U64(i) * high) & U64(0xFFFFFFFF)) * U64(size) >> U64(32)).astype(np.int64)


class Filter:
    """Log-frequency Bloom filter of one block: bits that entries (key, level) set."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: float = BITS):
        levels = np.searchsorted(LEAST, counts, side="right") - 1
        self.bits = np.zeros(max(64, math.ceil(int(levels.sum()) * bits / 8) * 8), bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in _positions(keys[levels >= level], level, len(self.bits)):
                self.bits[at] = True

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by probing upwards until one is missing."""
        out, live, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        while len(live) and level < len(LEAST):
            ok = np.ones(len(live), bool)
            for at in _positions(keys[live], level, len(self.bits)):
                ok &= self.bits[at]
            live = live[ok]
            out[live] = level
            level += 1
        return out


ANSWERS = "kind int, chunk long, block long, answer binary, types long, total long, singles long, level_types binary, level_total binary"


def answered(messages: DataFrame, bits: float = BITS) -> DataFrame:
    """(chunk, kind, block, keys, counts) -> an answer to each message, and a row of statistics for each block (with a null chunk).

    Words are answered with their counts, n-grams with the levels that the block's filter tells.
    """

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        kind, block = key[0].as_py(), key[1].as_py()
        parts = [_from_planes(x.as_py(), U64 if kind == 1 else np.uint32) for x in t.column("keys")]
        sizes = [len(x) for x in parts]
        keys, where = np.unique(np.concatenate(parts), return_inverse=True)
        sent = np.concatenate([_from_small(x.as_py(), n) for x, n in zip(t.column("counts"), sizes, strict=True)])
        counts = np.bincount(where, sent, len(keys)).astype(np.int64)
        del parts, sent
        known = counts > 0
        level = np.searchsorted(LEAST, counts, side="right") - 1
        found = counts if kind == 1 else Filter(keys[known], counts[known], bits).levels(keys)
        answers = [x.tobytes() for x in np.split(found[where], np.cumsum(sizes)[:-1])]
        stats = [int(known.sum()), int(counts.sum()), int((counts == 1).sum()), np.bincount(level[known], minlength=len(LEAST)).tobytes(), np.bincount(level, counts, len(LEAST)).astype(np.int64).tobytes()]
        n = len(sizes)
        cols = [[kind] * (n + 1), [*t.column("chunk").to_pylist(), None], [block] * (n + 1), [*answers, None], *([None] * n + [x] for x in stats)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ANSWERS.split(", ")])

    return messages.groupBy("kind", "block").applyInArrow(merge, ANSWERS)


def learned_weight(singles: int, total: int, level_types: np.ndarray, level_total: np.ndarray) -> float:
    """K of m = (c - 1) / (c - 1 + K), such that its mean over histories, each as often as it occurs, is the share of n-gram tokens that don't occur only once.

    Histories are given by level: how many, and how often all of them occur.
    """
    if not total or not level_total.sum():
        return math.inf
    want = 1 - singles / total
    mean = np.where(level_types > 0, level_total / np.maximum(level_types, 1), 1.0) - 1
    share = level_total / level_total.sum()
    low, high = -20.0, 60.0  # binary logarithms of K
    for _ in range(80):
        middle = (low + high) / 2
        if (share * mean / (mean + 2.0**middle)).sum() > want:
            low = middle
        else:
            high = middle
    return 2.0**low


class Model:
    """What all chunks share: a few numbers. Tokens and types of the training rows, and K of bigrams and trigrams."""

    def __init__(self, tokens: int, types: int, k2: float, k3: float):
        self.tokens, self.types, self.k2, self.k3 = tokens, types, k2, k3

    def base(self, count: np.ndarray) -> np.ndarray:
        """P1 of words by their counts; of an unknown one, the class of all unknown words."""
        return (count + ALPHA) / (self.tokens + ALPHA * (self.types + 1))

    @staticmethod
    def weight(count: np.ndarray, k: float) -> np.ndarray:
        more = np.maximum(count - 1, 0).astype(float)
        return np.zeros(len(more)) if math.isinf(k) else more / (more + k)

    def bigram(self, base: np.ndarray, count: np.ndarray, before: np.ndarray, level: np.ndarray) -> np.ndarray:
        """P2 from P1, the counts of the word and of the one before, and the bigram's level."""
        m = self.weight(before, self.k2)
        return m * np.minimum(LEAST[level], np.minimum(count, before)) / np.maximum(before, 1) + (1 - m) * base

    def trigram(self, lower: np.ndarray, history: np.ndarray, level: np.ndarray) -> np.ndarray:
        """P3 from P2 and the levels of the history and of the trigram."""
        m = self.weight(LEAST[history], self.k3)
        return m * np.minimum(LEAST[level], LEAST[history]) / np.maximum(MOST[history], 1) + (1 - m) * lower


def _sums(grams: Grams, model: Model, answers: dict[int, np.ndarray], rows: int) -> np.ndarray:
    """By row of a chunk: tokens, known tokens, and log10 of the base's and the model's probability."""
    count = answers[1][grams.word]
    base = model.base(count)
    full = model.bigram(base, count, answers[1][grams.first], answers[2][grams.second])
    at = grams.at
    full[at] = model.trigram(full[at], answers[2][grams.second[at - 1]], answers[3][grams.third])
    own = grams.counted
    row = grams.row[own]
    return np.stack([np.bincount(row, x[own], rows) for x in (np.ones(len(count)), count > 0, np.log10(base), np.log10(full))])


def score(docs: DataFrame, held_out: str = HELD_OUT, filter_bits: float = BITS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row.

    The model learns from the rows for which the SQL condition `held_out` is not true (a
    null doc_id: those too); held_out is false for these. Null and empty texts are the end token alone. Repeated rows are
    learned and scored repeatedly. Where nothing is learned, known counts are zero, N and V too. Texts of any length
    are cut into chunks, which changes no score. An empty table gives an empty one.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")).withColumn("rid", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = keep(chunked(rows, chunk), "chunks")
    tokens = chunks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    bits = min(31, max(0, math.ceil(math.log2(max(1, tokens / 4 / BLOCK_ITEMS)))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (row,) = b.slice(i, 1).to_pylist()
                yield from _messages(Grams(row), row["chunk"], bits)

    messages = chunks.select("chunk", "held", "sizes", "silent", "before", "words", "tokens").mapInArrow(send, "chunk long, kind int, block long, keys binary, counts binary")
    answers = keep(answered(messages, filter_bits), "answers")
    stats = {k: (np.zeros(3, np.int64), np.zeros((2, len(LEAST)), np.int64)) for k in (1, 2, 3)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                own = sums.setdefault(r["kind"], [np.zeros(3, np.int64), np.zeros((2, len(LEAST)), np.int64)])
                own[0] += (r["types"], r["total"], r["singles"])
                own[1] += [np.frombuffer(r[c], np.int64) for c in ("level_types", "level_total")]
        for k, (numbers, levels) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([int(x)]) for x in numbers), *(pa.array([x.tobytes()], pa.binary()) for x in levels)], names=["kind", "types", "total", "singles", "level_types", "level_total"])

    parts = answers.where("chunk IS NULL").select("kind", "types", "total", "singles", "level_types", "level_total")
    for r in parts.mapInArrow(add, parts.schema).collect():  # three rows a task, of a fixed size
        stats[r["kind"]][0][:] += (r["types"], r["total"], r["singles"])
        stats[r["kind"]][1][:] += [np.frombuffer(r[c], np.int64) for c in ("level_types", "level_total")]
    k2, k3 = (learned_weight(int(stats[k][0][2]), int(stats[k][0][1]), *stats[k - 1][1].astype(float)) for k in (2, 3))
    model = Model(int(stats[1][0][1]), int(stats[1][0][0]), k2, k3)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        grams, found = Grams(row), {}
        order = np.lexsort((right.column("block").to_numpy(), right.column("kind").to_numpy()))
        kinds = right.column("kind").to_numpy()[order]
        for k in (1, 2, 3):
            own = right.column("answer").take(pa.array(order[kinds == k]))
            found[k] = np.frombuffer(b"".join(x.as_py() for x in own), np.int64 if k == 1 else np.uint8)
        n, known, base, full = _sums(grams, model, found, len(row["rids"]))
        ids = left.schema.field("ids").type.value_type
        return pa.table({"rid": pa.array(row["rids"], pa.int64()), "doc_id": pa.array(row["ids"], ids), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "score": full})

    sums = (
        chunks.groupBy("chunk").cogroup(answers.where("chunk IS NOT NULL").select("chunk", "kind", "block", "answer").groupBy("chunk"))
        .applyInArrow(finish, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    total = sums.groupBy("rid", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
