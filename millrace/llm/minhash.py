"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

One hash of each shingle picks a bin and competes for its minimum there. An empty bin
borrows from the first full bin of its own random order of bins, the same for all documents.
Of each bin's value (scrambled with the bin's number, so that borrowed values don't repeat
their bits) the low-order bits are packed. Two fingerprints agree by chance in a share
1 / 2^bits of the bins, which the likeness takes off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, forget, mix, needs_integer_id, remembered, word_chunks

SHINGLE_WORDS, BINS, BITS = 5, 512, 4
#: Rows that one task holds in turn, about, and the most tasks; bounds of ranges are looked up 64 at a time.
RANGE_ROWS, MAX_RANGES, STEP = 4000, 10_000, 64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U64)
_WORDS = WordHashes()
remembered("words", _WORDS.clear)


def shingle_hashes(words: list[bytes], k: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, U64)
    h, k = _WORDS.of(words), min(k, len(words))
    total = np.full(len(words) - k + 1, k, U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total += mix(h[i : len(h) - k + 1 + i] * FACTORS[i % len(FACTORS)] + U64(i))
    return mix(total)


@lru_cache(2)
def _borrow(bins: int) -> np.ndarray:
    """By bin: the place of every other bin in its order for borrowing."""
    draw = mix(np.arange(bins * bins, dtype=U64) + U64(1 << 40)).reshape(bins, bins)
    return np.argsort(np.argsort(draw, axis=1), axis=1).astype(np.uint16)


@lru_cache(2)
def _salts(bins: int) -> np.ndarray:
    return mix(np.arange(bins, dtype=U64) + U64(1 << 50))


def sketch(text: str | None, k: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """The bins' low-order bits of whole text, one value a bin; None if it has no words. Bins: a power of two."""
    shift = U64(64 - bins.bit_length() + 1)
    least = np.full(bins, ~U64(0))
    full = np.zeros(bins, bool)
    for words in word_chunks(text, k - 1):
        h = np.sort(shingle_hashes(words, k))
        at = (h >> shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        least[at[first]] = np.minimum(least[at[first]], h[first])
        full[at[first]] = True
    if not full.any():
        return None
    return (mix(densified(least, full) ^ _salts(bins)) & U64((1 << bits) - 1)).astype(np.uint8)


def densified(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Bins' values, those of empty bins borrowed from the first full bin of their order. One bin at least is full."""
    if not full.all():
        own, empty = np.flatnonzero(full), np.flatnonzero(~full)
        least[empty] = least[own[_borrow(len(full))[np.ix_(empty, own)].argmin(1)]]
    return least


def least_of(items: np.ndarray, bins: int) -> np.ndarray:
    """The bins' values of a set of sorted distinct shingle hashes, one at least."""
    at = (items >> U64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    least, full = np.zeros(bins, U64), np.zeros(bins, bool)
    least[at[first]], full[at[first]] = items[first], True
    return densified(least, full)


def pack(values: np.ndarray | None, bits: int = BITS) -> str:
    """Hex digits of the bins' bits in order; an empty string for no words."""
    if values is None:
        return ""
    return np.packbits(np.unpackbits(values[:, None], axis=1)[:, 8 - bits :]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard likeness of the shingle sets, without what low-order bits share by chance; two empty texts are alike."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 1 / (1 << bits)
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint), a row per row; a null text counts as empty, equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("words")
        for b in batches:
            out = [pack(sketch(t, k, bins, bits), bits) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id: (bucket, extra, doc_id, text), sorted within partitions; a range ends with the next one's first row.

    The last range ends with the first row of all. Ranges' bounds and first ids (10,000 at
    most) are all that reaches the driver; each text moves once. Beyond 10,000 ranges they grow, but a range is
    sorted (with spilling) and read row by row, so a task's memory does not. Null ids come first; rows
    with equal ids are in the order of their texts. doc_id must be an integer.
    """
    needs_integer_id(docs)
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"))
    n = min(MAX_RANGES, max(1, ids.count() // RANGE_ROWS))
    bounds = sorted(set(ids.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 10 * MAX_RANGES)).first()[0] or [])) if n > 1 else []
    where = F.lit(0)
    if bounds:
        coarse = F.array(*(F.lit(x).cast("long") for x in bounds[STEP - 1 :: STEP] or [(1 << 63) - 1]))
        step = F.size(F.filter(coarse, lambda x: x < F.col("o"))) * STEP
        where = step + F.size(F.filter(F.slice(F.array(*(F.lit(x).cast("long") for x in bounds)), step + 1, STEP), lambda x: x < F.col("o")))
    firsts = sorted(ids.select("o", where.alias("bucket")).groupBy("bucket").agg(F.min("o").alias("o")).collect())
    before = spark.createDataFrame([(o, firsts[i - 1][0]) for i, (_, o) in enumerate(firsts)], "o long, before int")
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o")).withColumn("bucket", where)
    deal = F.explode(F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("extra")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))))))
    return (
        rows.join(F.broadcast(before), "o", "left")
        .select("doc_id", "text", "o", deal.alias("at"))
        .select("at.bucket", "at.extra", "doc_id", "o", "text")
        .repartition(max(1, len(firsts)), "bucket")
        .sortWithinPartitions("bucket", "extra", "o", "text")
        .drop("o")
    )


def edited_likeness(docs: DataFrame, k: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row.

    The edited text has its last half replaced by the next document's first characters; the
    last document is followed by the first, a lone one by itself. A null text counts as empty;
    a text without words has an empty fingerprint, alike (1) to another and to no other text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        for b in batches:
            out = []
            for bucket, extra, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
                text = text or ""
                if extra and (held is None or held[0] != bucket):
                    continue
                own = sketch(text, k, bins, bits)
                if held is not None:
                    _, id_, prior, values = held
                    half = len(prior) // 2
                    edited = prior[: len(prior) - half] + text[:half]
                    other = sketch(edited, k, bins, bits)
                    out.append((id_, len(prior), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), pack(values, bits), pack(other, bits), likeness(values, other, bits), likeness(values, own, bits)))
                held = None if extra else (bucket, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema, strict=True)], schema=schema)

    return with_neighbours(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
