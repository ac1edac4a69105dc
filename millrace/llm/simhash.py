"""SimHash near-duplicates, with candidates from Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each padded to a word of
the perfect binary Golay code [23, 12, 7]. Fingerprints that differ in at most four bits
meet in one of two ways:

* some segment has no error: they share that segment itself (three keys);
* else every segment has an error, so two of them have exactly one. For each pair of
  segments a fingerprint is stored under the indices of its nearest codewords, and looked
  up under every pair of indices of codewords within distance four. If y is one bit from x,
  the nearest codeword of x (at distance three or less, as the code is perfect) is within
  four of y. A word has one such codeword, or six if its nearest is three bits off.

Entries are dealt by key as packed arrays, a bucket's entries are sorted and compared there,
and only links that hold (and of those a spanning forest) leave the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keep, shingles, unused, word_chunks
from .components import components

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Entries of one bucket, in expectation; a bucket is one unit of comparison.
BUCKET_ENTRIES = 400_000
#: Groups up to this many entries are compared by shifted copies, larger ones in blocks.
SHIFTS, BLOCK = 32, 2048


def fingerprint(text: str | None, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of whole text: a bit is set if it is set in over half of the shingles' hashes. No words: zero."""
    total, ones = 0, np.zeros(64, np.int64)
    for words in word_chunks(text, k - 1):
        parts = shingles(words, k)
        for i in range(0, len(parts), 65536):
            some = parts[i : i + 65536]
            h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), U64, len(some))
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(some)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, carried columns, fp): one row per row, fp as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, k, seed) for t in b.column("text").to_pylist()), U64, b.num_rows)
            names = ["doc_id", *carry]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fp.view(np.int64))], names=[*names, "fp"])

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in ("doc_id", *carry))
    return docs.select("doc_id", "text", *carry).mapInArrow(run, f"{kinds}, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight four or less, -1 where there are fewer than six; and how many there are.

    The first is the one pattern of weight three or less: taken off a word, it leaves the
    nearest codeword, whose index is its upper twelve bits.
    """
    words = np.zeros(1, np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        words = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(syndrome(words).tolist(), words.tolist(), strict=True):
            if weight < 4 or bin(found[s][0]).count("1") == 3:
                found[s].append(e)
    patterns = np.full((2048, 6), -1, np.int64)
    for s, own in enumerate(found):
        patterns[s, : len(own)] = own
    return patterns, (patterns >= 0).sum(1)


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of fingerprints (uint64): keys with the role in the lowest bit (0 stored, 1 looked up), and row numbers."""
    patterns, _ = golay()
    rows = np.arange(len(fp))
    out_keys, out_rows, near = [], [], []
    for n, (low, width) in enumerate(SEGMENTS):
        part = ((fp >> U64(low)) & U64((1 << width) - 1)).astype(np.int64)
        out_keys.append((n << 24 | part) << 1)
        out_rows.append(rows)
        errors = patterns[syndrome(part)]
        near.append(np.where(errors >= 0, (part[:, None] ^ errors) >> 11, -1))
    for n, (i, j) in enumerate(PAIRS):
        kind = 3 + n << 24
        out_keys.append((kind | near[i][:, 0] << 12 | near[j][:, 0]) << 1)
        out_rows.append(rows)
        both = np.where((near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0), kind | near[i][:, :, None] << 12 | near[j][:, None, :], -1)
        r, *where = np.nonzero(both >= 0)
        out_keys.append(both[r, *where] << 1 | 1)
        out_rows.append(r)
    return np.concatenate(out_keys), np.concatenate(out_rows)


def nearest(fp: np.ndarray) -> np.ndarray:
    """The indices of the codewords nearest to each fingerprint's segments, as one number of 36 bits."""
    patterns, _ = golay()
    out = np.zeros(len(fp), U64)
    for low, width in SEGMENTS:
        part = ((fp >> U64(low)) & U64((1 << width) - 1)).astype(np.int64)
        out = out << U64(12) | ((part ^ patterns[syndrome(part)][:, 0]) >> 11).astype(U64)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between values, as many as connect the same values."""
    if not len(a):
        return a, b
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    both = np.unique(np.minimum(x, y) * len(values) + np.maximum(x, y))
    parent, kept = list(range(len(values))), []
    for link in both.tolist():
        p, q = divmod(link, len(values))
        u, v = p, q
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u != v:
            parent[u] = v
            kept.append((p, q))
    at = np.array(kept, np.int64).reshape(-1, 2)
    return values[at[:, 0]], values[at[:, 1]]


def match(key: np.ndarray, fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most `bits` differing bits between entries of equal key, of which one at least is stored."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    role, key = key & 1, key >> 1
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    found_a, found_b = [], []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        ok = (np.bitwise_count(a ^ b) <= bits) & (a != b)
        found_a.append(a[ok])
        found_b.append(b[ok])
        if sum(map(len, found_a)) > 1_000_000:
            x, y = _forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a[:], found_b[:] = [x], [y]

    small = np.repeat(sizes <= SHIFTS, sizes)
    k, f, stored = key[small], fp[small], role[small] == 0
    for s in range(1, SHIFTS):
        at = np.flatnonzero((k[s:] == k[:-s]) & stored[:-s]) if len(k) > s else np.zeros(0, np.int64)
        if not len(at):
            break
        add(f[at], f[at + s])
    for start, size in zip(starts[sizes > SHIFTS].tolist(), sizes[sizes > SHIFTS].tolist(), strict=True):
        all_ = np.unique(fp[start : start + size])
        own = np.unique(fp[start : start + size][role[start : start + size] == 0])
        for i in range(0, len(own), BLOCK):
            for j in range(0, len(all_), BLOCK):
                a, b = own[i : i + BLOCK], all_[j : j + BLOCK]
                x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= bits)
                add(a[x], b[y])
    if not found_a:
        return np.zeros(0, U64), np.zeros(0, U64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, count: int, bits: int = MAX_BITS) -> DataFrame:
    """(fp) of distinct fingerprints, about `count` of them -> links (a, b) that connect all within `bits` (4 at most) of another."""
    if bits > MAX_BITS:
        raise ValueError(f"the keys find links of at most {MAX_BITS} bits")
    buckets = max(1, -(-count * 91 // BUCKET_ENTRIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            key, row = keys(fps)
            bucket = ((key >> 1) * 0x9E3779B1 & 0xFFFFFFFF) * buckets >> 32
            order = np.argsort(bucket, kind="stable")
            own, at = np.unique(bucket[order], return_index=True)
            k, f = np.split(key[order].astype(np.int32), at[1:]), np.split(fps[row[order]], at[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array([x.tobytes() for x in k], pa.binary()), pa.array([x.tobytes() for x in f], pa.binary())],
                names=["bucket", "keys", "fps"],
            )

    def compare(t: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int32)
        fps = np.frombuffer(b"".join(t.column("fps").to_pylist()), U64)
        a, b = match(key, fps, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return (
        distinct.select("fp")
        .mapInArrow(deal, "bucket int, keys binary, fps binary")
        .groupBy("bucket")
        .applyInArrow(compare, "a long, b long")
    )


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = SEED, bits: int = MAX_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, carried columns, fp, component_id), a row per row.

    component_id is the smallest doc_id that links reach, itself included; links join
    fingerprints that differ in at most `bits` bits, equal ones too. Texts without words
    have fingerprint zero and link like any other. Null texts count as empty. Rows with a null
    doc_id take part, but give no id: a component of such rows alone has a null id. Repeated
    rows stay. Columns other than doc_id, text and the carried are not read. An empty table gives an empty one.
    """
    fps = keep(fingerprints(docs, k, seed, carry), "fps")
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct, distinct.count(), bits), "simhash")
    owned = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = owned.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", *carry, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = SEED, bits: int = MAX_BITS) -> DataFrame:
    """docs without the rows whose doc_id is not their component's smallest; all columns stay.

    Rows are told apart by doc_id and text: of rows that share an id each is judged by its own text,
    repeated rows with the smallest doc_id all stay, and so do rows with a null doc_id.
    """
    h, own, text = unused(docs, "__hash", "__id", "__text")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    gone = near_duplicates(hashed, k, seed, bits, (h,)).where("doc_id <> component_id")
    gone = gone.select(F.col("doc_id").alias(own), F.col(h).alias(text)).distinct()
    return hashed.join(gone, (F.col("doc_id") == F.col(own)) & (F.col(h) == F.col(text)), "left_anti").drop(h)
