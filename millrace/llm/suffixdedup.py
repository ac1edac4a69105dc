"""Removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

A window is a string of `length` bytes. Each window has an anchor, the place of its 32-byte gram with the smallest hash
(leftmost of equals): equal windows have their anchors in the same place. Windows that follow one another and share an anchor form a block,
so that a text has about one block in 35 bytes, and only blocks are sorted, not every suffix:

1. blocks meet by the gram of their anchor. Equal blocks: all but the first are later copies as a whole;
2. different blocks with the same gram are fetched from the texts, and what follows and (backwards) what precedes the anchor is sorted deep-shallow
   (`deepshallow`). Windows with j bytes before the anchor are equal where both orders have them in one class, at depths length - j and j;
   the first in document order stays, and the marks of a block span what its later windows cover.

A gram that has more than a 2,000th of all blocks, or more than `LARGE` different ones, is not sorted in one task: its windows meet one by one under
128-bit hashes instead, which an aggregate combines before it shuffles. Blocks are compared by 64-bit hashes
within a 64-bit hash of their gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean, forget, keep, mix, needs_integer_id, with_counted
from .deepshallow import classes, deep_shallow

LENGTH, GRAM = 100, 32
#: Bytes that are hashed at once; the low bits of a hash are given to the place, so that of equal hashes the leftmost is the smallest.
CHUNK = 1 << 20
PLACE = np.uint64(2 * CHUNK - 1)
#: More different blocks of one gram than these are compared window by window.
LARGE = 50_000
#: A gram with more than this part of all blocks is hot; HOT_HERE is the part of a task's chunk from which it counts there.
HOT, HOT_HERE = 2000, 4000
#: Grams with fewer blocks are never hot.
FEW = 5_000
#: Rows of whole groups that are sorted at once.
SORTED = 50_000
SPAN, BITS = 127, 7  # a block's windows, and the place of its anchor, are numbers below length
MANY = 1 << 40
REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _ordered(docs: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """docs as (o, th, text): the doc_id, null first, and the hash of the text where an id has several texts; else th is 0."""
    needs_integer_id(docs)
    placed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"), F.xxhash64(column).alias("th"), F.col(column).alias("text"))
    several = placed.groupBy("o").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").limit(1).count() > 0
    return (placed if several else placed.withColumn("th", F.lit(0).cast("long"))), several


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on, by doubling; the last 31 places have none."""
    with np.errstate(over="ignore"):
        h, by, n = data.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15), 1
        while n < GRAM:
            h = h[:-n] * by + h[n:]
            by, n = by * by, 2 * n
    return mix(h)


def _blocks(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor, gram's hash) of each block in texts that lie one after the other; ends: where each ends."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = _hashes(np.frombuffer(data, np.uint8))
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, n = length - GRAM + 1, 1
    while 2 * n <= wide:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    if wide > n:
        least = np.minimum(least[: len(least) - (wide - n)], least[wide - n :])
    anchor = (least & PLACE).astype(np.int64)  # of each window
    text = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= ends[text])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    a, t = anchor[inside], text[inside]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    return t[new], inside[new], inside[np.r_[new[1:], len(inside)] - 1], a[new], h[a[new]]


def _chunks(texts: list[bytes | None], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, numbers, offsets): texts, or overlapping pieces of long ones, put together to chunks of bounded size."""
    parts, number, offset, size = [], [], [], 0

    def out():
        return b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(number), np.array(offset)

    for k, text in enumerate(texts):
        for start in range(0, max(1, len(text or b"") - length + 1), CHUNK // 2):
            piece = (text or b"")[start : start + CHUNK // 2 + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > CHUNK:
                yield out()
                parts, number, offset, size = [], [], [], 0
            parts.append(piece)
            number.append(k)
            offset.append(start)
            size += len(piece)
    if parts:
        yield out()


def _hot_grams(placed: DataFrame, length: int, hot: int, here: int, few: int) -> np.ndarray:
    """Hashes of all grams with more than `few` blocks and one in `hot` of all, and of some with less, 2 * hot at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n = [], 0

        def counted():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            often = c * here > n
            v, c = np.r_[v[often], np.uint64(0)], np.r_[c[often], 0]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(np.r_[np.zeros(len(v) - 1, np.int64), n])], names=["h", "n", "blocks"])

        for b in batches:
            for data, ends, _, _ in _chunks(b.column(0).cast(pa.binary()).to_pylist(), length):
                held.append(_blocks(data, ends, length)[4])
                n += len(held[-1])
                if n >= 500_000:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    found = keep(placed.select("text").mapInArrow(run, "h long, n long, blocks long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks")), "hot")
    total = found.agg(F.sum("blocks")).first()[0] or 0
    return np.sort(np.array([r["h"] for r in found.where((F.col("n") > few) & (F.col("n") * 2 * hot > total)).collect()], np.int64))


def _distinct(*cols: np.ndarray) -> list[np.ndarray]:
    """Sorted columns without rows that equal the one before: rows that repeat a document are that document."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return [c[new] for c in cols]


def _packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First window, number of windows after it and place of the anchor as one integer that sorts by the first."""
    return (first << (2 * BITS)) | ((last - first) << BITS) | (anchor - first)


def _all_blocks(placed: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """(part, h, b, o, th, p, whole): the blocks; of blocks that are equal within a task only the first by (o, th, p) is open, the others are `whole` copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n = [], 0

        def sent():
            h, b, o, th, p = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((p, th, o, b, h))
            h, b, o, th, p = _distinct(h[by], b[by], o[by], th[by], p[by])
            whole = np.r_[False, (h[1:] == h[:-1]) & (b[1:] == b[:-1])]
            part = np.where(np.isin(h, hot), b, h)  # hot grams are dealt out by block, copies by place
            part[whole] = mix((o + p).view(np.uint64)[whole]).view(np.int64)
            cols = (part, h, b, o, th, p)
            for k in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in (*cols, whole)], names=["part", "h", "b", "o", "th", "p", "whole"])

        for batch in batches:
            o, th = np.asarray(batch.column("o")), np.asarray(batch.column("th"))
            for data, ends, number, offset in _chunks(batch.column("text").cast(pa.binary()).to_pylist(), length):
                t, first, last, anchor, h = _blocks(data, ends, length)
                begun = np.r_[0, ends[:-1]][t] - offset[t]
                hashed = xxhash.xxh64_intdigest
                b = np.fromiter((hashed(data[x:y]) for x, y in zip(first.tolist(), (last + length).tolist())), np.uint64, len(first)).view(np.int64)
                held.append((h.view(np.int64), b, o[number[t]], th[number[t]], _packed(first - begun, last - begun, anchor - begun)))
                n += len(h)
                if n >= 500_000:
                    yield from sent()
                    held, n = [], 0
        if n:
            yield from sent()

    return placed.mapInArrow(run, "part long, h long, b long, o long, th long, p long, whole boolean")


def _met(blocks: DataFrame, hot: np.ndarray) -> DataFrame:
    """Blocks by gram -> (h, n, o, th, p): n is 0 for a later copy of an equal block, else the number of different blocks of its gram, 2 or more; MANY for hot grams."""
    names = ["h", "n", "o", "th", "p"]

    def judged(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, b, o, th, p = _distinct(*map(np.concatenate, zip(*held)))
        new_h = np.r_[True, h[1:] != h[:-1]]
        first = np.r_[True, b[1:] != b[:-1]] | new_h
        group = np.cumsum(new_h) - 1
        n = np.bincount(group[first], minlength=group[-1] + 1)[group]
        n[np.isin(h, hot)] = MANY
        out = ~first | (n > 1)
        return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (h, np.where(first, n, 0), o, th, p)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            whole = np.asarray(batch.column("whole"))
            cols = [np.asarray(batch.column(c)) for c in ("h", "b", "o", "th", "p")]
            h, _, o, th, p = (x[whole] for x in cols)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, np.zeros_like(h), o, th, p)], names=names)
            cols = [x[~whole] for x in cols]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            cut = int(edge[-1]) + 1 if len(edge) else 0  # the last gram may go on
            if cut or held and held[-1][0][-1] != cols[0][0]:
                yield judged([*held, [x[:cut] for x in cols]])
                held, cols = [], [x[cut:] for x in cols]
            held.append(cols)
        if held:
            yield judged(held)

    return blocks.repartition("part").sortWithinPartitions("h", "b", "o", "th", "p").mapInArrow(run, "h long, n long, o long, th long, p long")


def _fetched(placed: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(h, n, o, th, p) -> the same with the bytes of the block, once for each row that repeats the document."""
    marked = open_.groupBy("o", "th").agg(F.collect_list(F.struct("h", "n", "p")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            texts, own = b.column("text").cast(pa.binary()).to_pylist(), b.column("own")
            at, flat = np.repeat(np.arange(b.num_rows), np.asarray(own.value_lengths())), own.flatten()
            p = np.asarray(flat.field("p"))
            first = p >> (2 * BITS)
            stop = first + ((p >> BITS) & SPAN) + length
            data = [texts[k][x:y] for k, x, y in zip(at.tolist(), first.tolist(), stop.tolist())]
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("n"), b.column("o").take(at), b.column("th").take(at), flat.field("p"), pa.array(data, pa.binary())], names=["h", "n", "o", "th", "p", "data"])

    return placed.join(marked, ["o", "th"]).select("o", "th", "text", "own").mapInArrow(run, "h long, n long, o long, th long, p long, data binary")


def _sorted_marks(fetched: DataFrame, length: int) -> DataFrame:
    """Different blocks that share a gram -> (o, th, s, e): what their windows cover that some block before has as well."""

    def marks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        h, o, th, p = (rows[c].to_numpy() for c in ("h", "o", "th", "p"))
        data = rows["data"].to_pylist()
        place, after = p & SPAN, (p >> BITS) & SPAN
        at = (p >> (2 * BITS)) + place
        by = np.lexsort((at, th, o, h))
        once = np.ones(len(by), bool)
        once[1:] = np.any([c[by][1:] != c[by][:-1] for c in (h, o, th, p)], axis=0)  # a repeated row is the same document
        by = by[once]
        h, o, th, at, place, after = (c[by] for c in (h, o, th, at, place, after))
        cuts, listed = place.tolist(), by.tolist()
        right = deep_shallow([data[k][c:] for k, c in zip(listed, cuts)], h)
        left = deep_shallow([data[k][:c][::-1] for k, c in zip(listed, cuts)], h)
        most, least = np.full(len(h), -1), np.full(len(h), length)
        for j in range(length - GRAM + 1):  # windows with j bytes before the anchor
            has = np.flatnonzero((j <= place) & (j >= place - after))
            if len(has) < 2:
                continue
            key = classes(*right, length - j)[has] * (len(h) + 1) + classes(*left, j)[has]
            later = np.ones(len(has), bool)
            later[np.unique(key, return_index=True)[1]] = False  # rows lie in document order: the first of a class stays
            hit = has[later]
            most[hit], least[hit] = np.maximum(most[hit], j), np.minimum(least[hit], j)
        hit = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (o[hit], th[hit], (at - most)[hit], (at - least)[hit] + length)], names=["o", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n = [], 0
        for b in batches:
            if n >= SORTED:  # whole grams only
                h = np.asarray(b.column("h"))
                edge = np.flatnonzero(h != held[-1].column("h")[-1].as_py())
                cut = int(edge[0]) if len(edge) else b.num_rows
                held.append(b.slice(0, cut))
                if cut < b.num_rows:
                    yield marks(held)
                    held, n, b = [], 0, b.slice(cut)
                else:
                    continue
            held.append(b)
            n += b.num_rows
        if held:
            yield marks(held)

    return fetched.repartition("h").sortWithinPartitions("h").mapInArrow(run, "o long, th long, s long, e long")


def _windows(fetched: DataFrame, length: int) -> DataFrame:
    """(o, th, s, e) of every window of the given blocks that some window before equals; nothing is grouped but equal windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.asarray(b.column("p")) >> (2 * BITS)
            for k in range(0, b.num_rows, 500):
                at, start, hashes = [], [], []
                for i, data in enumerate(b.column("data").slice(k, 500).to_pylist(), k):
                    n = len(data) - length + 1
                    at += [i] * n
                    start += range(int(p[i]), int(p[i]) + n)
                    hashes += [xxhash.xxh3_128_digest(data[x : x + length]) for x in range(n)]
                w = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), b.column("o").take(take), b.column("th").take(take), pa.array(start, pa.int64())], names=["w1", "w2", "o", "th", "s"])

    rows = keep(fetched.mapInArrow(run, "w1 long, w2 long, o long, th long, s long"), "windows")
    place = F.struct("o", "th", "s")
    several = keep(rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "several")
    later = with_counted(rows, several, ["w1", "w2"], rows.count()).where(place > F.col("first"))
    return later.select("o", "th", "s", (F.col("s") + length).alias("e"))


def later_copies(placed: DataFrame, length: int = LENGTH, large: int = LARGE, hot: int = HOT, here: int = HOT_HERE, few: int = FEW) -> DataFrame:
    """(o, th, text) -> (o, th, s, e): byte ranges, which may overlap, whose union is all that is covered by windows that start earlier as well."""
    if not GRAM <= length <= SPAN:
        raise ValueError(f"length must lie between {GRAM} and {SPAN}")
    grams = _hot_grams(placed, length, hot, here, few)
    found = keep(_met(_all_blocks(placed, length, grams), grams), "met")
    clean(placed.sparkSession)
    fetched = keep(_fetched(placed, found.where("n > 0"), length), "fetched")
    clean(placed.sparkSession)
    first = F.shiftright("p", 2 * BITS)
    copies = found.where("n = 0").select("o", "th", first.alias("s"), (first + F.shiftright("p", BITS).bitwiseAND(F.lit(SPAN)) + length).alias("e"))
    out = copies.unionByName(_sorted_marks(fetched.where(F.col("n") <= large), length))
    wide = fetched.where(F.col("n") > large)
    return keep(out if wide.isEmpty() else out.unionByName(_windows(wide, length)), "marks")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, column: str = "text", large: int = LARGE, hot: int = HOT, here: int = HOT_HERE, few: int = FEW) -> DataFrame:
    """docs with `n_bytes`, `removed` (array of (start, end): maximal runs of removed bytes) and `kept` (binary: what is left).

    Texts are UTF-8 bytes (null: empty), and matches never cross documents. A byte goes if a string of `length` bytes that covers it
    also starts earlier: in a document with a smaller doc_id (null is the smallest; of equal ids the smaller text hash), or earlier in the
    same one. All is judged on the texts as given; overlaps count. Rows equal in doc_id and text are one document, and stay equal.
    Texts shorter than `length` stay. Other columns stay, but for those that have one of the three new names; an empty table gives an empty one.
    Which hash class is met in which task changes nothing in the result.
    """
    placed, several = _ordered(docs, column)
    marks = later_copies(placed, length, large, hot, here, few).groupBy("o", "th").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    clean(docs.sparkSession)
    th = F.xxhash64(column) if several else F.lit(0).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("o"), th.alias("th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = rows.join(marks, ["o", "th"], "left").select("doc", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            sizes, removed, kept = [], [], []
            for text, own in zip(b.column("doc").field(column).cast(pa.binary()).to_pylist(), b.column("marks"), strict=True):
                text, gone = text or b"", []
                if own.is_valid:
                    s, e = (own.values.field(c).to_numpy() for c in ("s", "e"))
                    by = np.argsort(s)
                    s, e = s[by], np.maximum.accumulate(e[by])
                    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    gone = list(zip(s[new].tolist(), e[np.r_[new[1:], len(s)] - 1].tolist()))
                edges = [0, *(x for pair in gone for x in pair), len(text)]
                sizes.append(len(text))
                removed.append([{"start": x, "end": y} for x, y in gone])
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if gone else text)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, REMOVED), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "removed", "kept"])

    out = rows.mapInArrow(run, rows.select("doc").withColumns({"n_bytes": F.lit(0).cast("long"), "removed": F.lit(None).cast("array<struct<start:bigint,end:bigint>>"), "kept": F.lit(None).cast("binary")}).schema)
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_bytes", "removed", "kept")]
    return out.select(*own, "n_bytes", "removed", "kept")
