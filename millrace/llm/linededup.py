"""Deduplication of repeated line runs with a suffix array over line-ID sequences.

A document is the sequence of its lines' IDs (64-bit hashes). Suffixes are ranked by
distributed prefix doubling: the rank of 2h lines comes from sorting the pairs of ranks of h
lines that follow one another. Ranks are names in sort order, so suffixes that share a
prefix stand together, in an interval of the array in which the longest common prefix is at
least that long. What only occurs once is dropped from each round.

A run is deleted where it has `min_words` words or more and has occurred before. It is enough
to look at its shortest parts of that many words: each line of such a run lies in the shortest
one that starts there, or in the shortest that ends with the run. The interval of such a part is
found from two ranks of a power of two of lines that overlap; all but its first place in the order of
documents are later copies. So doubling ends with the longest of these parts, which has at most
`min_words` lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import clean, discard, keep, needs_integer_id, unused, with_counted

MIN_WORDS = 50
PLACE = ["o", "th"]
#: See common.with_counted.
HOT = 2000


def _placed(docs: DataFrame, order: str = "__order", text: str = "__hash") -> DataFrame:
    """docs with the order of a document (null ids first) and the hash of its text: equal pairs are repeated rows."""
    needs_integer_id(docs)
    return docs.withColumns({order: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), text: F.xxhash64("text")})


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (o, th, i, id, w): the lines with words, numbered from 0, with their IDs and numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, number, ids, words = [], [], [], []
            for n, text in enumerate(b.column("text").to_pylist()):
                own = [x for line in (text or "").encode("utf-8", "replace").split(b"\n") if (x := line.strip())]
                doc += [n] * len(own)
                number += range(len(own))
                ids += map(xxhash.xxh64_intdigest, own)
                words += [len(x.split()) for x in own]
            at = pa.array(np.array(doc, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("__order").take(at), b.column("__hash").take(at), pa.array(number, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(words, pa.int32())],
                names=["o", "th", "i", "id", "w"],
            )

    return _placed(docs).select("__order", "__hash", "text").mapInArrow(run, "o long, th long, i int, id long, w int")


def shortest_parts(lines: DataFrame, min_words: int) -> DataFrame:
    """(o, th, i, w) of repeated lines -> (o, th, i, m): the shortest parts of `min_words` words that start, or end, at a line."""

    def parts(o: np.ndarray, th: np.ndarray, i: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        total = np.r_[0, np.cumsum(w)]
        run = np.cumsum(np.r_[False, (o[1:] != o[:-1]) | (th[1:] != th[:-1]) | (i[1:] != i[:-1] + 1)]) if len(o) else np.zeros(0, np.int64)
        here = np.arange(len(o))
        end = np.searchsorted(total[1:], total[:-1] + min_words)
        ok = end < len(o)
        ok[ok] = run[end[ok]] == run[ok]
        start = np.searchsorted(total, total[1:] - min_words, side="right") - 1
        fine = start >= 0
        fine[fine] = run[start[fine]] == run[fine]
        s, e = np.r_[here[ok], start[fine]], np.r_[end[ok], here[fine]]
        s, e = np.unique(np.stack([s, e]), axis=1) if len(s) else (s, e)
        return pa.RecordBatch.from_arrays([pa.array(o[s]), pa.array(th[s]), pa.array(i[s].astype(np.int32)), pa.array((e - s + 1).astype(np.int32))], names=["o", "th", "i", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for b in batches:
            held = [np.r_[x, np.asarray(b.column(c)).astype(np.int64)] for x, c in zip(held, ("o", "th", "i", "w"), strict=True)]
            other = np.flatnonzero((held[0] != held[0][-1:]) | (held[1] != held[1][-1:]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last document may go on
            if cut:
                yield parts(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        yield parts(*held)

    dealt = lines.select("o", "th", "i", "w").repartition(*PLACE).sortWithinPartitions("o", "th", "i")
    return dealt.mapInArrow(run, "o long, th long, i int, m int")


def _doubled(ranks: DataFrame, h: int) -> DataFrame:
    """(o, th, i, r) of h lines -> the same of 2h lines, where they occur more than once."""
    ahead = F.first("r").over(Window.partitionBy("o", "th").orderBy("i").rangeBetween(h, h))
    pairs = keep(ranks.withColumn("s", ahead).where("s IS NOT NULL"), "pairs")
    order = keep(
        pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("r", "s").select("r", "s", "n", F.monotonically_increasing_id().alias("rank")),
        "order",
    )  # written, since ranks must not be drawn again if an executor is lost
    out = keep(with_counted(pairs, order, ["r", "s"], pairs.count(), HOT).select("o", "th", "i", F.col("rank").alias("r")), "ranks")
    discard(pairs, order)
    return out


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, ...) -> (o, th, lines): for each document with later copies of runs, the numbers of the lines to delete."""
    lines = keep(line_ids(docs), "lines")
    several = keep(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    ranks = keep(with_counted(lines, several, ["id"], lines.count(), HOT).select("o", "th", "i", "w", F.col("id").alias("r")).dropDuplicates(["o", "th", "i"]), "repeated")
    discard(lines, several)
    parts = keep(shortest_parts(ranks, min_words), "parts")
    clean(docs.sparkSession)
    longest = parts.agg(F.max("m")).first()[0] or 0
    kept, found, h = [ranks], [], 1
    ranks = ranks.drop("w")
    while h <= longest:
        own = parts.where(F.col("m").between(h, 2 * h - 1))
        named = own.hint("merge").join(ranks, PLACE + ["i"])
        if h > 1:
            second = ranks.select("o", "th", F.col("i").alias("_j"), F.col("r").alias("s"))
            named = named.withColumn("_j", F.col("i") + F.col("m") - h).join(second.hint("merge"), PLACE + ["_j"]).drop("_j")
        else:
            named = named.withColumn("s", F.lit(0).cast("long"))
        found.append(keep(named.select("o", "th", "i", "m", "r", "s"), "named"))
        if 2 * h <= longest:
            ranks = _doubled(ranks, h)
            discard(kept.pop())  # ranks of h lines aren't read any more
            kept.append(ranks)
        h *= 2
    discard(*kept)
    if not found:
        return keep(parts.groupBy("o", "th").agg(F.collect_set("i").alias("lines")), "later")
    discard(parts)
    named, found = found, reduce(DataFrame.unionByName, found)
    at = F.struct("o", "th", "i")
    first = keep(found.groupBy("m", "r", "s").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    later = with_counted(found, first, ["m", "r", "s"], found.count(), HOT).where(at > F.col("first"))
    # a copy that overlaps the first one goes only where it lies beyond that
    same = (F.col("first.o") == F.col("o")) & (F.col("first.th") == F.col("th"))
    start, end = F.when(same, F.greatest(F.col("i"), F.col("first.i") + F.col("m"))).otherwise(F.col("i")), F.col("i") + F.col("m") - 1
    later = later.select("o", "th", start.alias("start"), end.alias("end")).where("start <= end")
    later = keep(later.select("o", "th", F.explode(F.sequence("start", "end")).alias("line")).groupBy("o", "th").agg(F.array_sort(F.collect_set("line")).alias("lines")), "later")
    discard(first, *named)
    clean(docs.sparkSession)
    return later


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = False, report: str | None = "removed") -> DataFrame:
    """docs with later copies of repeated line runs deleted from text, and a column `report` with the numbers of the deleted lines.

    Lines end at line breaks and are compared without the white space around them; lines without words
    are not counted as lines of a run and stay. The first occurrence, in the order of doc_id
    (nulls first), then of text hash and line, stays; a run may repeat within a document, and of a copy that overlaps the first occurrence
    only what lies beyond it goes.
    A column n_chars follows the text. Rows that are equal in doc_id and text are one document here,
    and stay equal. Null texts stay null. With `drop_emptied`, documents that
    lose all their words are left out. Other columns stay, but for one named as the report; an empty
    table gives an empty one.
    """
    order, text, mark = unused(docs, "__order", "__hash", "__gone")
    gone = later_copies(docs.select("doc_id", "text"), min_words).select(F.col("o").alias(order), F.col("th").alias(text), F.col("lines").alias(mark))
    joined = _placed(docs, order, text).join(gone.hint("merge"), [order, text], "left")  # at every size, see common.with_counted
    joined = joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(mark, F.array().cast("array<int>")).alias(mark))
    place, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed = b.column(mark)
            lengths = np.asarray(removed.value_lengths())
            if not lengths.any():
                yield b
                continue
            texts, stay = b.column(place).to_pylist(), np.ones(b.num_rows, bool)
            for n in np.flatnonzero(lengths).tolist():
                out, i, drop = [], 0, set(removed[n].as_py())
                for line in texts[n].split("\n"):
                    if line.encode("utf-8", "replace").strip():
                        if i not in drop:
                            out.append(line)
                        i += 1
                    else:
                        out.append(line)
                texts[n] = "\n".join(out)
                stay[n] = not drop_emptied or len(drop) < i
            cols = list(b.columns)
            cols[place] = pa.array(texts, b.schema.field(place).type)
            if counted is not None:
                kind = b.schema.field(counted).type
                fresh = [len(t) if d and t is not None else v for t, d, v in zip(texts, lengths.tolist(), cols[counted].to_pylist(), strict=True)]
                cols[counted] = pa.array(fresh, kind)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(stay))

    out = joined.mapInArrow(run, joined.schema)
    return out.drop(mark) if report is None else out.withColumn(report, F.col(mark)).drop(mark)
