"""Mergeable quantile summaries: an exponential hierarchy of fixed blocks, merged and pruned with decreasing local errors.

A summary of n rows is a list of points (x, lo, up): `lo` is a lower bound of the number of rows up to x, `up` an upper bound of the rank of
the first row at x (rows below, plus one). Bounds of several summaries add up at each x, so merging is exact about them; pruning keeps points
near evenly spaced ranks and widens the gap between neighbours, by one rank in `points`. The error of a summary is half that gap.

Within a task the rows of a group go into blocks of fixed size, which are sorted and exact; two summaries of one level merge to one of the next, pruned
with a local error that shrinks as levels rise, so that the errors of all levels have a bounded sum whatever the number of rows (`BLOCKS`). What the tasks
have goes on by a tree of merges with bounded fan-in, pruned the same way (`TREE`), so that no task holds more than `FAN` summaries of a hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean, forget, keep

BLOCK, FAN = 512, 32
#: Error that the levels of blocks, the levels of the tree and the last pruning may add, as parts of all rows.
BLOCKS, TREE = 0.004, 0.004
#: A summary that is kept has at least LEAST points, or all there are, and at most MOST.
LEAST, MOST = 10, 1000
#: Bits of x that one level of exact counting takes.
DIGIT = 13

Points = tuple[np.ndarray, np.ndarray, np.ndarray]


def local_points(error: float, level: int) -> int:
    """Points to keep at a level, so that the errors 1 / (2 points) of all levels add up to `error`: shares of 6 / (pi (level + 1))^2."""
    return int(np.ceil(np.pi**2 * (level + 1) ** 2 / (12 * error))) + 2


def exact(x: np.ndarray) -> Points:
    """The summary of sorted rows that loses nothing."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[first], np.r_[first[1:], len(x)], first + 1


def merged(parts: list[Points]) -> Points:
    """The summary of all rows of some summaries."""
    if len(parts) == 1:
        return parts[0]
    x = np.unique(np.concatenate([p[0] for p in parts]))
    lo, up = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    for v, low, high in parts:
        lo += np.r_[0, low][np.searchsorted(v, x, side="right")]
        up += np.r_[high - 1, low[-1]][np.searchsorted(v, x, side="left")]
    return x, lo, up


def pruned(points: Points, most: int, least: int = LEAST) -> Points:
    """At most `most` points: the smallest and largest x, those nearest to evenly spaced ranks, and others up to `least` in all."""
    x, lo, up = points
    if len(x) <= most:
        return points
    n, parts, end = int(lo[-1]), max(1, most - 2), len(x) - 1
    targets = np.arange(1, parts + 1) * n // parts
    wrong = lambda k: np.maximum(np.maximum(up[k] - targets, targets - lo[k]), 0)
    # the last point that begins within the summary's error of the rank errs no more than that; one of those around the rank may err less
    error = int(np.max(up[1:] - lo[:-1]) + 1) // 2
    best = np.searchsorted(up, targets + error, side="right") - 1
    near = np.searchsorted(up, targets, side="right") - 1
    for k in (near, near + 1):
        k = np.clip(k, 0, end)
        best = np.where(wrong(k) < wrong(best), k, best)
    chosen = np.unique(np.r_[0, best, end])
    if len(chosen) < least:
        rest = np.setdiff1d(np.arange(len(x)), chosen)[: least - len(chosen)]
        chosen = np.sort(np.r_[chosen, rest])
    return x[chosen], lo[chosen], up[chosen]


class Hierarchy:
    """Rows of one group: a block that fills up, and above it one summary a level at most."""

    def __init__(self, error: float = BLOCKS, block: int = BLOCK):
        self.error, self.block = error, block
        self.rows: list[np.ndarray] = []
        self.n = 0
        self.levels: list[Points | None] = []

    def add(self, x: np.ndarray) -> None:
        self.rows.append(x)
        self.n += len(x)
        if self.n >= self.block:
            x = np.concatenate(self.rows)
            whole = len(x) - len(x) % self.block
            for k in range(0, whole, self.block):
                self._raise(exact(np.sort(x[k : k + self.block])))
            self.rows, self.n = [x[whole:]], len(x) - whole

    def _raise(self, summary: Points) -> None:
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append(None)
            if self.levels[level] is None:
                self.levels[level] = summary
                return
            summary = pruned(merged([self.levels[level], summary]), local_points(self.error, level))
            self.levels[level] = None

    def summary(self) -> Points:
        parts = [p for p in self.levels if p is not None]
        if self.n:
            parts.append(exact(np.sort(np.concatenate(self.rows))))
        return merged(parts)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a new key begins, in a batch that is sorted by the keys; keys are not null."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in keys:
        column = batch.column(c)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _exact_runs(x: np.ndarray, c: np.ndarray, run: np.ndarray, runs: int) -> tuple[np.ndarray, Points]:
    """Exact summaries of many groups at once: values x, each of c rows, of groups numbered in `run` -> (points of each group, all points)."""
    order = np.lexsort((x, run))
    x, c, run = x[order], c[order], run[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (run[1:] != run[:-1])])
    own = run[first]
    upto = np.cumsum(c)[np.r_[first[1:], len(x)] - 1]
    before = np.r_[0, upto[:-1]]
    base = np.r_[0, np.cumsum(np.bincount(run, weights=c, minlength=runs).astype(np.int64))][own]
    return np.bincount(own, minlength=runs), (x[first], upto - base, before - base + 1)


def _rows_of(keys: list[pa.Array], sizes: np.ndarray, points: Points, names: list[str]) -> pa.RecordBatch:
    """A row a summary: its keys and three arrays."""
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    return pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(offsets, pa.array(p, pa.int64())) for p in points)], names=[*names, "x", "lo", "up"])


def _listed(keys: list[list[pa.Array]], points: list[Points], names: list[str]) -> pa.RecordBatch:
    return _rows_of([pa.concat_arrays(k) for k in keys], np.array([len(p[0]) for p in points]), tuple(np.concatenate(c) for c in zip(*points)), names)


def _schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), *(f"{c} array<bigint>" for c in ("x", "lo", "up"))])


def _local(rows: DataFrame, keys: list[str], error: float, block: int, most: int) -> DataFrame:
    """(keys, x) sorted by keys within partitions -> a summary of each group in each partition.

    Groups that lie within a batch and fit into a block are exact, and made all at once; larger ones go through a hierarchy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        open_, key = None, None  # the group that may go on in the next batch

        def closed():
            return _listed([[k] for k in key], [pruned(open_.summary(), most)], keys)

        for b in batches:
            if not b.num_rows:
                continue
            starts, x = _starts(b, keys), b.column("x").to_numpy()
            ends = np.r_[starts[1:], b.num_rows]
            first = 0
            if open_ is not None:
                if all(k[0] == b.column(c)[0] for k, c in zip(key, keys)):
                    open_.add(x[: ends[0]])
                    first = 1
                if not first or len(starts) > 1:
                    yield closed()
                    open_ = None
            last = len(starts) - 1
            if first <= last:
                small = np.arange(first, last)
                small = small[(ends - starts)[small] <= block]
                if len(small):
                    sizes = (ends - starts)[small]
                    at = np.repeat(starts[small] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                    own, points = _exact_runs(x[at], np.ones(len(at), np.int64), np.repeat(np.arange(len(small)), sizes), len(small))
                    yield _rows_of([b.column(c).take(pa.array(starts[small])) for c in keys], own, points, keys)
                for k in [*np.setdiff1d(np.arange(first, last), small).tolist(), last]:
                    open_, key = Hierarchy(error, block), [b.column(c).slice(int(starts[k]), 1) for c in keys]
                    open_.add(x[starts[k] : ends[k]])
                    if k < last:
                        yield closed()
        if open_ is not None:
            yield closed()

    return rows.mapInArrow(run, _schema(rows, keys))


def _merge(summaries_: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The summaries of each key merged, and pruned to `most` points; a key has a bounded number of them."""
    dealt = summaries_.select(*keys, "x", "lo", "up").repartition(*keys).sortWithinPartitions(F.xxhash64(*keys), *keys)

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        b = rows.combine_chunks().to_batches()[0]
        starts = _starts(b, keys)
        x, lo, up = (b.column(c).flatten().to_numpy() for c in ("x", "lo", "up"))
        sizes = b.column("x").value_lengths().to_numpy()
        edges = np.r_[0, np.cumsum(sizes)]
        c = lo - up + 1
        loose = np.add.reduceat(c, edges[:-1]) != lo[edges[1:] - 1]  # its points don't stand for all its rows
        number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, b.num_rows]))  # of each summary's key
        mixed = np.zeros(len(starts), bool)
        np.logical_or.at(mixed, number[loose], True)
        of = np.repeat(number, sizes)
        take = ~mixed[of]
        tight = np.flatnonzero(~mixed)
        if len(tight):
            renumbered = np.cumsum(~mixed) - 1
            own, points = _exact_runs(x[take], c[take], renumbered[of[take]], len(tight))
            fits = own <= most
            inside = np.repeat(fits, own)
            if fits.any():
                yield _rows_of([b.column(k).take(pa.array(starts[tight[fits]])) for k in keys], own[fits], tuple(p[inside] for p in points), keys)
            cuts = np.r_[0, np.cumsum(own)]
            if not fits.all():
                wide = np.flatnonzero(~fits)
                yield _listed([[b.column(k).slice(int(starts[tight[i]]), 1) for i in wide] for k in keys], [pruned(tuple(p[cuts[i] : cuts[i + 1]] for p in points), most) for i in wide], keys)
        rest = np.flatnonzero(mixed)
        if len(rest):
            stops = np.r_[starts[1:], b.num_rows]
            parts = [[tuple(p[edges[r] : edges[r + 1]] for p in (x, lo, up)) for r in range(starts[k], stops[k])] for k in rest]
            yield _listed([[b.column(k).slice(int(starts[i]), 1) for i in rest] for k in keys], [pruned(merged(p), most) for p in parts], keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            cut = int(_starts(b, keys)[-1])  # the last key may go on
            if cut or held and any(held[-1].column(c)[-1] != b.column(c)[0] for c in keys):
                held.append(b.slice(0, cut))
                yield from done(pa.Table.from_batches([h for h in held if h.num_rows]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, _schema(summaries_, keys))


def summaries(rows: DataFrame, keys: list[str], column: str = "x", most: int = MOST // 2, blocks: float = BLOCKS, tree: float = TREE, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(keys ..., x long) -> (keys ..., x, lo, up): a row with the points of a summary for each group.

    Ranks asked of it err by at most blocks + tree + 1 / (most - 2) of a group's rows, whatever their order and number.
    Keys and x must not be null. An empty table gives an empty one.
    """
    # sorted by a hash, which is a number; groups whose hashes are equal may come in pieces, which are merged like those of different tasks
    own = rows.select(*keys, F.col(column).cast("long").alias("x")).sortWithinPartitions(F.xxhash64(*keys))
    parts = keep(_local(own, keys, blocks, block, most).withColumn("_number", F.spark_partition_id()), "parts")
    last, level = parts.agg(F.max("_number")).first()[0] or 0, 0
    while last >= fan:
        parts = parts.withColumn("_node", F.floor(F.col("_number") / fan).cast("int"))
        parts = keep(_merge(parts, [*keys, "_node"], local_points(tree, level)).withColumnRenamed("_node", "_number"), "tree")
        last, level = last // fan, level + 1
    return _merge(parts, keys, most)


def merge_groups(points: DataFrame, keys: list[str], most: int = MOST // 2) -> DataFrame:
    """The summaries of each key as one, made of their points only; a key must have a bounded number of them."""
    return _merge(points, keys, most)


class Ranks:
    """Exact counts of x by group, as digits: `table[k]` has a row for each prefix of DIGIT * k bits less that occurs, how many rows it has, and how many of its siblings lie before.

    Siblings differ in DIGIT bits, so that no window has more than 8,192 rows, however many a group has.
    """

    def __init__(self, counts: DataFrame, keys: list[str]):
        """counts: (keys ..., x, c), one row a value."""
        self.keys, self.tables = keys[::-1], []  # sorts begin with the key that tells most groups apart
        spread = counts.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
        a, b, k = spread["a"] or 0, spread["b"] or 0, 0
        level = counts.select(*keys, F.col("x").alias("p"), "c")
        while True:
            top = (b >> DIGIT * k) - (a >> DIGIT * k) < 1 << DIGIT
            own = Window.partitionBy(*self.keys, "above").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
            level = level.withColumn("above", F.lit(0).cast("long") if top else F.shiftright("p", DIGIT))
            self.tables.append(keep(level.withColumn("before", F.coalesce(F.sum("c").over(own), F.lit(0).cast("long"))), f"digits{k}"))
            if top:
                break
            level, k = self.tables[-1].groupBy(*keys, F.col("above").alias("p")).agg(F.sum("c").alias("c")), k + 1

    def at(self, targets: DataFrame) -> DataFrame:
        """(keys ..., target, ...) -> the same with exact_x: the target-th smallest x."""
        columns = targets.columns
        found = targets.withColumns({"_left": F.col("target"), "above": F.lit(0).cast("long")})
        for table in reversed(self.tables):
            digits = table.select(*self.keys, "p", "above", "before", F.col("c").alias("_c"))
            found = found.join(digits, [*self.keys, "above"]).where("_left > before AND _left <= before + _c")
            found = found.select(*columns, (F.col("_left") - F.col("before")).alias("_left"), F.col("p").alias("above"))
        return found.select(*columns, F.col("above").alias("exact_x"))

    def around(self, asked: DataFrame, column: str) -> DataFrame:
        """(keys ..., column, ...) -> the same with n_below and n_upto: rows with smaller x, and with x up to it; the x must occur in its group."""
        columns = asked.columns
        out = asked.withColumn("n_below", F.lit(0).cast("long"))
        for k, table in enumerate(self.tables):
            digits = table.select(*self.keys, F.col("p").alias("_p"), "before", F.col("c").alias("_c"))
            joined = out.withColumn("_p", F.shiftright(column, DIGIT * k)).join(digits, [*self.keys, "_p"])
            kept = F.col("_c") if k == 0 else F.col("_at")
            out = joined.select(*columns, (F.col("n_below") + F.col("before")).alias("n_below"), kept.alias("_at"))
        return out.select(*columns, "n_below", (F.col("n_below") + F.col("_at")).alias("n_upto"))


def _asked(points: DataFrame, keys: list[str], parts: int, least: int) -> DataFrame:
    """Summaries -> (keys, i, n, target, points, answer) for i = 1 .. parts - 1, of groups with `least` rows or more: the point that may err least, of equals the smaller."""
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, lo, up = (b.column(c).flatten().to_numpy() for c in ("x", "lo", "up"))
            sizes = b.column("x").value_lengths().to_numpy()
            edges = np.r_[0, np.cumsum(sizes)]
            n = lo[edges[1:] - 1]
            asked = np.flatnonzero(n >= least)
            answers, targets = [], []
            for k in asked.tolist():
                a, z = edges[k], edges[k + 1]
                t = np.array([[-(-i * int(n[k]) // parts)] for i in range(1, parts)])
                answers.append(x[a + np.argmin(np.maximum(up[a:z] - t, t - lo[a:z]), axis=1)])
                targets.append(t[:, 0])
            if answers:
                at = pa.array(np.repeat(asked, parts - 1))
                cols = [np.tile(np.arange(1, parts, dtype=np.int32), len(asked)), np.repeat(n[asked], parts - 1), np.concatenate(targets), np.repeat(sizes[asked], parts - 1).astype(np.int64), np.concatenate(answers)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), *map(pa.array, cols)], names=[*keys, "i", "n", "target", "points", "answer"])

    return points.select(*keys, "x", "lo", "up").mapInArrow(run, f"{kinds}, i int, n long, target long, points long, answer long")


def report(rows: DataFrame, keys: list[str], batches: int = 4, parts: int = 4, least: int = 20, most: int = MOST // 2) -> DataFrame:
    """(keys ..., batch, x) -> summaries of every batch of a group, and of the whole (batch -1) merged from these alone, held against exact ranks.

    Returns keys, batch, i, n, target, exact_x, points, answer, n_below, n_upto for groups of `least` rows or more.
    """
    rows = keep(rows, "rows")
    clean(rows.sparkSession)
    every = [*keys, "batch"]
    single = keep(summaries(rows, every, most=most), "batches")
    whole = merge_groups(single, keys, most).withColumn("batch", F.lit(-1))
    points = keep(single.unionByName(whole), "points")
    counts = keep(rows.groupBy(*every, "x").agg(F.count(F.lit(1)).alias("c")), "counts")
    clean(rows.sparkSession)
    both = counts.unionByName(counts.groupBy(*keys, "x").agg(F.sum("c").alias("c")).withColumn("batch", F.lit(-1)))
    ranks = Ranks(both, every)
    clean(rows.sparkSession)
    asked = keep(_asked(points, every, parts, least), "asked")
    return ranks.around(ranks.at(asked), "answer")


def streams(clicks: DataFrame, lines: DataFrame, items: DataFrame, batches: int = 4) -> DataFrame:
    """(stream, grp, batch, x): `value` of clicks, one row a click_id, and `price` of every line with its item; rows without item, grp or money are left out.

    Of rows that share a click_id the one with the smallest (value, client_id) counts, nulls last; rows without an id are rows of their own, in the batch of the empty text. Money that is
    not finite counts as lacking.
    """
    money = F.when(F.abs("money") < float("inf"), F.col("money"))  # neither NaN nor infinite
    once = clicks.where("click_id IS NOT NULL").groupBy("click_id").agg(F.min(F.struct(F.col("value").isNull(), F.col("value"), F.col("client_id").isNull(), F.col("client_id"))).alias("r"))
    once = once.select(F.lit("value").alias("stream"), F.col("r.client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), F.col("r.value").alias("money"))
    alone = clicks.where("click_id IS NULL").select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), F.col("click_id").alias("id"), F.col("value").alias("money"))
    priced = lines.select("item_id", "vendor_id").join(items.select("item_id", "brand", "price"), "item_id")
    priced = priced.select(F.lit("price").alias("stream"), F.col("brand").cast("string").alias("grp"), F.col("vendor_id").alias("id"), F.col("price").alias("money"))
    rows = once.unionByName(alone).unionByName(priced)
    rows = rows.withColumn("money", money.cast("double")).where("grp IS NOT NULL AND money IS NOT NULL")
    batch: Column = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(batches)).cast("int")
    rows = rows.withColumn("batch", batch)
    return rows.select("stream", "grp", "batch", (F.floor(F.lit(100.0) * F.col("money") + F.lit(0.5)) + F.lit(1000).cast("long") * F.col("batch")).cast("long").alias("x"))


def shop_report(clicks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """The report over the two streams with the error of each answer in ranks, and whether it keeps the bound of a fiftieth of the rows."""
    got = report(streams(clicks, lines, items), ["stream", "grp"])
    wrong = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return got.select("stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", wrong.alias("rank_error")).withColumn("within", F.expr("1000 * rank_error <= 20 * n"))
