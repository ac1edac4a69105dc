"""Mergeable quantile summaries: bounds of points, error of answers, exact ranks, and the query against plain Python."""

import collections
import math
import random
import zlib

import __spark_entry__ as entry
import numpy as np
import pytest
from millrace.llm import quantiles as q

from .. import oracle


def holds(points, rows):
    """Bounds of every point are true of the rows, and the ends are kept."""
    x, lo, up = points
    rows = np.sort(rows)
    assert np.all(np.diff(x) > 0) and x[0] == rows[0] and x[-1] == rows[-1] and lo[-1] == len(rows)
    assert np.all(lo <= np.searchsorted(rows, x, side="right")) and np.all(up >= np.searchsorted(rows, x, side="left") + 1)


def worst(points, n):
    _, lo, up = points
    t = np.arange(1, n + 1)[:, None]
    return int(np.maximum(np.maximum(up - t, t - lo), 0).min(axis=1).max())


@pytest.mark.parametrize("kind", ["even", "few", "heavy", "sorted"])
def test_hierarchy_keeps_its_bound(kind):
    rng = np.random.default_rng(3)
    n = 6000
    rows = {"even": rng.integers(-(10**6), 10**6, n), "few": rng.integers(0, 7, n), "heavy": np.where(rng.random(n) < 0.97, 5, rng.integers(0, 10**6, n)), "sorted": np.arange(n)}[kind]
    h = q.Hierarchy(0.02, 64)
    for part in np.array_split(rows, 37):
        h.add(part)
    points = h.summary()
    holds(points, rows)
    assert worst(points, n) <= 0.02 * n + 1
    small = q.pruned(points, 40)
    holds(small, rows)
    assert len(small[0]) <= 40 and len(small[0]) >= min(10, len(set(rows.tolist()))) and worst(small, n) <= (0.02 + 0.5 / 38) * n + 2
    several = q.merged([q.exact(np.sort(rows[:100])), points, q.exact(np.sort(rows[50:700]))])
    holds(several, np.r_[rows[:100], rows, rows[50:700]])


def test_local_errors_add_up():
    assert sum(0.5 / (q.local_points(0.004, k) - 2) for k in range(10_000)) <= 0.004
    assert q.local_points(0.004, 3) > q.local_points(0.004, 2) > q.local_points(0.004, 0)


def plain_ranks(rows, parts=4):
    out = {}
    for key, x in rows.items():
        x = np.sort(np.array(x, np.int64))
        for i in range(1, parts):
            t = -(-i * len(x) // parts)
            out[(*key, i)] = (x, t, int(x[t - 1]))
    return out


def check(got, want, least=20):
    seen = set()
    for r in got:
        key = tuple(r[c] for c in ("grp", "batch", "i"))
        x, t, exact = want[key]
        seen.add(key)
        assert (r["n"], r["target"], r["exact_x"]) == (len(x), t, exact)
        assert (r["n_below"], r["n_upto"]) == (int((x < r["answer"]).sum()), int((x <= r["answer"]).sum()))
        assert r["n_upto"] > r["n_below"] and x[0] <= r["answer"] <= x[-1]
        assert max(0, r["n_below"] + 1 - t, t - r["n_upto"]) <= 0.02 * len(x)
        assert min(10, len(set(x.tolist()))) <= r["points"] <= min(len(x), 1000)
    assert seen == {k for k, v in want.items() if len(v[0]) >= least}


def test_report_equals_plain_ranks(spark, monkeypatch):
    monkeypatch.setattr(q, "DIGIT", 9)
    rng = random.Random(4)
    rows, groups = [], collections.defaultdict(list)
    for k in range(30_000):
        g = "hot" if k % 3 == 0 else rng.choice("abcdefgh") * rng.randint(1, 3)
        x = rng.choice([7, 7, rng.randint(-(1 << 40), 1 << 40), rng.randint(0, 5000)])
        b = rng.randint(0, 3)
        rows.append((g, b, x))
        groups[g, b].append(x)
        groups[g, -1].append(x)
    rows += [("few", 0, k) for k in range(19)] + [("just", 1, k) for k in range(20)]
    groups["few", 0] = groups["few", -1] = list(range(19))
    groups["just", 1] = groups["just", -1] = list(range(20))
    df = spark.createDataFrame(rows, "grp string, batch int, x long").repartition(9)
    got = q.report(df, ["grp"]).collect()
    check(got, plain_ranks(groups))
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["i"]):
        by[r["grp"], r["batch"]].append(r["answer"])
    assert all(v == sorted(v) for v in by.values())


def test_tree_of_merges(spark):
    rng = random.Random(5)
    rows = [("g", rng.randint(0, 10**6)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(16)
    (row,) = q.summaries(df, ["g"], most=60, blocks=0.01, tree=0.01, block=32, fan=2).collect()
    got = tuple(np.array(row[c]) for c in ("x", "lo", "up"))
    holds(got, np.array([x for _, x in rows]))
    assert len(row["x"]) <= 60 and worst(got, len(rows)) <= (0.02 + 1 / 58) * len(rows) + 3


def test_streams_drop_what_lacks_money_and_repeats(spark):
    clicks = spark.createDataFrame([(1, 5, 1.005, "x"), (1, 5, 1.005, "x"), (2, None, 3.0, "x"), (3, 6, None, "x"), (None, 6, 2.5, "x"), (None, 6, 2.5, "x"), (4, 6, float("nan"), "x"), (5, 6, float("inf"), "x"), (6, 7, -2.345, "x")], "click_id long, client_id long, value double, brand string")
    lines = spark.createDataFrame([(10, 1), (10, 1), (11, None), (12, 3), (None, 4), (13, 1)], "item_id long, vendor_id long")
    items = spark.createDataFrame([(10, "A", 2.0, 9), (11, "A", 1.0, 9), (13, None, 1.0, 9), (14, "B", 1.0, 9)], "item_id long, brand string, price double, vendor_id long")
    got = sorted(map(tuple, q.streams(clicks, lines, items).collect()))
    batch = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4
    x = lambda m, i: math.floor(100 * m + 0.5) + 1000 * batch(i)
    want = [("value", "5", batch(1), x(1.005, 1)), ("value", "7", batch(6), x(-2.345, 6)), *[("value", "6", batch(None), x(2.5, None))] * 2, *[("price", "A", batch(1), x(2.0, 1))] * 2, ("price", "A", batch(None), x(1.0, None))]
    assert got == sorted(want)
    assert q.shop_report(clicks.limit(0), lines.limit(0), items.limit(0)).collect() == []


def test_query_equals_plain_python(spark):
    read = lambda t: spark.read.parquet(f"{oracle.DATA}/{t}.parquet").collect()
    groups = collections.defaultdict(list)
    batch = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4

    def add(stream, grp, i, money):
        if grp is not None and money is not None:
            for b in (batch(i), -1):
                groups[(stream, str(grp), b)].append(math.floor(100 * money + 0.5) + 1000 * batch(i))

    for r in {r["click_id"]: r for r in read("clicks")}.values():
        add("value", r["client_id"], r["click_id"], r["value"])
    items = {r["item_id"]: r for r in read("items")}
    for r in read("sale_lines"):
        if r["item_id"] in items:
            add("price", items[r["item_id"]]["brand"], r["vendor_id"], items[r["item_id"]]["price"])
    df = entry.queries()["op13_quantiles"](spark, oracle.DATA)
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("stream", "grp", "batch", "i", "n", "rank_error", "within")] == ["string", "string", "int", "int", "bigint", "bigint", "boolean"]
    got = df.collect()
    assert all(r["within"] for r in got) and len({r["stream"] for r in got}) == 2
    for s in ("value", "price"):
        check([r for r in got if r["stream"] == s], plain_ranks({k[1:]: v for k, v in groups.items() if k[0] == s}))
