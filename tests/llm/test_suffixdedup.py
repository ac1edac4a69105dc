"""Byte-level deduplication and its sorter against brute force."""

import hashlib
import os
import random

import __spark_entry__ as entry
import numpy as np
import pytest
from millrace.llm import suffixdedup
from millrace.llm.deepshallow import classes, deep_shallow

from .. import oracle


def plain(rows, length):
    """(doc_id, text) -> {(doc_id, text): removed byte numbers}; equal rows are one document."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    docs = sorted({(i, t) for i, t in rows}, key=repr)
    hashes = SparkSession.active().createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "k int, t string").select("k", F.xxhash64("t").alias("h")).collect()
    order = {r["k"]: r["h"] for r in hashes}
    several = {i for i, _ in docs if sum(j == i for j, _ in docs) > 1}
    by = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, order[k] if several else 0))
    seen, out = set(), {}
    for k in by:
        data = (docs[k][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out[docs[k]] = gone
    return out


def check(spark, rows, length=100, parts=3, **settings):
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, o string, marks int").repartition(parts)
    want = plain(rows, length)
    got = suffixdedup.dedup_bytes(docs, length, **settings).collect()
    assert len(got) == len(rows) and all(r["o"] == "k" and r["marks"] == 7 for r in got)
    for r in got:
        data, gone = (r["text"] or "").encode(), want[(r["doc_id"], r["text"])]
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2).tolist()
        assert [[x["start"], x["end"]] for x in r["removed"]] == edges
        assert bytes(r["kept"]) == bytes(np.frombuffer(data, np.uint8)[~gone]) and r["n_bytes"] == len(data)
    return sum(int(g.sum()) for g in want.values())


def words(rng, n, size=40):
    return " ".join(rng.choice(VOCABULARY[:size]) for _ in range(n))


VOCABULARY = ["".join(random.Random(k).choice("abcdefghij") for _ in range(2 + k % 9)) for k in range(400)]


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(14, 60)) for _ in range(6)]
    rows = []
    for k in range(60):
        text = words(rng, rng.randint(0, 80), 400)
        if k % 3 == 0:
            text += rng.choice(passages) + words(rng, 20, 400)
        if k % 5 == 0 and rows:
            other = rng.choice(rows)[1] or ""
            cut = rng.randint(0, max(0, len(other) - 1)) if other else 0
            text = other[:cut] + "ü" * (k % 2) + other[cut + 1 :] if k % 10 else other
        rows.append((k * 3 % 61, text))
    rows += [(None, passages[0]), (None, None), (200, ""), (201, "ab" * 300), (202, "ab" * 70 + "c"), (203, "\0" * 150 + "x"), (204, "\0" * 130), rows[3], rows[3], (7, passages[1] + "!"), (205, "x" * 99)]
    return rows


@pytest.mark.parametrize("seed, settings", [(1, {}), (2, {"large": 1}), (3, {"hot": 40, "here": 80, "few": 1}), (4, {"large": 2})])
def test_equals_brute_force(spark, seed, settings):
    assert check(spark, corpus(seed), **settings) > 1000


def test_long_texts_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 1 << 9)
    monkeypatch.setattr(suffixdedup, "PLACE", np.uint64((1 << 10) - 1))
    monkeypatch.setattr(suffixdedup, "SORTED", 10)
    rng = random.Random(5)
    long = words(rng, 1200, 400)
    assert check(spark, [*corpus(6), (300, long), (301, words(rng, 9) + long[777:4000] + words(rng, 5)), (302, long[100:])]) > 3000


def test_other_lengths(spark):
    check(spark, corpus(7)[:40], length=32)
    check(spark, corpus(8)[:40], length=127)
    with pytest.raises(ValueError):
        suffixdedup.later_copies(None, 31)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    got = suffixdedup.dedup_bytes(none)
    assert got.collect() == [] and got.columns == ["doc_id", "text", "n_bytes", "removed", "kept"]
    with pytest.raises(TypeError):
        suffixdedup.dedup_bytes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_sorter_equals_sorted():
    rng = random.Random(9)
    for _ in range(30):
        base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 90))) for _ in range(8)]
        strings = [rng.choice(base)[: rng.randint(0, 90)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 3))) for _ in range(120)]
        groups = np.array([rng.randint(0, 3) for _ in strings])
        order, shared = deep_shallow(strings, groups)
        assert sorted(order.tolist()) == list(range(len(strings)))
        for d in (0, 1, 5, 31, 32, 33, 60):
            got, want = classes(order, shared, d), {}
            for k, s in enumerate(strings):
                if len(s) >= d:
                    want.setdefault((groups[k], s[:d]), set()).add(int(got[k]))
            assert all(len(x) == 1 for x in want.values()) and len(set().union(*want.values())) == len(want)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id", "text").collect()
    want = plain([tuple(r) for r in docs], 100)
    got = {r["doc_id"]: r for r in entry.queries()["op12_suffixdedup"](spark, oracle.DATA).collect()}
    assert len(got) == len(docs) and os.path.isdir(oracle.DATA)
    for i, text in docs:
        gone, data, r = want[(i, text)], (text or "").encode(), got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()))
        assert r["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()
    assert sum(r["n_removed"] for r in got.values()) > 1000
