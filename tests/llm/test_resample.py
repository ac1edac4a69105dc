"""Importance resampling against plain Python and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import __spark_entry__ as entry
import pytest
from millrace.llm import resample

from .. import oracle

TEXTS = [
    "The cat sat on the mat, the cat sat. " * 4,
    "ÄÖÜ straße naïve " * 9,
    None,
    "",
    "... !!",
    "alpha beta gamma delta " * 300,
    "one",
    "DATA science and Data Engineering with 12 clusters " * 5,
    "the cat sat on the mat " * 30,
]


def plain(rows, wanted, longest, percent, least, buckets, seed=2024):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([r[1] for r in rows], wanted))
    whole, all_wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (whole + float(buckets)) / ((s[b] + 1.0) * (all_wanted + float(buckets)))))
    out = []
    for doc_id, text in rows:
        words, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, -r[3], -r[2]))
    n = len(able) * percent // 100
    ranks = {id(r): i + 1 if i < n else None for i, r in enumerate(able)}
    return sorted([(*r, ranks.get(id(r))) for r in out], key=repr)


@pytest.mark.parametrize("longest, nodes, chunk", [(1, 400_000, 1 << 22), (2, 50, 64), (3, 400_000, 17)])
def test_equals_plain_python(spark, monkeypatch, longest, nodes, chunk):
    monkeypatch.setattr(resample, "NODES", nodes)
    monkeypatch.setattr(resample, "CHUNK", chunk)
    rows = [(i % 60 if i % 13 else None, TEXTS[i * 7 % len(TEXTS)]) for i in range(80)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, weight int, rank string").repartition(3)
    target = spark.createDataFrame([(1, "the data engineering cat"), (2, None), (3, "clusters of data")], "item_id int, text string")
    got = sorted(map(tuple, resample.resample(docs, target, 50, 12, longest, 97).collect()), key=repr)
    assert got == plain(rows, ["the data engineering cat", None, "clusters of data"], longest, 50, 12, 97)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(5, "a b c " * 10), (6, "x")], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    got = {r["doc_id"]: r["rank"] for r in resample.resample(some, none, percent=100).collect()}
    assert got == {5: 1, 6: None}


def test_a_trie_goes_on_with_the_crc_of_the_shorter_run():
    trie = resample.Trie()
    one, two, three = trie.walk([b"ab", b"c", b"ab"], 3)
    assert one[0] == one[2]
    assert trie.crc[two[0]] == zlib.crc32(b"ab c") and trie.crc[three[0]] == zlib.crc32(b"ab c ab")


def test_query_equals_its_sql(spark):
    assert oracle.compare(spark, entry.queries()["op11_resample"], entry.oracle_sql()["op11_resample"]) == 200
