"""Tables in parts: merges that touch few buckets, races, breaches, deletes, old versions, streams that run again."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import store
from millrace.operators.parts import Breach, BucketTable, Conflict, PartTable
from millrace.streaming import ingest

NOW = datetime(2026, 9, 10, tzinfo=timezone.utc)
KIND = "doc_key string, content_hash string, title string"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_batches_rewrite_their_buckets_and_equal_one_big_upsert(spark, tmp_path):
    rng = random.Random(1)
    t = BucketTable(spark, str(tmp_path / "t"), buckets=50)
    first = [(f"k{i}", f"h{i}", "old") for i in range(300)]
    t.merge(spark.createDataFrame(first, KIND), NOW)
    batches, keys = [], rng.sample([f"k{i}" for i in range(420)], 60)
    for n in range(6):
        batches.append([(k, f"h{k[1:]}" if rng.random() < 0.4 else f"new{n}", f"batch{n}") for k in keys[10 * n : 10 * n + 10]])
        before = t.manifest()
        t.merge(spark.createDataFrame(batches[-1], KIND), NOW + timedelta(days=1), f"b{n}")
        after = t.manifest()
        changed = {p for p in after["parts"] if after["parts"][p] != before["parts"].get(p)}
        assert 0 < len(changed) <= 10 and set(after["written"]) == changed
    big = store.upsert(store.upsert(spark.createDataFrame([], KIND), spark.createDataFrame(first, KIND), NOW).drop("outcome"), spark.createDataFrame(sum(batches, []), KIND), NOW + timedelta(days=1)).drop("outcome")
    columns = ("doc_key", "content_hash", "title", "first_seen_at", "last_seen_at")
    assert rows_of(t.read(), *columns) == rows_of(big, *columns)
    assert rows_of(t.lookup(["k3", "k7", "none"]), "doc_key") == [("k3",), ("k7",)]
    assert t.merge(spark.createDataFrame(batches[0], KIND), NOW, "b0") == {"new": 0, "changed": 0, "unchanged": 0}
    t.rebucket(7)
    assert len(t.manifest()["parts"]) == 7 and rows_of(t.read(), *columns) == rows_of(big, *columns)
    t.merge(spark.createDataFrame([("k1", "x", "after")], KIND), NOW)
    assert len(t.manifest()["parts"]) == 7 and t.read().count() == big.count()


def test_outcomes_new_columns_and_null_keys(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), buckets=4)
    assert t.merge(spark.createDataFrame([("a", "1", "A"), ("b", "1", "B"), (None, "1", "C")], KIND), NOW) == {"new": 2, "changed": 0, "unchanged": 0}
    more = spark.createDataFrame([("a", "1", "A", 5), ("b", "2", "BB", 6), ("c", "1", "C", 7)], KIND + ", stars int")
    assert t.merge(more, NOW) == {"new": 1, "changed": 1, "unchanged": 1}
    assert rows_of(t.read(), "doc_key", "title", "stars") == [("a", "A", 5), ("b", "BB", 6), ("c", "C", 7)]
    assert t.merge(spark.createDataFrame([], KIND), NOW) == {"new": 0, "changed": 0, "unchanged": 0} and t.manifest()["version"] == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    t = PartTable(spark, str(tmp_path / "t"), "week")
    rows = lambda *r: spark.createDataFrame(list(r), "week string, n int")
    t.replace(rows(("w1", 1), ("w2", 1), ("w3", 1)))
    base = t.manifest()
    t.replace(rows(("w2", 2)), ["w2"])
    late = lambda scope, *r: t._write(rows(*r).withColumn("_part", F.col("week")), rows(*r).schema, lambda _: scope, (), (), base)
    late(["w3"], ("w3", 3))  # other parts: both stand
    assert rows_of(t.read(), "week", "n") == [("w1", 1), ("w2", 2), ("w3", 3)]
    with pytest.raises(Conflict):
        late(["w2"], ("w2", 9))
    b = BucketTable(spark, str(tmp_path / "b"), buckets=1)
    b.merge(spark.createDataFrame([("a", "1", "A")], KIND), NOW)
    put, raced = b._put, []

    def racing(manifest):
        if not raced:
            raced.append(1)
            BucketTable(spark, b.path).merge(spark.createDataFrame([("c", "1", "C")], KIND), NOW)
        return put(manifest)

    b._put = racing
    b.merge(spark.createDataFrame([("b", "1", "B")], KIND), NOW)
    assert rows_of(b.read(), "doc_key") == [("a",), ("b",), ("c",)]


def test_emptied_parts_vanish_and_readers_see_one_version(spark, tmp_path):
    t = PartTable(spark, str(tmp_path / "t"), "week")
    rows = lambda *r: spark.createDataFrame(list(r), "week string, topic string, n int")
    t.replace(rows(("w1", "a", 1), ("w2", "a", 2), ("w2", "b", 2), ("w/3 x", "a", 3)), None, ("topic",))
    reader = t.read()
    t.replace(rows(("w1", "a", 9)), ["w1", "w2"], ("topic",))
    assert rows_of(reader, "week", "topic", "n") == [("w/3 x", "a", 3), ("w1", "a", 1), ("w2", "a", 2), ("w2", "b", 2)]
    assert rows_of(t.read(), "week", "topic", "n") == [("w/3 x", "a", 3), ("w1", "a", 9)] and t.manifest()["removed"] == ["w2"]
    assert rows_of(t.read(0, ["w2"]), "n") == [(2,), (2,)] and t.read(parts=["w2"]).count() == 0
    t.replace(rows().limit(0), ["w1"])
    assert rows_of(t.read(), "week") == [("w/3 x",)]


def test_breaches_never_become_current(spark, tmp_path):
    t = PartTable(spark, str(tmp_path / "t"), "week")
    rows = lambda *r: spark.createDataFrame(list(r), "week string, topic string, n int")
    t.replace(rows(("w1", "a", 1)), ["w1"], ("topic",))
    for bad, args in (((("w1", "a", 1), ("w1", "a", 2)), (["w1"], ("topic",))), ((("w1", None, 1),), (["w1"], (), ("topic",))), ((("w2", "a", 1),), (["w1"],)), (((None, "a", 1),), (None,))):
        with pytest.raises(Breach):
            t.replace(rows(*bad), *args)
    assert t.versions() == [0] and rows_of(t.read(), "n") == [(1,)]
    assert [p.name for p in (tmp_path / "t" / "data").iterdir()] == [t.manifest()["parts"]["w1"].split("/")[1]]


def test_vacuum_keeps_what_kept_versions_list(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), buckets=3)
    for k in range(5):
        t.merge(spark.createDataFrame([(f"k{i}", f"h{k}", "T") for i in range(k, k + 4)], KIND), NOW)
    before, old = rows_of(t.read(), "doc_key", "content_hash"), rows_of(t.read(3), "doc_key", "content_hash")
    assert t.vacuum(2) == 0 and t.versions() == [3, 4]  # folders are still young
    assert t.vacuum(2, older_than_s=-5) > 0
    assert (rows_of(t.read(), "doc_key", "content_hash"), rows_of(t.read(3), "doc_key", "content_hash")) == (before, old)
    with pytest.raises(FileNotFoundError):
        t.read(1)


def test_a_stream_that_crashed_after_its_merge_does_not_merge_again(spark, tmp_path):
    source, kept = str(tmp_path / "in"), BucketTable(spark, str(tmp_path / "t"), buckets=4)
    spark.createDataFrame([("a", "1", "A"), ("b", "1", "B")], KIND).coalesce(1).write.parquet(source)
    read = spark.readStream.schema(KIND).parquet(source)
    merge = kept.merge

    def crashing(*args):
        merge(*args)
        raise OSError("power is gone")

    kept.merge = crashing
    with pytest.raises(Exception, match="power is gone"):
        ingest.upsert_stream(read, kept, str(tmp_path / "cp")).awaitTermination(120)
    kept.merge = merge
    version = kept.manifest()["version"]
    ingest.upsert_stream(read, kept, str(tmp_path / "cp")).awaitTermination(120)
    assert kept.manifest()["version"] == version == 0 and rows_of(kept.read(), "doc_key") == [("a",), ("b",)]
