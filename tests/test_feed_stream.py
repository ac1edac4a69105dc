"""The stream of feeds: a batch that runs again gives the same rows, feeds are partitions, what is committed is trimmed."""

import json
import os

import pytest

from millrace.sources.base import register
from millrace.sources.stream import FeedStreamReader, Folder

from . import fake_feeds


@pytest.fixture
def asked(tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()
    with open(fake_feeds.WHERE, "w") as f:
        f.write(str(folder))
    return folder


def options(tmp_path, **more):
    return {"name": "one,two", "log": str(tmp_path / "log"), "registry": "tests.fake_feeds:build_sources"} | more


def answers(rows):
    return sorted((s, json.loads(v)["answer"], json.loads(v)["i"]) for s, v in rows)


def test_reader_replays_its_log_and_trims_it(tmp_path, asked):
    reader = FeedStreamReader(options(tmp_path))
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert [p.feed for p in parts] == ["one", "two"] and end == {"poll": 1}
    first = answers(r for p in parts for r in reader.read(p))
    again = FeedStreamReader(options(tmp_path))  # after a crash
    assert answers(r for p in again.partitions(start, end) for r in again.read(p)) == first == [(f, 0, i) for f in ("one", "two") for i in range(3)]
    assert len(list(asked.iterdir())) == 2
    after = again.latestOffset()
    (asked / "broken-two").touch()
    second = again.partitions(end, after)
    assert answers(r for p in second for r in again.read(p)) == [("one", 1, i) for i in range(3)]
    assert second[0].since == parts[0].until
    again.commit(end)
    assert again.log.names("items") == ["2"] and again.log.names("plans") == ["0000000001.json", "0000000002.json"]
    (asked / "broken-two").unlink()
    third = again.partitions(after, again.latestOffset())
    assert third[1].since == second[1].since and third[0].since == second[0].until  # the feed that failed is asked for its window again
    assert len(answers(r for p in third for r in again.read(p))) == 6
    again.commit({"poll": 3})
    assert again.log.names("items") == [] and again.log.names("plans") == ["0000000003.json"]
    slow = FeedStreamReader(options(tmp_path, every="3600"))
    assert slow.latestOffset() == slow.latestOffset() == {"poll": 3}
    with pytest.raises(ValueError):
        FeedStreamReader({"name": "one"})


def test_saved_payloads_come_once_by_file(tmp_path):
    saved = tmp_path / "saved" / "a"
    saved.mkdir(parents=True)
    (saved / "1.json").write_text('{"x": 1}\n{"x": 2}')
    reader = FeedStreamReader({"name": "a,b", "log": str(tmp_path / "log"), "payloads": str(tmp_path / "saved")})
    one = reader.latestOffset()
    assert reader.latestOffset() == one == {"poll": 1}
    (saved / "2.json").write_text('{"x": 3}\n\n')
    two = reader.latestOffset()
    read = lambda a, b: [(p.file, *r) for p in reader.partitions(a, b) for r in reader.read(p)]
    assert read(one, two) == [("2.json", "a", '{"x": 3}')] and len(read({"poll": 0}, two)) == 3
    long = Folder(str(tmp_path))
    long.put("long", (str(k).encode() * 1000 for k in range(3000)))
    assert [len(x) for x in long.lines("long")] == [1000 * len(str(k)) for k in range(3000)]
    long.put("long", iter([b"late"]))  # a second attempt changes nothing
    assert os.path.getsize(tmp_path / "long") > 1000


def test_a_stream_killed_before_its_commit_gives_the_same_rows(spark, tmp_path, asked):
    register(spark)
    seen = []

    def run(crash):
        def step(batch, number):
            seen.append((number, answers(batch.select("source", "value").collect())))
            if crash:
                raise OSError("killed")

        stream = spark.readStream.format("feed").options(**options(tmp_path, every="0")).load()
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        run(True).awaitTermination(120)
    q = run(False)
    assert q.awaitTermination(120) and q.exception() is None
    assert seen[0] == seen[1] and len(seen[0][1]) == 6 and seen[0][0] == seen[1][0] == 0
    assert [n for n, _ in seen] in ([0, 0], [0, 0, 1])
