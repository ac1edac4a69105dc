"""Rate limits with late and repeated hits: stream = table = brute force."""

import collections
import random
from datetime import datetime, timedelta, timezone

from millrace.plans import registry
from millrace.streaming import limits

from . import oracle

ZERO = datetime(2026, 1, 1, tzinfo=timezone.utc)


def plain(hits, most, window, late):
    """(client, seconds, arrival, id) -> verdicts in the order of arrival, by looking at every window."""
    accepted, newest, out = collections.defaultdict(set), {}, []
    for client, t, came, name in sorted(hits, key=lambda h: (h[2], h[3])):
        newest[client] = max(newest.get(client, t), t)
        own = accepted[client]
        if (t, name) in own and t >= newest[client] - late - window:
            ok = True
        elif t < newest[client] - late:
            ok = False
        else:
            times = sorted([x for x, _ in own] + [t])
            ok = not any(a <= t <= a + window and sum(a <= x <= a + window for x in times) > most for a in times)
        if ok:
            own.add((t, name))
        out.append((client, t, came, name, ok))
    return sorted(out)


def hits(seed, n=400):
    rng, out = random.Random(seed), []
    for k in range(n):
        t = k * 2 + rng.randint(0, 3)
        out.append((rng.choice("aaabc"), t, t + (rng.randint(0, 150) if rng.random() < 0.3 else 0), f"n{k}"))
        if rng.random() < 0.1:
            c, t, came, name = rng.choice(out)
            out.append((c, t, came + rng.randint(0, 200), name))
    return out


def rows(spark, own):
    at = lambda s: ZERO + timedelta(seconds=s)
    return spark.createDataFrame([(c, at(t), at(came), name) for c, t, came, name in own], "client string, ts timestamp, came timestamp, name string")


def seconds(got):
    s = lambda t: round((t.replace(tzinfo=timezone.utc) - ZERO).total_seconds())
    return sorted((r["client"], s(r["ts"]), s(r["came"]), r["name"], r["accepted"]) for r in got)


def test_log_in_order_is_the_plain_limit():
    rng = random.Random(3)
    times = sorted(rng.randint(0, 2000) for _ in range(500))
    log = limits.Log(5, 60, 0)
    assert [log.judge(t * 10**6, str(k)) for k, t in enumerate(times)] == limits.limit_times(times, 5, 60)
    assert limits.Log(0, 60, 0).judge(1, "x") and not limits.Log(2, 60, 0).judge(None, "x")


def test_table_equals_brute_force(spark):
    for seed in (1, 2):
        own = hits(seed)
        got = limits.limit_arrivals(rows(spark, own).repartition(3), "client", "ts", "came", "name", 3, 60, 90)
        want = plain(own, 3, 60, 90)
        assert seconds(got.collect()) == want and 50 < sum(x[-1] for x in want) < len(want)


def run(spark, folder, cp, name, initial=None):
    stream = spark.readStream.schema("client string, ts timestamp, came timestamp, name string").option("maxFilesPerTrigger", 1).parquet(folder)
    judged = limits.limit_stream(stream, "client", "ts", 3, 60, 90, "name", "came", initial=initial)
    q = judged.writeStream.format("parquet").option("path", f"{cp}/out").option("checkpointLocation", f"{cp}/cp").trigger(availableNow=True).start()
    ended = q.awaitTermination(120)
    q.stop()
    assert ended and q.exception() is None
    return spark.read.parquet(f"{cp}/out")


def test_stream_equals_table_also_after_restarts_and_from_a_table(spark, tmp_path):
    own = sorted(hits(5, 150), key=lambda h: (h[2], h[3]))
    want, folder = plain(own, 3, 60, 90), str(tmp_path / "in")
    cuts = [0, 60, 61, 130, len(own)]
    parts = [own[a:b] for a, b in zip(cuts, cuts[1:])]
    for part in parts[:2]:
        rows(spark, part).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, str(tmp_path / "a"), "a")
    for part in parts[2:]:  # the stream has ended, and goes on from its checkpoint
        rows(spark, part).coalesce(1).write.mode("append").parquet(folder)
        got = run(spark, folder, str(tmp_path / "a"), "a")
    assert seconds(got.collect()) == want
    done = limits.limit_arrivals(rows(spark, parts[0]), "client", "ts", "came", "name", 3, 60, 90)
    for part in parts[1:]:
        rows(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "rest"))
    rest = run(spark, str(tmp_path / "rest"), str(tmp_path / "b"), "b", done)
    assert sorted(seconds(done.collect()) + seconds(rest.collect())) == want


def test_query_equals_brute_force(spark):
    got = registry.QUERIES["rate_limit_arrivals"](spark, oracle.DATA).collect()
    micro = lambda t: round((t.replace(tzinfo=timezone.utc) - ZERO) / timedelta(microseconds=1))
    one = [((r["client_id"] is not None, r["client_id"] or 0), micro(r["ts"]), micro(r["arrived_at"]), str(r["click_id"])) for r in got if r["ts"] is not None and r["arrived_at"] is not None]
    verdicts = sorted((*k, r["accepted"]) for k, r in zip(one, (r for r in got if r["ts"] is not None and r["arrived_at"] is not None)))
    assert verdicts == plain(one, 2, 60 * 10**6, 600 * 10**6) and len(got) == spark.read.parquet(f"{oracle.DATA}/clicks.parquet").count()
    assert all(not r["accepted"] for r in got if r["ts"] is None)
