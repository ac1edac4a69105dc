"""Every registered query of the engine against its SQL; those without SQL against brute force."""

import collections

import pytest

from millrace.plans import registry
from millrace.streaming.limits import limit_times

from . import oracle


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(spark, registry.QUERIES[name], registry.ORACLES[name]) > 0


def test_rate_limit_equals_a_plain_log(spark):
    got = registry.QUERIES["rate_limit"](spark, oracle.DATA).collect()
    by_user = collections.defaultdict(list)
    for r in got:
        by_user[r["user_id"]].append((r["ts"].timestamp(), r["event_id"], r["accepted"]))
    for events in by_user.values():
        events.sort()
        accepted = []
        for t, _, ok in events:
            want = sum(t - a <= 86_400 for a in accepted) < 2
            assert ok == want
            accepted += [t] * want
    assert not all(r["accepted"] for r in got)


def test_limit_is_a_log_not_a_count():
    assert limit_times([0, 1, 2, 61, 61.5, 62.5], 2, 60) == [True, True, False, True, True, False]
    assert limit_times([0, 0, 0], 0) == [True, True, True]


def test_merged_rounds_hold_every_source_once(spark):
    rows = registry.QUERIES["merge_rounds"](spark, oracle.DATA).collect()
    assert sum(r["sources"] for r in rows) == spark.read.parquet(f"{oracle.DATA}/orders.parquet").count()
    assert len({r["_id"] for r in rows}) == len(rows)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
