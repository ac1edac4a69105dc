"""Digests that are kept: nothing is written unless inputs or prompts differ; lists, totals, one week."""

from datetime import datetime, timezone

import pytest

from millrace.operators import digest

AT = datetime(2026, 9, 10, tzinfo=timezone.utc)


def made(week, key="k", bullets=(2, 1)):
    start = datetime(2026, 9, int(week[-1]), tzinfo=timezone.utc)
    sections = [{"key": f"s{i}", "title": "T", "markdown": "- x [1]", "bullets": b, "sources": [{"n": 1, "doc_id": 7, "type": "repo", "title": "t", "url": "u", "event_at": start}]} for i, b in enumerate(bullets)]
    return {"week": week, "week_start": start, "week_end": start, "prompt_version": "v1", "input_hash": key, "input_doc_ids": [7], "counts": {"s0": 1}, "sections": sections, "warnings": {}}


def test_a_week_is_written_once_for_the_same_inputs(spark, tmp_path):
    kept = digest.DigestStore(spark, str(tmp_path / "d"))
    assert kept.list().collect() == []
    with pytest.raises(KeyError):
        kept.latest()
    assert [kept.put(made("2026-W3"), AT), kept.put(made("2026-W3"), AT), kept.put(made("2026-W4"), AT)] == ["stored", "unchanged", "stored"]
    version = kept.table.manifest()["version"]
    assert kept.put(made("2026-W4") | {"prompt_version": "v2"}, AT) == "stored" and kept.put(made("2026-W3", "other", (5, 5)), AT) == "stored"
    assert kept.table.manifest()["version"] == version + 2
    assert kept.put(made("2026-W3", "other", (5, 5)), AT, force=True) == "stored"
    assert [(r["week"], r["bullets"]) for r in kept.list().collect()] == [("2026-W4", 3), ("2026-W3", 10)]
    assert [r["week"] for r in kept.list(1).collect()] == ["2026-W4"] and "sections" not in kept.list().columns
    assert kept.latest()["week"] == "2026-W4" and kept.week("2026-W3")["sections"][0]["sources"][0]["doc_id"] == "7"
    for bad in (lambda: kept.week("2026-W9"), lambda: kept.list(0), lambda: kept.list(53)):
        with pytest.raises((KeyError, ValueError)):
            bad()
