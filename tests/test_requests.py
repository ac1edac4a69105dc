"""Requests are checked before plans are made; the first time a document was seen."""

import inspect
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.dates import first_seen
from millrace.plans.api import REQUESTS, Api


@pytest.mark.parametrize(
    ("path", "good", "bad"),
    [
        ("similar", {"doc_id": "a", "top_k": 20}, [{"doc_id": "a", "top_k": 21}, {"doc_id": "a" * 65}, {"doc_id": "a", "k": 1}]),
        ("documents", {"kind": "repo", "since_days": 365, "offset": 0}, [{"kind": "no such"}, {"since_days": 0}, {"limit": 101}, {"offset": -1}, {"limit": True}]),
        ("funding", {"least_usd": 0.5, "name": "seed"}, [{"least_usd": -1}, {"name": "x" * 21}, {"limit": 0}, {"since_days": 366}]),
        ("companies", {"text": "x", "sort": "name"}, [{"sort": "size"}, {"text": "x" * 101}, {"offset": 10_001}]),
        ("trends", {"week": "2026-W02"}, [{"week": "2026-2"}, {"week": "2026-W02\n"}, {"week": "2026-W02", "limit": 1.5}]),
        ("velocity", {"kind": "paper", "days": 90}, [{"days": 1}, {"kind": "startup"}]),
    ],
)
def test_bounds_of_requests(path, good, bad):
    request = REQUESTS[path].parse(good)
    assert vars(request).keys() <= inspect.signature(getattr(Api, path)).parameters.keys()
    for raw in bad:
        with pytest.raises(ValueError):
            REQUESTS[path].parse(raw)


def test_first_seen_takes_the_first_mark_that_reads(spark):
    rows = [(1, "2024-01-02T00:00:00Z", "2023-01-01"), (2, None, "2023-01-01"), (3, "not a date", None)]
    docs = spark.createDataFrame(rows, "id int, inserted_at string, scraped_at string")
    got = docs.select("id", first_seen(F.lit("2025-05-05").cast("timestamp"), set(docs.columns)).cast("date").alias("d")).orderBy("id").collect()
    assert [str(r["d"]) for r in got] == ["2024-01-02", "2023-01-01", "2025-05-05"]
    assert docs.select(first_seen(F.lit(datetime(2025, 5, 5)), set()).cast("date").cast("string")).first()[0] == "2025-05-05"
