"""Weekly topic counts, what rises, and what gains fastest."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import previous_weeks, week_bounds, week_id
from ..functions.topics import document_topics

MIN_COUNT, BASELINE_WEEKS, TRAILING_WEEKS = 3, 4, 8
#: The metric of a type, and the least gain worth showing.
VELOCITY_METRIC = {"repo": "stars", "model": "likes", "paper": "upvotes", "launch": "points"}
VELOCITY_FLOOR = {"repo": 20, "model": 20, "paper": 5, "launch": 5}


def count_weekly(rows: DataFrame) -> DataFrame:
    """(topic, week, doc_count, by_type) of (topic, week, type) rows, one a document and topic."""
    per_type = rows.groupBy("topic", "week", "type").agg(F.count(F.lit(1)).alias("n"))
    return per_type.groupBy("topic", "week").agg(F.sum("n").alias("doc_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))


def topic_weekly(docs: DataFrame, week: str, trailing: int = TRAILING_WEEKS) -> DataFrame:
    """Topic counts of a week and those before it; the range of dates reaches the scan."""
    first = week_bounds(([week, *previous_weeks(week, trailing - 1)])[-1])[0]
    last = week_bounds(week)[1]
    inside = docs.where((F.col("event_at") >= F.lit(first)) & (F.col("event_at") < F.lit(last)))
    return count_weekly(inside.select("type", week_id("event_at").alias("week"), F.explode(document_topics()).alias("topic")))


def rising(weekly: DataFrame, week: str, limit: int = 20, least: int = MIN_COUNT) -> DataFrame:
    """(topic, count, baseline, score, by_type): count against the mean of the four weeks before, missing weeks as 0."""
    before = previous_weeks(week, BASELINE_WEEKS)
    baseline = F.sum(F.when(F.col("week").isin(*before), F.col("doc_count")).otherwise(0)) / BASELINE_WEEKS
    rows = weekly.where(F.col("week").isin(week, *before)).groupBy("topic").agg(
        F.max(F.when(F.col("week") == week, F.col("doc_count"))).alias("count"),
        baseline.alias("raw"),
        F.first(F.when(F.col("week") == week, F.col("by_type")), ignorenulls=True).alias("by_type"),
    )
    score = F.bround((F.col("count") - F.col("raw")) / F.sqrt(F.col("raw") + 1), 3)
    kept = rows.where(F.col("count") >= least)
    return kept.select("topic", "count", F.bround("raw", 2).alias("baseline"), score.alias("score"), "by_type").orderBy(F.desc("score"), F.desc("count"), "topic").limit(limit)


def top(weekly: DataFrame, week: str, limit: int = 20) -> DataFrame:
    return weekly.where(F.col("week") == week).select("topic", F.col("doc_count").alias("count"), "by_type").orderBy(F.desc("count"), "topic").limit(limit)


def history(weekly: DataFrame, week: str) -> DataFrame:
    """(history_weeks, insufficient_history): how many of the weeks before have any data."""
    n = F.count_distinct(F.when(F.col("week").isin(*previous_weeks(week, BASELINE_WEEKS)), F.col("week")))
    return weekly.agg(n.alias("history_weeks")).withColumn("insufficient_history", F.col("history_weeks") < BASELINE_WEEKS)


def trailing_mean(weekly: DataFrame, weeks: list[str], n: int = BASELINE_WEEKS) -> DataFrame:
    """(topic, week, doc_count, prior_mean) on a calendar spine, so that missing weeks are zeros in every mean."""
    spark = weekly.sparkSession
    spine = weekly.select("topic").distinct().crossJoin(F.broadcast(spark.createDataFrame([(w,) for w in sorted(weeks)], "week string")))
    filled = spine.join(weekly.select("topic", "week", "doc_count"), ["topic", "week"], "left").fillna(0, ["doc_count"])
    before = Window.partitionBy("topic").orderBy("week").rowsBetween(-n, -1)
    return filled.withColumn("prior_mean", F.coalesce(F.sum("doc_count").over(before), F.lit(0)) / n)


def velocity(snapshots: DataFrame, metric: str, floor: float, today: date, days: int = 14, limit: int = 20) -> DataFrame:
    """(doc_id, gained, now, from_date, to_date): the metric's gain between the first and last day in the window.

    Snapshots without the metric are no days; one day alone says nothing.
    """
    inside = snapshots.where((F.col("date") >= F.lit(today - timedelta(days=days))) & F.col(metric).isNotNull())
    ends = inside.groupBy("doc_id").agg(F.min_by(metric, "date").alias("first"), F.max_by(metric, "date").alias("now"), F.min("date").alias("from_date"), F.max("date").alias("to_date"))
    gained = ends.where("from_date < to_date").withColumn("gained", F.col("now") - F.col("first"))
    return gained.where(F.col("gained") >= floor).select("doc_id", "gained", "now", "from_date", "to_date").orderBy(F.desc("gained"), "doc_id").limit(limit)
