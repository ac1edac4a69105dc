"""Quality of rankings and of extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import name_key


def ranking(hits: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, p, r, mrr, ndcg) of hits (query_id, doc_id, rank) against gains (query_id, doc_id, gain).

    Queries without gains are left out; queries without hits score zero.
    """
    found = gains.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    hit = found.withColumn("at", F.when(F.col("rank") <= k, F.col("rank")))
    got = hit.groupBy("query_id").agg(
        (F.count("at") / k).alias("p"),
        (F.count("at") / F.count(F.lit(1))).alias("r"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("at").isNotNull(), F.col("gain") / F.log2(F.col("at") + 1))), F.lit(0.0)).alias("dcg"),
        F.slice(F.sort_array(F.collect_list(F.col("gain").cast("double")), asc=False), 1, k).alias("best"),
    )
    ideal = F.aggregate(F.transform("best", lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    return got.select("query_id", "p", "r", "mrr", F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def means(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("p", "r", "mrr", "ndcg")), F.count(F.lit(1)).alias("queries"))


def resolve_labels(labels: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels (query_id, title, gain) by document (doc_id, title): gains, missing labels, and titles of several documents.

    Of such a title the largest doc_id counts.
    """
    by_title = docs.groupBy("title").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    joined = labels.join(by_title, "title", "left")
    return (
        joined.where("doc_id IS NOT NULL").select("query_id", "doc_id", "gain"),
        joined.where("doc_id IS NULL").select("query_id", "title"),
        by_title.where("n > 1").select("title", "n"),
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn, accuracy, precision, recall) of boolean columns truth and predicted, in one pass."""
    t, p = F.col("truth"), F.col("predicted")
    counts = pairs.agg(*(F.count_if(c).alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def extraction_fields(rows: DataFrame) -> DataFrame:
    """Right and scored numbers of company, amount (within 5 %) and round over true positives.

    Rows have truth, predicted, company, amount_usd, round, want_company, want_amount,
    want_round and amount_labelled: an amount counts if it is labelled, even as none.
    """
    tp = F.col("truth") & F.col("predicted")
    want, got = F.col("want_amount"), F.col("amount_usd")
    near = (want.isNull() & got.isNull()) | F.coalesce((want != 0) & (got != 0) & (F.abs(got - want) <= 0.05 * want), F.lit(False))
    company = tp & (F.coalesce(F.col("want_company"), F.lit("")) != "")
    named = tp & (F.coalesce(F.col("want_round"), F.lit("")) != "")
    return rows.agg(
        F.count_if(company).alias("company_n"), F.count_if(company & (name_key("company") == name_key("want_company"))).alias("company_ok"),
        F.count_if(tp & F.col("amount_labelled")).alias("amount_n"), F.count_if(tp & F.col("amount_labelled") & near).alias("amount_ok"),
        F.count_if(named).alias("round_n"), F.count_if(named & F.coalesce(F.col("round") == F.col("want_round"), F.lit(False))).alias("round_ok"),
    )
