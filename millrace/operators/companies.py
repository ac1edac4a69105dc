"""Companies from startups, launches and rounds, matched by strict identities only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import company_slug, name_key, registered_domain
from ..functions.text import first_nonblank
from .store import keep

COMPANY = (
    "slug string, name string, name_key string, yc_slug string, domain string, website string, yc_batch string, location string, description string, tags array<string>, launched_at timestamp, startup_ids array<string>"
)


def identities(startups: DataFrame) -> DataFrame:
    """Startups with the keys they can be matched by."""
    key = name_key("name")
    slug = F.lower(F.coalesce("yc_slug", F.lit("")))
    out = startups.withColumns({"doc_id": F.col("doc_id").cast("string"), "name": F.trim(F.coalesce("name", F.lit(""))), "name_key": key, "yc_slug": slug, "domain": registered_domain(first_nonblank(F.col("link"), F.col("website")))})
    return out.withColumn("candidate", company_slug("yc_slug", "domain", F.when(F.col("name_key") != "", F.col("name_key")).otherwise(F.col("doc_id"))))


def _groups(records: DataFrame) -> DataFrame:
    """(doc_id, group): records that share a directory slug, a domain or a candidate slug, directly or through others."""
    tags = records.select(
        "doc_id",
        F.explode(F.array_compact(F.array(F.when(F.col("yc_slug") != "", F.concat(F.lit("y:"), "yc_slug")), F.when(F.col("domain") != "", F.concat(F.lit("d:"), "domain")), F.concat(F.lit("c:"), "candidate")))).alias("tag"),
    )
    tags = keep(tags, "tags")
    labels, seen = records.select("doc_id", F.col("doc_id").alias("group")), None
    while True:
        least = tags.join(labels, "doc_id").groupBy("tag").agg(F.min("group").alias("group"))
        labels = keep(tags.join(least, "tag").groupBy("doc_id").agg(F.min("group").alias("group")), "labels")
        sign = labels.agg(F.bit_xor(F.xxhash64("doc_id", "group"))).first()[0]
        if sign == seen:
            return labels
        seen = sign


def merge_startups(startups: DataFrame) -> DataFrame:
    """COMPANY rows: startups merge on a directory slug or a domain, never on a name alone.

    The first record in the order of doc_id gives a company its slug and facts; later ones add
    identities it lacks. Which identities are known by then matters, so each group of linked
    records (one company's, as a rule) is replayed in order.
    """
    names = [f.split(" ")[0] for f in COMPANY.split(", ")]
    records = identities(startups)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        made: dict[str, dict] = {}
        owner: dict[tuple[str, str], str] = {}
        for r in pdf.sort_values("doc_id").to_dict("records"):
            strong = [(f, r[f]) for f in ("yc_slug", "domain") if r[f]]
            slug = next((owner[s] for s in strong if s in owner), None)
            if slug is not None:
                for f, value in strong:
                    made[slug][f] = made[slug][f] or value
                made[slug]["startup_ids"].append(r["doc_id"])
            else:
                slug = r["candidate"] if r["candidate"] not in made else f"{r['candidate']}-{r['doc_id'][-6:]}"
                made[slug] = {n: r.get(n) for n in names} | {"slug": slug, "website": r["link"] or "", "description": r["one_liner"] or r["description"] or "", "launched_at": r["event_at"], "startup_ids": [r["doc_id"]], "tags": [] if r["tags"] is None else list(r["tags"])}
            owner |= {(f, made[slug][f]): slug for f in ("yc_slug", "domain") if made[slug][f]}
        return pd.DataFrame(list(made.values()), columns=names)

    fields = ["doc_id", "name", "name_key", "yc_slug", "domain", "candidate", "link", "yc_batch", "location", "one_liner", "description", "tags", "event_at"]
    return records.select(*fields).join(_groups(records), "doc_id").groupBy("group").applyInPandas(replay, COMPANY)


def match(records: DataFrame, companies: DataFrame) -> DataFrame:
    """records (id, yc_slug, domain, name_key) with the slug of their company, or null: by directory slug, else domain, else a name only one company has."""
    by_yc = companies.where("yc_slug <> ''").groupBy("yc_slug").agg(F.max("slug").alias("_yc"))
    by_domain = companies.where("domain <> ''").groupBy("domain").agg(F.max("slug").alias("_domain"))
    by_name = companies.where("name_key <> ''").groupBy("name_key").agg(F.min("slug").alias("_name"), F.count(F.lit(1)).alias("_n"))
    joined = records.join(by_yc, "yc_slug", "left").join(by_domain, "domain", "left").join(by_name, "name_key", "left")
    return joined.withColumns({"slug": F.coalesce("_yc", "_domain", F.when(F.col("_n") == 1, F.col("_name"))), "ambiguous": F.coalesce(F.col("_n") > 1, F.lit(False))}).drop("_yc", "_domain", "_name", "_n")


def build(startups: DataFrame, launches: DataFrame, rounds: DataFrame) -> DataFrame:
    """Companies with documents, rounds and totals, from scratch.

    Rounds of fair or high confidence go to the one company of their name; names that several have are left
    alone; unknown names make companies known from news only.
    """
    base = keep(merge_startups(startups), "companies")
    posts = launches.select(F.col("doc_id").cast("string").alias("id"), F.lower(F.coalesce("company_slug", F.lit(""))).alias("yc_slug"), registered_domain("link").alias("domain"), name_key("company_name").alias("name_key"))
    launch_ids = match(posts, base).where("slug IS NOT NULL").groupBy("slug").agg(F.array_sort(F.collect_set("id")).alias("launch_ids"))
    good = rounds.where(F.col("confidence").isin("high", "medium") & (F.col("company_key") != ""))
    asked = good.select("_id", "amount_usd", "source_doc_ids", "company", F.col("company_key").alias("name_key"), F.lit("").alias("yc_slug"), F.lit("").alias("domain"))
    placed = match(asked, base).where("slug IS NOT NULL OR NOT ambiguous").withColumn("news", F.col("slug").isNull()).withColumn("slug", F.coalesce("slug", F.concat(F.lit("n-"), "name_key")))
    totals = placed.groupBy("slug").agg(
        F.array_sort(F.collect_list("_id")).alias("rounds"),
        F.coalesce(F.sum("amount_usd"), F.lit(0.0)).alias("funding_total_usd"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_doc_ids")))).alias("article_ids"),
        F.bool_or("news").alias("news"), F.min_by("company", "_id").alias("_company"), F.first("name_key").alias("_key"),
    )
    none = F.array().cast("array<string>")
    joined = base.join(totals, "slug", "full").join(launch_ids, "slug", "left")
    out = joined.withColumns(
        {
            "name": F.coalesce("name", first_nonblank(F.col("_company"), F.col("_key"))), "name_key": F.coalesce("name_key", "_key"),
            **{c: F.coalesce(c, F.lit("")) for c in ("yc_slug", "domain", "website", "yc_batch", "location", "description")}, "tags": F.coalesce("tags", none),
            "rounds": F.coalesce("rounds", none), "funding_total_usd": F.coalesce("funding_total_usd", F.lit(0.0)), "from_news_only": F.coalesce("news", F.lit(False)),
            **{c: F.coalesce(c, none) for c in ("startup_ids", "launch_ids", "article_ids")},
        }
    )
    ids = F.map_from_arrays(F.array(F.lit("startup"), F.lit("launch"), F.lit("article")), F.array("startup_ids", "launch_ids", "article_ids"))
    out = out.withColumn("doc_ids", F.map_filter(ids, lambda k, v: F.size(v) > 0))
    return out.withColumn("document_count", F.size("startup_ids") + F.size("launch_ids") + F.size("article_ids")).drop("startup_ids", "launch_ids", "article_ids", "news", "_company", "_key")


def page(companies: DataFrame, text: str | None = None, sort: str = "funding", limit: int = 20, offset: int = 0) -> DataFrame:
    """Companies whose name contains a text in any case, by funding, by documents or by name."""
    orders = {"funding": [F.desc("funding_total_usd"), F.desc("document_count"), "slug"], "documents": [F.desc("document_count"), "slug"], "name": ["name", "slug"]}
    found = companies.where(F.lower("name").contains(text.lower())) if text else companies
    return found.orderBy(*orders[sort]).offset(offset).limit(limit)


def detail(companies: DataFrame, rounds: DataFrame, docs: DataFrame, slug: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One company, its rounds (the newest first), and its documents (the newest first)."""
    own = companies.where(F.col("slug") == slug).limit(1)
    mine = own.select(F.explode("rounds").alias("_id"))
    ids = own.select(F.explode(F.flatten(F.map_values("doc_ids"))).alias("doc_id"))
    found = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    return own, rounds.join(F.broadcast(mine), "_id").orderBy(F.desc_nulls_last("announced_at"), "_id"), found.join(F.broadcast(ids), "doc_id").orderBy(F.desc_nulls_last("event_at"), "doc_id")
