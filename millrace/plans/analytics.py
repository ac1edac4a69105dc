"""Analytic queries: ingestion, identity, trends, companies, rounds, digest, and the functions they rest on."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, doctext, identity, money, text, topics
from ..operators import companies, digest, funding, store, trends
from ..operators.entities import stale
from ..streaming import ingest, limits
from .registry import query, table

HASHED = "sha1(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00a0}\\x{200b}\\x{200c}\\x{200d}\\x{feff}]+', ' ', 'g')))"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _map_text(c: Column | str) -> Column:
    """A map as text, by key."""
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


# ---- trends over events: event_type as topic, the second digit of user_id as type


_WEEKLY = """
t AS (SELECT event_type AS topic, strftime(ts, '%G-W%V') AS week, (user_id % 3)::VARCHAR AS type, count(*) AS n FROM events GROUP BY ALL),
weekly AS (SELECT topic, week, sum(n)::BIGINT AS doc_count, string_agg(type || ':' || n, ',' ORDER BY type) AS by_type FROM t GROUP BY ALL)"""


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("event_type").alias("topic"), dates.week_id("ts").alias("week"), (F.col("user_id") % 3).cast("string").alias("type"))
    return trends.count_weekly(rows)


@query(f"WITH {_WEEKLY} SELECT * FROM weekly")
def topic_weekly(spark: SparkSession, d: str) -> DataFrame:
    return _weekly(spark, d).withColumn("by_type", _map_text("by_type"))


@query(
    f"""WITH {_WEEKLY},
r AS (SELECT topic, max(doc_count) FILTER (week = '2024-W04') AS count, coalesce(sum(doc_count) FILTER (week IN ('2024-W03', '2024-W02', '2024-W01', '2023-W52')), 0) / 4 AS raw FROM weekly GROUP BY topic)
SELECT topic, count, round_even(raw, 2) AS baseline, round_even((count - raw) / sqrt(raw + 1), 3) AS score FROM r WHERE count >= 3 ORDER BY score DESC, count DESC, topic LIMIT 20"""
)
def rising_topics(spark: SparkSession, d: str) -> DataFrame:
    return trends.rising(_weekly(spark, d), "2024-W04").select("topic", "count", F.col("baseline").cast("double").alias("baseline"), "score")


@query(f"WITH {_WEEKLY} SELECT topic, doc_count AS count FROM weekly WHERE week = '2024-W03' ORDER BY count DESC, topic LIMIT 20")
def top_topics(spark: SparkSession, d: str) -> DataFrame:
    return trends.top(_weekly(spark, d), "2024-W03").select("topic", "count")


@query(f"WITH {_WEEKLY} SELECT count(DISTINCT week) FILTER (week IN ('2024-W03', '2024-W02', '2024-W01', '2023-W52')) AS history_weeks, history_weeks < 4 AS insufficient_history FROM weekly")
def trend_history(spark: SparkSession, d: str) -> DataFrame:
    return trends.history(_weekly(spark, d), "2024-W04")


@query(
    f"""WITH {_WEEKLY}, spine AS (SELECT topic, unnest(['2024-W01', '2024-W02', '2024-W03', '2024-W04', '2024-W05']) AS week FROM (SELECT DISTINCT topic FROM weekly)),
f AS (SELECT s.topic, s.week, coalesce(doc_count, 0) AS doc_count FROM spine s LEFT JOIN weekly USING (topic, week))
SELECT topic, week, doc_count, coalesce(sum(doc_count) OVER (PARTITION BY topic ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) / 4 AS prior_mean FROM f"""
)
def trailing_mean(spark: SparkSession, d: str) -> DataFrame:
    return trends.trailing_mean(_weekly(spark, d), [f"2024-W0{i}" for i in range(1, 6)])


_SNAPS = "snaps AS (SELECT user_id AS doc_id, ts::DATE AS date, max(event_id) AS stars FROM events GROUP BY ALL)"


@query(
    f"""WITH {_SNAPS}, e AS (SELECT doc_id, arg_min(stars, date) AS first, arg_max(stars, date) AS now, min(date) AS from_date, max(date) AS to_date FROM snaps WHERE date >= DATE '2024-01-06' GROUP BY doc_id)
SELECT doc_id, now - first AS gained, now, from_date, to_date FROM e WHERE from_date < to_date AND now - first >= 20 ORDER BY gained DESC, doc_id LIMIT 20"""
)
def velocity(spark: SparkSession, d: str) -> DataFrame:
    snaps = _events(spark, d).groupBy(F.col("user_id").alias("doc_id"), F.to_date("ts").alias("date")).agg(F.max("event_id").alias("stars"))
    return trends.velocity(snaps, "stars", trends.VELOCITY_FLOOR["repo"], date(2024, 1, 20))


@query("SELECT date_trunc('week', ts) AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly_windows(spark: SparkSession, d: str) -> DataFrame:
    counted = ingest.weekly_counts(table(spark, d, "events"), "ts", "event_type")
    return counted.select(F.col("window.start").alias("week_start"), "event_type", "n")


# ---- counts and pages


@query(
    """SELECT t.type, count(e.event_id) AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup', 'view']) AS type) t LEFT JOIN events e ON e.event_type = t.type GROUP BY t.type"""
)
def counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each known type, zero for those that no row has."""
    known = spark.createDataFrame([(t,) for t in ("click", "error", "purchase", "refund", "signup", "view")], "type string")
    counted = _events(spark, d).groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(known), "type", "right").fillna(0, ["n"])


@query("SELECT event_type, max_ts AS ts, event_id, user_id FROM (SELECT event_type, ts AS max_ts, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The latest whole row of each group, by one aggregate instead of a sort."""
    latest = F.max_by(F.struct("ts", "event_id", "user_id"), F.struct("ts", "event_id")).alias("r")
    return table(spark, d, "events").groupBy("event_type").agg(latest).select("event_type", "r.*")


@query("SELECT event_id, event_type, ts, (SELECT count(*) FROM events WHERE event_type = 'click') AS total FROM events WHERE event_type = 'click' ORDER BY ts DESC NULLS LAST, event_id LIMIT 10 OFFSET 20")
def documents_page(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").where("event_type = 'click'")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    rows = found.orderBy(F.desc_nulls_last("ts"), "event_id").offset(20).limit(10).select("event_id", "event_type", "ts")
    return rows.crossJoin(F.broadcast(total))


@query(
    """SELECT d.lang AS type, count(*) AS total, count(*) FILTER (n_chars > 500) AS dated, count(e.vec_id) AS embedded FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.lang"""
)
def stats_per_type(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left")
    return docs.groupBy(F.col("lang").alias("type")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") > 500).alias("dated"), F.count("has").alias("embedded"))


# ---- ingestion: versions of documents


_OLD = "old AS (SELECT doc_id::VARCHAR AS k, sha1(text) AS h FROM documents WHERE lang <> 'es')"
_NEW = "new AS (SELECT doc_id::VARCHAR AS k, sha1(replace(text, 'License', 'Licence')) AS h FROM documents WHERE source <> 'src1')"


@query(
    f"""WITH {_OLD}, {_NEW} SELECT CASE WHEN old.k IS NULL THEN 'new' WHEN new.k IS NULL THEN 'kept' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS outcome, count(*) AS n
FROM old FULL JOIN new ON old.k = new.k GROUP BY 1"""
)
def upsert_classify(spark: SparkSession, d: str) -> DataFrame:
    """Documents met again: those without Spanish as known, those of all but one source with another spelling as incoming."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "doc_id", "text", "lang", "source")
    old = docs.where("lang <> 'es'").withColumn("content_hash", F.sha1("text")).drop("lang", "source")
    new = docs.where("source <> 'src1'").withColumn("text", F.replace("text", F.lit("License"), F.lit("Licence"))).withColumn("content_hash", F.sha1("text")).drop("lang", "source")
    return store.upsert(old, new, datetime(2024, 1, 1, tzinfo=timezone.utc)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS stale FROM documents WHERE source = 'src2' OR contains(text, 'License') GROUP BY source")
def stale_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were never derived (one source), or from another text."""
    docs = table(spark, d, "documents").withColumn("content_hash", F.sha1("text"))
    derived = F.when(F.col("source") != "src2", F.sha1(F.replace("text", F.lit("License"), F.lit("Licence"))))
    return docs.withColumn("entities_hash", derived).where(stale("entities_hash", "content_hash")).groupBy("source").agg(F.count(F.lit(1)).alias("stale"))


@query(f"SELECT {HASHED} AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark: SparkSession, d: str) -> DataFrame:
    hashed = F.sha1(F.coalesce(text.normalize_whitespace("text"), F.lit("")))
    return table(spark, d, "documents").groupBy(hashed.alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_URL = f"""
u AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\\.', '') AS host,
             regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT page_id, 'https://' || lower(host) || path || coalesce('?' || nullif(array_to_string(list_filter(string_split(q, '&'),
        lambda p: p LIKE '_%=_%' AND NOT starts_with(p, 'utm_') AND string_split(p, '=')[1] NOT IN ({", ".join(f"'{t}'" for t in identity.TRACKING)})), '&'), ''), '') AS canonical FROM u)"""


@query(f"WITH {_URL} SELECT page_id, canonical FROM c")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", identity.canonical_url("url").alias("canonical"))


@query(f"WITH {_URL} SELECT canonical, min(page_id) AS page_id, count(*) AS pages FROM c GROUP BY canonical")
def page_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(identity.canonical_url("url").alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("pages"))


@query(f"WITH {_URL} SELECT page_id, array_to_string(string_split(lower(host), '.')[-2:], '.') AS domain FROM u")
def registered_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", identity.registered_domain("url").alias("domain"))


@query(
    """WITH t AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[^>]*>', ' ', 'g') AS h FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[\\s\\x{00a0}\\x{200b}\\x{200c}\\x{200d}\\x{feff}]+', ' ', 'g')) AS text FROM t"""
)
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("text"))


# ---- companies and rounds: customers, suppliers and orders in their place


@query("SELECT o_orderkey, o_custkey, c_name AS company, o_totalprice AS amount_usd FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def funding_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The largest orders, with their customers: the cut comes before the join."""
    best = table(spark, d, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("company"))
    return customers.join(F.broadcast(best), "o_custkey").select("o_orderkey", "o_custkey", "company", F.col("o_totalprice").alias("amount_usd"))


@query("SELECT c_custkey, any_value(c_name) AS company, count(o_orderkey) AS rounds, round(coalesce(sum(o_totalprice), 0), 2) AS total_usd FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def company_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("rounds"), F.round(F.sum("o_totalprice"), 2).alias("total_usd"))
    return table(spark, d, "customer").join(totals, "c_custkey", "left").select("c_custkey", F.col("c_name").alias("company"), F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("total_usd", F.lit(0.0)).alias("total_usd"))


@query("SELECT c_name AS company, o_orderkey, o_totalprice, o_orderdate, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = (SELECT min(o_custkey) FROM orders)")
def company_detail(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    first = F.broadcast(orders.agg(F.min("o_custkey").alias("c_custkey")))
    own = customer.join(first, "c_custkey").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(F.broadcast(own), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("company"), "o_orderkey", "o_totalprice", "o_orderdate", "n_name")


@query("SELECT c_custkey, c_name AS name, c_acctbal AS funding_total_usd FROM customer WHERE contains(lower(c_name), '00001') ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def companies_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("slug"), F.col("c_acctbal").alias("funding_total_usd"), F.lit(0).alias("document_count"))
    return companies.page(rows, "00001").select("c_custkey", "name", "funding_total_usd")


@query(
    """WITH comp AS (SELECT 'c-' || c_custkey AS slug, CASE WHEN c_nationkey < 8 THEN regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') ELSE '' END AS yc_slug,
  CASE WHEN c_nationkey BETWEEN 8 AND 15 THEN c_custkey || '.com' ELSE '' END AS domain, lower(c_mktsegment) || c_nationkey AS name_key FROM customer),
recs AS (SELECT s_suppkey AS id, 'customer' || lpad(s_suppkey::VARCHAR, 9, '0') AS yc_slug, s_suppkey || '.com' AS domain, 'building' || s_nationkey AS name_key FROM supplier),
nm AS (SELECT name_key, min(slug) AS slug, count(*) AS n FROM comp GROUP BY name_key)
SELECT r.id, coalesce(y.slug, d.slug, CASE WHEN nm.n = 1 THEN nm.slug END) AS slug, coalesce(nm.n > 1, false) AS ambiguous
FROM recs r LEFT JOIN (SELECT yc_slug, max(slug) AS slug FROM comp WHERE yc_slug <> '' GROUP BY 1) y ON r.yc_slug = y.yc_slug
LEFT JOIN (SELECT domain, max(slug) AS slug FROM comp WHERE domain <> '' GROUP BY 1) d ON r.domain = d.domain LEFT JOIN nm ON r.name_key = nm.name_key"""
)
def resolve_companies(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers matched to customers by slug, else domain, else a name that only one has."""
    c = table(spark, d, "customer")
    known = c.select(
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("slug"), F.when(F.col("c_nationkey") < 8, identity.name_key("c_name")).otherwise("").alias("yc_slug"),
        F.when(F.col("c_nationkey").between(8, 15), F.concat(F.col("c_custkey").cast("string"), F.lit(".com"))).otherwise("").alias("domain"), F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("name_key"),
    )
    key = F.col("s_suppkey").cast("string")
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("customer"), F.lpad(key, 9, "0")).alias("yc_slug"), F.concat(key, F.lit(".com")).alias("domain"), F.concat(F.lit("building"), F.col("s_nationkey").cast("string")).alias("name_key"))
    return companies.match(asked, known).select("id", "slug", "ambiguous")


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    key = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(
        key.alias("_id"), F.col("o_orderkey"), F.concat(F.lit("company "), F.col("o_custkey").cast("string")).alias("company"), F.col("o_custkey").cast("string").alias("company_key"), F.col("o_custkey").cast("string").alias("round_key"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("currency"), F.col("o_totalprice").alias("amount_usd"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("round"), none.alias("lead_investors"), none.alias("investors"),
        F.lit(None).cast("double").alias("valuation"), F.col("o_orderdate").cast("timestamp").alias("announced_at"), F.lit("high").alias("confidence"), F.array(key).alias("source_doc_ids"), F.array(F.col("o_orderpriority")).alias("publishers"), F.lit("v").alias("extraction_version"), F.col("o_orderdate").cast("timestamp").alias("extracted_at"),
    )


@query(
    """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, nullif(o_orderpriority, '5-LOW') AS round, o_orderstatus AS cur, o_totalprice AS x, o_orderdate AS t FROM orders)
SELECT a.k AS a, b.k AS b FROM r a JOIN r b ON a.c = b.c AND a.k < b.k
WHERE coalesce(a.round = b.round, true) AND abs(a.x - b.x) <= CASE WHEN a.cur <> b.cur THEN 0.2 ELSE 0.1 END * greatest(a.x, b.x) AND abs(epoch(a.t) - epoch(b.t)) <= 14 * 86400"""
)
def same_round_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one customer that could be one round: an equi-join on the key, the rest as its condition."""
    a, b = _rounds(spark, d).alias("a"), _rounds(spark, d).alias("b")
    return a.join(b, funding.same_round("a", "b") & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query()
def merge_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds after each was merged with the first kept one that matches; a replay, so there is no SQL for it."""
    merged = funding.merge(_rounds(spark, d))
    return merged.select("_id", "round_key", "amount_usd", "round", F.size("source_doc_ids").alias("sources"))


@query()
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events accepted at most twice in any day per user: a state machine, so there is no SQL for it."""
    return limits.limit_batch(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 86_400)


# ---- digest: parts as repositories, events as launches, orders as articles and rounds


START, END = datetime(2024, 1, 8, tzinfo=timezone.utc), datetime(2024, 1, 15, tzinfo=timezone.utc)
_PICK = """
launch AS (SELECT 'e' || event_id AS doc_id, 'launches' AS section, 0 AS s, row_number() OVER (ORDER BY floor(value) DESC, ts DESC, event_type, 'e' || event_id) AS pos FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' QUALIFY pos <= 10),
repo AS (SELECT 'p' || p_partkey AS doc_id, 'open_source' AS section, 2 AS s, row_number() OVER (ORDER BY p_size DESC, p_name || ' ' || p_partkey, 'p' || p_partkey) AS pos FROM part QUALIFY pos <= 5),
round AS (SELECT 'o' || o_orderkey AS doc_id, 'funding' AS section, 1 AS s, row_number() OVER (ORDER BY o_totalprice DESC, 'company ' || o_custkey, o_orderkey::VARCHAR) AS pos FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY pos <= 10),
picked AS (SELECT *, row_number() OVER (ORDER BY s, pos) AS n FROM (SELECT * FROM launch UNION ALL SELECT * FROM repo UNION ALL SELECT * FROM round))"""


def _digest_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    at = F.lit(datetime(2024, 1, 10, tzinfo=timezone.utc)).cast("timestamp")
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("doc_id"), F.lit("repo").alias("type"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("full_name"), F.col("p_size").cast("long").alias("stars"), at.alias("event_at"))
    posts = _events(spark, d).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("doc_id"), F.lit("launch").alias("type"), F.col("event_type").alias("title"), F.floor("value").alias("points"), F.col("ts").alias("event_at"))
    news = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.lit("article").alias("type"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), at.alias("event_at"))
    docs = doctext.with_fields(parts.unionByName(posts, allowMissingColumns=True).unionByName(news, allowMissingColumns=True))
    rounds = _rounds(spark, d).withColumn("source_doc_ids", F.array(F.concat(F.lit("o"), "_id"))).withColumn("announced_at", at).where("publishers[0] = '1-URGENT'")
    return docs.withColumn("content_hash", F.sha1("doc_id")), rounds


def _selection(spark: SparkSession, d: str) -> DataFrame:
    return digest.select_week(*_digest_inputs(spark, d), START, END)


@query(f"WITH {_PICK} SELECT section, doc_id, n FROM picked")
def digest_select(spark: SparkSession, d: str) -> DataFrame:
    return _selection(spark, d).select("section", "doc_id", F.col("n").cast("long").alias("n"))


@query(f"WITH {_PICK} SELECT sha1(string_agg(doc_id || ':' || sha1(doc_id), chr(10) ORDER BY doc_id || ':' || sha1(doc_id))) AS input_hash FROM picked")
def input_hash(spark: SparkSession, d: str) -> DataFrame:
    return digest.input_hash(_selection(spark, d))


@query(f"WITH {_PICK} SELECT section, string_agg(n::VARCHAR, ',' ORDER BY n) AS numbers FROM picked GROUP BY section")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = _selection(spark, d).groupBy("section").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    return rows.select("section", F.array_join(F.transform("ns", lambda n: n.cast("string")), ",").alias("numbers"))


@query(
    """SELECT section, count(*) AS bullets, 0 AS uncited_bullets, 0 AS invalid_citations FROM (WITH """
    + _PICK
    + """ SELECT section FROM picked) GROUP BY section"""
)
def digest_written(spark: SparkSession, d: str) -> DataFrame:
    """The digest written by the stand-in, and its citations checked: a cited bullet a source."""
    written = digest.write(digest.section_prompts(digest.sources(_selection(spark, d))))
    return written.select("section", *(F.col(c).cast("long").alias(c) for c in ("bullets", "uncited_bullets", "invalid_citations")))


_DIGESTS = """
weeks AS (SELECT '2024-W0' || k AS week, TIMESTAMP '2024-01-01' + INTERVAL 7 DAY * (k - 1) AS start FROM (SELECT unnest([2, 3, 4]) AS k)),
digests AS (SELECT week, least(10, (SELECT count(*) FROM events WHERE ts >= start AND ts < start + INTERVAL 7 DAY)) AS launches,
  CASE WHEN week = '2024-W02' THEN least(5, (SELECT count(*) FROM part)) + least(10, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')) ELSE 0 END AS others FROM weeks)"""


def _digests(spark: SparkSession, d: str) -> digest.DigestStore:
    """Digests of three weeks, each made twice: the second time nothing is written."""
    docs, rounds = _digest_inputs(spark, d)
    kept = digest.DigestStore(spark, f"{store.work_dir(spark)}/digests-{uuid.uuid4().hex}")
    for _ in range(2):
        for k in range(3):
            start = START + timedelta(days=7 * k)
            kept.make(docs, rounds, f"2024-W0{2 + k}", start, start + timedelta(days=7), END)
    return kept


@query(f"WITH {_DIGESTS} SELECT week, launches, launches + others AS bullets FROM digests ORDER BY week DESC")
def digest_list(spark: SparkSession, d: str) -> DataFrame:
    return _digests(spark, d).list().select("week", F.coalesce(F.col("counts")["launches"], F.lit(0).cast("long")).alias("launches"), "bullets")


@query(f"WITH {_DIGESTS} SELECT count(*) AS digests, sum(launches + others)::BIGINT AS bullets FROM digests")
def digest_totals(spark: SparkSession, d: str) -> DataFrame:
    return _digests(spark, d).summaries().agg(F.count(F.lit(1)).alias("digests"), F.sum("bullets").alias("bullets"))


@query(
    """SELECT day, type, count(*) AS n, max(v)::BIGINT AS most FROM (SELECT DATE '2024-01-10' AS day, 'repo' AS type, p_size AS v FROM part UNION ALL SELECT DATE '2024-01-10', 'launch', floor(value) FROM events WHERE value IS NOT NULL) GROUP BY ALL"""
)
def metric_snapshots(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("repo").alias("type"), F.col("p_size").cast("long").alias("stars"))
    posts = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.lit("launch").alias("type"), F.floor("value").alias("points"))
    taken = store.snapshots(parts.unionByName(posts, allowMissingColumns=True), date(2024, 1, 10))
    return taken.groupBy(F.col("date").alias("day"), "type").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("stars", "points")).alias("most"))


# ---- functions over whole tables


@query(
    """SELECT o_orderkey, round_even(o_totalprice * CASE o_orderstatus WHEN 'O' THEN 1.08 WHEN 'F' THEN 0.012 ELSE 1.0 END, 0) AS usd,
  substr(sha1(o_custkey || '|' || lower(o_orderpriority) || '|' || strftime(o_orderdate, '%Y-%m')), 1, 16) AS round_id FROM orders"""
)
def money_and_round_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    currency = F.when(F.col("o_orderstatus") == "O", "EUR").when(F.col("o_orderstatus") == "F", "INR").otherwise("USD")
    return o.select("o_orderkey", money.amount_usd("o_totalprice", currency).alias("usd"), identity.round_id(F.col("o_custkey").cast("string"), F.lower("o_orderpriority"), "o_orderdate").alias("round_id"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS name_key, regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g') AS topic FROM part")
def names_and_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", identity.name_key("p_name").alias("name_key"), topics.normalize_topic(F.concat_ws(" ", "p_type", "p_brand")).alias("topic"))


@query(
    """SELECT c_custkey, 'startup:manual:' || regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS doc_key, sha1(c_name || '. Located in ' || n_name) AS content_hash, c_name AS title
FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def prepared_documents(spark: SparkSession, d: str) -> DataFrame:
    """Customers as startups with keys, hashes of their indexable text, and titles."""
    nations = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("location")))
    fields = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("name"), "location")
    return store.prepare(fields, "startup", "manual").select("c_custkey", "doc_key", "content_hash", doctext.document_title().alias("title"))


@query(
    """SELECT event_id, epoch_us(ts)::BIGINT AS iso_us, (floor(epoch(ts)) * 1000000)::BIGINT AS unix_us, strftime(ts, '%G-W%V') AS week FROM events"""
)
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    iso, unix = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.unix_seconds("ts").cast("string")
    return e.select("event_id", F.unix_micros(dates.parse_datetime(iso)).alias("iso_us"), F.unix_micros(dates.parse_datetime(unix)).alias("unix_us"), dates.week_id("ts").alias("week"))
