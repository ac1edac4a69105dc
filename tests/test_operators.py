"""Operators on small tables: merges, stores, fusion, expansion, sources, streams and the whole pipeline."""

import json
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions.doctext import with_fields
from millrace.operators import bm25, companies, dense, digest, entities, evaluate, funding, fusion, graph, rag, search, store, trends
from millrace.operators.models import HashingEmbedder, PatternRecogniser, parse_json
from millrace.plans.api import Api, SearchRequest
from millrace.plans.pipeline import Pipeline
from millrace.sources import normalizers, registry, runner
from millrace.sources.base import get
from millrace.streaming import ingest, limits

NOW = datetime(2026, 9, 10, 12, tzinfo=timezone.utc)


def texts(spark, *rows):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "doc_id string, text string")


def test_bm25_counts_repeats_and_common_terms(spark):
    index = bm25.build(texts(spark, "alpha beta", "alpha gamma", "delta delta gamma", "", None, "the of"))
    assert index.corpus.first()["n"] == 4
    once = {r["doc_id"]: r["score"] for r in bm25.search(index, "delta").collect()}
    twice = {r["doc_id"]: r["score"] for r in bm25.search(index, "delta delta").collect()}
    assert list(once) == ["2"] and twice["2"] == pytest.approx(2 * once["2"])
    assert bm25.search(index, "alpha").count() == 0  # in exactly half of the documents: no weight
    assert bm25.search(index, "the").count() == 0


def test_filters_apply_before_the_cut(spark):
    index = bm25.build(texts(spark, *["x1 word"] * 3, "x1 other words here and more", *["filler"] * 9))
    allowed = spark.createDataFrame([("3",)], "doc_id string")
    assert [r["doc_id"] for r in bm25.search(index, "x1", 1, allowed=allowed).collect()] == ["3"]


def test_fusion_formula_and_ties(spark):
    a = spark.createDataFrame([("x", 9.0), ("y", 5.0)], "doc_id string, score double")
    b = spark.createDataFrame([("z", 0.9)], "doc_id string, score double")
    got = fusion.fuse({"keyword": a, "semantic": b}, weights={"semantic": 0.5}).collect()
    assert [r["doc_id"] for r in got] == ["x", "z", "y"]
    assert got[0]["rrf_score"] == pytest.approx(0.5 / 61) and got[0]["ranks"] == {"keyword": 1} and got[2]["ranks"] == {"keyword": 2}


def test_expansion_leaves_out_hubs_and_seeds(spark):
    rows = [("s", "e1"), ("a", "e1"), ("s", "e2"), ("a", "e2"), ("b", "e2"), *((f"h{i}", "hub") for i in range(30)), ("s", "hub"), ("s", "only")]
    edges = spark.createDataFrame([(d, e, e) for d, e in rows], "doc_id string, entity_id string, entity_text string")
    got = graph.expand(edges, spark.createDataFrame([("s",)], "doc_id string"), spark.createDataFrame([(100,)], "n long")).collect()
    assert [(r["doc_id"], r["shared"]) for r in got] == [("a", ["e1", "e2"]), ("b", ["e2"])]


def test_canonical_entities(spark):
    docs = spark.createDataFrame([("1", "article", [("OpenAI", "ORG", 2), ("Openai", "ORG", 1)]), ("2", "repo", [("OpenAI", "ORG", 3)])], f"doc_id string, type string, entities {entities.ENTITIES}")
    (r,) = entities.canonical(entities.mentions(docs)).collect()
    assert (r["entity_text"], r["mention_count"], r["document_count"]) == ("OpenAI", 6, 2)
    cleaned = docs.select(entities.clean_entities(F.expr("array(named_struct('entity_text', 'the Acme’s ', 'entity_type', 'ORG', 'count', 1), named_struct('entity_text', '42', 'entity_type', 'ORG', 'count', 1), named_struct('entity_text', 'AI', 'entity_type', 'ORG', 'count', 1), named_struct('entity_text', 'May', 'entity_type', 'DATE', 'count', 1))")).alias("e")).first()["e"]
    assert [x["entity_text"] for x in cleaned] == ["Acme"]
    assert entities.by_type(docs.where("doc_id = '1'")).first()["names"] == {"ORG": ["OpenAI", "Openai"]}


def test_only_stale_documents_are_extracted(spark):
    docs = spark.createDataFrame([("1", "Acme Corp", "h", "h"), ("2", "Beta Labs", "h", None), ("3", "Gamma", "h", "old")], "doc_id string, text string, content_hash string, entities_hash string")
    assert sorted(r["doc_id"] for r in entities.extract(docs).collect()) == ["2", "3"]


ROUND_ROW = dict(company="Acme", company_key="acme", round_key="acme", amount=1e6, currency="USD", amount_usd=1e6, round="seed", lead_investors=["A"], investors=["A"], valuation=None, announced_at=datetime(2026, 9, 1), confidence="medium", source_doc_ids=["1"], publishers=["p"], extraction_version="v", extracted_at=datetime(2026, 9, 2))


def rounds_of(spark, *changes):
    names = [f.split(" ")[0] for f in funding.ROUND.split(", ")]
    data = [{"_id": f"r{i}", **ROUND_ROW, "extracted_at": datetime(2026, 9, 2, i), "source_doc_ids": [str(i)], **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], funding.ROUND)


def test_rounds_merge_with_the_first_that_matches(spark):
    got = {r["_id"]: r for r in funding.merge(rounds_of(spark, {"round": None}, {"amount_usd": 1.05e6, "confidence": "high", "investors": ["B"]}, {"amount_usd": 2e6}, {"announced_at": datetime(2026, 10, 1)}, {"round_key": ""}, {"round_key": ""})).collect()}
    assert set(got) == {"r0", "r2", "r3", "r4", "r5"}
    assert got["r0"]["source_doc_ids"] == ["0", "1"] and got["r0"]["amount_usd"] == 1.05e6 and got["r0"]["confidence"] == "high" and got["r0"]["investors"] == ["A", "B"] and got["r0"]["round"] == "seed"


def test_taken_round_ids_are_salted(spark):
    got = funding.merge(rounds_of(spark, {"_id": "x"}, {"_id": "x", "amount_usd": 9e6})).collect()
    assert sorted(r["_id"][:2] for r in got) == ["x", "x-"]


def test_merging_again_changes_nothing(spark):
    once = funding.merge(rounds_of(spark, {}, {"amount_usd": 1.02e6}, {"round": "series a"}))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(funding.merge(once)) == rows(once)


def test_same_round_tolerances(spark):
    base = rounds_of(spark, {}).alias("a")
    for change, want in (({"amount_usd": 1.1e6}, 1), ({"amount_usd": 1.2e6}, 0), ({"amount_usd": 1.2e6, "currency": "EUR"}, 1), ({"round": "other"}, 0), ({"round": None}, 1), ({"announced_at": datetime(2026, 9, 15)}, 1), ({"announced_at": datetime(2026, 9, 16)}, 0), ({"amount_usd": None}, 1), ({"round_key": "b"}, 0)):
        assert base.join(rounds_of(spark, change).alias("b"), funding.same_round("a", "b")).count() == want, change


def test_extraction_and_purge(spark):
    rows = [("1", "article", "Acme raises $5M seed led by Big Fund", "Acme Robots", "h", None, None, NOW, "P", "s"), ("2", "article", "Weekly roundup: Acme raises $5M", "x", "h", None, None, NOW, "P", "s"), ("3", "article", "Beta raises €2.5 million", "x", "h", "h", funding.VERSION, NOW, "P", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, type string, title string, description string, content_hash string, funding_hash string, funding_extraction_version string, event_at timestamp, publisher string, source string")
    (r,) = funding.extract(docs).collect()
    assert (r["company"], r["amount_usd"], r["round"], r["confidence"], r["lead_investors"], r["source_doc_ids"]) == ("Acme", 5e6, "seed", "high", ["Big Fund"], ["1"])
    assert funding.extract(docs, force=True).count() == 2
    kept = funding.purge(rounds_of(spark, {"source_doc_ids": ["2"]}, {"source_doc_ids": ["1", "2"]}, {"source_doc_ids": ["9"]}), docs)
    assert sorted(x["_id"] for x in kept.collect()) == ["r1", "r2"]


STARTUP = "doc_id string, name string, yc_slug string, link string, website string, yc_batch string, location string, one_liner string, description string, tags array<string>, event_at timestamp"


def startup(i, name, slug=None, link=None):
    return (i, name, slug, link, None, "W24", "Paris", None, "d", ["t"], NOW)


def test_companies_from_startups_launches_and_rounds(spark):
    rows = [startup("1", "Acme", "acme"), startup("2", "Acme Inc", "acme", "https://acme.ai"), startup("3", "Acme Robotics", None, "https://www.acme.ai/x"), startup("4", "Candor"), startup("5", "Candor"), startup("6", "Solo", None, "https://github.com/solo")]
    launches = spark.createDataFrame([("l1", "ACME", None, None), ("l2", None, "https://acme.ai", None), ("l3", None, None, "Candor"), ("l4", None, None, "Solo")], "doc_id string, company_slug string, link string, company_name string")
    rounds = rounds_of(spark, {"company_key": "solo", "amount_usd": 5.0}, {"company_key": "candor"}, {"company_key": "fresh", "company": "Fresh", "amount_usd": None}, {"company_key": "solo", "confidence": "low"})
    got = {r["slug"]: r for r in companies.build(spark.createDataFrame(rows, STARTUP), launches, rounds).collect()}
    assert set(got) == {"yc-acme", "n-candor", "n-candor-5", "n-solo", "n-fresh"}
    assert got["yc-acme"]["doc_ids"] == {"startup": ["1", "2", "3"], "launch": ["l1", "l2"]} and got["yc-acme"]["domain"] == "acme.ai"
    assert (got["n-solo"]["rounds"], got["n-solo"]["funding_total_usd"], got["n-solo"]["document_count"]) == (["r0"], 5.0, 3)
    assert got["n-fresh"]["from_news_only"] and got["n-fresh"]["name"] == "Fresh" and got["n-candor"]["rounds"] == []


def test_upsert_outcomes(spark):
    old = spark.createDataFrame([("k1", "h1", "Old", 1, datetime(2026, 1, 1)), ("k2", "h2", "Same", 1, datetime(2026, 1, 1)), ("k3", "h3", "Absent", 1, datetime(2026, 1, 1))], "doc_key string, content_hash string, title string, stars int, first_seen_at timestamp").withColumn("last_seen_at", F.col("first_seen_at"))
    new = spark.createDataFrame([("k1", "h9", "New", 5), ("k2", "h2", "Other", 7), ("k4", "h4", "Fresh", 2), (None, "h", "x", 0)], "doc_key string, content_hash string, title string, stars int")
    got = {r["doc_key"]: r for r in store.upsert(old, new, NOW).collect()}
    assert {k: (r["outcome"], r["title"], r["stars"]) for k, r in got.items()} == {"k1": ("changed", "New", 5), "k2": ("unchanged", "Same", 7), "k3": ("kept", "Absent", 1), "k4": ("new", "Fresh", 2)}
    assert got["k1"]["first_seen_at"] == datetime(2026, 1, 1) and got["k4"]["first_seen_at"] == got["k2"]["last_seen_at"] != got["k3"]["last_seen_at"]
    again = store.upsert(store.upsert(old, new, NOW).drop("outcome"), new, NOW)
    assert {r["outcome"] for r in again.collect()} == {"unchanged", "kept"}


def test_versioned_tables_and_partitions(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() is None
    t.replace(spark.range(3))
    before = t.read()
    t.replace(spark.range(5))
    assert (t.version(), t.read().count(), before.count()) == (1, 5, 3)
    path = str(tmp_path / "p")
    rows = lambda *r: spark.createDataFrame(list(r), "week string, n int")
    store.replace_partitions(rows(("w1", 1), ("w2", 2)), path, "week")
    for _ in range(2):
        store.replace_partitions(rows(("w2", 3)), path, "week")
    assert sorted((r["week"], r["n"]) for r in spark.read.parquet(path).collect()) == [("w1", 1), ("w2", 3)]


def test_snapshots_migration_and_copies(spark, tmp_path):
    docs = spark.createDataFrame([("1", "repo", 5, None), ("2", "repo", None, None), ("3", "paper", 7, 3), ("4", "article", 9, 9)], "doc_id string, type string, stars long, upvotes long")
    got = {r["doc_id"]: r for r in store.snapshots(docs, date(2026, 9, 1)).collect()}
    assert set(got) == {"1", "3"} and got["3"]["stars"] is None and got["3"]["upvotes"] == 3
    all_, report, doubled = store.migrate({"startup": spark.createDataFrame([("Acme",), ("Acme Inc",)], "name string"), "repo": spark.createDataFrame([("a/b", "2026-01-01")], "full_name string, created_at string")})
    assert {(r["type"], r["total"], r["dated"]) for r in report.collect()} == {("startup", 2, 0), ("repo", 1, 1)} and doubled.count() == 1
    docs.write.parquet(str(tmp_path / "a/docs"))
    assert store.copy_tables(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["docs"]) == {"docs": 4}
    store.export_jsonl({"documents": docs}, str(tmp_path / "j"))
    assert store.import_jsonl(spark, str(tmp_path / "j"), "documents", "doc_id string, stars long").count() == 4
    edges = spark.createDataFrame([("1", "e"), ("9", "e")], "doc_id string, entity_id string")
    assert [r["doc_id"] for r in store.dangling(edges, docs).collect()] == ["9"]


def test_rising_and_velocity(spark):
    weekly = spark.createDataFrame([("a", "2026-W02", 9, None), ("a", "2026-W01", 4, None), ("b", "2026-W02", 1, None), ("c", "2026-W01", 5, None), ("d", "2026-W02", 3, None), *(("d", w, 3, None) for w in ("2026-W01", "2025-W52", "2025-W51", "2025-W50"))], "topic string, week string, doc_count long, by_type map<string,long>")
    got = {r["topic"]: (r["count"], r["baseline"], r["score"]) for r in trends.rising(weekly, "2026-W02").collect()}
    assert got == {"a": (9, 1.0, round(8 / 2**0.5, 3)), "d": (3, 3.0, 0.0)}
    assert trends.history(weekly, "2026-W02").first()["insufficient_history"] is False
    snaps = spark.createDataFrame([("x", date(2026, 9, 1), 100), ("x", date(2026, 9, 9), 400), ("y", date(2026, 9, 9), 5), ("z", date(2026, 9, 1), 1), ("z", date(2026, 9, 9), 5), ("w", date(2026, 8, 1), 0), ("w", date(2026, 9, 9), 900), ("v", date(2026, 9, 2), None), ("v", date(2026, 9, 9), 50)], "doc_id string, date date, stars long")
    assert [(r["doc_id"], r["gained"]) for r in trends.velocity(snaps, "stars", 20, date(2026, 9, 10)).collect()] == [("x", 300)]


def test_digest_takes_each_article_once(spark):
    rows = [(str(i), "article", f"Acme raises {i}", NOW) for i in range(3)] + [("r1", "repo", None, NOW), ("l1", "launch", "L", NOW)]
    docs = with_fields(spark.createDataFrame(rows, "doc_id string, type string, title string, event_at timestamp")).withColumn("content_hash", F.lit("h"))
    rounds = rounds_of(spark, {"amount_usd": 9e6, "source_doc_ids": ["x", "1", "0"], "announced_at": NOW.replace(tzinfo=None)}, {"amount_usd": 5e6, "source_doc_ids": ["1", "2"], "announced_at": NOW.replace(tzinfo=None)}, {"amount_usd": 1e6, "source_doc_ids": ["1"], "announced_at": NOW.replace(tzinfo=None)})
    start, end = datetime(2026, 9, 7, tzinfo=timezone.utc), datetime(2026, 9, 14, tzinfo=timezone.utc)
    got = digest.select_week(docs, rounds, start, end).orderBy("n").collect()
    assert [(r["section"], r["doc_id"], r["n"]) for r in got] == [("launches", "l1", 1), ("funding", "1", 2), ("funding", "2", 3), ("funding", "0", 4), ("open_source", "r1", 5)]
    made, how = digest.generate(docs, rounds, "2026-W37", start, end)
    assert how == "generated" and made["counts"] == {"launches": 1, "funding": 3, "open_source": 1} and made["warnings"] == {"invalid_citations": 0, "uncited_bullets": 0}
    stored = spark.createDataFrame([("2026-W37", made["input_hash"], made["prompt_version"])], "week string, input_hash string, prompt_version string")
    assert digest.generate(docs, rounds, "2026-W37", start, end, stored)[1] == "unchanged"
    assert digest.generate(docs.limit(0), rounds.limit(0), "2026-W37", start, end) == (None, "empty")


def test_ranking_metrics(spark):
    gains = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("r", "c", 1)], "query_id string, doc_id string, gain int")
    hits = spark.createDataFrame([("q", "x", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    got = {r["query_id"]: r for r in evaluate.ranking(hits, gains, 2).collect()}
    assert (got["q"]["p"], got["q"]["r"], got["q"]["mrr"]) == (0.5, 0.5, 0.5) and got["q"]["ndcg"] == pytest.approx((1 / 1.584962500721156) / (2 + 1 / 1.584962500721156))
    assert (got["r"]["ndcg"], got["r"]["mrr"]) == (0.0, 0.0)
    found, missing, doubled = evaluate.resolve_labels(spark.createDataFrame([("q", "T", 1), ("q", "gone", 1)], "query_id string, title string, gain int"), spark.createDataFrame([("1", "T"), ("2", "T")], "doc_id string, title string"))
    assert [r["doc_id"] for r in found.collect()] == ["2"] and missing.count() == 1 and doubled.count() == 1


def test_ladder_and_days():
    assert search.ladder("Paris", 7) == [("Paris", 7, None), (None, 7, "dropped_location"), (None, 28, "widened_window_to_28_days"), (None, None, "dropped_date")]
    assert search.ladder(None, 365) == [(None, 365, None), (None, None, "dropped_date")]
    assert [search.clamp_days(x) for x in (True, 7, "30", 9999, -1, "x", None, 2.5)] == [None, 7, 30, 365, None, None, None, 2]


def test_plans_survive_bad_planners():
    class Broken:
        def plan(self, question, history):
            raise RuntimeError

    class Odd:
        def plan(self, question, history):
            return {"intent": "?", "search_query": " ", "collection": "articles", "since_days": "9", "location": 5}

    assert rag.plan_query("q", planner=Broken()) == search.Plan("q")
    assert rag.plan_query("q", planner=Odd()) == search.Plan("q", kind="article", days=9)
    assert parse_json('```json\n{"a": 1}\n```') == {"a": 1}
    with pytest.raises(ValueError):
        parse_json("[1]")


def raw(spark, items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "value string")


def normal(spark, name, items):
    source = registry.build_sources()[name]
    return [r.asDict() for r in source.normalize(source.parse(raw(spark, items))).collect()]


def test_feeds_are_normalised(spark):
    feed = b"""<rss><channel><item><title>A\xc2\xa0B - The Paper</title><link>https://x/1</link><pubDate>Thu, 10 Sep 2026 10:00:00 GMT</pubDate><category>AI</category><category>Tech</category><description><![CDATA[<p>A B - The Paper</p>]]></description></item><item><title></title><link>y</link></item></channel></rss>"""
    entries = registry.parse_feed(feed)
    (r,) = normal(spark, "techcrunch_ai", entries)
    assert (r["title"], r["categories"], r["author"], r["publisher"], r["title_key"]) == ("A B - The Paper", ["AI", "Tech"], "Unknown", "techcrunch", "abthepaper")
    (r,) = normal(spark, "google_news", entries)
    assert (r["title"], r["publisher"], r["description"], r["title_key"]) == ("A B", "The Paper", "", "ab")
    got = {r["hn_id"]: r for r in normal(spark, "hn_launches", [{"objectID": "1", "title": "Show HN: Foo – an LLM tool", "points": 20}, {"objectID": "2", "title": "Show HN: Foo – an LLM tool", "points": 2}, {"objectID": "3", "title": "Show HN: A retail site", "points": 90}, {"objectID": "4", "title": "Launch HN: Bar (YC W24) – robots", "created_at_i": 5, "_kind": "Launch HN"}])}
    assert set(got) == {"1", "4"} and (got["4"]["title"], got["4"]["yc_batch"], got["4"]["launched_at"]) == ("Bar: robots", "W24", "5") and (got["1"]["company_name"], got["1"]["description"]) == ("Foo", "an LLM tool")
    repos = [{"full_name": "a/b", "name": "b", "stargazers_count": 5, "_window": "w"}, {"full_name": "A/B", "name": "b", "stargazers_count": 9, "_window": "w"}, {"full_name": "c/awesome-x", "name": "awesome x", "_window": "w"}, {"full_name": " ", "_window": "w"}]
    (r,) = normal(spark, "github_new", repos)
    assert (r["full_name"], r["stars"], r["description"]) == ("A/B", 9, "No description")
    (r,) = normal(spark, "hf_models", [{"id": "o/m", "tags": ["license:mit", "safetensors", "pytorch"], "likes": 3}, {"id": ""}])
    assert (r["organization"], r["name"], r["tags"], r["downloads"]) == ("o", "m", ["pytorch"], 0)
    (r,) = normal(spark, "hf_papers", [{"title": "P", "numComments": "4", "paper": {"id": "1.2", "upvotes": 10, "authors": [{"name": "X"}, {"name": ""}], "organization": {"name": "Org"}}}, {"title": "Q", "paper": {"id": "2", "upvotes": 9}}])
    assert (r["arxiv_id"], r["authors"], r["num_comments"], r["organization"]) == ("1.2", ["X"], 4, "Org")
    (r,) = normal(spark, "yc_oss", [{"id": 1, "name": "A", "slug": "A", "batch": "Winter 2024", "tags": ["AI"], "launched_at": 1700000000}, {"name": "B", "slug": "b", "batch": "W2024", "tags": ["Retail"]}, {"name": "C", "slug": "c", "batch": "2019", "tags": ["AI"]}])
    assert (r["yc_slug"], r["location"], r["launched_at"]) == ("a", "Unknown", "1700000000")
    (r,) = normal(spark, "yc_launches", [{"id": 1, "title": "T", "tagline": "An agent", "company": {"name": "N", "slug": "n"}}, {"id": 2, "title": "Shop", "company": {"tags": ["Retail"]}}])
    assert (r["company_url"], r["kind"]) == ("https://www.ycombinator.com/companies/n", "YC Launch")
    (r,) = normal(spark, "startupsavant", [{"html": "<h4>1. Acme</h4><ul><li>Location: Paris</li><li>Series A: $5M</li><li>Investors: X, Y and Z</li></ul><p>Robots. <a href='https://a'>Site</a></p><h4> </h4>"}])
    assert (r["name"], r["location"], r["funding"], r["investors"], r["link"]) == ("Acme", "Paris", "$5M", ["X", "Y", "Z"], "https://a")


def test_feed_runs_are_idempotent_and_isolated(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "documents"))
    source = registry.build_sources()["hf_models"]
    items = raw(spark, [{"id": "a/b", "likes": 1}, {"id": "c/d"}, {"id": ""}])
    runs = [runner.run_source(source, lambda: items, table, now=NOW) for _ in range(2)]
    assert [(r["fetched"], r["new"], r["unchanged"], r["skipped"]) for r in runs] == [(3, 2, 0, 1), (3, 0, 2, 1)]

    def broken():
        raise OSError("no network")

    assert runner.run_source(source, broken, table)["status"] == "failed" and table.read().count() == 2
    assert runner.run_source(source, lambda: items, table, dry_run=True)["new"] == 2 and table.version() == 1


def test_http_retries():
    import io
    import urllib.error

    calls, waits = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "", {}, None)
        return io.BytesIO(b"ok")

    assert get("http://x", {"a": 1}, opener=opener, wait=waits.append) == b"ok" and waits == [1, 2] and calls[0] == "http://x?a=1"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("k1", "h1", "T"), ("k2", "h2", "U")], "doc_key string, content_hash string, title string").write.parquet(source)
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    read = spark.readStream.schema("doc_key string, content_hash string, title string").parquet(source)
    for _ in range(2):
        ingest.upsert_stream(read, table, str(tmp_path / "cp")).awaitTermination(60)
    assert table.read().count() == 2
    events = [("u", datetime(2026, 1, 1, 0, 0, s)) for s in range(5)]
    spark.createDataFrame(events, "user string, ts timestamp").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "ev"))
    q = limits.limit_stream(stream, "user", "ts", 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["ts"].second, r["accepted"]) for r in spark.table("limited").collect()) == [(0, True), (1, True), (2, False), (3, False), (4, False)]


def test_pipeline_and_api(spark, tmp_path):
    path = str(tmp_path / "p")
    models = raw(spark, [{"id": "org/llm-a", "likes": 5, "createdAt": "2026-09-08T00:00:00Z", "pipeline_tag": "text-generation", "tags": ["agents"]}, {"id": "org/vision-b", "likes": 9, "createdAt": "2026-09-09T00:00:00Z"}])
    news = raw(spark, [{"title": "Acme raises $5M seed", "link": "https://n/1", "summary": "Acme Robots of Paris", "published": "2026-09-09T10:00:00Z", "tags": [{"term": "Robotics"}]}])
    sources = registry.build_sources()
    p = Pipeline(spark, path, today=NOW.date())
    for name, items in (("hf_models", models), ("techcrunch_ai", news)):
        assert runner.run_source(sources[name], lambda items=items: items, p.table("documents"), now=NOW)["status"] == "ok"
    record = p.run()
    assert record["status"] == "ok", record
    assert record["stages"]["entities"]["counts"]["extracted"] == 3 and record["stages"]["funding"]["counts"]["rounds"] == 1
    again = p.run(("refresh", "entities", "embed"))
    assert again["stages"]["entities"]["counts"]["extracted"] == 0 and again["stages"]["embed"]["counts"]["embedded"] == 0
    api = Api(p, NOW)
    (hit,) = api.search(SearchRequest("Acme robots", top_k=1)).collect()
    assert hit["type"] == "article" and "embedding" not in hit
    assert [r["type"] for r in api.search(SearchRequest("org", type="model")).collect()] == ["model", "model"]
    page, total = api.documents("model")
    assert [r["hf_id"] for r in page.collect()] == ["org/vision-b", "org/llm-a"] and total.first()["total"] == 2
    assert api.funding(least_usd=1e6).first()["company"] == "Acme" and api.companies("acm").first()["from_news_only"]
    assert api.meta()["counts"]["model"] == 2 and api.meta()["counts"]["paper"] == 0
    got = api.chat("Who raised the most in the last 7 days?")
    assert got["plan"].intent == "funding_ranking" and got["sources"][0]["n"] == 1 and "[1]" in got["answer"]
    one = page.first()["doc_id"]
    assert api.document(one)["hf_id"] == "org/vision-b" and api.similar(one).first()["hf_id"] == "org/llm-a"
    for missing in (lambda: api.document("none"), lambda: api.company("none"), api.digest, lambda: api.digest("2026-W01")):
        with pytest.raises(KeyError):
            missing()
    assert [p.digest()["digest"] for _ in range(2)] == ["stored", "unchanged"]
    (row,) = api.digests().collect()
    assert row["week"] == p.digest()["week"] and api.digest()["sections"][1]["bullets"] == 1 and row["bullets"] == sum(s["bullets"] for s in api.digest(row["week"])["sections"])
    (org,) = p.table("canonical_entities").read().where("entity_text = 'Acme Robots'").limit(1).collect() or [None]
    if org is not None:
        assert api.entity_documents(org["entity_id"]).first()["type"] == "article"
    for bad in ({"query": ""}, {"query": "q", "top_k": 99}, {"query": "q", "type": "x"}, {"query": "q", "extra": 1}):
        with pytest.raises(ValueError):
            SearchRequest.parse(bad)


def test_vectors_and_stand_ins(spark):
    e = HashingEmbedder(16)
    v = e.embed(["alpha beta", "", "passage: alpha beta"])
    assert v[0].tolist() == v[2].tolist() and not v[1].any() and abs(float((v[0] ** 2).sum()) - 1) < 1e-6
    df = spark.createDataFrame([([0.5, 0.25],)], "v array<float>")
    assert df.select(dense.decode(dense.encode("v")).alias("v")).first()["v"] == [0.5, 0.25]
    assert PatternRecogniser().entities("Acme Corp and Acme Corp of X") == [("Acme Corp", "ORG", 2), ("X", "ORG", 1)]
    assert normalizers.list_companies(None) == []


def test_rounds_match_as_the_columns_say(spark):
    """The replay's rule equals same_round, for every pair of a few hundred."""
    rng = random.Random(3)
    base = datetime(2026, 7, 1)
    changes = [{"round": rng.choice([None, "seed", "series a"]), "currency": rng.choice([None, "USD", "EUR"]), "amount_usd": rng.choice([None, 0.0, 1e6, 1.05e6, 1.15e6, 2e6]), "announced_at": rng.choice([None, base, base + timedelta(days=13), base + timedelta(days=30)])} for _ in range(24)]
    rounds = rounds_of(spark, *[c | {"_id": str(i)} for i, c in enumerate(changes)])
    want = {(r["x"], r["y"]) for r in rounds.alias("a").join(rounds.alias("b"), funding.same_round("a", "b")).select(F.col("a._id").alias("x"), F.col("b._id").alias("y")).collect()}
    rows_ = {r["_id"]: r.asDict() for r in rounds.collect()}
    assert {(a, b) for a in rows_ for b in rows_ if funding._first_match([rows_[a]], rows_[b]) == 0} == want and 50 < len(want) < 500
    assert funding._first_match([], rows_["0"]) is None


def test_articles_beyond_the_limit_are_read_later_and_failures_again(spark, tmp_path):
    class Shaky(funding.PatternExtractor):
        def extract(self, title, text):
            if "Fails" in title:
                raise RuntimeError("no reply")
            return super().extract(title, text)

    rows_ = [(str(i), "article", f"Firm{chr(65 + i)} raises ${i + 1}M" if i < 5 else "Fails raises $9M" if i == 5 else "Nothing to see", "", f"h{i}", None, None, NOW - timedelta(hours=i), "P", "s") for i in range(8)]
    docs = spark.createDataFrame(rows_, "doc_id string, type string, title string, description string, content_hash string, funding_hash string, funding_extraction_version string, event_at timestamp, publisher string, source string")
    p = Pipeline(spark, str(tmp_path), extractor=Shaky(), funding_limit=2)
    p._save("documents", docs)
    counts = [p.funding() for _ in range(4)]
    assert [c["rounds"] for c in counts] == [2, 4, 5, 5] and [c["read"] for c in counts] == [2, 2, 1, 0] and [c["failed"] for c in counts] == [0, 0, 1, 1]
    marked = {r["doc_id"]: r["funding_hash"] for r in p.documents().collect()}
    assert marked == {str(i): None if i == 5 else f"h{i}" for i in range(8)}


def test_kept_rounds_are_found_by_cells(spark):
    """The replay finds what a scan of all kept records finds; the first instant of all is a date like any other."""
    rng = random.Random(11)
    kept, plain = funding._Kept(), []
    for i in range(1500):
        day = rng.choice([None, *(rng.randrange(-86_400_000_000 * 300, 86_400_000_000 * 300) for _ in range(15))])
        r = dict(_id=str(i), round=rng.choice([None, "seed", "series a", "series b"]), currency=rng.choice(["USD", "EUR"]), amount_usd=rng.choice([None, -1.0, *(10 ** rng.uniform(5, 7) for _ in range(15))]), announced_at=day, confidence=rng.choice(["low", "high"]), amount=None, valuation=None, company="c", **{f: [str(i)] for f in funding.LISTS})
        at = next((n for n, k in enumerate(kept.rows) if not funding._apart(k, r, kept.SPAN)), None)
        assert kept.find(r) == at
        plain.append(at)
        kept.add(r, True)
    assert 100 < plain.count(None) < 1400 and len(kept.rows) == plain.count(None)
    far = funding.merge(rounds_of(spark, {"announced_at": datetime(1970, 1, 1)}, {"announced_at": datetime(1970, 3, 1)}))
    assert far.count() == 2


def test_placed_rounds_equal_a_replay_of_all(spark):
    """Articles that many rounds share, sets of them in any order, rows in many partitions."""
    for seed, cap in ((1, 10), (2, 4), (3, 10), (4, 60)):
        rng = random.Random(seed)
        rows = [(f"r{i}", rng.choice([None, float("nan"), *map(float, range(40))]), rng.choice(["a", "b", None]), "s", [f"d{rng.randrange(15)}" for _ in range(rng.randrange(1, 4))] if rng.random() < 0.9 or seed == 3 else [f"own{i}"]) for i in range(600)]
        few = spark.createDataFrame(rows, "_id string, amount_usd double, company string, round_summary string, ids array<string>").repartition(5)
        taken, want = set(), []
        known = lambda x: x is not None and x == x
        for id_, usd, company, _, ids in sorted(rows, key=lambda r: (not known(r[1]), -r[1] if known(r[1]) else 0, r[2] is None, r[2] or "", r[0])):
            doc = next((d for d in ids if d not in taken), None)
            if doc is not None and len(want) < cap:
                taken.add(doc)
                want.append((doc, len(want) + 1, usd if known(usd) else 0.0))
        got = digest._first_placed(few, cap)
        assert sorted((r["doc_id"], r["pos"], r["round_amount_usd"]) for r in got.collect()) == sorted(want)
    # what reaches the last task doesn't grow with the rounds
    many = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("_id"), F.col("id").cast("double").alias("amount_usd"), F.lit("c").alias("company"), F.lit("s").alias("round_summary"), F.array(F.concat(F.lit("d"), F.col("id") % 7)).alias("ids"))
    assert digest._first_placed(many, 10).count() == 7


def test_hubs_go_by_a_bound_that_repeats_do_not_raise(spark):
    """An entity of 25 documents whose edges repeat counts, one of 26 does not, and the bound lies between half the degree and the degree."""
    rows = [(d, e) for e, n in (("kept", 25), ("hub", 26), ("large", 400)) for d in range(n) for _ in range(3)]
    edges = spark.createDataFrame(rows, "doc_id long, entity_id string").withColumn("entity_text", F.col("entity_id"))
    bound = {r["entity_id"]: r["n"] for r in edges.groupBy("entity_id").agg(graph._distinct_at_least("doc_id", 25).alias("n")).collect()}
    assert 12 < bound["kept"] <= 25 and bound["hub"] <= 26 and bound["large"] > 25
    found = graph.expand(edges, spark.createDataFrame([(0,)], "doc_id long"), spark.range(1).select(F.lit(400).alias("n")), 50)
    assert {r["doc_id"] for r in found.collect()} == set(range(1, 25)) and {x for r in found.collect() for x in r["shared"]} == {"kept"}


def test_bm25_counts_tokens_where_rows_are_read(spark):
    """Tokens aren't shuffled by document, and are those of tokenize(); rows with one id and length are one document."""
    from millrace.functions.text import tokenize

    texts = ["The C++ of node.js -- gpt-4... the. .a. A", "İstanbul Kelvin CAFÉ x1 x1 x.", "...", "  ", None, "one two two - three."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("type", F.lit("t"))
    index = bm25.build(docs)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    want = docs.where("trim(text) <> ''").select("doc_id", F.explode(tokenize("text")).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    assert sorted(map(tuple, index.postings.select("term", "doc_id", "tf").collect())) == sorted(map(tuple, want.collect()))
    assert {r["doc_id"]: r["length"] for r in index.lengths.collect()} == {r[0]: r[1] for r in docs.where("trim(text) <> ''").select("doc_id", F.size(tokenize("text"))).collect()}
    twice = bm25.build(docs.union(docs))
    assert twice.corpus.first()["n"] == 4 and {r["tf"] for r in twice.postings.where("term = 'x1'").collect()} == {4}
