"""Expressions on single values, against values worked out by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import citations, dates, doctext, identity, money, text, topics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(value):
    return F.lit(value) if value is not None else F.lit(None).cast("string")


@pytest.mark.parametrize("value, want", [(None, None), ("", ""), (" a  b​\tc\n", "a b c")])
def test_whitespace(spark, value, want):
    assert one(spark, text.normalize_whitespace(lit(value))) == want


@pytest.mark.parametrize("value, want", [(None, ""), ("N/A", ""), ("none ", ""), ("[]", ""), (" x  y ", "x y")])
def test_clean(spark, value, want):
    assert one(spark, text.clean(lit(value))) == want


@pytest.mark.parametrize("value, want", [(None, []), ("", []), ("['a', \"b c\"]", ["a", "b c"]), ("[]", []), ("plain", ["plain"]), ("[1, 2]", ["1", "2"]), ("[broken", ["[broken"])])
def test_list_from_text(spark, value, want):
    assert one(spark, text.list_from_text(lit(value))) == want


@pytest.mark.parametrize("value, want", [(None, []), ("C++ and GPT-4 on node.js", ["c++", "gpt-4", "node.js"]), ("the. the x -a- b2", ["the", "b2"]), ("AI AI", ["ai", "ai"])])
def test_tokens(spark, value, want):
    assert one(spark, text.tokenize(lit(value))) == want


def test_strip_html(spark):
    assert one(spark, text.strip_html(F.lit("<p>a<script>x<y</script> b&nbsp;&amp;lt;</p><!-- c -->"))) == "a b &lt;"


@pytest.mark.parametrize(
    "value, want",
    [
        ("2025-11-13T15:02:11.764Z", "2025-11-13 15:02:11.764"),
        ("2025-11-13", "2025-11-13 00:00:00"),
        ("2025-11-13T15:02:11+02:00", "2025-11-13 13:02:11"),
        ("Thu, 13 Nov 2025 15:02:11 +0000", "2025-11-13 15:02:11"),
        ("Thu, 13 Nov 2025 15:02:11 GMT", "2025-11-13 15:02:11"),
        ("1700000000", "2023-11-14 22:13:20"),
        ("garbage", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, value, want):
    got = one(spark, dates.parse_datetime(lit(value)))
    assert got == (datetime.fromisoformat(want) if want else None)


@pytest.mark.parametrize("day, week", [("2026-01-05", "2026-W02"), ("2025-12-29", "2026-W01"), ("2027-01-01", "2026-W53"), ("2024-12-30", "2025-W01")])
def test_weeks(spark, day, week):
    assert one(spark, dates.week_id(F.lit(day).cast("date"))) == week == dates.week_of(date.fromisoformat(day))


def test_week_arithmetic():
    assert dates.previous_weeks("2026-W02", 3) == ["2026-W01", "2025-W52", "2025-W51"]
    start, end = dates.week_bounds("2026-W37")
    assert (start.isoformat(), (end - start).days) == ("2026-09-07T00:00:00+00:00", 7)
    assert dates.resolve_week("previous", date(2026, 1, 5)) == "2026-W01"
    with pytest.raises(ValueError):
        dates.resolve_week("2026-37")


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://WWW.Example.com/A/?utm_source=x&b=1&ref=q#top", "https://example.com/A?b=1"),
        ("https://example.com/", "https://example.com"),
        ("https://example.com/p?a=1&c=&d", "https://example.com/p?a=1"),
        ("https://example.com/p?q=a%20b", "https://example.com/p?q=a+b"),
        ("ftp://example.com", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, identity.canonical_url(lit(url))) == want


@pytest.mark.parametrize("name, want", [("Acme, Inc.", "acme"), ("Harvey AI", "harveyai"), ("The Exploration Company (TEC)", "theexplorationcompany"), ("Straße GmbH", "strasse"), ("Coco", "coco"), (None, "")])
def test_name_key(spark, name, want):
    assert one(spark, identity.name_key(lit(name))) == want


@pytest.mark.parametrize("url, want", [("https://www.app.acme.com/x", "acme.com"), ("http://a.b.co.uk", "b.co.uk"), ("https://github.com/x", ""), ("https://acme.io:8080/", "acme.io"), ("https://localhost/", ""), ("acme.com", ""), (None, "")])
def test_registered_domain(spark, url, want):
    assert one(spark, identity.registered_domain(lit(url))) == want


def test_slugs_and_rounds(spark):
    slug = lambda a, b, c: one(spark, identity.company_slug(F.lit(a), F.lit(b), F.lit(c)))
    assert (slug("x", "d.com", "k"), slug("", "d.co.uk", "k"), slug("", "", "k")) == ("yc-x", "d-d-co-uk", "n-k")
    assert [one(spark, identity.round_key(F.lit(k))) for k in ("mistralai", "ai", "xai", "openai")] == ["mistral", "ai", "xai", "open"]


@pytest.mark.parametrize("amount, currency, want", [(2.6e6, "EUR", 2808000.0), (47e7, "INR", 5640000.0), (5.0, "XXX", None), (None, "USD", None)])
def test_amount_usd(spark, amount, currency, want):
    assert one(spark, money.amount_usd(F.lit(amount).cast("double"), F.lit(currency))) == want


@pytest.mark.parametrize(
    "company, amount, said, want",
    [("Acme", 75e6, "acme raised $75 million", "high"), ("Acme", 75e6, "Acme raised a lot", "medium"), ("Acme", None, "Acme raised", "medium"), ("Acme", 75e6, "someone raised $75m", "low"), (None, 1.0, "x", "low"), ("A", 1.5e9, "A got 1.5bn", "high"), ("A", 75000.0, "A got 75,000", "high")],
)
def test_confidence(spark, company, amount, said, want):
    assert one(spark, money.confidence(lit(company), F.lit(amount).cast("double"), F.lit(said))) == want


@pytest.mark.parametrize("value, want", [("Series-A", "series a"), ("pre seed", "pre-seed"), ("SEED", "seed"), ("mega", "other"), (" ", None), (None, None), ("series_b", "series b")])
def test_round_names(spark, value, want):
    assert one(spark, money.round_name(lit(value))) == want


def test_titles(spark):
    funding = lambda t: one(spark, money.is_funding_title(F.lit(t)) & money.is_single_announcement(F.lit(t)))
    assert funding("Acme raises $5M") and not funding("Weekly roundup: who raised") and not funding("Acme in talks to raise") and not funding("Acme ships")


def test_round_summary(spark):
    df = spark.sql("SELECT 'Acme' AS company, 5000000D AS amount_usd, 5e6D AS amount, 'USD' AS currency, 'seed' AS round, array('X','Y') AS lead_investors, timestamp'2026-01-02' AS announced_at")
    assert df.select(money.round_summary().alias("s")).first()["s"] == "Acme raised $5,000,000 (seed) led by X, Y on 2026-01-02."
    bare = df.withColumns({"amount_usd": F.lit(0.0), "amount": F.lit(None).cast("double"), "round": lit(None), "lead_investors": F.array().cast("array<string>"), "announced_at": F.lit(None).cast("timestamp")})
    assert bare.select(money.round_summary().alias("s")).first()["s"] == "Acme raised an undisclosed amount."


@pytest.mark.parametrize("value, want", [("LLMs", "llm"), ("Large Language Models", "llm"), ("AI", ""), ("uk-startups", ""), ("  Graph DB ", "graph-db"), ("x", ""), (None, "")])
def test_topics(spark, value, want):
    assert one(spark, topics.normalize_topic(lit(value))) == want


def test_citations(spark):
    v = one(spark, citations.validate(F.lit("- a 【1】\n- b [7]\n- c\ntext [2]"), F.array(F.lit(1), F.lit(2))))
    assert (v["markdown"], v["bullets"], v["uncited_bullets"], v["invalid_citations"]) == ("- a [1]\n- b\n- c\ntext [2]", 3, 2, 1)


def _doc(spark, **fields):
    df = spark.range(1)
    for k, v in fields.items():
        df = df.withColumn(k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))
    return doctext.with_fields(df)


def test_document_texts(spark):
    say = lambda **f: _doc(spark, **f).select(doctext.document_text().alias("t")).first()["t"]
    assert say(type="startup", name="Acme", description="Robots", location="Paris", investors=["X", "Y"]) == "Acme. Robots. Located in Paris. Investors: X, Y"
    assert say(type="repo", full_name="a/b", description="nan", primary_language="Rust", stars=9) == "a/b. Written in Rust"
    assert say(type="launch", title="T", company_name="C", yc_batch="W24", platform="hn") == "T. Launched by C (YC W24). Posted on Hacker News as Show HN"
    assert say(type="model", hf_id="o/m", pipeline_tag="text-generation", tags=[str(i) for i in range(20)]) == "o/m. Task: text generation. Tags: 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11"
    assert say(type="unknown", name="N", summary="S") == "N. S"


def test_titles_urls_and_context(spark):
    df = _doc(spark, type="article", title="T", url="https://u", stars=0, points=5, publisher="P", source="s").withColumn("event_at", F.lit("2026-01-02").cast("timestamp"))
    row = df.select(doctext.document_title().alias("t"), doctext.document_url().alias("u"), doctext.document_context().alias("c"), doctext.label_for("type").alias("l")).first()
    assert tuple(row) == ("T", "https://u", "T\nDate: 2026-01-02 · Points: 5 · Publisher: P · Source: s", "News article")
    assert _doc(spark, type="model").select(doctext.document_title().alias("t")).first()["t"] == "Untitled model"


@pytest.mark.parametrize(
    "fields, want",
    [
        ({"type": "startup", "name": "Acme Inc", "source": "ycombinator"}, "startup:yc:acme"),
        ({"type": "startup", "name": "Acme", "company_url": "https://www.ycombinator.com/companies/Acme-2"}, "startup:yc:acme-2"),
        ({"type": "article", "article_url": "http://www.a.com/x/"}, "article:https://a.com/x"),
        ({"type": "article", "title": "Big News", "source": "Feed"}, "article:feed:bignews"),
        ({"type": "repo", "full_name": "A/B"}, "repo:gh:a/b"),
        ({"type": "launch", "platform": "hn", "hn_id": "7"}, "launch:hn:7"),
        ({"type": "paper", "arxiv_id": "1.2"}, "paper:arxiv:1.2"),
        ({"type": "model", "hf_id": " "}, None),
        ({"type": "startup"}, None),
    ],
)
def test_document_keys(spark, fields, want):
    assert _doc(spark, **fields).select(identity.doc_key().alias("k")).first()["k"] == want
