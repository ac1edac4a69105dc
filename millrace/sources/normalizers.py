"""Raw feed items to document fields: projections and filters, one function a feed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import name_key
from ..functions.text import first_nonblank, normalize_whitespace, strip_html

#: Words that make a launch, a post or a company one about AI. Whole words: "Retail" has one inside.
POST_WORDS = (
    r"(?i)\b(ai|llm|llms|gpt|gpt-\d|agent|agents|agentic|ml|rag|copilot|chatbot|"
    r"neural|transformer|diffusion|embedding|embeddings|vector|openai|claude|"
    r"gemini|llama|mistral|ollama|whisper|voice ai|ai-powered|ai-native)\b"
)
LAUNCH_WORDS = (
    r"(?i)\b(ai|llm|llms|gpt|agent|agents|ml|machine learning|rag|copilot|"
    r"chatbot|neural|model|models|automation|autonomous)\b"
)
COMPANY_WORDS = r"(?i)\b(ai|artificial intelligence|machine learning|generative ai|nlp|computer vision|llm|aiops|ai-powered|deep learning)\b"
#: Tags that tell of packaging, not of the model.
NOISE_PREFIXES = ("license:", "region:", "arxiv:", "dataset:", "base_model:", "doi:")
NOISE_TAGS = ("endpoints_compatible", "safetensors", "eval-results", "autotrain_compatible", "text-generation-inference", "custom_code", "has_space", "model-index")

RSS = "title string, link string, published string, updated string, summary string, content array<struct<value:string>>, author string, tags array<struct<term:string>>"
HN = "objectID string, title string, url string, points bigint, num_comments bigint, author string, created_at string, created_at_i bigint, story_text string, _kind string"
GITHUB = "name string, full_name string, description string, html_url string, stargazers_count bigint, forks_count bigint, watchers_count bigint, open_issues_count bigint, language string, topics array<string>, owner struct<login:string,type:string>, created_at string, updated_at string, pushed_at string, homepage string, fork boolean, _window string"
HF_MODEL = "id string, modelId string, likes bigint, trendingScore bigint, downloads bigint, tags array<string>, pipeline_tag string, library_name string, createdAt string"
HF_PAPER = "title string, summary string, publishedAt string, numComments string, paper struct<id:string,title:string,summary:string,ai_summary:string,ai_keywords:array<string>,authors:array<struct<name:string>>,organization:string,githubRepo:string,githubStars:bigint,upvotes:bigint,publishedAt:string,submittedOnDailyAt:string>"
YC_COMPANY = "id bigint, name string, slug string, batch string, one_liner string, long_description string, all_locations string, tags array<string>, industries array<string>, industry string, subindustry string, regions array<string>, team_size bigint, status string, stage string, isHiring boolean, launched_at bigint, website string"
YC_LAUNCH = "id bigint, title string, tagline string, slug string, created_at string, total_vote_count bigint, search_path string, company struct<name:string,url:string,slug:string,tags:array<string>,batch:string,industry:string,subindustry:string>"
PAGE = "html string"
STRINGS = "array<string>"


def _text(c: Column | str) -> Column:
    """Normalised text, empty for null."""
    return F.coalesce(normalize_whitespace(c), F.lit(""))


def _or(c: Column | str, default: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(c != "", c), F.lit(default))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _list(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(STRINGS))


def looks_ai(*values: Column) -> Column:
    """Whether a tag or an industry has a word of AI."""
    items = F.concat(*(_list(v) for v in values))
    return F.exists(items, lambda x: F.coalesce(x.rlike(COMPANY_WORDS), F.lit(False)))


def batch_year(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(20\d\d)", 1).try_cast("int")


def clean_tags(c: Column | str) -> Column:
    packaging = lambda t: t.isin(*NOISE_TAGS) | t.rlike("^(" + "|".join(NOISE_PREFIXES) + ")")
    return F.filter(_list(c), lambda t: t.isNotNull() & ~packaging(t))


def rss(tag: str):
    """Entries of a news feed; those without title or link go."""

    def run(raw: DataFrame) -> DataFrame:
        summary = first_nonblank(F.col("summary"), F.try_element_at("content", F.lit(1))["value"])
        terms = F.filter(F.transform(F.col("tags"), lambda t: t["term"]), lambda t: F.coalesce(t, F.lit("")) != "")
        out = raw.select(
            _text("title").alias("title"), F.trim(F.coalesce("link", F.lit(""))).alias("article_url"), first_nonblank(F.col("published"), F.col("updated")).alias("published_date"),
            strip_html(summary).alias("description"), _or(_text("author"), "Unknown").alias("author"), _list(terms).alias("categories"), F.lit(tag).alias("publisher"),
        )
        return out.where("title <> '' AND article_url <> ''").withColumn("title_key", name_key("title"))

    return run


def google_news(raw: DataFrame) -> DataFrame:
    """News search: the publisher stands behind the title; a description that repeats the title is dropped."""
    suffix = r"(?U)\s+-\s+([^-]{2,60})$"
    out = rss("googlenews")(raw).withColumn("_by", F.trim(F.regexp_extract("title", suffix, 1)))
    out = out.withColumns({"publisher": F.when(F.col("_by") != "", F.col("_by")).otherwise(F.col("publisher")), "title": F.trim(F.regexp_replace("title", suffix, ""))})
    echo = F.col("description").startswith(F.substring("title", 1, 30))
    return out.withColumns({"title_key": name_key("title"), "description": F.when(echo, "").otherwise(F.col("description"))}).drop("_by")


def without_known_titles(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Articles whose title no other source has."""
    other = known.where("type = 'article' AND title_key <> ''").select("title_key", F.col("source").alias("_other")).distinct()
    return docs.join(other, (docs.title_key == other.title_key) & (docs.source != F.col("_other")), "left_anti")


def hacker_news(raw: DataFrame, least_points: int = 10) -> DataFrame:
    """Posts of launches: "Launch HN" of companies always, "Show HN" with enough points and a word of AI."""
    title = _text("title")
    kind = first_nonblank(F.col("_kind"), F.when(F.lower(title).startswith("launch hn"), "Launch HN").otherwise("Show HN"))
    out = raw.withColumns({"_title": F.trim(F.regexp_replace(title, r"(?i)^(show|launch)\s+hn\s*:\s*", "")), "_raw": title, "kind": kind, "points": _zero("points")})
    launch = r"(?U)^(.+?)\s*\((YC\s+[A-Z]?\d{2,4}|YC\s+\w+\s*\d{4})\)\s*[–—:-]?\s*(.*)$"
    is_launch = F.col("kind") == "Launch HN"
    part = lambda n: F.trim(F.regexp_extract("_title", launch, n))
    pair = r"(?U)^(.*?)\s+[–—-]\s+(.*)$"
    company = F.when(is_launch, part(1)).otherwise(F.trim(F.regexp_extract("_title", pair, 1)))
    tagline = F.when(is_launch, part(3)).otherwise(F.trim(F.regexp_extract("_title", pair, 2)))
    named = F.when(is_launch & (company != ""), F.when(tagline != "", F.concat(company, F.lit(": "), tagline)).otherwise(company)).otherwise(F.col("_title"))
    link = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("objectID"))
    kept = out.where((F.col("_raw") != "") & (F.coalesce("objectID", F.lit("")) != "") & (is_launch | ((F.col("points") >= least_points) & F.col("_title").rlike(POST_WORDS))))
    return kept.select(
        named.alias("title"), first_nonblank(F.substring(strip_html("story_text"), 1, 1500), tagline).alias("description"), F.col("objectID").alias("hn_id"), link.alias("hn_url"),
        first_nonblank(F.trim("url"), link).alias("url"), company.alias("company_name"), F.when(is_launch, F.trim(F.regexp_replace(part(2), "YC", ""))).otherwise("").alias("yc_batch"),
        F.array().cast(STRINGS).alias("tags"), "points", _zero("num_comments").alias("num_comments"), F.coalesce("author", F.lit("")).alias("author"),
        first_nonblank(F.col("created_at"), F.col("created_at_i").cast("string")).alias("launched_at"), F.lit("hn").alias("platform"), "kind",
    )


def github(raw: DataFrame, cap: int = 60) -> DataFrame:
    """Repositories: of each window the most starred, each once; link collections ("awesome") go."""
    from pyspark.sql import Window

    stars = _zero("stargazers_count")
    named = raw.where(F.trim(F.coalesce("full_name", F.lit(""))) != "").withColumn("_key", F.lower(F.trim("full_name")))
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy("_window", "_key").orderBy(F.desc(stars)))).where("_n = 1")
    best = once.withColumn("_n", F.row_number().over(Window.partitionBy("_window").orderBy(F.desc(stars), "_key"))).where(F.col("_n") <= cap)
    awesome = F.coalesce("name", F.lit("")).rlike(r"(?i)\bawesome\b") | F.substring(F.coalesce("description", F.lit("")), 1, 80).rlike(r"(?i)\bawesome\b")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return best.where(~awesome).select(
        blank("name").alias("name"), F.trim("full_name").alias("full_name"), _or("description", "No description").alias("description"), blank("html_url").alias("html_url"),
        stars.alias("stars"), _zero("forks_count").alias("forks"), _zero("watchers_count").alias("watchers"), _zero("open_issues_count").alias("open_issues"),
        _or("language", "Unknown").alias("primary_language"), _list("topics").alias("topics"), _or(F.col("owner.login"), "Unknown").alias("owner_name"), _or(F.col("owner.type"), "Unknown").alias("owner_type"),
        blank("created_at").alias("created_at"), blank("updated_at").alias("updated_at"), blank("pushed_at").alias("pushed_at"), blank("homepage").alias("homepage"), F.coalesce("fork", F.lit(False)).alias("is_fork"),
    )


def hf_models(raw: DataFrame) -> DataFrame:
    """Trending models; those without an id go."""
    out = raw.withColumn("hf_id", F.trim(first_nonblank(F.col("id"), F.col("modelId")))).where("hf_id <> ''")
    return out.select(
        "hf_id", F.substring_index("hf_id", "/", -1).alias("name"), F.when(F.col("hf_id").contains("/"), F.substring_index("hf_id", "/", 1)).otherwise("").alias("organization"),
        F.coalesce("pipeline_tag", F.lit("")).alias("pipeline_tag"), F.coalesce("library_name", F.lit("")).alias("library_name"), clean_tags("tags").alias("tags"),
        _zero("likes").alias("likes"), _zero("downloads").alias("downloads"), _zero("trendingScore").alias("trending_score"), F.coalesce("createdAt", F.lit("")).alias("created_at"),
        F.concat(F.lit("https://huggingface.co/"), "hf_id").alias("url"),
    )


def hf_papers(raw: DataFrame, least_upvotes: int = 10) -> DataFrame:
    """Daily papers with enough upvotes, an id and a title."""
    p = lambda f: F.col(f"paper.{f}")
    authors = F.slice(F.filter(F.transform(p("authors"), lambda a: a["name"]), lambda a: F.coalesce(a, F.lit("")) != ""), 1, 12)
    organization = F.coalesce(F.get_json_object(p("organization"), "$.name"), F.get_json_object(p("organization"), "$.fullname"), F.when(~p("organization").startswith("{"), p("organization")), F.lit(""))
    out = raw.select(
        F.trim(F.coalesce(p("id"), F.lit(""))).alias("arxiv_id"), _text(first_nonblank(F.col("title"), p("title"))).alias("title"),
        _text(first_nonblank(p("ai_summary"), p("summary"), F.col("summary"))).alias("summary"), _text(first_nonblank(p("summary"), F.col("summary"))).alias("abstract"),
        _list(p("ai_keywords")).alias("keywords"), _list(authors).alias("authors"), organization.alias("organization"), F.coalesce(p("githubRepo"), F.lit("")).alias("github_repo"),
        F.coalesce(p("githubStars"), F.lit(0)).alias("github_stars"), F.coalesce(p("upvotes"), F.lit(0)).alias("upvotes"), F.coalesce(F.col("numComments").try_cast("bigint"), F.lit(0)).alias("num_comments"),
        first_nonblank(p("publishedAt"), F.col("publishedAt")).alias("published_at"), F.coalesce(p("submittedOnDailyAt"), F.lit("")).alias("submitted_at"),
    )
    kept = out.where((F.col("arxiv_id") != "") & (F.col("title") != "") & (F.col("upvotes") >= least_upvotes))
    return kept.withColumns({"url": F.concat(F.lit("https://huggingface.co/papers/"), "arxiv_id"), "arxiv_url": F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id")})


def yc_companies(raw: DataFrame, least_year: int = 2023, ai_only: bool = True) -> DataFrame:
    """Directory of companies: of AI, from batches since a year."""
    out = raw.where(batch_year("batch") >= least_year) if least_year else raw
    if ai_only:
        out = out.where(looks_ai(F.col("tags"), F.array("industry", "subindustry")))
    slug = F.lower(F.trim(F.coalesce("slug", F.lit(""))))
    kept = out.where((_text("name") != "") & (slug != ""))
    return kept.select(
        _text("name").alias("name"), first_nonblank(_text("long_description"), _text("one_liner")).alias("description"), _text("one_liner").alias("one_liner"), _or(_text("all_locations"), "Unknown").alias("location"),
        _or("batch", "Unknown").alias("yc_batch"), slug.alias("yc_slug"), F.col("id").alias("yc_id"), _list("tags").alias("tags"), _list("industries").alias("industries"), _list("regions").alias("regions"),
        "team_size", "status", "stage", F.coalesce("isHiring", F.lit(False)).alias("is_hiring"), F.col("launched_at").cast("string").alias("launched_at"),
        F.concat(F.lit("https://www.ycombinator.com/companies/"), slug).alias("company_url"), F.trim(F.coalesce("website", F.lit(""))).alias("link"),
    )


def yc_launches(raw: DataFrame) -> DataFrame:
    """Launches of companies of AI, or with a word of it in title or tagline."""
    c = lambda f: F.coalesce(F.col(f"company.{f}"), F.lit(""))
    said = F.concat_ws(" ", _text("title"), _text("tagline"))
    kept = raw.where((_text("title") != "") & F.col("id").isNotNull() & (looks_ai(F.col("company.tags"), F.array("company.industry", "company.subindustry")) | said.rlike(LAUNCH_WORDS)))
    slug = F.trim(F.coalesce("slug", F.lit("")))
    return kept.select(
        _text("title").alias("title"), _text("tagline").alias("description"), F.col("id").alias("yc_launch_id"), slug.alias("launch_slug"),
        first_nonblank(F.col("search_path"), F.concat(F.lit("https://www.ycombinator.com/launches/"), slug)).alias("url"), _text(c("name")).alias("company_name"), c("slug").alias("company_slug"),
        F.when(c("slug") != "", F.concat(F.lit("https://www.ycombinator.com/companies/"), c("slug"))).otherwise("").alias("company_url"), F.trim(c("url")).alias("link"), c("batch").alias("yc_batch"), c("industry").alias("industry"),
        _list("company.tags").alias("tags"), _zero("total_vote_count").alias("points"), F.col("created_at").alias("launched_at"), F.lit("yc").alias("platform"), F.lit("YC Launch").alias("kind"),
    )


class _Listing(HTMLParser):
    """h4 headings, each with the list and the paragraph that follow it on its level."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.into: list[str] | None = None
        self.href = False

    def handle_starttag(self, tag, attrs):
        if tag == "h4":
            self.found.append({"name": [], "items": [], "text": None, "link": "", "list": False})
            self.into = self.found[-1]["name"]
        elif self.found:
            now = self.found[-1]
            if tag == "ul":
                now["list"] = now["text"] is None
            elif tag == "li" and now["list"]:
                now["items"].append([])
                self.into = now["items"][-1]
            elif tag == "p" and now["text"] is None:
                now["text"], self.href = [], True
                self.into = now["text"]
            elif tag == "a" and self.href and not now["link"]:
                now["link"] = (dict(attrs).get("href") or "").strip()

    def handle_endtag(self, tag):
        if tag in ("h4", "li", "p"):
            self.into = None
            self.href = self.href and tag != "p"

    def handle_data(self, data):
        if self.into is not None:
            self.into.append(data)


def list_companies(page: str | None) -> list[dict]:
    """Companies of a listing page: headings with "Key: value" bullets and a paragraph."""
    parser = _Listing()
    parser.feed(page or "")
    out = []
    for f in parser.found:
        text = lambda parts: " ".join("".join(parts).split())
        name = re.sub(r"^\d+\.\s*", "", text(f["name"])).strip()
        if not name:
            continue
        row = {"name": name, "location": "Unknown", "funding": "Unknown", "investors": [], "description": text(f["text"]) if f["text"] is not None else "No description", "link": f["link"]}
        for item in map(text, f["items"]):
            value = item.partition(":")[2].strip() if ":" in item else item
            low = item.lower()
            if "location" in low:
                row["location"] = value
            elif "funding" in low or "series" in low or "$" in item:
                row["funding"] = value
            elif "investor" in low:
                row["investors"] = [x.strip() for x in re.split(r",|\band\b", value) if x.strip()]
        out.append(row)
    return out


def listing(raw: DataFrame) -> DataFrame:
    """Startups of listing pages (html); messy markup needs a parser, so this one runs in Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for page in pdf.html for r in list_companies(page)]
            yield pd.DataFrame(rows, columns=["name", "location", "funding", "investors", "description", "link"])

    return raw.select("html").mapInPandas(run, "name string, location string, funding string, investors array<string>, description string, link string")
