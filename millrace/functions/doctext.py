"""What a document says: type registry, indexable text, title, url, and context for answers.

All of it works on one wide table with the fields of every type; fields that a table lacks
are added as nulls by `with_fields`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean, clean_list, col, first_nonblank


@dataclass(frozen=True)
class DocType:
    """One kind of document: its name, labels for people and for the graph, a hint for planners, and a former name."""

    name: str
    label: str
    node: str
    hint: str
    former: str = ""


TYPES = (
    DocType("startup", "Startup", "Startup", "company profiles: name, description, place, batch, funding, investors", "startups"),
    DocType("article", "News article", "Article", "news: funding rounds, acquisitions, products, with publisher and date", "articles"),
    DocType("repo", "GitHub repository", "GitHubRepo", "open-source repositories: description, language, topics, stars", "github_repos"),
    DocType("launch", "Product launch", "Launch", "product launches: title, tagline, company, batch, points"),
    DocType("model", "Hugging Face model", "Model", "models: organisation, task, library, tags, likes, downloads"),
    DocType("paper", "Research paper", "Paper", "research papers: summary, keywords, authors, code"),
)
TYPE_NAMES = tuple(t.name for t in TYPES)

#: Fields of documents that text, keys and dates are made from.
FIELDS = {
    **dict.fromkeys(
        "name title full_name description summary location funding author primary_language company_name yc_batch platform kind hf_id organization pipeline_tag library_name github_repo "
        "link article_url html_url url homepage company_url source published_date published_at created_at launched_at publisher hn_id arxiv_id company_slug yc_slug round_summary one_liner".split(),
        "string",
    ),
    **dict.fromkeys("investors categories topics tags keywords authors industries".split(), "array<string>"),
    **dict.fromkeys("stars forks likes downloads points num_comments upvotes github_stars trending_score yc_launch_id".split(), "bigint"),
    "event_at": "timestamp",
}


def with_fields(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """df with the fields it lacks as typed nulls."""
    missing = {n: F.lit(None).cast(t) for n, t in (fields or FIELDS).items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def normalize_type(c: Column | str) -> Column:
    """A registered type from its own or its former name; null for anything else."""
    names = F.create_map(*(F.lit(x) for t in TYPES for pair in ((t.name, t.name), (t.former, t.name)) if pair[0] for x in pair))
    return F.try_element_at(names, F.trim(col(c)))


def label_for(c: Column | str) -> Column:
    """A type's label for people; unknown types show themselves, missing ones as "Document"."""
    labels = F.create_map(*(F.lit(x) for t in TYPES for x in (t.name, t.label)))
    return F.coalesce(F.try_element_at(labels, col(c)), F.when(col(c) != "", col(c)), F.lit("Document"))


def type_catalogue() -> str:
    """Types and hints, one a line, for planners."""
    width = max(map(len, TYPE_NAMES))
    return "\n".join(f"{t.name:<{width}}  {t.hint}" for t in TYPES)


def _said(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.when(value != "", F.concat(F.lit(prefix), value, F.lit(suffix)))


def _listed(prefix: str, field: str, most: int | None = None) -> Column:
    items = clean_list(field)
    return _said(prefix, F.array_join(F.slice(items, 1, most) if most else items, ", "))


def _parts() -> dict[str, list[Column]]:
    """Per type, the parts of its text in order; null or empty parts are left out."""
    company, batch = clean("company_name"), clean("yc_batch")
    launched = F.when((company != "") & (batch != ""), F.concat(F.lit("Launched by "), company, F.lit(" (YC "), batch, F.lit(")"))).when(company != "", F.concat(F.lit("Launched by "), company))
    posted = F.when(clean("platform") == "hn", F.concat(F.lit("Posted on Hacker News as "), first_nonblank(clean("kind"), F.lit("Show HN")))).when(clean("platform") == "yc", F.lit("Posted on Y Combinator Launches"))
    return {
        "startup": [clean("name"), clean("description"), _said("Located in ", clean("location")), _said("Funding: ", clean("funding")), _listed("Investors: ", "investors")],
        "article": [clean("title"), clean("description"), _said("By ", clean("author")), _listed("Topics: ", "categories")],
        "repo": [first_nonblank(clean("full_name"), clean("name")), clean("description"), _said("Written in ", clean("primary_language")), _listed("Topics: ", "topics")],
        "launch": [clean("title"), clean("description"), launched, _listed("Topics: ", "tags"), posted],
        "model": [first_nonblank(clean("hf_id"), clean("name")), _said("Published by ", clean("organization"), " on Hugging Face"), _said("Task: ", F.replace(clean("pipeline_tag"), F.lit("-"), F.lit(" "))), _said("Library: ", clean("library_name")), _listed("Tags: ", "tags", 12)],
        "paper": [clean("title"), clean("summary"), _listed("Keywords: ", "keywords"), _listed("Authors: ", "authors", 5), _said("Organization: ", clean("organization")), _said("Code: ", clean("github_repo"))],
        "": [clean(f) for f in ("name", "title", "full_name", "description", "summary")],
    }


def _by_type(kind: Column, values: dict[str, Column]) -> Column:
    out = None
    for name, value in values.items():
        if name:
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(values[""])


def resolved_type(kind: Column | str = "type") -> Column:
    return F.coalesce(normalize_type(kind), col(kind), F.lit(""))


def document_text(kind: Column | str = "type") -> Column:
    """Indexable text: identifying parts first, joined by full stops. Volatile numbers are left out on purpose."""
    joined = {name: F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ". ") for name, parts in _parts().items()}
    return _by_type(resolved_type(kind), joined)


def content_hash(kind: Column | str = "type") -> Column:
    """sha1 of the indexable text: "changed" means that it would be indexed differently."""
    return F.sha1(document_text(kind))


def document_title(kind: Column | str = "type") -> Column:
    first = lambda fields, none: first_nonblank(*map(clean, fields), F.lit(none))
    return _by_type(
        resolved_type(kind),
        {
            "startup": first(["name"], "Untitled startup"),
            "article": first(["title"], "Untitled article"),
            "repo": first(["full_name", "name"], "Untitled repository"),
            "launch": first(["title"], "Untitled launch"),
            "model": first(["hf_id", "name"], "Untitled model"),
            "paper": first(["title"], "Untitled paper"),
            "": first(["name", "title"], "Untitled"),
        },
    )


def document_url() -> Column:
    """The first web url among a document's links."""
    return first_nonblank(*(F.when(clean(f).startswith("http"), clean(f)) for f in ("link", "article_url", "html_url", "url", "homepage")))


#: Facts that are shown with a document but never indexed.
METRICS = (
    ("event_at", "Date"), ("stars", "GitHub stars"), ("forks", "Forks"), ("likes", "Likes"), ("downloads", "Downloads"), ("points", "Points"), ("num_comments", "Comments"),
    ("upvotes", "Upvotes"), ("github_stars", "Code stars"), ("funding", "Funding"), ("yc_batch", "YC batch"), ("publisher", "Publisher"), ("source", "Source"),
)


def document_context(kind: Column | str = "type", max_chars: int = 900) -> Column:
    """What an answer may be based on: a round's summary, the text's start, and the dated facts."""
    text = F.substring(document_text(kind), 1, max_chars)
    text = F.when(F.coalesce(F.col("round_summary"), F.lit("")) != "", F.concat(F.col("round_summary"), F.lit("\n"), text)).otherwise(text)
    facts = []
    for field, label in METRICS:
        value = F.date_format(field, "yyyy-MM-dd") if field == "event_at" else F.col(field).cast("string")
        shown = ~value.isin("", "0", "Unknown")
        if field == "funding":
            shown &= ~text.contains("Funding:")
        facts.append(F.when(shown, F.concat(F.lit(f"{label}: "), value)))
    line = F.array_join(F.array_compact(F.array(*facts)), " · ")
    return F.concat(text, F.when(line != "", F.concat(F.lit("\n"), line)).otherwise(""))
