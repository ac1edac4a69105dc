"""One spelling for the tags that sources carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Spellings that mean the same.
ALIASES = {
    "llms": "llm", "large-language-model": "llm", "large-language-models": "llm",
    "language-model": "llm", "language-models": "llm",
    "genai": "generative-ai", "gen-ai": "generative-ai",
    "artificial-intelligence": "ai", "machine-learning": "ml", "machinelearning": "ml",
    "agents": "agent", "ai-agent": "agent", "ai-agents": "agent", "agentic-ai": "agent",
    "agent-skill": "agent-skills", "skills": "agent-skills",
    "agentic": "agent", "llm-agent": "agent", "llm-agents": "agent", "multi-agent": "agent",
    "retrieval-augmented-generation": "rag", "rag-pipeline": "rag",
    "chat-gpt": "chatgpt", "gpt4": "gpt-4", "text-to-speech": "tts", "speech-to-text": "stt",
    "computer-vision": "vision", "cv": "vision",
    "developer-tools": "devtools", "dev-tools": "devtools", "developer-tool": "devtools",
    "opensource": "open-source",
    "fine-tuning": "finetuning", "fine-tune": "finetuning",
}
#: Topics that mean nothing in such a corpus.
STOP_TOPICS = (
    "ai", "python", "typescript", "javascript", "saas", "b2b", "b2c", "software", "startup",
    "startups", "technology", "tech", "platform", "app", "tool", "tools", "api", "data",
    "open-source", "ml", "deep-learning", "transformers", "pytorch", "safetensors",
    "region-us", "endpoints-compatible", "eval-results", "license-mit", "license-apache-2-0",
    "artificial-intelligence-ai", "news", "ai-news", "fundraising", "venture", "funding",
    "know-how", "text-generation", "text-to-text", "startups-news", "startup-news", "interviews",
    "events", "other", "misc", "uncategorized", "general", "featured", "europe",
)
#: Fixed value: publishers' section tags.
SECTION_TAG = r"^([a-z]+-)?startups?$|^[a-z]+-(news|startups|weekly)$"
#: Fields that hold a type's topics, in order.
TOPIC_FIELDS = {"repo": ("topics",), "model": ("tags", "pipeline_tag"), "paper": ("keywords",), "startup": ("tags", "industries"), "launch": ("tags",), "article": ("categories",)}


def normalize_topic(c: Column | str) -> Column:
    """A topic's slug after aliases; empty for null, for stop topics, section tags and single characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    aliases = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    topic = F.coalesce(F.try_element_at(aliases, slug), slug)
    return F.when((F.length(topic) < 2) | topic.isin(*STOP_TOPICS) | topic.rlike(SECTION_TAG), "").otherwise(topic)


def document_topics(kind: Column | str = "type") -> Column:
    """Distinct topics of a document in the order of its type's fields. Needs the fields of all types."""
    none = F.array().cast("array<string>")
    out = None
    for name, fields in TOPIC_FIELDS.items():
        values = F.concat(*(F.array(f) if f == "pipeline_tag" else F.coalesce(F.col(f), none) for f in fields))
        out = F.when(col(kind) == name, values) if out is None else out.when(col(kind) == name, values)
    return F.array_distinct(F.filter(F.transform(out.otherwise(none), normalize_topic), lambda t: t != ""))
