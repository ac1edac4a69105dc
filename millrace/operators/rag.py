"""From a question to a cited answer: plan, retrieval with relaxation, context, answer."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import normalize_citations
from ..functions.doctext import TYPES, document_context, document_title, document_url, label_for
from .funding import ranking
from .models import ExtractiveWriter, LanguageModel
from .search import MAX_DAYS, Engine, Plan, clamp_days, retrieve

BODY_CHARS, SNIPPET_CHARS, PLAN_TURNS, ANSWER_TURNS, FUNDING_DAYS = 900, 280, 4, 6, 90
INTENTS = ("search", "funding_ranking")


class Planner(Protocol):
    def plan(self, question: str, history: list[dict]) -> dict: ...


class RulePlanner:
    """Reads types, windows and rankings off a question's words; a stand-in for a language model."""

    def plan(self, question: str, history: list[dict]) -> dict:
        low = question.lower()
        days = re.search(r"last (\d+) days", low)
        kind = next((t.name for t in TYPES if re.search(rf"\b{t.name}s?\b", low)), None)
        place = re.search(r"\bin ([A-Z][\w]+(?: [A-Z][\w]+)*)", question)
        return {
            "intent": "funding_ranking" if re.search(r"raised the most|largest rounds?|biggest rounds?", low) else "search",
            "search_query": question, "type": kind, "location": place[1] if place else None,
            "since_days": days[1] if days else 7 if "this week" in low else None,
        }


def plan_query(question: str, history: list[dict] | None = None, planner: Planner | None = None) -> Plan:
    """A checked plan; whatever the planner gets wrong falls back to a plain search for the question."""
    try:
        raw = (planner or RulePlanner()).plan(question, [t for t in (history or [])[-PLAN_TURNS:] if t.get("content")])
    except Exception:  # any planner may fail; a search still works
        raw = {}
    text = lambda k: raw[k].strip() if isinstance(raw.get(k), str) and raw[k].strip() else None
    names = {t.name: t.name for t in TYPES} | {t.former: t.name for t in TYPES if t.former}
    return Plan(
        query=text("search_query") or question,
        intent=raw.get("intent") if raw.get("intent") in INTENTS else "search",
        kind=names.get(text("type") or text("collection") or ""),
        place=text("location"),
        days=clamp_days(raw.get("since_days")),
    )


def funding_sources(plan: Plan, rounds: DataFrame, docs: DataFrame, now: datetime, top_k: int) -> DataFrame:
    """Rounds by amount in the plan's window, 90 days if it has none, widened to a year where that is empty."""
    days = plan.days or FUNDING_DAYS
    found = ranking(rounds, docs, now - timedelta(days=days), top_k)
    plan.relaxations, plan.effective_days, plan.effective_place = [], days, None
    if days < MAX_DAYS and found.isEmpty():
        found = ranking(rounds, docs, now - timedelta(days=MAX_DAYS), top_k)
        plan.relaxations = [f"widened_window_to_{MAX_DAYS}_days"]
        plan.effective_days = None if found.isEmpty() else MAX_DAYS
    return found


def context(results: DataFrame, order: str = "rrf_score") -> DataFrame:
    """(n, doc_id, type, title, url, snippet, block) of hydrated results, best first, numbered from 1."""
    numbered = results.withColumn("n", F.row_number().over(Window.orderBy(F.desc(order), "doc_id")))
    out = numbered.withColumns({"_title": document_title("type"), "_url": document_url(), "_body": document_context("type", BODY_CHARS)})
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), label_for("type"), F.lit(": "), "_title", F.lit("\n"), "_body", F.when(F.col("_url") != "", F.concat(F.lit("\nSource URL: "), "_url")).otherwise(""))
    return out.select("n", "doc_id", "type", F.col("_title").alias("title"), F.col("_url").alias("url"), F.substring("_body", 1, SNIPPET_CHARS).alias("snippet"), block.alias("block"))


def recent_turns(chats: DataFrame, most: int = ANSWER_TURNS) -> DataFrame:
    """(conv_id, history): the last turns of each conversation with text, in order, one a line.

    The turns to show are found by an ordered aggregate of turn numbers and texts per conversation.
    """
    said = chats.where(F.coalesce("text", F.lit("")) != "")
    last = said.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_n") <= most)
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("history"))


def retrieval_note(plan: Plan, today: str) -> str:
    """What was searched, in words."""
    out = [f"Today is {today}."]
    if plan.intent == "funding_ranking":
        out.append("The sources are funding rounds sorted by amount, largest first; keep that order and the amounts.")
    if plan.days and plan.effective_days and plan.effective_days != plan.days:
        out.append(f"Nothing matched the last {plan.days} days; the sources cover the last {plan.effective_days} days.")
    elif plan.days and not plan.effective_days and plan.relaxations:
        out.append(f"Nothing matched the last {plan.days} days; the sources are undated or older.")
    elif plan.effective_days:
        out.append(f"The sources are from the last {plan.effective_days} days.")
    if plan.place and not plan.effective_place and plan.relaxations:
        out.append(f"No source matched the location {plan.place!r}.")
    return " ".join(out)


def answer(question: str, engine: Engine, rounds: DataFrame | None, now: datetime, top_k: int = 8, history: list[dict] | None = None, planner: Planner | None = None, writer: LanguageModel | None = None) -> dict:
    """Answer, sources (few, so collected) and plan of a question."""
    plan = plan_query(question, history, planner)
    if plan.intent == "funding_ranking" and rounds is not None:
        found = funding_sources(plan, rounds, engine.docs, now, top_k)
        docs = engine.docs.withColumn("doc_id", F.col("doc_id").cast("string")).drop("round_summary")
        results = docs.join(F.broadcast(found.select("doc_id", "round_summary", (-F.col("rank")).alias("rrf_score"))), "doc_id")
    else:
        results = retrieve(plan, lambda f: engine.search(plan.query, f, top_k), now)
    rows = context(results).orderBy("n").collect()
    if not rows:
        return {"answer": "Nothing in the indexed corpus matches that question.", "sources": [], "plan": plan}
    transcript = "\n".join(f"{t.get('role', 'user').capitalize()}: {t['content']}" for t in (history or [])[-ANSWER_TURNS:] if t.get("content"))
    prompt = "\n\n".join(x for x in (transcript, retrieval_note(plan, now.date().isoformat()), *(r["block"] for r in rows), f"Question: {question}") if x)
    text = (writer or ExtractiveWriter()).generate(prompt)
    cleaned = engine.docs.sparkSession.range(1).select(normalize_citations(F.lit(text)).alias("t")).first()["t"]
    return {"answer": cleaned, "sources": [{k: r[k] for k in ("n", "doc_id", "type", "title", "url", "snippet")} for r in rows], "plan": plan}
