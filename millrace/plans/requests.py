"""Requests with their bounds: what breaks them, and unknown fields, is an error before any plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from ..functions.doctext import TYPE_NAMES
from ..operators.trends import VELOCITY_METRIC


def _number(name: str, value: float | None, low: float, high: float = float("inf"), whole: bool = True) -> None:
    if value is None:
        return
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not low <= value <= high:
        raise ValueError(f"{name}: {low} to {high}")


def _text(name: str, value: str | None, most: int) -> None:
    if value is not None and (not isinstance(value, str) or len(value) > most):
        raise ValueError(f"{name}: at most {most} characters")


class _Request:
    @classmethod
    def parse(cls, raw: dict):
        if unknown := raw.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        return cls(**raw)


@dataclass(frozen=True)
class SimilarRequest(_Request):
    doc_id: str
    top_k: int = 5

    def __post_init__(self):
        _text("doc_id", self.doc_id, 64)
        _number("top_k", self.top_k, 1, 20)


@dataclass(frozen=True)
class DocumentsRequest(_Request):
    kind: str | None = None
    source: str | None = None
    since_days: int | None = None
    limit: int = 20
    offset: int = 0

    def __post_init__(self):
        if self.kind is not None and self.kind not in TYPE_NAMES:
            raise ValueError(f"kind: one of {TYPE_NAMES}")
        _text("source", self.source, 50)
        _number("since_days", self.since_days, 1, 365)
        _number("limit", self.limit, 1, 100)
        _number("offset", self.offset, 0, 10_000)


@dataclass(frozen=True)
class FundingRequest(_Request):
    since_days: int | None = None
    least_usd: float | None = None
    name: str | None = None
    limit: int = 20

    def __post_init__(self):
        _number("since_days", self.since_days, 1, 365)
        _number("least_usd", self.least_usd, 0, whole=False)
        _text("name", self.name, 20)
        _number("limit", self.limit, 1, 100)


@dataclass(frozen=True)
class CompaniesRequest(_Request):
    text: str | None = None
    sort: str = "funding"
    limit: int = 20
    offset: int = 0

    def __post_init__(self):
        _text("text", self.text, 100)
        if self.sort not in ("funding", "documents", "name"):
            raise ValueError("sort: funding, documents or name")
        _number("limit", self.limit, 1, 100)
        _number("offset", self.offset, 0, 10_000)


@dataclass(frozen=True)
class TrendsRequest(_Request):
    week: str
    limit: int = 20

    def __post_init__(self):
        if not isinstance(self.week, str) or not re.fullmatch(r"[0-9]{4}-W[0-9]{2}", self.week):
            raise ValueError("week: like 2026-W02")
        _number("limit", self.limit, 1, 100)


@dataclass(frozen=True)
class VelocityRequest(_Request):
    kind: str = "repo"
    days: int = 14
    limit: int = 20

    def __post_init__(self):
        if self.kind not in VELOCITY_METRIC:
            raise ValueError(f"kind: one of {sorted(VELOCITY_METRIC)}")
        _number("days", self.days, 2, 90)
        _number("limit", self.limit, 1, 100)
