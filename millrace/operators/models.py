"""Models behind small interfaces, with deterministic stand-ins that need no network.

The stand-ins let every relational step be checked; they claim no quality of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol

import numpy as np


class Recogniser(Protocol):
    def entities(self, text: str) -> list[tuple[str, str, int]]:
        """(text, type, count) of the entities of a text."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str], prefix: str) -> np.ndarray:
        """A unit row a text; zeros for blank texts."""


class LanguageModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class PatternRecogniser:
    """Capitalised runs as organisations, by a pattern; first occurrence first."""

    PATTERN = re.compile(r"\b[A-Z][\w&.-]*(?: [A-Z][\w&.-]*)*")

    def entities(self, text: str) -> list[tuple[str, str, int]]:
        counts: dict[str, int] = {}
        for m in self.PATTERN.finditer(text or ""):
            counts[m.group()] = counts.get(m.group(), 0) + 1
        return [(t, "ORG", n) for t, n in counts.items()]


class HashingEmbedder:
    """Signed feature hashing of words, to unit length; the prefix is added unless the text has it."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str], prefix: str = "passage: ") -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            if not (text or "").strip():
                continue
            text = text if text.startswith(prefix) else prefix + text
            for word in re.findall(r"\w+", text[len(prefix) :].lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
            size = np.linalg.norm(row)
            if size:
                row /= size
        return out

    def query(self, text: str) -> list[float]:
        return self.embed([text], "query: ")[0].tolist()


class ExtractiveWriter:
    """Writes a bullet for each numbered source of a prompt, with its citation."""

    def generate(self, prompt: str) -> str:
        return "\n".join(f"- {m[2].strip()} [{m[1]}]" for m in re.finditer(r"(?m)^\[(\d+)\] (.*)$", prompt))


def parse_json(text: str) -> dict:
    """A model's JSON reply, with or without a code fence; ValueError for anything but an object."""
    text = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"no JSON: {e}") from None
    if not isinstance(value, dict):
        raise ValueError("no JSON object")
    return value
