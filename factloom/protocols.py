"""What a deployment plugs in: models, parsers and page readers; with offline stand-ins for tests."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Mapping, Sequence
from typing import Protocol


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class PageSource(Protocol):
    """Text per page of a document, and the recognition score of each page (None for digital pages)."""

    def pages(self, path: str) -> list[tuple[str, float | None]]: ...


class Planner(Protocol):
    def plan(self, question: str, tables: Sequence[str]) -> list[str]: ...


class HashingEmbedder:
    """A stand-in: words hashed into buckets, unit length."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for word in re.findall(r"\w+", text.lower()):
                v[int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big") % self.width] += 1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def checked_embeddings(embedder: Embedder, texts: Sequence[str], width: int, batch: int = 32, prefix: str = "search_document: ") -> list[list[float]]:
    """Embeddings in batches; a wrong number or width is an error."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        part = [prefix + t for t in texts[i : i + batch]]
        vectors = embedder.embed(part)
        if len(vectors) != len(part) or any(len(v) != width for v in vectors):
            raise ValueError("the embedder gave another number or width of vectors")
        out += vectors
    return out


def split_pages(text: str, sentinel: str, n: int) -> list[str]:
    """Pages around a sentinel; too few are filled up, too many are an error."""
    pages = text.split(sentinel)
    if len(pages) > n:
        raise ValueError(f"{len(pages)} pages where {n} were expected")
    return pages + [""] * (n - len(pages))


def checked_route(names: Sequence[str], known: Sequence[str], confidence: float, refused: bool) -> tuple[list[str], float]:
    """A routing decision: known, distinct names, none on a refusal, confidence within [0, 1]."""
    if refused:
        return [], 0.0
    if len(set(names)) != len(names) or any(n not in known for n in names):
        raise ValueError("the route names an unknown source or one twice")
    return list(names), max(0.0, min(1.0, confidence))


def checked_plan(goals: Mapping[str, str], routed: Sequence[str]) -> dict[str, str]:
    """Every routed source has one goal, and no other has."""
    if set(goals) != set(routed):
        raise ValueError("goals and routed sources differ")
    return dict(goals)


def escalated(pages: Sequence[tuple[int, str, float]], transcriptions: Mapping[int, tuple[bool, str, float]], floor: float = 0.60, cap: float = 0.85) -> list[tuple[int, str, float, str]]:
    """(page, text, confidence, status) after a second reading of pages under ``floor``.

    ``transcriptions`` gives (legible, text, confidence) where there is one; its
    confidence is capped.
    """
    out = []
    for page, text, confidence in pages:
        if confidence >= floor:
            out.append((page, text, confidence, "kept"))
        elif page not in transcriptions:
            out.append((page, text, confidence, "unavailable"))
        elif not transcriptions[page][0]:
            out.append((page, text, 0.0, "illegible"))
        else:
            _, better, sure = transcriptions[page]
            out.append((page, better, min(cap, max(0.0, sure)), "replaced"))
    return out
