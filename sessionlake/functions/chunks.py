"""Chunking and section parsing: folds over lines, as small functions within Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CHUNK_BUDGET = 100_000
LINES = re.compile(r"[^\n]*\n|[^\n]+")


def width(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)


def _cut(line: str, budget: int) -> Iterator[str]:
    """A line in parts within the budget. A character of two units is never split: with a budget of one it stands alone."""
    part, size = [], 0
    for c in line:
        w = 1 + (c > "￿")
        if part and size + w > budget:
            yield "".join(part)
            part, size = [], 0
        part.append(c)
        size += w
    if part:
        yield "".join(part)


def chunk_text(text: str, budget: int = CHUNK_BUDGET) -> list[str]:
    """Whole lines packed within ``budget`` units, longer lines cut; joined, the chunks are the text."""
    if isinstance(budget, bool) or not isinstance(budget, int) or budget <= 0:
        raise ValueError("the budget must be a positive whole number")
    if width(text) <= budget:
        return [text]
    chunks, held, size = [], [], 0
    for line in LINES.findall(text):
        w = width(line)
        if held and size + w > budget:
            chunks.append("".join(held))
            held, size = [], 0
        if w > budget:
            *whole, last = _cut(line, budget)
            chunks += whole
            held, size = [last], width(last)
        else:
            held.append(line)
            size += w
    return chunks + (["".join(held)] if held else [])


def chunks(texts: DataFrame, budget: int = CHUNK_BUDGET) -> DataFrame:
    """(id, ix, chunk) of ``texts(id, text)``."""
    chunk_text("", budget)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, text in zip(frame["id"], frame["text"], strict=True):
                parts = chunk_text(text or "", budget)
                yield pd.DataFrame({"id": [i] * len(parts), "ix": range(len(parts)), "chunk": parts})

    return texts.select("id", "text").mapInPandas(cut, f"id {texts.schema['id'].dataType.simpleString()}, ix int, chunk string")


#: Sections by their rendered titles, in lower case: fixed values.
TITLES = {
    "topic": None,
    "one-line summary": None,
    "context": "why",
    "key details": "key_details",
    "decisions & reasoning": "decisions",
    "findings & analysis": "findings",
    "code & implementation": "code",
    "preferences & corrections": "preferences",
    "open threads": "open_threads",
}
#: A title between asterisks at a line's beginning, and a bullet's mark.
HEAD = re.compile(r"^\*{1,2}([^*\n]+)\*{1,2}:?", re.MULTILINE)
MARK = re.compile(r"^[-–•]")


def bullets(body: str) -> list[str]:
    return [b for line in body.split("\n") if (b := MARK.sub("", line.strip()).strip())]


def parse_sections(text: str) -> tuple[str | None, list[tuple[str, list[str]]]]:
    """A rendered note's context, and its sections in order of appearance with their bullets.

    The text is cut at its titles. What stands before the first, or under an unknown one, is of the key details.
    """
    heads = list(HEAD.finditer(text))
    ends = [m.start() for m in heads] + [len(text)]
    found: dict[str | None, list[str]] = {"key_details": bullets(text[: ends[0]])}
    for m, end in zip(heads, ends[1:], strict=True):
        kind = TITLES.get(m[1].strip().removesuffix(":").strip().lower(), "key_details")
        some = bullets(text[m.end() : end])
        found[kind] = found.pop(kind) + some if found.get(kind) == [] else found.get(kind, []) + some
    return "\n".join(found.pop("why", [])) or None, [(k, v) for k, v in found.items() if k and v]


def sections(texts: DataFrame) -> DataFrame:
    """(id, why, sections) of ``texts(id, text)``."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [parse_sections(t or "") for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "why": [w for w, _ in rows], "sections": [[{"kind": k, "bullets": b} for k, b in s] for _, s in rows]})

    return texts.select("id", "text").mapInPandas(parse, f"id {texts.schema['id'].dataType.simpleString()}, why string, sections array<struct<kind: string, bullets: array<string>>>")
