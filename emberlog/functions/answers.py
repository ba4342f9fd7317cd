"""Prompts for an explainer and the parsing of its answers, which degrades and never fails
on anything but blank text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F, types as T

from emberlog.functions.text import duration

TRIGGER_CHARS, CONTEXT_CHARS, SUMMARY_CHARS = 1000, 300, 400

SYSTEM = (
    "You explain one anomalous log line. You get the line, its masked template, how often it "
    "occurred and the lines before it. Answer with one JSON object and nothing else: "
    '{"summary": "...", "likely_cause": "...", "suggestion": "..."} '
    "- what happened in one sentence, the most probable cause, the most useful next check. "
    "Each under 200 characters. If the line looks harmless, say so in summary."
)


@dataclass(frozen=True)
class Request:
    raw: str
    template: str
    source: str = ""
    stream: str = "stdout"
    level: str = ""
    count: int = 1
    time: datetime | None = None
    first_seen: datetime | None = None
    context: tuple[str, ...] = ()


@dataclass
class Answer:
    summary: str = ""
    likely_cause: str = ""
    suggestion: str = ""
    truncated: bool = False


def shortened(text: str, n: int) -> str:
    return text if len(text) <= n else text[:n] + "…[truncated]"


def user_prompt(r: Request) -> str:
    age = ""
    if r.time and r.first_seen and r.time >= r.first_seen:
        age = f" (first seen {duration(int((r.time - r.first_seen).total_seconds()))} ago)"
    head = f"Trigger line (source={r.source or '-'}, stream={r.stream}, level={r.level or '-'}):\n{shortened(r.raw, TRIGGER_CHARS)}\n"
    out = f"{head}\nMasked template: {r.template}\nOccurrences: {r.count}{age}\n"
    if r.context:
        out += "\nPreceding lines (oldest first):\n" + "".join(shortened(c, CONTEXT_CHARS) + "\n" for c in r.context)
    return out


def messages(r: Request) -> list[dict[str, str]]:
    return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": user_prompt(r)}]


# The keys of an answer's fields, without case, spaces and dashes.
FIELDS = {
    "summary": ("summary", "what", "whathappened"),
    "likely_cause": ("likelycause", "cause", "probablecause", "rootcause", "why"),
    "suggestion": ("suggestion", "suggestions", "check", "whattocheck", "nextstep", "action"),
}
_FIELD_OF = {key: name for name, keys in FIELDS.items() for key in keys}
_FENCE = "```"
_DECODER = json.JSONDecoder(strict=True)
_WHITE = " \t\n\r"


def without_fences(text: str) -> str:
    """The body of the first fenced block, without the language after its opening marks; else the text."""
    parts = text.split(_FENCE, 2)
    if len(parts) == 1:
        return text
    language, _, body = parts[1].partition("\n")
    return (parts[1] if "{" in language or "\n" not in parts[1] else body).strip()


def _next(text: str, at: int) -> tuple[str, int]:
    """The first character that isn't white space at or after a place ('' at the end), and its place."""
    while at < len(text) and text[at] in _WHITE:
        at += 1
    return text[at : at + 1], at


def _values(text: str, at: int) -> Iterator[tuple[str, object] | None]:
    """The complete (key, value) pairs of the object that opens at a place; None last if the object is closed.

    A number at the very end may have been cut and isn't complete.
    """
    mark, at = _next(text, at + 1)
    while mark != "}":
        try:
            key, at = _DECODER.raw_decode(text, at)
            mark, at = _next(text, at)
            if mark != ":" or not isinstance(key, str):
                return
            value, at = _DECODER.raw_decode(text, _next(text, at + 1)[1])
        except (ValueError, RecursionError):
            return
        mark, at = _next(text, at)
        if mark or isinstance(value, str):
            yield key, value
        if mark == ",":
            mark, at = _next(text, at + 1)
            if mark == "}":
                return
        elif mark != "}":
            return
    yield None


def partial(text: str) -> tuple[Answer | None, bool]:
    """The first object that gives a field, and whether it was closed."""
    text = without_fences(text.strip())
    at = text.find("{")
    while at >= 0:
        pairs = list(_values(text, at))
        fields = {}
        for key, value in filter(None, pairs):
            name = _FIELD_OF.get(key.lower().translate({ord(c): None for c in "_- \t"}))
            if name and isinstance(value, str) and value.strip():
                fields[name] = value.strip()
        if fields:
            return Answer(**fields), pairs[-1] is None
        at = text.find("{", at + 1)
    return None, False


def parse(text: str) -> Answer:
    if not text.strip():
        raise ValueError("the model returned an empty response")
    answer, _ = partial(text)
    if answer:
        return answer
    return Answer(summary=shortened(" ".join(without_fences(text.strip()).split()), SUMMARY_CHARS))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("summary", "likely_cause", "suggestion", "error")]))
def parsed(raw: pd.Series) -> pd.DataFrame:
    """parse() over a column; blank texts give an error."""
    rows = []
    for text in raw:
        try:
            a = parse(text or "")
            rows.append((a.summary, a.likely_cause, a.suggestion, ""))
        except ValueError as error:
            rows.append(("", "", "", str(error)))
    return pd.DataFrame(rows, columns=["summary", "likely_cause", "suggestion", "error"])
