"""Explanations of escalations by a pluggable backend, as a map over few rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberlog.config import ExplainConfig
from emberlog.functions import answers
from emberlog.functions.anonymize import Mapper, trim_dangling
from emberlog.functions.answers import Answer, Request


class Backend(Protocol):
    def explain(self, request: Request) -> Answer: ...


class Stub:
    """A backend without a network, for tests and dry runs."""

    def explain(self, request: Request) -> Answer:
        return Answer(f"seen {request.count} times: {request.template}", "unknown", f"look at {request.source or '-'}")


@dataclass
class Anonymizing:
    """Masks a request's texts with one mapper, and restores the answer."""

    inner: Backend
    suffixes: tuple[str, ...] = ()

    def explain(self, request: Request) -> Answer:
        m = Mapper(self.suffixes)
        masked = replace(
            request, raw=m.mask(request.raw), source=m.mask(request.source), template=m.mask(request.template),
            context=tuple(m.mask(c) for c in request.context),
        )
        got = self.inner.explain(masked)
        fix = lambda t: m.restore(trim_dangling(t) if got.truncated else t)
        return Answer(fix(got.summary), fix(got.likely_cause), fix(got.suggestion), got.truncated)


# ---- HTTP

BODY_BYTES, STREAM_BYTES = 1 << 20, 8 << 20


@dataclass
class Reply:
    status: int
    chunks: Iterable[bytes]
    content_type: str = "application/json"


class Transport(Protocol):
    """Raises OSError for network failures."""

    def __call__(self, url: str, headers: dict[str, str], body: bytes, timeout: float) -> Reply: ...


def urllib_transport(url: str, headers: dict[str, str], body: bytes, timeout: float) -> Reply:
    from urllib import error, request

    try:
        got = request.urlopen(request.Request(url, body, headers), timeout=timeout)
    except error.HTTPError as e:
        got = e
    chunks = iter(lambda: got.read1(65_536) if hasattr(got, "read1") else got.read(65_536), b"")
    return Reply(got.status, chunks, got.headers.get("Content-Type", ""))


class BackendError(RuntimeError):
    def __init__(self, text: str, transient: bool = False, rejected: bool = False):
        super().__init__(text)
        self.transient, self.rejected = transient, rejected


def events(chunks: Iterable[bytes]) -> Iterator[str]:
    """The data of a server-sent event stream, whatever the cuts between chunks."""
    rest, size = b"", 0
    for chunk in chunks:
        size += len(chunk)
        if size > STREAM_BYTES:
            raise BackendError("the stream is too long")
        *lines, rest = (rest + chunk).split(b"\n")
        for line in lines:
            if line.startswith(b"data:"):
                yield line[5:].strip().decode("utf-8", "replace")
    if rest.startswith(b"data:"):
        yield rest[5:].strip().decode("utf-8", "replace")


@dataclass
class OpenAICompatible:
    """A chat completion client. Retries 429, 5xx and network failures; a rejected request (400,
    422) gives up streaming, then JSON mode, and remembers it."""

    config: ExplainConfig
    api_key: str = ""
    transport: Transport = urllib_transport
    sleep: Callable[[float], None] = time.sleep
    streaming: bool = field(init=False)
    json_mode: bool = field(init=False)

    def __post_init__(self) -> None:
        self.streaming, self.json_mode = self.config.stream, self.config.json_mode

    def explain(self, request: Request) -> Answer:
        tries = 0
        while True:
            try:
                return self._call(request)
            except BackendError as error:
                if error.rejected and self.streaming:
                    self.streaming = False
                elif error.rejected and self.json_mode:
                    self.json_mode = False
                elif error.transient and tries < self.config.retries:
                    self.sleep(self.config.backoff * 2**tries)
                    tries += 1
                else:
                    raise

    def _call(self, request: Request) -> Answer:
        body = {
            "model": self.config.model, "messages": answers.messages(request),
            "max_tokens": self.config.max_tokens, "temperature": self.config.temperature, "stream": self.streaming,
        }
        if self.json_mode:
            body["response_format"] = {"type": "json_object"}
        headers = {"Content-Type": "application/json"}
        if self.api_key:
            headers["Authorization"] = f"Bearer {self.api_key}"
        url = self.config.base_url.rstrip("/") + "/chat/completions"
        try:
            reply = self.transport(url, headers, json.dumps(body).encode(), self.config.timeout)
        except OSError as error:
            raise BackendError(self._clean(f"request failed: {error}"), transient=True) from error
        if reply.status != 200:
            text = self._clean(b"".join(reply.chunks)[:400].decode("utf-8", "replace").strip())
            hint = {401: " (is the API key right?)", 404: " (are the URL and the model right?)"}.get(reply.status, "")
            raise BackendError(
                f"HTTP {reply.status}{hint}: {text}", reply.status == 429 or reply.status >= 500, reply.status in (400, 422)
            )
        if self.streaming and "event-stream" in reply.content_type:
            return self._streamed(reply.chunks)
        raw = b""
        for chunk in reply.chunks:
            raw += chunk
            if len(raw) > BODY_BYTES:
                raise BackendError("the response is too long")
        try:
            choice = json.loads(raw)["choices"][0]
            message = choice["message"]
        except (ValueError, LookupError, TypeError) as error:
            raise BackendError("the response is not a completion") from error
        return self._answer(message.get("content") or message.get("reasoning") or message.get("reasoning_content") or "", choice.get("finish_reason"))

    def _answer(self, text: str, finish: str | None) -> Answer:
        if not text.strip():
            raise BackendError("no answer within max_tokens" if finish == "length" else "the model returned an empty response")
        got = answers.parse(text)
        got.truncated = finish == "length" and not answers.partial(text)[1]
        return got

    def _streamed(self, chunks: Iterable[bytes]) -> Answer:
        text, reasoning, finish, closed = "", "", None, False
        try:
            for data in events(chunks):
                if data == "[DONE]":
                    closed = True
                    break
                try:
                    choice = json.loads(data)["choices"][0]
                except (ValueError, LookupError, TypeError):
                    continue
                delta = choice.get("delta") or {}
                text += delta.get("content") or ""
                reasoning += delta.get("reasoning") or delta.get("reasoning_content") or ""
                finish = choice.get("finish_reason") or finish
        except OSError as error:
            got, _ = answers.partial(text)
            if got is None:
                raise BackendError(self._clean(f"the stream broke: {error}"), transient=True) from error
            got.truncated = True
            return got
        if not closed and finish is None:
            got, whole = answers.partial(text)
            if got is None:
                raise BackendError("the stream ended early", transient=True)
            got.truncated = not whole
            return got
        return self._answer(text or reasoning, finish)

    def _clean(self, text: str) -> str:
        return text.replace(self.api_key, "***") if self.api_key else text


SCHEMA = "seq bigint, state string, summary string, likely_cause string, suggestion string, truncated boolean, error string, at string"


def explain(escalated: DataFrame, make_backend: Callable[[], Backend], workers: int = 2) -> DataFrame:
    """(seq, state, ...) for each escalation, which has raw, pattern, source, stream, level, count,
    us, first_us and context. A failure is a result; it fails no task. `workers` requests at most run at a
    time, whatever the cluster: it is the backend's limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                when = [pd.Timestamp(int(x), unit="us").to_pydatetime() for x in (r.us, r.first_us)]
                request = Request(r.raw, r.pattern, r.source, r.stream, r.level, int(r.count_), when[0], when[1], tuple(r.context))
                at = when[0].isoformat() + "Z"
                try:
                    a = backend.explain(request)
                    rows.append((r.seq, "explained", a.summary, a.likely_cause, a.suggestion, a.truncated, "", at))
                except Exception as error:  # noqa: BLE001
                    rows.append((r.seq, "unavailable", "", "", "", False, str(error), at))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    columns = ("seq", "raw", "pattern", "source", "stream", "level", F.col("count").alias("count_"), "us", "first_us", "context")
    return escalated.select(*columns).repartition(workers).mapInPandas(run, SCHEMA)
