"""Settings: defaults, then a file (unknown keys are errors), then explicit flags."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from importlib import metadata
from urllib.parse import urlsplit

RECENT_CAP = 2048


@dataclass(frozen=True)
class Weights:
    novelty: float = 0.45
    burst: float = 1.0
    stderr: float = 0.3
    warn: float = 0.2
    error: float = 0.6
    fatal: float = 1.0
    severity_max: float = 1.0


@dataclass(frozen=True)
class ScoreConfig:
    """Scoring and gating; durations in seconds."""

    weights: Weights = field(default_factory=Weights)
    threshold: float = 1.0
    cooloff: float = 900.0
    warmup: float = 30.0
    warmup_lines: int = 100
    burst_window: float = 10.0
    burst_multiplier: float = 5.0
    burst_min_count: int = 25
    baseline_min_age: float = 60.0
    baseline_min_count: int = 20
    rate_per_min: int = 10
    cache_ttl: float = 3600.0
    context_lines: int = 30

    def __post_init__(self) -> None:
        for bad, text in (
            (self.threshold <= 0, "threshold must be > 0"),
            (self.burst_min_count > RECENT_CAP, "burst_min_count exceeds the recent occurrences kept"),
            (self.burst_window <= 0, "burst_window must be > 0"),
            (self.burst_multiplier <= 1, "burst_multiplier must be > 1"),
            (self.rate_per_min < 0, "rate_per_min must be >= 0"),
            (self.cache_ttl < 0, "cache_ttl must be >= 0"),
            (self.context_lines < 0, "context_lines must be >= 0"),
        ):
            if bad:
                raise ValueError(text)


@dataclass(frozen=True)
class ContainerConfig:
    all: bool = False
    ids: tuple[str, ...] = ()
    name: str = ""
    labels: tuple[str, ...] = ()
    tail: int = 100

    def __post_init__(self) -> None:
        for label in self.labels:
            if "=" not in label:
                raise ValueError(f"label {label!r} is not key=value")


@dataclass(frozen=True)
class JournalConfig:
    enabled: bool = False
    units: tuple[str, ...] = ()
    priority: int = 7

    def __post_init__(self) -> None:
        if not 0 <= self.priority <= 7:
            raise ValueError("journal priority must be 0..7")


@dataclass(frozen=True)
class ExplainConfig:
    base_url: str = "http://localhost:11434/v1"
    model: str = "gemma2:2b"
    workers: int = 2
    queue: int = 64
    timeout: float = 30.0
    max_tokens: int = 300
    temperature: float = 0.1
    json_mode: bool = True
    stream: bool = True
    retries: int = 1
    backoff: float = 0.5
    anonymize: bool = False
    host_suffixes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        url = urlsplit(self.base_url)
        for bad, text in (
            (url.scheme not in ("http", "https") or not url.netloc, "base_url must be an http(s) URL"),
            (not self.model, "model must not be empty"),
            (self.workers < 1, "workers must be >= 1"),
            (self.queue < 1, "queue must be >= 1"),
            (self.timeout <= 0, "timeout must be > 0"),
            (self.max_tokens < 1, "max_tokens must be >= 1"),
            (not 0 <= self.temperature <= 2, "temperature must be 0..2"),
            (self.retries < 0, "retries must be >= 0"),
        ):
            if bad:
                raise ValueError(text)


@dataclass(frozen=True)
class Config:
    score: ScoreConfig = field(default_factory=ScoreConfig)
    containers: ContainerConfig = field(default_factory=ContainerConfig)
    journal: JournalConfig = field(default_factory=JournalConfig)
    explain: ExplainConfig = field(default_factory=ExplainConfig)
    group_timeout: float = 0.2
    plain: bool = False
    dry_run: bool = False
    no_explain: bool = False
    export: str = ""
    command: tuple[str, ...] = ()
    #: From the environment only, never from a file or flag.
    api_key: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        if self.group_timeout < 0:
            raise ValueError("group_timeout must be >= 0")


def _updated(value, changes: dict, where: str = ""):
    """A copy of a dataclass with nested changes; unknown keys are errors."""
    known = {f.name: f for f in dataclasses.fields(value)}
    new = {}
    for key, change in changes.items():
        if key not in known or key in ("api_key", "command"):
            raise ValueError(f"unknown key {where}{key}")
        old = getattr(value, key)
        if dataclasses.is_dataclass(old):
            if not isinstance(change, dict):
                raise ValueError(f"{where}{key} must be a table")
            new[key] = _updated(old, change, f"{where}{key}.")
        elif isinstance(old, tuple):
            new[key] = tuple(change)
        elif isinstance(old, bool) != isinstance(change, bool) or not isinstance(change, (type(old), int)):
            raise ValueError(f"{where}{key} has the wrong type")
        else:
            new[key] = type(old)(change)
    return dataclasses.replace(value, **new)


def read_file(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        return json.loads(text or "{}")
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML settings need PyYAML; a .json file works without") from error
    return yaml.safe_load(text) or {}


_FLAGS: dict[str, tuple[str, type]] = {
    "threshold": ("score.threshold", float), "rate-limit": ("score.rate_per_min", int),
    "cache-ttl": ("score.cache_ttl", float), "context-lines": ("score.context_lines", int),
    "burst-window": ("score.burst_window", float), "burst-multiplier": ("score.burst_multiplier", float),
    "burst-min-count": ("score.burst_min_count", int), "cooloff": ("score.cooloff", float),
    "warmup": ("score.warmup", float), "docker-name": ("containers.name", str),
    "docker-tail": ("containers.tail", int), "journal-priority": ("journal.priority", int),
    "llm-url": ("explain.base_url", str), "llm-model": ("explain.model", str),
    "llm-workers": ("explain.workers", int), "llm-queue": ("explain.queue", int),
    "llm-timeout": ("explain.timeout", float), "group-timeout": ("group_timeout", float), "export": ("export", str),
}
_SWITCHES = {
    "plain": "plain", "dry-run": "dry_run", "no-explain": "no_explain", "anonymize": "explain.anonymize",
    "docker-all": "containers.all", "journal": "journal.enabled",
}
_LISTS = {"docker": "containers.ids", "docker-label": "containers.labels", "journal-unit": "journal.units"}


def load(argv: Sequence[str], environ: dict[str, str] | None = None) -> Config:
    """Settings from the command line; what follows `--` is a command to run."""
    argv = list(argv)
    command: tuple[str, ...] = ()
    if "--" in argv:
        at = argv.index("--")
        argv, command = argv[:at], tuple(argv[at + 1 :])
    parser = argparse.ArgumentParser(argument_default=argparse.SUPPRESS, allow_abbrev=False)
    parser.add_argument("--config")
    parser.add_argument("--version", action="version", version=version())
    for name, (_, kind) in _FLAGS.items():
        parser.add_argument(f"--{name}", type=kind)
    for name in _SWITCHES:
        parser.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    for name in _LISTS:
        parser.add_argument(f"--{name}", action="append")
    given = vars(parser.parse_args(argv))
    config = Config()
    if path := given.pop("config", None):
        config = _updated(config, read_file(path))
    places = {k: v[0] for k, v in _FLAGS.items()} | _SWITCHES | _LISTS
    for name, value in given.items():
        *parents, leaf = places[name.replace("_", "-")].split(".")
        change = {leaf: value}
        for parent in reversed(parents):
            change = {parent: change}
        config = _updated(config, change)
    key = (os.environ if environ is None else environ).get("EMBERLOG_API_KEY", "")
    return dataclasses.replace(config, command=command, api_key=key)


def remote_host(config: Config) -> str:
    """The host that would get log lines in clear, or ''."""
    if config.dry_run or config.no_explain or config.explain.anonymize:
        return ""
    host = (urlsplit(config.explain.base_url).hostname or "").lower()
    local = host in ("localhost", "::1", "") or host.startswith("127.")
    return "" if local else host


def version() -> str:
    try:
        return metadata.version("emberlog")
    except metadata.PackageNotFoundError:
        return "dev"
