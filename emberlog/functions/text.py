"""Texts of durations, counts, cards and plain lines."""

from __future__ import annotations

from datetime import datetime


def duration(seconds: float) -> str:
    """A duration as 1h0m0s, 15m0s, 10s, 1.5s, 200ms or 5µs."""
    micros = round(seconds * 1_000_000)
    sign, micros = ("-", -micros) if micros < 0 else ("", micros)
    if not micros:
        return "0s"
    if micros < 1000:
        return f"{sign}{micros}µs"
    number = lambda value, unit: f"{value:.6f}".rstrip("0").rstrip(".") + unit
    if micros < 1_000_000:
        return sign + number(micros / 1000, "ms")
    minutes, rest = divmod(micros, 60_000_000)
    hours, minutes = divmod(minutes, 60)
    text = number(rest / 1_000_000, "s")
    if hours:
        return f"{sign}{hours}h{minutes}m{text}"
    return f"{sign}{minutes}m{text}" if minutes else sign + text


def count_text(n: int) -> str:
    return f"{n:,}"


def severity(level: str) -> int:
    """0 none, 1 warning, 2 error, 3 fatal."""
    level = level.upper()
    if level in ("PANIC", "FATAL", "CRITICAL", "CRIT", "EMERG", "ALERT"):
        return 3
    return 2 if level in ("ERROR", "ERR") else 1 if level in ("WARN", "WARNING") else 0


def badge(level: str) -> str:
    return level.upper() or "EVENT"


def why(reasons: list[str], score: float) -> str:
    return f"{', '.join(reasons)} · score {score:.2f}" if reasons or score else ""


def relative(then: datetime | None, now: datetime) -> str:
    if then is None:
        return ""
    s = (now - then).total_seconds()
    if s < 5:
        return "just now"
    for limit, unit, size in ((60, "s", 1), (3600, "m", 60), (86_400, "h", 3600)):
        if s < limit:
            return f"{int(s // size)}{unit} ago"
    return f"{int(s // 86_400)}d ago"


def status(state: str, summary: str, truncated: bool) -> str:
    """An explanation's state as a card shows it."""
    if state == "failed":
        return "retry failed" if summary else "explanation unavailable"
    if state == "pending":
        return "explaining…"
    return "answer incomplete" if state == "done" and truncated else ""


def meta(count: int, source: str, last_seen: datetime | None, now: datetime, flags: int, state: str) -> str:
    parts = ["x" + count_text(count), source, relative(last_seen, now)]
    parts += ["⚑" + count_text(flags) if flags > 1 else "", state]
    return " · ".join(p for p in parts if p)


def headline(summary: str, pattern: str) -> str:
    return summary or pattern


def _clock(t: datetime) -> str:
    return t.strftime("%H:%M:%S")


def seen(first: datetime | None, last: datetime | None) -> str:
    return f"first {_clock(first)} · last {_clock(last)}" if first and last else ""


def flags(n: int, first: datetime | None, last: datetime | None) -> str:
    if n <= 0 or first is None or last is None:
        return ""
    return _clock(first) if n == 1 else f"{count_text(n)}× · first {_clock(first)} · last {_clock(last)}"


def predates(summary: str, at: datetime | None, last_flagged: datetime | None) -> bool:
    """Whether a card's answer is older than its last flag."""
    return bool(summary and at and last_flagged and at < last_flagged)


def detail(card: dict) -> list[str]:
    """The lines of an opened card; `card` has explanation fields, times, flags, context."""
    out = []
    ex = card.get("explanation") or {}
    if predates(ex.get("summary", ""), ex.get("at"), card.get("last_flagged")):
        out.append(f"answer: from the flag at {_clock(ex['at'])}")
    for label, key in (("cause", "likely_cause"), ("check", "suggestion")):
        if ex.get(key):
            out.append(f"{label}: {ex[key]}")
    if ex.get("state") == "failed" and ex.get("err"):
        out.append(f"failed: {ex['err']}")
    for label, text in (
        ("seen", seen(card.get("first_seen"), card.get("last_seen"))),
        ("flags", flags(card.get("flag_count", 0), card.get("first_flagged"), card.get("last_flagged"))),
    ):
        if text:
            out.append(f"{label}: {text}")
    if card.get("context"):
        out += ["context:", *(f"  {line}" for line in card["context"])]
    return out


def plural(n: int, one: str, many: str) -> str:
    return one if n == 1 else many


def sources_phrase(n: int) -> str:
    return f"{n} {plural(n, 'source', 'sources')}" if n else "no sources yet"


def cards_title(cards: int, escalations: int, dry_run: bool = False) -> str:
    flagged = f"{count_text(escalations)} flags" if escalations != cards else ""
    if dry_run:
        inner = f"{flagged} · dry run — no LLM" if flagged else "dry run — no LLM called"
        return f"WOULD ESCALATE · {count_text(cards)} ({inner})"
    if not cards:
        return "ANOMALIES"
    return f"ANOMALIES · {count_text(cards)}" + (f" ({flagged})" if flagged else "")


def explained(pattern: str, ex: dict) -> str:
    """An explanation in plain output."""
    if ex["state"] == "failed":
        return f"EXPLANATION UNAVAILABLE: {pattern} | {ex['err']}\n"
    out = f"EXPLAINED{' (INCOMPLETE)' if ex.get('truncated') else ''}: {pattern}\n  what:  {ex['summary']}\n"
    for label, key in (("cause", "likely_cause"), ("check", "suggestion")):
        if ex.get(key):
            out += f"  {label}: {ex[key]}\n"
    return out
