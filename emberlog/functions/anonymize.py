"""Reversible masking of sensitive values in the texts of one request.

Rules run in order over all texts of a request; equal values share one placeholder, which is
numbered per kind by first sight. A value that a verified rule still finds afterwards fails the
request: nothing leaves in clear. Rules match leftmost-longest.

Known and kept gaps: an IPv6 address glued to a port is masked with it, a query part that looks
like credentials is masked, public bare host names stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, functions as F, types as T

# Placeholders of templates and of this module; private host suffixes.
TEMPLATE_MARK = "<(?:TS|UUID|IP|HEX|NUM|STR)>"
OWN_MARK = r"<[A-Z]+_\d+>"
HOST_SUFFIXES = ("internal", "local", "lan", "corp", "intranet", "svc", "private")


def _over(chars: str) -> str:
    """A run of characters that may step over template placeholders."""
    return f"(?:{chars}|{TEMPLATE_MARK})+"


def _cut(chars: str) -> str:
    """Such a run with at least one placeholder in it."""
    one = f"(?:{chars}|{TEMPLATE_MARK})"
    return f"{one}*{TEMPLATE_MARK}{one}*"


def _ipv6() -> str:
    g = "[0-9a-f]{1,4}"
    middle = "|".join(f"(?:{g}:){{1,{n}}}(?::{g}){{1,{7 - n}}}" for n in range(6, 0, -1))
    return f"(?:{g}:){{7}}{g}|(?:{g}:){{1,7}}:|{middle}|:(?:(?::{g}){{1,7}}|:)"


_SEVEN_GROUPS = re.compile("(?:[0-9A-Fa-f]{1,4}:){7}")


def _may_hold_ipv6(text: str) -> bool:
    """Every IPv6 address has two colons together or seven groups that end in one."""
    return "::" in text or (text.count(":") >= 7 and _SEVEN_GROUPS.search(text) is not None)


def _may_hold_ends(suffixes: Sequence[str]) -> Callable[[str], bool] | None:
    """Whether a text has one of the suffixes after a dot; unknown, so none, for suffixes beyond ASCII."""
    ends = tuple(f".{s.lower()}" for s in suffixes)
    if not all(e.isascii() for e in ends):
        return None

    def found(text: str) -> bool:
        low = text.lower()
        return any(e in low for e in ends)

    return found


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_JWT = _over("[A-Za-z0-9_-]")
_ANY = f"|{TEMPLATE_MARK}|{OWN_MARK}"


@dataclass(frozen=True)
class Rule:
    tag: str
    pattern: str
    group: int = 0
    verified: bool = True
    nocase: bool = False
    #: A quick test that fails only on texts without a match; those don't reach the slow search.
    guard: Callable[[str], bool] | None = None

    def may_match(self, text: str) -> bool:
        return self.guard is None or self.guard(text)

    def compiled(self):
        flags = regex.POSIX | regex.ASCII | regex.VERSION0 | (regex.IGNORECASE if self.nocase else 0)
        return regex.compile(self.pattern, flags)


def rules(extra_suffixes: Sequence[str] = ()) -> list[Rule]:
    # What is sensitive, in order.
    name, inside = f"(?:[a-z0-9]|{TEMPLATE_MARK})", f"(?:[a-z0-9-]|{TEMPLATE_MARK})"
    suffixes = "|".join(re.escape(s) for s in (*HOST_SUFFIXES, *extra_suffixes))
    user, password = r"[^:/@\s<>]", r"[^@/\s<>]"
    return [
        Rule("TOKEN", rf"\beyJ{_JWT}\.eyJ{_JWT}\.{_JWT}"),
        Rule("TOKEN", rf"\b(?:AKIA|ASIA)(?:[0-9A-Z]{{16}}\b|{_cut('[0-9A-Z]')})"),
        Rule("TOKEN", rf"\bbearer\s+({_over('[A-Za-z0-9._~+/=-]')})", 1, nocase=True),
        Rule("TOKEN", rf"\bsk-(?:[A-Za-z0-9]{{16,}}\b|{_cut('[A-Za-z0-9]')})"),
        Rule("TOKEN", f"://({_over(user)}:{_over(password)})@", 1),
        Rule("TOKEN", f"://(?:{user}{_ANY})*:({_over(password)})@", 1),
        Rule("TOKEN", f"://({_over(user)}):(?:{password}{_ANY})*@", 1),
        Rule("EMAIL", rf"{_over('[A-Za-z0-9._%+-]')}@{_over('[A-Za-z0-9.-]')}\.[A-Za-z]{{2,}}\b"),
        Rule("UUID", r"\b" + "-".join(f"[0-9a-fA-F]{{{n}}}" for n in (8, 4, 4, 4, 12)) + r"\b"),
        Rule("IP", _ipv6(), nocase=True, guard=_may_hold_ipv6),
        Rule("IP", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"),
        Rule("HOST", rf"\b[a-z][a-z0-9+.-]*://(?:[^/@\s]*@)?({_over('[a-z0-9.-]')})", 1, False, True),
        Rule("HOST", rf"\b(?:{name}(?:{inside}*{name})?\.)+(?:{suffixes})\b", 0, False, True, _may_hold_ends((*HOST_SUFFIXES, *extra_suffixes))),
        Rule("USER", r"(?:/home/|/Users/)(" + _over(r"[^/<>\s:]") + ")", 1),
    ]


class ResidueError(ValueError):
    """A sensitive value survived the rules."""


_compiled: dict[tuple[str, ...], list[tuple[Rule, object]]] = {}


@dataclass
class Mapper:
    """The placeholders of one request."""

    extra_suffixes: tuple[str, ...] = ()
    tokens: dict[str, str] = field(default_factory=dict)
    _of: dict[str, str] = field(default_factory=dict)
    _n: dict[str, int] = field(default_factory=dict)

    def _rules(self):
        if self.extra_suffixes not in _compiled:
            _compiled[self.extra_suffixes] = [(r, r.compiled()) for r in rules(self.extra_suffixes)]
        return _compiled[self.extra_suffixes]

    def _token(self, tag: str, value: str) -> str:
        if value not in self._of:
            self._n[tag] = self._n.get(tag, 0) + 1
            self._of[value] = f"<{tag}_{self._n[tag]}>"
            self.tokens[self._of[value]] = value
        return self._of[value]

    def mask(self, text: str) -> str:
        for rule, pattern in self._rules():
            if not rule.may_match(text):
                continue
            out, at = [], 0
            for m in pattern.finditer(text):
                a, b = m.span(rule.group)
                if a >= 0:
                    out += [text[at:a], self._token(rule.tag, text[a:b])]
                    at = b
            text = "".join(out) + text[at:]
        for rule, pattern in self._rules():
            if rule.verified and rule.may_match(text) and (m := pattern.search(text)) and m.span(rule.group)[0] >= 0:
                raise ResidueError(f"a {rule.tag} value survived masking")
        return text

    def restore(self, text: str) -> str:
        for token, value in self.tokens.items():
            text = text.replace(token, value)
        return text


_DANGLING = re.compile(r"<[A-Z]*(?:_\d*)?\Z")


def trim_dangling(text: str) -> str:
    """Without a placeholder that was cut off at the end."""
    return _DANGLING.sub("", text).rstrip(" ")


MASKED = (
    T.StructType().add("masked", T.ArrayType(T.StringType())).add("tokens", T.MapType(T.StringType(), T.StringType()))
    .add("error", T.StringType())
)


def mask_group(texts: Sequence[str] | None, extra: tuple[str, ...] = ()) -> tuple[list[str] | None, dict[str, str], str]:
    mapper = Mapper(extra)
    try:
        return [mapper.mask(t or "") for t in (texts if texts is not None else [])], mapper.tokens, ""
    except ResidueError as error:
        return None, {}, str(error)


def mask(texts: Column, extra: Sequence[str] = ()) -> Column:
    """Struct (masked, tokens, error) of one request's texts."""
    suffixes = tuple(extra)

    @F.pandas_udf(MASKED)
    def run(groups: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mask_group(group, suffixes) for group in groups], columns=["masked", "tokens", "error"])

    return run(texts)


def hits(text: Column, tag: str, pattern: int = 0) -> Column:
    """How often one rule finds something in a text: the rule of that tag, by its place among them."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        found = [rule for rule in rules() if rule.tag == tag][pattern].compiled()
        return pd.Series([sum(1 for _ in found.finditer(t)) if t else 0 for t in texts])

    return run(text)


@F.pandas_udf(T.StringType())
def restore(text: pd.Series, tokens: pd.Series) -> pd.Series:
    out = []
    for t, table in zip(text, tokens):
        for token, value in (dict(table) if table is not None else {}).items():
            t = t.replace(token, value) if t is not None else t
        out.append(t)
    return pd.Series(out)
