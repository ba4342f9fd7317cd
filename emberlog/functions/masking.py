"""Template signatures of text: variable parts become placeholders.

The same pattern texts serve Spark (Java) and Python; their word borders are written as ASCII
lookarounds, because Java's \\b follows Unicode. `duckdb` gives the form for SQL oracles.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_B, _E = r"(?<!\w)", r"(?!\w)"
_G = "[0-9a-fA-F]{1,4}"
_SHORT = "|".join(rf"(?:{_G}:){{{n}}}(?::{_G}){{1,{7 - n}}}" for n in range(6, 0, -1))

# What is masked, in order. IP takes the longest of its forms, and gives back
# the character before an IPv6 address; HEX without 0x needs a letter.
TS = _B + r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?"
UUID = _B + "-".join(f"[0-9a-fA-F]{{{n}}}" for n in (8, 4, 4, 4, 12)) + _E
IP = (
    rf"(?:{_B}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_E})"
    rf"|(?:(^|[^0-9A-Za-z:.])(?:(?:(?:{_G}:){{7}}{_G}|{_SHORT}|::(?:{_G}:){{1,6}}{_G}){_E}|(?:{_G}:){{2,7}}:))"
)
HEX = (
    rf"0x[0-9a-fA-F]+|{_B}(?:"
    + "|".join(rf"\d{{{k}}}[a-fA-F][0-9a-fA-F]{{{7 - k},}}" for k in range(8))
    + rf"|\d{{8,}}[a-fA-F][0-9a-fA-F]*){_E}"
)
NUM = r"[+-]?\d+(?:\.\d+)?"
STR = "\"[^\"]*\"|'[^']*'"
GAP = r"[\t\n\f\r ]+"

MASKS = (("TS", TS), ("UUID", UUID), ("IP", IP), ("HEX", HEX), ("NUM", NUM), ("STR", STR))

# The same for Java alone: what every match begins with is tested before its alternatives. The character before an
# IPv6 address is looked back at: no address ends in one that may stand there, and Java is slow at negated classes.
_FIRST_D, _FIRST_G = r"\d(?<!\w\d)", r"[0-9a-fA-F](?<!\w[0-9a-fA-F])"
_NATIVE = (
    ("TS", TS.replace(_B + r"\d{4}", _FIRST_D + r"\d{3}", 1)),
    ("UUID", UUID.replace(_B + "[0-9a-fA-F]{8}", _FIRST_G + "[0-9a-fA-F]{7}", 1)),
    ("IP", IP.replace(_B + r"\d{1,3}", _FIRST_D + r"\d{0,2}", 1).replace("(^|[^0-9A-Za-z:.])", f"(?=(?:{_G}|:):)(?<![0-9A-Za-z:.])", 1)),
    ("HEX", HEX.replace(_B, "(?=[0-9a-fA-F]{8})" + _B, 1)),
    ("NUM", NUM),
    ("STR", STR),
)

#: White space of Unicode, as a regex class body for Java and for RE2.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WHITE_CHARS = "\t\n\v\f\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^[{WHITE}]++|[{WHITE}]++$", "")


def trim_text(text: str) -> str:
    return text.strip(_WHITE_CHARS)


def mask(message: Column) -> Column:
    """Template of a text, native."""
    for name, pattern in _NATIVE:
        message = F.regexp_replace(message, pattern, f"<{name}>")
    return trim(F.regexp_replace(message, GAP, " "))


_COMPILED = [(re.compile(p, re.ASCII), rf"\1<{n}>" if n == "IP" else f"<{n}>") for n, p in MASKS]
_GAP = re.compile(GAP)


def mask_text(message: str) -> str:
    """Template of a text, in Python."""
    for pattern, new in _COMPILED:
        message = pattern.sub(new, message)
    return trim_text(_GAP.sub(" ", message))


def duckdb(expression: str) -> str:
    """DuckDB SQL of mask()."""
    for name, pattern in MASKS:
        pattern = pattern.replace(_B, r"\b").replace(_E, r"\b").replace("'", "''")
        new = rf"\1<{name}>" if name == "IP" else f"<{name}>"
        expression = f"regexp_replace({expression}, '{pattern}', '{new}', 'g')"
    return duckdb_trim(f"regexp_replace({expression}, '{GAP}', ' ', 'g')")


def duckdb_trim(expression: str) -> str:
    return f"regexp_replace({expression}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def _fnv_batch(texts: list[str | None]) -> list[str | None]:
    """FNV of many texts at once, byte by byte over all that are long enough; the few longest one by one."""
    raw = [t.encode("utf-8", "replace") if t is not None else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, falling = (np.cumsum(sizes) - sizes)[order], -sizes[order]
    octets, h = np.frombuffer(b"".join(raw), dtype=np.uint8), np.full(len(raw), _BASIS, dtype=np.uint64)
    at, n = 0, len(raw)
    while (n := int(np.searchsorted(falling[:n], -at))) > 16:
        h[:n] = (h[:n] ^ octets[starts[:n] + at]) * np.uint64(_PRIME)
        at += 1
    out: list[str | None] = [None] * len(raw)
    for k, place in enumerate(order.tolist()):
        value = int(h[k])
        for b in raw[place][at:] if k < n else b"":
            value = (value ^ b) * _PRIME % 2**64
        out[place] = f"{value:016x}" if texts[place] is not None else None
    return out


@F.pandas_udf(T.StringType())
def fnv(pattern: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes as 16 hex digits; for distinct patterns only."""
    return pd.Series(_fnv_batch(pattern.tolist()), dtype=object)


def fnv_text(pattern: str) -> str:
    h = _BASIS
    for b in pattern.encode("utf-8", "replace"):
        h = (h ^ b) * _PRIME % 2**64
    return f"{h:016x}"


def duckdb_fnv(expression: str) -> str:
    raw = f"hex(encode({expression}))"
    octets = f"list_transform(range(1, length({raw}) + 1, 2), lambda i: CAST('0x' || substr({raw}, i, 2) AS HUGEINT))"
    start = "CAST(14695981039346656037 AS HUGEINT)"
    step = "lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616"
    return f"lpad(lower(to_hex(CAST(list_reduce(list_prepend({start}, {octets}), {step}) AS UBIGINT))), 16, '0')"
