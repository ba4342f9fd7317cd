"""Levels and messages of lines, and shapes of JSON lines."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from emberlog.functions.masking import duckdb_trim, mask, mask_text, trim, trim_text

# Level words and the level they stand for; keys of JSON lines in order.
LEVELS = {
    "trace": "DEBUG", "debug": "DEBUG", "dbg": "DEBUG", "info": "INFO", "inf": "INFO", "notice": "INFO",
    "warn": "WARN", "warning": "WARN", "err": "ERROR", "error": "ERROR", "fatal": "FATAL", "panic": "PANIC",
    "crit": "CRITICAL", "critical": "CRITICAL",
}
LEVEL_KEYS = ("level", "lvl", "severity", "log.level")
MESSAGE_KEYS = ("message", "msg", "text")
#: Bounds of a shape.
MAX_DEPTH, MAX_NODES = 6, 128

_S = r"[\t\n\f\r ]*"
LEADING = rf'(?i)^{_S}(?:\[{_S}([a-z]+){_S}\]|([a-z]+){_S}:|level{_S}={_S}"?([a-z]+)"?){_S}'
_LEADING = re.compile(LEADING)


def canonical(token: Column) -> Column:
    """A level word's level, or ''."""
    table = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(token)), F.lit(""))


def plain_level(raw: Column) -> Column:
    return canonical(F.concat(*(F.regexp_extract(raw, LEADING, k) for k in (1, 2, 3))))


def plain_message(raw: Column) -> Column:
    rest = trim(F.substr(raw, F.length(F.regexp_extract(raw, LEADING, 0)) + 1))
    return F.when(plain_level(raw) != "", rest).otherwise(raw)


def plain_text(raw: str) -> tuple[str, str]:
    """Level and message of a line that is no JSON object."""
    m = _LEADING.match(raw)
    level = LEVELS.get(((m[1] or "") + (m[2] or "") + (m[3] or "")).lower(), "") if m else ""
    return (level, trim_text(raw[m.end() :])) if level else ("", raw)


# ---- strict JSON


def _no_constant(name: str):
    raise ValueError(name)


def _clean(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse(text: str):
    """The value of a strict JSON text; ValueError if it is none. Numbers become 0."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_int=lambda s: 0, parse_float=lambda s: 0)
    except RecursionError as error:
        raise ValueError("too deep") from error


def _index(obj: dict) -> dict[str, str]:
    """Lower-cased keys; of keys that differ in case only, the first in byte order."""
    found: dict[str, str] = {}
    for key in sorted(obj):
        found.setdefault(key.lower(), key)
    return found


def json_level(obj: dict, text: str) -> tuple[str, str]:
    index = _index(obj)
    level, message = "", text
    for key in LEVEL_KEYS:
        if key in index and isinstance(value := obj[index[key]], str):
            level = LEVELS.get(value.lower(), "")
            break
    for key in MESSAGE_KEYS:
        if key in index and isinstance(value := obj[index[key]], str):
            message = _clean(value)
            break
    return level, message


def quote(text: str) -> str:
    """The text in double quotes; what can't be printed is escaped."""
    named = {'"': '\\"', "\\": "\\\\", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
    out = []
    for c in text:
        n = ord(c)
        if c in named:
            out.append(named[c])
        elif c.isprintable():
            out.append(c)
        elif n < 0x80:
            out.append(f"\\x{n:02x}")
        else:
            out.append(f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}")
    return '"' + "".join(out) + '"'


class _Shape:
    def __init__(self) -> None:
        self.left = MAX_NODES

    def of(self, value, depth: int) -> str:
        if isinstance(value, dict):
            return self.object(value, depth, "")
        if isinstance(value, list):
            return self.array(value, depth)
        if isinstance(value, bool):
            return "<BOOL>"
        return "<STR>" if isinstance(value, str) else "<NULL>" if value is None else "<NUM>"

    def object(self, value: dict, depth: int, message: str) -> str:
        if depth >= MAX_DEPTH:
            return "{...}"
        parts = []
        for key in sorted(value):
            if self.left <= 0:
                parts.append("...")
                break
            self.left -= 1
            named = quote(mask_text(_clean(value[key]))) if key == message else self.of(value[key], depth + 1)
            parts.append(f"{quote(_clean(key))}:{named}")
        return "{" + ",".join(parts) + "}"

    def array(self, value: list, depth: int) -> str:
        if depth >= MAX_DEPTH:
            return "[...]"
        shapes = set()
        for item in value:
            if self.left <= 0:
                shapes.add("...")
                break
            self.left -= 1
            shapes.add(self.of(item, depth + 1))
        return "[" + ",".join(sorted(shapes)) + "]"


def _message_key(obj: dict) -> str:
    """The one message key with a text value, or ''."""
    index = _index(obj)
    found = [index[k] for k in MESSAGE_KEYS if k in index]
    return found[0] if len(found) == 1 and isinstance(obj[found[0]], str) else ""


def shape(text: str) -> str | None:
    """Signature of a JSON object or array; None for anything else."""
    text = trim_text(text)
    if text[:1] not in ("{", "["):
        return None
    try:
        value = parse(text)
    except ValueError:
        return None
    if isinstance(value, dict):
        return _Shape().object(value, 0, _message_key(value))
    return _Shape().array(value, 0)


_PARTS = (
    T.StructType().add("is_object", T.BooleanType()).add("level", T.StringType())
    .add("message", T.StringType()).add("shape", T.StringType())
)


@F.pandas_udf(_PARTS)
def json_parts(raw: pd.Series) -> pd.DataFrame:
    """What strict JSON lines hold; nulls for other lines and for null."""
    rows = []
    for text in raw:
        row = (False, None, None, None)
        if text is not None:
            trimmed = trim_text(text)
            try:
                value = parse(trimmed) if trimmed[:1] in ("{", "[") else None
            except ValueError:
                value = None
            if isinstance(value, dict):
                row = (True, *json_level(value, trimmed), _Shape().object(value, 0, _message_key(value)))
            elif isinstance(value, list):
                row = (False, None, None, _Shape().array(value, 0))
        rows.append(row)
    return pd.DataFrame(rows, columns=["is_object", "level", "message", "shape"])


def normalize(lines: DataFrame) -> DataFrame:
    """Fill level and message from raw, and add `pattern`, the line's template.

    Only lines that begin like JSON reach Python. A level the source gave stays.
    """
    candidate = trim(F.col("raw")).rlike(r"^[{\[]")
    out = lines.withColumn("_json", json_parts(F.when(candidate, F.col("raw"))))
    j = F.col("_json")
    is_object = F.coalesce(j["is_object"], F.lit(False))
    given = F.col("level") if "level" in lines.columns else F.lit("")
    detected = F.when(is_object, j["level"]).otherwise(plain_level(F.col("raw")))
    out = out.withColumn("level", F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(detected))
    out = out.withColumn("message", F.when(is_object, j["message"]).otherwise(plain_message(F.col("raw"))))
    pattern = F.coalesce(j["shape"], mask(F.col("message")))
    return out.withColumn("pattern", pattern).drop("_json")


def duckdb_level(raw: str) -> str:
    token = "lower(" + " || ".join(f"regexp_extract({raw}, '{LEADING}', {k})" for k in (1, 2, 3)) + ")"
    return f"CASE {token} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " ELSE '' END"


def duckdb_message(raw: str) -> str:
    rest = duckdb_trim(f"substr({raw}, length(regexp_extract({raw}, '{LEADING}', 0)) + 1)")
    return f"CASE WHEN ({duckdb_level(raw)}) <> '' THEN {rest} ELSE {raw} END"
