"""Sources of log lines. All give LINE: seq, time, source, stream, raw, level."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from emberlog.config import Config, ContainerConfig, JournalConfig

LINE = "seq bigint, time timestamp, source string, stream string, raw string, level string"


class Source(Protocol):
    """Anything that loads lines."""

    name: str

    def load(self, spark: SparkSession) -> DataFrame: ...


def _line(df: DataFrame, source: Column, stream: Column, level: Column | None = None) -> DataFrame:
    return df.select(
        F.col("seq").cast("bigint").alias("seq"),
        F.col("time").cast("timestamp").alias("time"),
        source.alias("source"),
        stream.alias("stream"),
        F.col("raw"),
        (level if level is not None else F.lit("")).alias("level"),
    )


def without_ends(value: Column) -> Column:
    """A line without the carriage returns and line feeds at its end."""
    return F.regexp_replace(value, r"[\r\n]+$", "")


def in_file_order(rows: DataFrame) -> DataFrame:
    """Add `seq`, dense from 0, to rows with `_file`, `_start` and `_id`: files follow each other by name.

    Spark packs the pieces of files into tasks by size. A piece is read by one task in order, so a
    line's place is its piece's first place plus its distance from the piece's first id; only one
    row for each piece is sorted.
    """
    pieces = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = rows.join(pieces, ["_file", "_start"])
    return joined.withColumn("seq", F.col("_base") + F.col("_id") - F.col("_first")).drop("_file", "_start", "_id", "_first", "_base")


def _text_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return in_file_order(
        rows.select(
            without_ends(F.col("value")).alias("raw"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
        )
    )


def read_text(spark: SparkSession, path: str, source: str = "stdin", stream: str = "stdout", time: Column | None = None) -> DataFrame:
    """Newline text files; empty lines count, an unterminated last line too.

    seq follows the order in a file; files of a folder follow each other by name. Without `time`, which may
    be an expression of raw and seq, all lines have the time of reading.
    """
    rows = _text_rows(spark, path)
    rows = rows.withColumn("time", time if time is not None else F.current_timestamp())
    return _line(rows, F.lit(source), F.lit(stream))


def stream_text(spark: SparkSession, path: str, source: str = "stdin") -> DataFrame:
    """The same as a stream over a landing folder; seq is to be given where batches are ordered."""
    return spark.readStream.option("lineSep", "\n").text(path).select(
        F.current_timestamp().alias("time"), F.lit(source).alias("source"), F.lit("stdout").alias("stream"),
        without_ends(F.col("value")).alias("raw"), F.lit("").alias("level"),
    )


def process_name(argv: list[str]) -> str:
    return f"proc:{Path(argv[0]).name}" if argv else "proc"


def land_process(argv: list[str], folder: str) -> tuple[str, int]:
    """Run a command and land both of its pipes as text files; its exit code is information."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    with (target / "stdout.log").open("wb") as out, (target / "stderr.log").open("wb") as err:
        code = subprocess.run(argv, stdout=out, stderr=err, check=False).returncode
    return process_name(argv), code


def read_process(spark: SparkSession, argv: list[str], folder: str) -> DataFrame:
    name, _ = land_process(argv, folder)
    return fan_in([read_text(spark, f"{folder}/{s}.log", name, s) for s in ("stdout", "stderr")])


# ---- containers

#: RFC 3339 before the first space; digits past microseconds are dropped.
_STAMP = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2}) "


def container_time(raw: Column, received: Column) -> tuple[Column, Column]:
    """(time, text) of a container's line; without a valid time the line stays whole."""
    parts = [F.regexp_extract(raw, _STAMP, k) for k in (1, 2, 3)]
    parsed = F.try_to_timestamp(F.concat(parts[0], F.substring(parts[1], 1, 7), parts[2]))
    found = raw.rlike(_STAMP) & parsed.isNotNull()
    return (
        F.when(found, parsed).otherwise(received),
        F.when(found, F.regexp_replace(raw, _STAMP, "")).otherwise(raw),
    )


def container_name(names: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.get(names, F.lit(0)), F.lit("")), "^/", "")


def container_match(config: ContainerConfig, ident: Column, name: Column, labels: Column) -> Column:
    """Whether a container is followed: all, or by id, name pattern, or all of the labels."""
    if config.all:
        return F.lit(True)
    found = F.lit(False)
    if config.ids:
        found = found | ident.isin(*config.ids) | name.isin(*config.ids)
    if config.name:
        found = found | name.rlike(config.name)
    if config.labels:
        every = F.lit(True)
        for label in config.labels:
            key, _, value = label.partition("=")
            every = every & F.coalesce(F.try_element_at(labels, F.lit(key)) == value, F.lit(False))
        found = found | every
    return F.coalesce(found, F.lit(False))


def demux(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(stream, bytes) of a framed capture: one byte of stream, three of nothing, four of length."""
    at = 0
    while at + 8 <= len(content):
        kind, size = struct.unpack(">BxxxI", content[at : at + 8])
        yield ("stderr" if kind == 2 else "stdout"), content[at + 8 : at + 8 + size]
        at += 8 + size


def _framed(batches: Iterable[pd.DataFrame], tty: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            parts: dict[str, list[bytes]] = {}
            for stream, data in [("stdout", content)] if tty else demux(content):
                parts.setdefault(stream, []).append(data)
            rows = []
            for stream, data in parts.items():
                lines = b"".join(data).split(b"\n")
                if lines and not lines[-1]:
                    lines.pop()
                rows += [(path, stream, k, x.decode("utf-8", "replace").rstrip("\r\n")) for k, x in enumerate(lines)]
            yield pd.DataFrame(rows, columns=["path", "stream", "n", "raw"])


def read_containers(spark: SparkSession, path: str, tty: bool = False) -> DataFrame:
    """Captured container logs, one file for each container, named by it."""
    rows = (
        spark.read.format("binaryFile").load(path).select("path", "content")
        .mapInPandas(lambda it: _framed(it, tty), "path string, stream string, n bigint, raw string")
    )
    time, raw = container_time(F.col("raw"), F.current_timestamp())
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = rows.select(time.alias("time"), raw.alias("text"), "stream", name.alias("name"), F.monotonically_increasing_id().alias("seq"))
    return _line(rows.withColumnRenamed("text", "raw"), F.concat(F.lit("docker:"), "name"), F.col("stream"))


# ---- journal

# Priorities and their levels; 6 tells none.
JOURNAL_LEVELS = {0: "FATAL", 1: "FATAL", 2: "CRITICAL", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "", 7: "DEBUG"}
JOURNAL_UNITS = ("_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "_COMM")


def decode_entry(line: str) -> tuple[str, str, str, str, int | None]:
    """(raw, level, stream, source, microseconds) of an exported journal entry."""
    untouched = (line, "", "stdout", "journald", None)
    try:
        entry = json.loads(line)
    except (ValueError, RecursionError):
        return untouched
    if not isinstance(entry, dict):
        return untouched
    message = entry.get("MESSAGE")
    if isinstance(message, list):
        try:
            message = bytes(message).decode("utf-8", "replace")
        except (TypeError, ValueError):
            return untouched
    if not isinstance(message, str):
        return untouched
    value = entry.get("PRIORITY")
    level, stream = "", "stdout"
    if isinstance(value, (str, int)) and not isinstance(value, bool) and re.fullmatch(r"\s*[0-7]\s*", str(value)):
        priority = int(value)
        level, stream = JOURNAL_LEVELS[priority], "stderr" if priority <= 3 else "stdout"
    unit = next((u for k in JOURNAL_UNITS if isinstance(u := entry.get(k), str) and u), "")
    source = f"journald:{unit.removesuffix('.service')}" if unit else "journald"
    stamp = entry.get("__REALTIME_TIMESTAMP")
    micros = int(stamp) if isinstance(stamp, str) and re.fullmatch(r"[+-]?\d{1,18}", stamp) else None
    return message, level, stream, source, micros


_ENTRY = T.StructType([T.StructField(c, T.StringType()) for c in ("raw", "level", "stream", "source")]).add("micros", T.LongType())


@F.pandas_udf(_ENTRY)
def journal_parts(line: pd.Series) -> pd.DataFrame:
    rows = [decode_entry(x) if x is not None else ("", "", "stdout", "journald", None) for x in line]
    out = pd.DataFrame(rows, columns=["raw", "level", "stream", "source", "micros"])
    return out.astype({"micros": "Int64"})


def journal_match(config: JournalConfig, entry: Column) -> Column:
    """Whether an exported entry is followed: of one of the units, and at least as severe as the priority."""
    found = F.lit(True)
    if config.units:
        names = {u for unit in config.units for u in (unit, f"{unit}.service")}
        found = found & F.coalesce(F.get_json_object(entry, "$._SYSTEMD_UNIT").isin(*sorted(names)), F.lit(False))
    if config.priority < 7:
        level = F.get_json_object(entry, "$.PRIORITY").try_cast("int")
        found = found & F.coalesce(level.between(0, config.priority), F.lit(False))
    return found


def read_journal(spark: SparkSession, path: str, config: JournalConfig = JournalConfig()) -> DataFrame:
    """Text exported as one JSON object for each entry; those that the settings ask for."""
    rows = _text_rows(spark, path).where(journal_match(config, F.col("raw")))
    rows = rows.select("seq", journal_parts("raw").alias("e"))
    time = F.coalesce(F.timestamp_micros("e.micros"), F.current_timestamp())
    rows = rows.select("seq", time.alias("time"), "e.raw", "e.level", "e.stream", "e.source")
    return _line(rows, F.col("source"), F.col("stream"), F.col("level"))


def journal_error(code: int, stderr: bytes, cap: int = 4096) -> str:
    """What a failed journal reader says, with a hint for missing rights."""
    lines = stderr[:cap].decode("utf-8", "replace").strip().splitlines()
    text = lines[0] if lines else f"exit code {code}"
    if "permission" in text.lower() or "not seeing messages" in text.lower():
        text += " (is the user in the group systemd-journal?)"
    return text


def system_journal_warning(folders: Iterable[str] = ("/var/log/journal", "/run/log/journal")) -> str:
    """Says that the system's journal can't be read; silent if one file can, or when unsure."""
    files = [file for folder in folders for file in Path(folder).glob("*/system*.journal")]
    closed = [file for file in files if not os.access(file, os.R_OK)]
    if not closed or len(closed) < len(files):
        return ""
    return "journald: the system journal can't be read, only this session's (is the user in the group systemd-journal?)"


# ---- the driver's tables


def events_lines(events: DataFrame, speedup: int = 1) -> DataFrame:
    """The events table as lines of all formats; seq is event_id, and dense.

    With a speedup, times move towards the first one by that factor.
    """
    shard = F.expr("char(97 + user_id % 26)")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    raw = (
        F.when((kind == "error") & (F.col("user_id") % 50 == 0), F.concat(F.lit("FATAL: worker "), shard, F.lit(" user "), user, F.lit(" crashed")))
        .when(kind == "error", F.concat(F.lit("[ERROR] shard "), shard, F.lit(" failed for user "), user))
        .when(kind == "purchase", F.concat(F.lit("WARN: slow purchase user "), user))
        .when(kind == "signup", F.concat(F.lit('{"level":"info","msg":"signup user '), user, F.lit('","shard":"'), shard, F.lit('"}')))
        .when(kind == "view", F.concat(F.lit("level=debug view user "), user))
        .otherwise(F.concat(F.lit("click user "), user, F.lit(" "), F.col("props")))
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    if speedup != 1:
        first = events.agg(F.min(micros)).first()[0] or 0
        micros = F.expr(f"{first}L + (unix_micros(cast(ts as timestamp)) - {first}L) div {speedup}")
    rows = events.select(
        F.col("event_id").alias("seq"), F.timestamp_micros(micros).alias("time"), raw.alias("raw"),
        F.concat(F.lit("svc:"), kind).alias("source"),
        F.when(F.col("user_id") % 7 == 0, "stderr").otherwise("stdout").alias("stream"),
    )
    return _line(rows, F.col("source"), F.col("stream"))


def document_lines(docs: DataFrame) -> DataFrame:
    """Every line of the documents table; a document is a source, its lines are 50 ms apart."""
    rows = docs.select(
        "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "raw")
    ).select(
        (F.col("doc_id") * 1_000_000 + F.col("n")).alias("seq"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("n") * 50_000).alias("time"),
        without_ends(F.col("raw")).alias("raw"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source"),
    )
    return _line(rows, F.col("source"), F.lit("stdout"))


def fan_in(sources: list[DataFrame]) -> DataFrame:
    """All lines of all sources. Sources number their lines each for itself; the k-th of n gets seq * n + k."""
    numbered = [df.withColumn("seq", F.col("seq") * len(sources) + k) for k, df in enumerate(sources)]
    return functools.reduce(DataFrame.unionByName, numbered)


# ---- selection


@dataclass(frozen=True)
class Text:
    """Lines that stand in files, as those of the standard input landed by a shell."""

    path: str
    name: str = "stdin"

    def load(self, spark: SparkSession) -> DataFrame:
        return read_text(spark, self.path, self.name)


@dataclass(frozen=True)
class Process:
    """Both pipes of a command, landed in a folder."""

    argv: tuple[str, ...]
    folder: str

    @property
    def name(self) -> str:
        return process_name(list(self.argv))

    def load(self, spark: SparkSession) -> DataFrame:
        return read_process(spark, list(self.argv), self.folder)


@dataclass(frozen=True)
class Containers:
    """Captures of container logs whose names the settings ask for."""

    path: str
    config: ContainerConfig
    name: str = "docker"

    def load(self, spark: SparkSession) -> DataFrame:
        rows, name = read_containers(spark, self.path), F.regexp_replace("source", "^docker:", "")
        labels = F.create_map().cast("map<string, string>")
        return rows.where(container_match(self.config, name, name, labels))


@dataclass(frozen=True)
class Journal:
    """An exported journal."""

    path: str
    config: JournalConfig
    name: str = "journald"

    def load(self, spark: SparkSession) -> DataFrame:
        return read_journal(spark, self.path, self.config)


def select_sources(config: Config, stdin: str, containers: str = "", journal: str = "", landing: str = "") -> list[Source]:
    """The sources that the settings ask for, over captured data at these paths; stdin only if there is no other.

    A label can't be told from a capture, so labels select nothing here.
    """
    chosen: list[Source] = []
    if config.command:
        chosen.append(Process(config.command, landing))
    wanted = config.containers
    if wanted.all or wanted.ids or wanted.name or wanted.labels:
        chosen.append(Containers(containers, wanted))
    if config.journal.enabled or config.journal.units:
        chosen.append(Journal(journal, config.journal))
    return chosen or [Text(stdin)]


def load_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    return fan_in([source.load(spark) for source in sources])
