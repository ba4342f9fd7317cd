"""Folding of multi-line messages into one event per header line.

Lines of a (source, stream) are read in order. A line continues the message before it if it is
indented or looks like a stack frame, or, within a trace, if it is blank, an exception's
summary or a call frame; a pause of `timeout` always ends a message.

A line that can't continue anything, or follows a pause, begins a segment whatever came before, so
segments are folded on their own. Their beginnings are found in chunks of the stream: a chunk needs the
last time and the last beginning before it, summed up per (source, stream, chunk). Windows inside
segments say the rest without any Python; only segments that reach the caps of 200 lines or 64 KiB
are read line by line, because a cap makes the next line a header. That is a pass over sorted
rows which holds one message.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.functions.masking import WHITE
from emberlog.operators import chunks

MAX_LINES, MAX_BYTES = 200, 65_536

_S, _E = r"[\t\n\f\r ]", r"(?!\w)"

# Frames and causes of traces, their first lines, and their last.
FRAME = "|".join(
    (
        rf'^{_S}*File ".*", line \d+', rf"^{_S}*at{_S}+[\w$.]+\(", rf"^{_S}*Caused by:", rf"^{_S}*Suppressed:",
        rf"^{_S}*\.\.\.{_S}+\d+{_S}+more{_E}", r"^goroutine \d+ \[", rf"^{_S}*created by [^\t\n\f\r ]", rf"^{_S}*\[signal{_E}",
        r"\.go:\d+",
    )
)
START = rf"^Traceback \(most recent call last\):|^{_S}*panic:|^fatal error:|Exception in thread "
TAIL = (
    rf"^[\w$.]*(?:Error|Exception|Throwable|Fault|Failure|Warning|Interrupt|Timeout|Panic){_E}"
    r"|^[\w$]+(?:\.[\w$]+)+:|^[\w$./]+\("
)
BLANK = f"^[{WHITE}]*$"


def _always(raw: Column) -> Column:
    return (raw.rlike("^[ \t]") & ~raw.rlike(BLANK)) | raw.rlike(FRAME)


def _within(raw: Column) -> Column:
    return raw.rlike(BLANK) | raw.rlike(TAIL)


def _with_beginnings(df: DataFrame, us_gap: int, chunk_rows: int) -> DataFrame:
    """Add _seg, the seq of the line that begins each line's segment; df has _us and _maybe (may continue)."""
    marks = sorted(set(chunks.bounds(df, ["seq"], chunk_rows)[0]))
    keys = ["source", "stream", *(["_chunk"] if marks else [])]
    order = Window.partitionBy(*keys).orderBy("seq")
    paused = lambda before: F.coalesce(F.col("_us") - before >= us_gap, F.lit(True))
    if marks:
        df = chunks.below(df, "_chunk", marks, "seq")
        inner = df.select(*keys, "seq", "_us", "_maybe").withColumn("_r", F.row_number().over(order))
        begins = (F.col("_r") > 1) & (paused(F.lag("_us").over(order)) | ~F.col("_maybe"))
        made = inner.withColumn("_b", begins).groupBy(*keys).agg(
            F.min(F.struct("seq", "_us", "_maybe")).alias("_h"), F.max_by("_us", "seq").alias("_l"),
            F.max(F.when(F.col("_b"), F.col("seq"))).alias("_m"),
        )
        along = Window.partitionBy("source", "stream").orderBy("_chunk")
        made = made.withColumn("_prev0", F.lag("_l").over(along)).withColumn("_us", F.col("_h._us"))
        first = F.when(paused(F.col("_prev0")) | ~F.col("_h._maybe"), F.col("_h.seq"))
        made = made.withColumn("_m", F.coalesce("_m", first))
        made = made.withColumn("_seg0", F.max("_m").over(along.rowsBetween(Window.unboundedPreceding, -1)))
        df = df.join(made.select(*keys, "_prev0", "_seg0"), keys, "left")
    last = F.lag("_us").over(order)
    if marks:
        last = F.coalesce(last, F.col("_prev0"))
    df = df.withColumn("_b", paused(last) | ~F.col("_maybe"))
    seg = F.max(F.when(F.col("_b"), F.col("seq"))).over(order)
    return df.withColumn("_seg", F.coalesce(seg, F.col("_seg0"), F.col("seq")) if marks else seg).drop("_chunk", "_prev0", "_seg0", "_b")


def fold(lines: DataFrame, timeout: float = 0.2, chunk_rows: int = chunks.ROWS) -> DataFrame:
    """One row for each message: its header's columns, raw joined by line feeds, n_lines.

    seq is unique; source and stream are not null; a null raw begins a message. A timeout of 0 leaves
    the lines as they are.
    """
    if not timeout:
        return lines.withColumn("n_lines", F.lit(1).cast("bigint"))
    df = lines.select("seq", "time", "source", "stream", "raw", "level").withColumn("_us", F.unix_micros("time"))
    df = df.withColumn("_u", F.coalesce(_always(F.col("raw")), F.lit(False)))
    df = df.withColumn("_w", F.coalesce(_within(F.col("raw")), F.lit(False)) & ~F.col("_u"))
    df = df.withColumn("_maybe", F.col("_u") | F.col("_w"))
    keys = ["source", "stream", "_seg"]
    df = _with_beginnings(df, int(timeout * 1_000_000), chunk_rows).repartition(*keys)
    whole, k = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("seq")
    n, size = F.count("*").over(whole), F.sum(F.octet_length("raw") + 1).over(whole) - 1
    df = df.withColumn("_long", (n > MAX_LINES) | ((n > 1) & F.coalesce(size >= MAX_BYTES, F.lit(False))))
    short = df.where(~F.col("_long"))
    later = F.col("seq") > F.col("_seg")
    short = short.withColumn("_uu", F.col("_u") & later).withColumn("_pc", F.col("_w") & later)
    short = short.withColumn("_chain", F.sum(F.when(F.col("_pc"), 0).otherwise(1)).over(k))
    inner = Window.partitionBy(*keys, "_chain").orderBy("seq")
    short = short.withColumn("_act", F.max(F.col("_uu") | F.col("raw").rlike(START)).over(inner))
    cont = F.col("_uu") | (F.col("_pc") & F.coalesce(F.lag("_act").over(inner), F.lit(False)))
    short = short.withColumn("_event", F.max(F.when(~cont, F.col("seq"))).over(k))
    parts = F.sort_array(F.collect_list(F.struct("seq", "time", "level", "raw")))
    events = short.groupBy(*keys, "_event").agg(parts.alias("p")).select(
        F.col("p")[0]["seq"].alias("seq"), F.col("p")[0]["time"].alias("time"), "source", "stream",
        F.array_join(F.transform("p", lambda x: x["raw"]), "\n").alias("raw"),
        F.col("p")[0]["level"].alias("level"), F.size("p").cast("bigint").alias("n_lines"),
    )
    schema = "seq bigint, time timestamp, source string, stream string, raw string, level string, n_lines bigint"
    ordered = df.where("_long").select("seq", "time", *keys, "raw", "level").sortWithinPartitions(*keys, "seq")
    return events.unionByName(ordered.mapInPandas(_recut, schema))


_re = {n: re.compile(p, re.ASCII) for n, p in (("f", FRAME), ("s", START), ("t", TAIL))}
_blank = lambda s: not s.strip()


def continues(raw: str, active: bool) -> bool:
    """The rule for one line; active: whether a trace is open."""
    if (raw[:1] in (" ", "\t") and not _blank(raw)) or _re["f"].search(raw):
        return True
    return active and (_blank(raw) or bool(_re["t"].search(raw)))


def fold_rows(rows: list[tuple], timeout_us: int | None = None) -> list[list[tuple]]:
    """Messages of one stream's (seq, micros, raw, ...) rows, line by line, with both caps."""
    out: list[list[tuple]] = []
    open_, active, size, last = False, False, 0, 0
    for row in rows:
        raw = row[2]
        idle = timeout_us is not None and open_ and row[1] - last >= timeout_us
        if open_ and not idle and continues(raw, active):
            out[-1].append(row)
            active, size = True, size + 1 + len(raw.encode("utf-8", "surrogatepass"))
            open_ = not (len(out[-1]) >= MAX_LINES or size >= MAX_BYTES)
        else:
            out.append([row])
            open_, active, size = True, bool(_re["s"].search(raw)), len(raw.encode("utf-8", "surrogatepass"))
        last = row[1]
    return out


def _recut(batches):
    """Messages of sorted long segments; one is open at a time."""
    key, event, open_, active, size = None, [], False, False, 0

    def messages(events):
        rows = [(e[0][0], e[0][1], *k, "\n".join(x[3] for x in e), e[0][2], len(e)) for k, e in events]
        return pd.DataFrame(rows, columns=["seq", "time", "source", "stream", "raw", "level", "n_lines"])

    for batch in batches:
        done = []
        for seq, time, source, stream, seg, raw, level in batch.itertuples(index=False, name=None):
            raw, here = raw or "", (source, stream, seg)
            n = len(raw.encode("utf-8", "surrogatepass"))
            if here == key and open_ and continues(raw, active):
                event.append((seq, time, level, raw))
                active, size = True, size + 1 + n
                open_ = len(event) < MAX_LINES and size < MAX_BYTES
                continue
            if event:
                done.append((key[:2], event))
            key, event = here, [(seq, time, level, raw)]
            open_, active, size = True, bool(_re["s"].search(raw)), n
        yield messages(done)
    if event:
        yield messages([(key[:2], event)])
