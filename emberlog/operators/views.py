"""Context, cards, snapshots, exported records and plain lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.functions.masking import fnv


#: Bits of bitmap_construct_agg().
_BITS = 32_768


def _seconds_before(starts: DataFrame, flagged: DataFrame, n: int) -> DataFrame:
    """One row, `_bits`: which seconds, modulo _BITS, hold flagged rows or one of the n places before them."""
    hit = flagged.select(F.floor(F.col("us") / 1_000_000).alias("_s")).distinct().withColumn("_hit", F.lit(True))
    after = Window.orderBy("_s").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # one row for each second
    lowest = F.min(F.when(F.col("_hit"), F.col("_before") + 1 - n)).over(after)
    near = starts.join(hit, "_s", "left").withColumn("_low", lowest).where("_before + _n >= _low")
    return near.agg(F.bitmap_construct_agg(F.pmod("_s", F.lit(_BITS))).alias("_bits"))


def with_position(lines: DataFrame, flagged: DataFrame | None = None, n: int = 30) -> DataFrame:
    """Add `pos`, the dense place in (time, seq) order, without one task for all rows.

    Lines are counted per second, the counts summed up over the seconds, and lines ranked
    inside their second. With flagged rows (us), only whole seconds stay, at least those with the
    flagged rows and the n places before each: other lines are counted, but not moved.
    """
    df = lines.withColumn("_us", F.unix_micros("time")).withColumn("_s", F.floor(F.col("_us") / 1_000_000))
    upto = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row for each second
    starts = df.groupBy("_s").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    if flagged is not None:
        bit = F.pmod("_s", F.lit(_BITS))
        octet = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        wanted = F.getbit(octet, (bit % 8).cast("int")) == 1
        df = df.join(F.broadcast(_seconds_before(starts, flagged, n)), wanted, "left_semi")
    inside = Window.partitionBy("_s").orderBy("_us", "seq")
    return (
        df.withColumn("_r", F.row_number().over(inside)).join(starts.select("_s", "_before"), "_s")
        .withColumn("pos", F.col("_before") + F.col("_r")).drop("_us", "_s", "_r", "_before")
    )


def with_context(flagged: DataFrame, lines: DataFrame, n: int = 30, prefix: bool = True, name: str = "context") -> DataFrame:
    """Add the n lines before each flagged one over all sources, oldest first.

    Both tables have `pos`. Each flagged row asks for its n places, so it is an equi-join.
    """
    if n <= 0:
        return flagged.withColumn(name, F.array().cast("array<string>"))
    text = F.concat(F.lit("["), "source", F.lit("] "), "raw") if prefix else F.col("raw")
    wanted = flagged.select(F.col("pos").alias("_at"), F.explode(F.sequence(F.greatest(F.col("pos") - n, F.lit(1)), F.col("pos"))).alias("_p"))
    wanted = wanted.where("_p < _at")
    found = wanted.join(lines.select(F.col("pos").alias("_p"), text.alias("_t")), "_p")
    per = found.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct("_p", "_t"))).alias("_c"))
    joined = flagged.join(per, flagged["pos"] == per["_at"], "left").drop("_at")
    none = F.array().cast("array<string>")
    return joined.withColumn(name, F.coalesce(F.transform("_c", lambda x: x["_t"]), none)).drop("_c")


def stream_tail(lines: DataFrame, n: int = 2000) -> DataFrame:
    """The last n lines in order."""
    us = F.unix_micros("time")
    return lines.orderBy(us.desc(), F.desc("seq")).limit(n).orderBy(us, "seq")


def cards(decided: DataFrame, summaries: DataFrame, history: DataFrame | None = None, n: int = 20) -> DataFrame:
    """The newest escalation of each template, the n most recent, oldest first.

    Line, score and reasons are those of the escalation; counts, times and flags are live. Without
    a history, flags are counted on the way.
    """
    w = Window.partitionBy("pattern").orderBy(F.desc("us"), F.desc("seq"))
    newest = decided.where("decision = 'escalated'").withColumn("_r", F.row_number().over(w))
    if history is None:
        whole = Window.partitionBy("pattern")
        newest = newest.withColumns(
            {"flag_count": F.count("*").over(whole), "first_flagged_us": F.min("us").over(whole), "last_flagged_us": F.max("us").over(whole)}
        )
    kept = newest.where("_r = 1").drop("_r").orderBy(F.desc("us"), F.desc("seq")).limit(n)
    live = summaries.select("pattern", F.col("count").alias("live_count"), F.col("first_seen").alias("live_first"), F.col("last_seen").alias("live_last"))
    made = kept.join(live, "pattern", "left")
    return (made if history is None else made.join(history, "pattern", "left")).orderBy("us", "seq")


def newest_first(shown: DataFrame) -> DataFrame:
    """Cards as a screen lists them."""
    return shown.orderBy(F.desc("us"), F.desc("seq"))


def snapshot_stats(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: lines, templates, sources, escalated, suppressed, cached."""
    names = F.array_join(F.sort_array(F.collect_set(F.when(F.col("source") != "", F.col("source")))), ",")
    left = lines.agg(
        F.count("*").alias("total_lines"), F.count_distinct("pattern").alias("unique_templates"), names.alias("sources")
    )
    right = decided.agg(*(F.count_if(F.col("decision") == d).alias(d) for d in ("escalated", "suppressed", "cached")))
    return left.join(right, F.lit(True))


def lines_per_second(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.floor(F.unix_micros("time") / 1_000_000).alias("second")).agg(F.count("*").alias("lines"))


def rfc3339(us: Column) -> Column:
    """UTC, with as many digits of the fraction as it needs."""
    text = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(short, F.lit("Z"))


NO_TIME = "0001-01-01T00:00:00Z"

EXPLANATION = "state string, summary string, likely_cause string, suggestion string, truncated boolean, error string, at string"


def records(decided: DataFrame, answers: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Export records of escalations, as of their flag.

    answers: (seq, EXPLANATION fields), one for each resolved escalation; an escalation
    without one is not written. In a dry run every escalation is, without an answer.
    """
    rows = decided.where("decision = 'escalated'")
    if dry_run or answers is None:
        ex = F.struct(
            F.lit("not_requested" if dry_run else "unavailable").alias("state"), *(F.lit("").alias(c) for c in ("summary", "likely_cause", "suggestion")),
            F.lit(False).alias("truncated"), F.lit("").alias("error"), F.lit(NO_TIME).alias("at"),
        )
    else:
        rows = rows.join(answers.select("seq", F.struct(*(c.split()[0] for c in EXPLANATION.split(", "))).alias("_x")), "seq")
        ex = F.col("_x")
    return rows.select(
        F.lit("would_escalate" if dry_run else "anomaly").alias("kind"), fnv(F.col("pattern")).alias("template_hash"),
        "pattern", "level", "source", F.col("count").alias("count_at_flag"), rfc3339(F.col("first_us")).alias("first_seen"),
        rfc3339(F.col("us")).alias("last_seen_at_flag"), "score", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
        ex.alias("explanation"),
    )


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_records(rows: DataFrame, path: str) -> None:
    """Append records as JSON lines; files appear whole or not at all."""
    json_lines(rows).write.mode("append").text(path)


def explained_text(state: str, pattern: str, summary: str, cause: str, suggestion: str, truncated: bool, error: str) -> str:
    """What the plain sink prints when an answer arrives."""
    if state != "explained":
        return f"EXPLANATION UNAVAILABLE: {pattern} | {error}"
    rows = [f"EXPLAINED{' (INCOMPLETE)' if truncated else ''}: {pattern}", f"  what:  {summary}"]
    rows += [f"  {name}: {value}" for name, value in (("cause", cause), ("check", suggestion)) if value]
    return "\n".join(rows)


def plain_lines(decided: DataFrame, lines: DataFrame, dry_run: bool = False, answers: DataFrame | None = None) -> DataFrame:
    """(seq, part, text): each line's summary (0), what was flagged after it (1) and its answer (2).

    lines has count; decided adds decision, reasons, score and queued; answers is as in records().
    """
    label = F.when(F.col("level") == "", "-").otherwise(F.col("level"))
    plain = F.concat(F.lit("["), "source", F.lit(" "), label, F.lit(" x"), F.col("count").cast("string"), F.lit("] "), "pattern")
    every = lines.select("seq", F.lit(0).alias("part"), plain.alias("text"))

    @F.pandas_udf("string")
    def flagged(pattern: pd.Series, reasons: pd.Series, score: pd.Series, queued: pd.Series) -> pd.Series:
        verbs = ["WOULD ESCALATE" if dry_run else "ESCALATED" if q else "ESCALATION DROPPED (queue full)" for q in queued]
        return pd.Series([f"{v}: {p} | reasons: {', '.join(r)} | score: {s:.2f}" for v, p, r, s in zip(verbs, pattern, reasons, score)])

    hits = decided.where("decision = 'escalated'").select("seq", F.lit(1).alias("part"), flagged("pattern", "reasons", "score", "queued").alias("text"))
    if answers is None or dry_run:
        return every.unionByName(hits)

    @F.pandas_udf("string")
    def told(state: pd.Series, pattern: pd.Series, summary: pd.Series, cause: pd.Series, check: pd.Series, cut: pd.Series, error: pd.Series) -> pd.Series:
        return pd.Series([explained_text(*row) for row in zip(state, pattern, summary, cause, check, cut, error)])

    rows = decided.where("decision = 'escalated'").select("seq", "pattern").join(answers, "seq")
    text = told("state", "pattern", "summary", "likely_cause", "suggestion", "truncated", "error")
    return every.unionByName(hits).unionByName(rows.select("seq", F.lit(2).alias("part"), text.alias("text")))


def explain_counts(carried: DataFrame) -> DataFrame:
    """One row: how many templates wait for an answer, have one, or failed; of carry_answers()."""
    return carried.agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in (("pending", "explaining"), ("done", "explained"), ("failed", "failed"))))


def carry_answers(flags: DataFrame, answers: DataFrame) -> DataFrame:
    """The explanation each template shows: (hash, state, summary, likely_cause, suggestion, err, at).

    flags: (hash, ts); answers: (hash, at, state, summary, likely_cause, suggestion, err), the
    last two tables in event order. A flag makes the state pending and keeps the last answer; an
    answer replaces all; a failure keeps an earlier answer with its time and tells the error.
    A hash that was never flagged is ignored.
    """
    fields = ("summary", "likely_cause", "suggestion")
    f = flags.select("hash", F.col("ts").alias("t"), F.lit(0).alias("k"), F.lit("pending").alias("state"), *(F.lit(None).cast("string").alias(c) for c in (*fields, "err")))
    a = answers.join(flags.select("hash").distinct(), "hash", "left_semi").select("hash", F.col("at").alias("t"), F.lit(1).alias("k"), "state", *fields, "err")
    w = Window.partitionBy("hash").orderBy("t", "k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    done = F.when(F.col("state") == "done", F.struct("t", *fields))
    both = f.unionByName(a).withColumn("_d", F.last(done, ignorenulls=True).over(whole))
    both = both.withColumn("_l", F.last(F.struct("state", "err", "t")).over(whole)).dropDuplicates(["hash"])
    return both.select(
        "hash", F.col("_l.state").alias("state"), *(F.coalesce(F.col(f"_d.{c}"), F.lit("")).alias(c) for c in fields),
        F.when(F.col("_l.state") == "failed", F.col("_l.err")).otherwise(F.lit("")).alias("err"),
        F.when(F.col("_d").isNotNull(), F.col("_d.t")).when(F.col("_l.state") == "failed", F.col("_l.t")).alias("at"),
    )
