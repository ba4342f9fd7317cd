"""Running template state and anomaly scores, as windows over each template's lines in a chunk of time.

Lines are cut into chunks of about chunks.ROWS by quantiles of their time (and of their number, where one
microsecond holds more), so a template that holds a third of all lines is many window tasks. What a chunk
needs from those before it, its template's count, first and previous time and its last RECENT_CAP - 1 times
within the burst window, is summed up per (template, chunk) and put before the chunk's lines as rows of
their own: at most RECENT_CAP - 1 per (template, chunk), and no more than the lines of one burst window per
chunk. All windows over lines share one exchange. The warm-up needs the corpus's first line and its 101st:
two scalars from a top-k.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from emberlog.config import RECENT_CAP, ScoreConfig
from emberlog.functions.text import duration
from emberlog.operators import chunks


def chunk_bounds(lines: DataFrame, rows: int) -> tuple[list[int], list[int]]:
    """(us, seq) bounds that cut the lines into about equal chunks; the second list only if times tie."""
    times, numbers = chunks.bounds(lines.select(F.unix_micros("time").alias("us"), "seq"), ["us", "seq"], rows)
    return times, numbers if len(set(times)) < len(times) else []


def _with_chunk(df: DataFrame, times: list[int], numbers: list[int]) -> DataFrame:
    """Add _chunk, ascending in (us, seq); lines without a time come first, as in a sort."""
    distinct = sorted(set(times))
    tied = [t for k, t in enumerate(times) if times[k - 1 : k] == [t]]
    df = chunks.below(df, "_chunk", distinct, "us")
    if not numbers:
        return df.withColumn("_chunk", F.coalesce(F.when(F.col("us").isNotNull(), F.col("_chunk")), F.lit(-1)))
    df = chunks.below(df, "_part", sorted(set(numbers)), "seq")
    full = F.array_contains(chunks.literals(sorted(set(tied))), F.col("us"))
    place = 2 * F.col("_chunk") + full.cast("bigint")
    place = place * (len(numbers) + 1) + F.when(full, F.col("_part")).otherwise(0)
    return df.withColumn("_chunk", F.coalesce(place, F.lit(-1))).drop("_part")


def _carried(df: DataFrame, times: list[int], span: int) -> DataFrame:
    """Rows that stand before a (pattern, _chunk): times of earlier chunks within the window of its first line, in order.

    The last of them is there whatever its time, and has _skip, what its row number lacks to the template's
    count, and _first0.
    """
    last = RECENT_CAP - 1
    # Only times within the window of a later chunk's line count: such a line is not before the next bound.
    df = chunks.below(df.select("pattern", "us", "_chunk"), "_k", sorted(set(times)), "us")
    end = F.get(chunks.literals(sorted(set(times))), F.col("_k").cast("int"))
    near = F.when(F.col("us") >= end - span, F.col("us"))
    tail = F.slice(F.sort_array(F.collect_list(near), asc=False), 1, last)
    made = df.groupBy("pattern", "_chunk").agg(
        F.count("*").alias("_n"), F.min("us").alias("_first"), F.max("us").alias("_last"), tail.alias("_tail")
    )
    before = Window.partitionBy("pattern").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumns(
        {
            "_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_first0": F.min("_first").over(before),
            "_prev0": F.max("_last").over(before), "_t0": F.coalesce(F.sum(F.size("_tail")).over(before), F.lit(0)),
        }
    )
    # Chunks whose tails can be among the last 2047 times: tails hold at most as many each.
    reach = Window.partitionBy("pattern").orderBy("_t0").rangeBetween(-2 * last, Window.currentRow)
    made = made.withColumn("_near", F.collect_list(F.when(F.size("_tail") > 0, F.struct("_chunk", "_tail"))).over(reach))
    earlier = F.filter("_near", lambda x: x["_chunk"] < F.col("_chunk"))
    times_desc = F.sort_array(F.flatten(F.transform(earlier, lambda x: x["_tail"])), asc=False)
    near = F.filter(F.slice(times_desc, 1, last), lambda x: x >= F.col("_first") - span)
    made = made.where("_n0 > 0").withColumn("_older", F.slice(near, 2, last))
    skip, none = F.col("_n0") - F.size("_older") - 1, F.lit(None).cast("bigint")
    head = F.struct(F.col("_prev0").alias("us"), F.lit(-(2**63) + 1).alias("seq"), skip.alias("_skip"), F.col("_first0"))
    rest = F.transform("_older", lambda x: F.struct(x.alias("us"), F.lit(-(2**63)).alias("seq"), none.alias("_skip"), none.alias("_first0")))
    return made.select("pattern", "_chunk", F.explode(F.concat(F.array(head), rest)).alias("_x")).select("pattern", "_chunk", "_x.*")


def with_state(lines: DataFrame, config: ScoreConfig = ScoreConfig(), chunk_rows: int = chunks.ROWS) -> DataFrame:
    """Add, per template and as of each line: count, first_us, prev_us, in_window, seconds.

    in_window is the occurrences of the last burst_window among the last RECENT_CAP, this
    one included. Lines of one time count in seq order.
    """
    df = lines.withColumn("us", F.unix_micros("time"))
    span, back = int(config.burst_window * 1_000_000), RECENT_CAP - 1
    times, numbers = chunk_bounds(lines, chunk_rows)
    keys, count = ["pattern"], F.col("_r")
    first = F.col("us")
    if times:
        keys.append("_chunk")
        df = _with_chunk(df, times, numbers)
        df = df.withColumn("_line", F.lit(True)).unionByName(_carried(df, times, span), allowMissingColumns=True)
        first = F.coalesce("_first0", "us")
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    # Counted from the first line on, so the frame only grows: one that slides is read again for every line.
    past = Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, -span - 1)
    df = (
        df.withColumn("_r", F.row_number().over(w).cast("bigint"))
        .withColumn("first_us", F.min(first).over(w))
        .withColumn("prev_us", F.lag("us").over(w))
        .withColumn("_oldest", F.lag("us", back).over(w))
    )
    if times:
        count = count + F.coalesce(F.max("_skip").over(w), F.lit(0))
    seen = F.when(F.col("us").isNull(), F.col("_r")).otherwise(F.col("_r") - F.count("*").over(past))
    df = df.withColumn("count", count).withColumn("_seen", seen)
    if times:
        df = df.where("_line").drop("_chunk", "_line", "_skip", "_first0")
    df = df.withColumn("in_window", F.least(F.col("_seen"), F.lit(RECENT_CAP)).cast("bigint"))
    full = (F.col("in_window") == RECENT_CAP) & (F.col("us") - F.col("_oldest") < span)
    seconds = F.when(full, F.greatest((F.col("us") - F.col("_oldest")) / F.lit(1e6), F.lit(1e-6)))
    return df.withColumn("seconds", F.coalesce(seconds, F.lit(float(config.burst_window)))).drop("_oldest", "_seen", "_r")


def warm_from(lines: DataFrame, config: ScoreConfig) -> tuple[int, int, int] | None:
    """(earliest warm microsecond, us, seq of the first line past the warm-up's lines)."""
    head = (
        lines.select(F.unix_micros("time").alias("us"), "seq").orderBy("us", "seq").limit(config.warmup_lines + 1).collect()
    )
    if len(head) <= config.warmup_lines:
        return None
    return head[0][0] + int(config.warmup * 1_000_000), head[-1][0], head[-1][1]


def with_score(lines: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Add novel, burst, severity, score and the numbers their reasons tell."""
    return add_scores(with_state(lines, config), warm_from(lines, config), config)


def add_scores(df: DataFrame, warm: tuple[int, int, int] | None, config: ScoreConfig) -> DataFrame:
    """Scores of lines that have with_state()'s columns; warm as of warm_from()."""
    weights = config.weights
    if warm is None:
        warmed = F.lit(False)
    else:
        us, seq = F.col("us"), F.col("seq")
        warmed = (us >= warm[0]) & ((us > warm[1]) | ((us == warm[1]) & (seq >= warm[2])))
    gap = F.col("us") - F.col("prev_us")
    novel = warmed & ((F.col("count") == 1) | F.coalesce(gap > int(config.cooloff * 1_000_000), F.lit(False)))
    age = F.col("us") - F.col("first_us")
    df = df.withColumn("rate", F.col("in_window") / F.col("seconds"))
    df = df.withColumn("baseline", F.when(age > 0, F.col("count") / (age / F.lit(1e6))))
    burst = (
        (age >= int(config.baseline_min_age * 1_000_000)) & (age > 0)
        & (F.col("count") >= config.baseline_min_count) & (F.col("in_window") >= config.burst_min_count)
        & (F.col("rate") >= F.lit(float(config.burst_multiplier)) * F.col("baseline"))
    )
    level = F.upper("level")
    of_level = (
        F.when(level.isin("FATAL", "PANIC"), F.lit(weights.fatal)).when(level.isin("ERROR", "CRITICAL"), F.lit(weights.error))
        .when(level == "WARN", F.lit(weights.warn)).otherwise(F.lit(0.0))
    )
    of_stream = F.when(F.col("stream") == "stderr", F.lit(weights.stderr)).otherwise(F.lit(0.0))
    severity = F.greatest(of_stream, F.lit(0.0)) + F.greatest(of_level, F.lit(0.0))
    if weights.severity_max > 0:
        severity = F.least(severity, F.lit(weights.severity_max))
    df = df.withColumns(
        {
            "novel": novel, "burst": F.coalesce(burst, F.lit(False)), "severity": severity,
            "of_stderr": of_stream > 0, "of_level": F.when(of_level > 0, level).otherwise(F.lit("")),
        }
    )
    total = (
        F.when(F.col("novel"), F.lit(weights.novelty)).otherwise(F.lit(0.0))
        + F.when(F.col("burst"), F.lit(weights.burst)).otherwise(F.lit(0.0))
        + F.col("severity")
    )
    return df.withColumn("score", total)


#: What with_reasons() reads.
REASONED = ("novel", "burst", "of_stderr", "of_level", "count", "us", "prev_us", "rate", "baseline", "in_window")


def reasons_of(config: ScoreConfig):
    """A function for the reasons of flagged rows only; their texts round half to even."""

    @F.pandas_udf("array<string>")
    def reasons(
        novel: pd.Series, burst: pd.Series, stderr: pd.Series, level: pd.Series,
        gap_us: pd.Series, rate: pd.Series, base: pd.Series, n: pd.Series,
    ) -> pd.Series:
        out = []
        for nv, bu, se, lv, gap, r, b, k in zip(novel, burst, stderr, level, gap_us, rate, base, n):
            row = []
            if nv:
                row.append(
                    "novel template (first seen)" if pd.isna(gap)
                    else f"novel template (unseen for {duration(int(gap) // 1_000_000)}, cooloff {duration(config.cooloff)})"
                )
            if bu:
                row.append(f"burst: {r:.1f}/s vs baseline {b:.2f}/s ({r / b:.0f}×), {k} in the last {duration(config.burst_window)}")
            if se:
                row.append("stderr")
            if lv:
                row.append(f"level {lv}")
            out.append(row)
        return pd.Series(out)

    return reasons


def with_reasons(scored: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    gap = F.when(F.col("count") > 1, F.col("us") - F.col("prev_us"))
    args = ("novel", "burst", "of_stderr", "of_level", gap, "rate", F.coalesce("baseline", F.lit(0.0)), "in_window")
    return scored.withColumn("reasons", reasons_of(config)(*args))


def template_summary(lines: DataFrame) -> DataFrame:
    """One row for each template: count, first and last time, last level that isn't ''."""
    when = F.struct(F.unix_micros("time").alias("us"), F.col("seq"))
    level = F.max_by("level", F.when(F.col("level") != "", when))
    return lines.groupBy("pattern").agg(
        F.count("*").alias("count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"),
        F.coalesce(level, F.lit("")).alias("level"),
    )


def summary_order(summaries: DataFrame, hash_col: str = "hash") -> DataFrame:
    return summaries.orderBy(F.desc("count"), F.desc("last_seen"), hash_col)
