"""The batch operators over streams.

`fold_stream` keeps an open message for each (source, stream). `Live` scores micro-batches:
the state of templates is a table, the gate and the line counter are a small record, and both are
written under the number of the batch that made them. A batch that runs again starts from its
predecessor's state and overwrites its own results, so it counts once. The state of earlier batches
is removed.

Late lines are scored at the place where they arrive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.config import RECENT_CAP, Config
from emberlog.functions.levels import normalize
from emberlog.operators import fold, score
from emberlog.operators.gate import Gate

_MESSAGE = "time timestamp, source string, stream string, raw string, level string, n_lines bigint"
_OPEN = "time timestamp, level string, lines array<string>, active boolean, size bigint"


def _fold_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int) -> Iterator[pd.DataFrame]:
    source, stream = key
    out: list[tuple] = []

    def close(held: tuple) -> None:
        time, level, lines, _, _ = held
        out.append((time, source, stream, "\n".join(lines), level, len(lines)))

    held = state.get if state.exists else None
    if state.hasTimedOut:
        if held:
            close(held)
        state.remove()
    else:
        for batch in batches:
            for row in batch.sort_values(["time", "seq"] if "seq" in batch else ["time"], kind="stable").itertuples(index=False):
                size = len(row.raw.encode("utf-8", "surrogatepass"))
                if held and fold.continues(row.raw, held[3]):
                    held = (held[0], held[1], [*held[2], row.raw], True, held[4] + 1 + size)
                    if len(held[2]) >= fold.MAX_LINES or held[4] >= fold.MAX_BYTES:
                        close(held)
                        held = None
                else:
                    if held:
                        close(held)
                    held = (row.time, row.level, [row.raw], bool(fold._re["s"].search(row.raw)), size)
        if held:
            state.update(held)
            state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
    yield pd.DataFrame(out, columns=["time", "source", "stream", "raw", "level", "n_lines"])


def fold_stream(lines: DataFrame, timeout_ms: int = 200) -> DataFrame:
    """Messages of a stream of lines; an open one is let go after a pause of `timeout_ms`."""
    return lines.groupBy("source", "stream").applyInPandasWithState(
        lambda k, b, s: _fold_group(k, b, s, timeout_ms), _MESSAGE, _OPEN, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


_DECIDED = (
    "seq bigint, us bigint, source string, stream string, raw string, level string, pattern string, "
    "score double, reasons array<string>, count bigint, first_us bigint"
)
_STATE = "pattern string, n bigint, first bigint, last bigint, recent array<bigint>"


class Live:
    """Scores and decides micro-batches; use `process` with foreachBatch."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = Config()):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config

    # ---- stored state

    def _record(self, batch: int) -> dict:
        if batch < 0:
            gate = Gate(self.config.score.rate_per_min, int(self.config.score.cache_ttl * 1_000_000))
            return {"start": None, "lines": 0, "gate": asdict(gate)}
        return json.loads(self.spark.read.text(f"{self.folder}/record/{batch}").first()[0])

    def _templates(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.folder}/templates/{batch}")

    def _state(self, lines: DataFrame, prior: DataFrame) -> DataFrame:
        """with_state() on top of what earlier batches counted."""
        span = int(self.config.score.burst_window * 1_000_000)
        df = lines.withColumn("us", F.unix_micros("time")).join(prior, "pattern", "left")
        w = Window.partitionBy("pattern").orderBy("us", "seq")
        near = Window.partitionBy("pattern").orderBy("us").rangeBetween(-span, Window.currentRow)
        df = df.withColumn("_r", F.row_number().over(w)).withColumn("_lag", F.lag("us", RECENT_CAP - 1).over(w))
        df = (
            df.withColumn("count", (F.col("_r") + F.coalesce("n", F.lit(0))).cast("bigint"))
            .withColumn("first_us", F.coalesce("first", F.min("us").over(w)))
            .withColumn("prev_us", F.coalesce(F.lag("us").over(w), "last"))
            .withColumn("_from", F.min("_r").over(near))
        )
        none = F.array().cast("array<bigint>")
        recent = F.coalesce("recent", none)
        earlier = F.size(F.filter(recent, lambda t: t >= F.col("us") - span))
        df = df.withColumn("in_window", F.least(F.col("_r") - F.col("_from") + 1 + earlier, F.lit(RECENT_CAP)))
        oldest = F.coalesce("_lag", F.try_element_at(recent, -F.greatest(F.lit(RECENT_CAP) - F.col("_r"), F.lit(1))))
        full = (F.col("in_window") == RECENT_CAP) & (F.col("us") - oldest < span)
        seconds = F.when(full, F.greatest((F.col("us") - oldest) / F.lit(1e6), F.lit(1e-6)))
        df = df.withColumn("seconds", F.coalesce(seconds, F.lit(float(self.config.score.burst_window))))
        return df.drop("_r", "_lag", "_from", "n", "first", "last", "recent")

    def _merged(self, lines: DataFrame, prior: DataFrame) -> DataFrame:
        w = Window.partitionBy("pattern").orderBy(F.desc("us"), F.desc("seq"))
        rows = lines.select("pattern", F.unix_micros("time").alias("us"), "seq").withColumn("_r", F.row_number().over(w))
        new = rows.groupBy("pattern").agg(
            F.count("*").alias("k"), F.min("us").alias("f"), F.max("us").alias("l"),
            F.sort_array(F.collect_list(F.when(F.col("_r") <= RECENT_CAP, F.col("us")))).alias("c"),
        )
        both = F.concat(F.coalesce("recent", F.array().cast("array<bigint>")), F.coalesce("c", F.array().cast("array<bigint>")))
        kept = F.slice(both, F.greatest(F.size(both) - RECENT_CAP + 1, F.lit(1)), RECENT_CAP)
        return prior.join(new, "pattern", "full").select(
            "pattern", (F.coalesce("n", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("n"), F.coalesce("first", "f").alias("first"),
            F.coalesce("l", "last").alias("last"), kept.alias("recent"),
        )

    def _warm(self, lines: DataFrame, record: dict) -> tuple[int, int, int] | None:
        config = self.config.score
        left = config.warmup_lines + 1 - record["lines"]
        earliest = record["start"] + int(config.warmup * 1_000_000)
        if left <= 0:
            return earliest, -(2**62), 0
        head = lines.select(F.unix_micros("time").alias("us"), "seq").orderBy("us", "seq").limit(left).collect()
        return (earliest, head[-1][0], head[-1][1]) if len(head) == left else None

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

    # ---- one micro-batch

    def process(self, batch: DataFrame, number: int) -> None:
        """Score and decide a batch of lines (LINE columns); results go to <folder>/decided/<number>.

        Lines without seq count in the order of the batch's rows.
        """
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.monotonically_increasing_id())
        lines = normalize(batch).persist()
        try:
            record, prior = self._record(number - 1), self._templates(number - 1)
            n, start = lines.agg(F.count("*"), F.min(F.unix_micros("time"))).first()
            if record["start"] is None:
                record["start"] = start
            if n:
                warm = self._warm(lines, record)
                scored = score.add_scores(self._state(lines, prior), warm, self.config.score)
                rows = score.with_reasons(scored.where(F.col("score") >= self.config.score.threshold), self.config.score)
                rows = rows.select(*(c.split()[0] for c in _DECIDED.split(", ")))
                gate, made = Gate(**record["gate"]), []
                for r in rows.select("us", "seq", "pattern").orderBy("us", "seq").toLocalIterator():
                    made.append((r["seq"], gate.decide(r["pattern"], r["us"])))
                record["gate"] = asdict(gate)
                decided = rows.join(self.spark.createDataFrame(made, "seq bigint, decision string"), "seq")
            else:
                decided = self.spark.createDataFrame([], _DECIDED + ", decision string")
            record["lines"] += n
            decided.write.mode("overwrite").parquet(f"{self.folder}/decided/{number}")
            self._merged(lines, prior).write.mode("overwrite").parquet(f"{self.folder}/templates/{number}")
            text = self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1)
            text.write.mode("overwrite").text(f"{self.folder}/record/{number}")
            for name in ("templates", "record"):  # a batch that runs again needs its predecessor only
                self._remove(f"{self.folder}/{name}/{number - 2}")
        finally:
            lines.unpersist()

    def start(self, lines: DataFrame, folded: bool = False, **trigger):
        """Run over a stream of lines. folded: over its messages, each given out once a pause or a new header ends it;
        a trigger that stops by itself leaves the last one of each stream open."""
        if folded and self.config.group_timeout:
            lines = fold_stream(lines, int(self.config.group_timeout * 1000))
        writer = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def decided(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/decided")


def answered_flags(flags: DataFrame, answers: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Flags (hash, flagged) with the answer (hash, at, ...) that came within a time, over two streams.

    A flag without one is given out once the watermark has passed it, with nulls.
    """
    one = flags.withWatermark("flagged", within)
    two = answers.withColumnRenamed("hash", "_hash").withWatermark("at", within)
    on = F.expr(f"hash = _hash and at >= flagged and at <= flagged + interval {within}")
    return one.join(two, on, "left").drop("_hash")


def template_counts(lines: DataFrame, watermark: str = "1 hour", window: str = "1 minute") -> DataFrame:
    """Counts of each template per window of event time, over a stream of lines."""
    named = normalize(lines).withWatermark("time", watermark)
    return named.groupBy(F.window("time", window), "pattern").agg(F.count("*").alias("count"))
