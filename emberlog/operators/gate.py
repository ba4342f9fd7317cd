"""The escalation gate: threshold, a cache by template, and one token bucket for all.

The bucket is global and each decision depends on the one before, so the rows that reach the
threshold pass in (time, seq) order through one task, as a stream with the cache as its only
state, and come out with their decision: scores are computed once and nothing is joined back. They
are few by the gate's purpose; everything before stays parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from emberlog.config import ScoreConfig


@dataclass
class Gate:
    """One object for batch and stream; times in microseconds."""

    rate_per_min: int
    ttl_us: int
    tokens: float = -1.0
    last: int | None = None
    marks: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.tokens < 0:
            self.tokens = float(self.rate_per_min)

    def allow(self, now: int) -> bool:
        if self.rate_per_min <= 0:
            return False
        if self.last is None:
            self.last = now
        elif now > self.last:
            self.tokens = min(float(self.rate_per_min), self.tokens + (now - self.last) / 1e6 * (self.rate_per_min / 60.0))
            self.last = now
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True

    def decide(self, key: str, now: int) -> str:
        """escalated, cached (explained within the ttl) or suppressed (no token). Only an
        escalation marks the cache, and a cached row spends no token."""
        at = self.marks.get(key)
        if at is not None and now - at < self.ttl_us:
            return "cached"
        if not self.allow(now):
            return "suppressed"
        self.marks[key] = now
        return "escalated"


def decide(scored: DataFrame, config: ScoreConfig = ScoreConfig(), key: str = "pattern", columns: Iterable[str] | None = None) -> DataFrame:
    """The rows at or above the threshold, with `decision`.

    columns: what the rows keep besides seq, us and the key; all by default. Spark can't see what Python leaves
    unread, so what isn't named here goes through every exchange before the gate for nothing.
    """
    rate, ttl = config.rate_per_min, int(config.cache_ttl * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = Gate(rate, ttl)
        for batch in batches:
            made = [gate.decide(k, u) for k, u in zip(batch.column(key).to_pylist(), batch.column("us").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "decision"])

    candidates = scored.where(F.col("score") >= config.threshold)
    if columns is not None:
        candidates = candidates.select(*dict.fromkeys(("seq", "us", key, *columns)))
    ordered = candidates.repartition(1).sortWithinPartitions("us", "seq")
    return ordered.mapInArrow(run, T.StructType([*candidates.schema.fields, T.StructField("decision", T.StringType())]))


def stats(decided: DataFrame) -> DataFrame:
    """Escalated, cached, suppressed and dropped rows; with queued(), dropped are escalations the queue had no room for."""
    lost = F.count_if((F.col("decision") == "escalated") & ~F.col("queued")) if "queued" in decided.columns else F.lit(0).cast("bigint")
    return decided.agg(
        *(F.count_if(F.col("decision") == d).alias(d) for d in ("escalated", "cached", "suppressed")), lost.alias("dropped")
    )


def cache_counts(decided: DataFrame, key: str = "pattern") -> DataFrame:
    """(key, hits): rows of each template's present cache entry, the escalation that made it among them."""
    made = decided.where("decision = 'escalated'").groupBy(key).agg(F.max("us").alias("_made"))
    return (
        decided.where("decision <> 'suppressed'").join(made, key)
        .groupBy(key).agg((1 + F.count_if((F.col("decision") == "cached") & (F.col("us") >= F.col("_made")))).alias("hits"))
    )


def flag_history(decided: DataFrame, key: str = "pattern") -> DataFrame:
    """How often and when each template escalated."""
    return decided.where("decision = 'escalated'").groupBy(key).agg(
        F.count("*").alias("flag_count"), F.min("us").alias("first_flagged_us"), F.max("us").alias("last_flagged_us")
    )


def queued(decided: DataFrame, capacity: int | None) -> DataFrame:
    """Add `queued`: without an explainer (None) nothing is; else the first `capacity` escalations
    of each second, a bound on what a worker pool takes in."""
    if capacity is None:
        return decided.withColumn("queued", F.lit(False))
    from pyspark.sql import Window

    w = Window.partitionBy("decision", F.floor(F.col("us") / 1_000_000)).orderBy("us", "seq")
    return decided.withColumn("queued", (F.col("decision") == "escalated") & (F.row_number().over(w) <= capacity))
