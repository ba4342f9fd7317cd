"""The whole batch plan: lines -> messages -> templates -> scores -> decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from emberlog.config import Config
from emberlog.functions.levels import normalize
from emberlog.operators import fold, gate, score, views


@dataclass
class Replay:
    """Lazy tables of one replay. Times are event times, in (time, seq) order."""

    lines: DataFrame
    scored: DataFrame
    decided: DataFrame
    config: Config

    @classmethod
    def of(cls, lines: DataFrame, config: Config = Config(), folded: bool = True) -> Replay:
        events = fold.fold(lines, config.group_timeout) if folded else lines
        named = normalize(events)
        scored = score.with_score(named, config.score)
        decided = score.with_reasons(gate.decide(scored, config.score), config.score)
        return cls(named, scored, decided, config)

    def summaries(self) -> DataFrame:
        return score.template_summary(self.lines)

    def history(self) -> DataFrame:
        return gate.flag_history(self.decided)

    def cards(self, n: int = 20) -> DataFrame:
        return views.cards(self.decided, self.summaries(), n=n)

    def records(self, answers: DataFrame | None = None) -> DataFrame:
        return views.records(self.decided, answers, self.config.dry_run)
