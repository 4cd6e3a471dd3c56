"""The evidence ledger: what was measured in a session, so that later claims can be held against it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class EvidenceLedger:
    correlations: list[dict[str, Any]] = field(default_factory=list)
    imputed_groups: list[dict[str, Any]] = field(default_factory=list)
    rankings: list[dict[str, Any]] = field(default_factory=list)
    durations: list[dict[str, Any]] = field(default_factory=list)
    joins: list[dict[str, Any]] = field(default_factory=list)
    truncations: list[dict[str, Any]] = field(default_factory=list)
    grains: list[dict[str, Any]] = field(default_factory=list)
    reconciliations: list[dict[str, Any]] = field(default_factory=list)
    effects: list[dict[str, Any]] = field(default_factory=list)

    def note(self, kind: str, **facts: Any) -> None:
        getattr(self, kind).append(facts)

    def note_correlation(self, dataset: str, a: str, b: str, method: str, r: float | None) -> None:
        if r is not None and r == r:
            first, second = sorted((a, b))
            self.note("correlations", dataset=dataset, a=first, b=second, method=method, r=float(r))

    def note_ranking(self, dataset: str, group: str, value: str | None, how: str, order: list[tuple[str, float]], total: float | None = None, groups: int | None = None, running: dict[int, float] | None = None, table: DataFrame | None = None) -> None:
        """``order`` may be its head only; ``total`` and ``groups`` are of all groups, ``running`` the running share in per cent at the first so many of them, ``table`` (label, rank) the whole ranking."""
        self.rankings = [r for r in self.rankings if (r["dataset"], r["group"], r["value"], r["how"]) != (dataset, group, value, how)]
        self.note("rankings", dataset=dataset, group=group, value=value, how=how, order=order, total=sum(v for _, v in order) if total is None else total, groups=groups or len(order), running=running or {}, table=table)

    def of(self, kind: str, dataset: str) -> list[dict[str, Any]]:
        return [x for x in getattr(self, kind) if x.get("dataset") == dataset]

    def rankings_table(self, spark: SparkSession) -> DataFrame:
        """One row per ranked label of every recorded ranking."""
        rows = [
            (r["dataset"], r["group"], r["value"], r["how"], k, label, float(v))
            for r in self.rankings
            for k, (label, v) in enumerate(r["order"], 1)
        ]
        return spark.createDataFrame(rows, "dataset string, group_col string, value_col string, how string, rank int, label string, value double")
