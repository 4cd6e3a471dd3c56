"""Thresholds of the operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    min_group_rows: int = 5
    subgroup_min_rows: int = 30
    high_cardinality: int = 50
    pivot_levels: int = 60
    vocabulary: int = 2000
    fuzzy_labels: int = 500
    kendall_cells: int = 5000
    crosstab_cells: int = 1_000_000
    driver_candidates: int = 40
    reconcile_tolerance: float = 0.005
    near_tie: float = 0.05
    outlier_z: float = 3.0
    iqr_reach: float = 1.5
    null_column_share: float = 0.5
    null_row_share: float = 0.5
    looks_like_share: float = 0.8
    measure_loss: float = 0.005


LIMITS = Limits()


@dataclass(frozen=True)
class Refusal:
    """Returned in place of a result that would mislead."""

    reason: str

    def __bool__(self) -> bool:
        return False
