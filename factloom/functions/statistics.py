"""Closed forms on aggregates. P-values come from the JVM's distributions, for a handful of scalars."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def _dist(spark: SparkSession):
    return spark._jvm.org.apache.commons.math3.distribution


def t_two_sided(spark: SparkSession, t: float, dof: float) -> float:
    return 2 * _dist(spark).TDistribution(float(dof)).cumulativeProbability(-abs(float(t)))


def f_upper(spark: SparkSession, f: float, d1: float, d2: float) -> float:
    return 1 - _dist(spark).FDistribution(float(d1), float(d2)).cumulativeProbability(float(f))


def chi2_upper(spark: SparkSession, x: float, dof: float) -> float:
    return 1 - _dist(spark).ChiSquaredDistribution(float(dof)).cumulativeProbability(float(x))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def correlation_p(spark: SparkSession, r: float, n: int) -> float | None:
    """Two-sided p of a Pearson or Spearman correlation."""
    if n < 3 or abs(r) >= 1:
        return None if n < 3 else 0.0
    return t_two_sided(spark, r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def band(value: float, cuts: tuple[float, ...], words: tuple[str, ...]) -> str:
    """The word for the highest cut that ``value`` reaches in size."""
    return next((w for c, w in zip(cuts, words, strict=False) if abs(value) >= c), words[-1])


def strength(r: float) -> str:
    return band(r, (0.7, 0.4, 0.2), ("strong", "moderate", "weak", "negligible"))


def d_size(d: float) -> str:
    return band(d, (0.8, 0.5, 0.2), ("large", "medium", "small", "negligible"))


def eta_size(eta: float) -> str:
    return band(eta, (0.14, 0.06, 0.01), ("large", "medium", "small", "negligible"))
