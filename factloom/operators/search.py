"""Sequential search for settings: trials propose where the next ones go, and every trial is a Spark job of its own.

After ``START`` trials at random, those done are split into the best quarter and the rest. Each setting has a density of either group: for numbers a mixture of
normals around its trials and a flat part, for choices their smoothed shares. Candidates are drawn from the density of the good ones, and the one that is
likeliest under good against bad is tried. Trials of one round run side by side and do not see each other, so a seed gives the same trials whatever
finishes first.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession

from .models import candidates, judge, split, stages

START, GOOD, DRAWS, AT_ONCE = 8, 0.25, 32, 4


@dataclass(frozen=True)
class Number:
    """A number between two ends; ``log``: evenly over its orders of magnitude."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, v: float) -> float:
        """The value as a share of the range."""
        low, high, v = (np.log(x) if self.log else x for x in (self.low, self.high, v))
        return float((v - low) / (high - low))

    def outer(self, share: float) -> float | int:
        low, high = (np.log(x) if self.log else x for x in (self.low, self.high))
        v = low + min(1.0, max(0.0, share)) * (high - low)
        v = float(np.exp(v)) if self.log else float(v)
        return min(int(self.high), max(int(self.low), round(v))) if self.whole else v

    def draw(self, rng: np.random.Generator, seen: list) -> float | int:
        if not seen or rng.random() < 1 / (len(seen) + 1):
            return self.outer(rng.random())
        at = np.array([self.inner(v) for v in seen])
        return self.outer(rng.normal(at[rng.integers(len(at))], self.spread(at)))

    def spread(self, at: np.ndarray) -> float:
        return max(0.04, float(at.std()) * len(at) ** -0.2)

    def density(self, v: float, seen: list) -> float:
        at, x = np.array([self.inner(s) for s in seen]), self.inner(v)
        if not len(at):
            return 1.0
        wide = self.spread(at)
        return float((1 + np.exp(-0.5 * ((x - at) / wide) ** 2).sum() / (wide * np.sqrt(2 * np.pi))) / (len(at) + 1))


@dataclass(frozen=True)
class Choice:
    """One of several values."""

    values: tuple

    def shares(self, seen: list) -> np.ndarray:
        counts = np.array([1.0 + seen.count(v) for v in self.values])
        return counts / counts.sum()

    def draw(self, rng: np.random.Generator, seen: list):
        return self.values[rng.choice(len(self.values), p=self.shares(seen))]

    def density(self, v, seen: list) -> float:
        return float(self.shares(seen)[self.values.index(v)])


Space = dict[str, Number | Choice]


def propose(space: Space, done: list[tuple[dict, float]], rng: np.random.Generator) -> dict:
    """The next settings to try; ``done``: settings and losses so far, less is better."""
    if len(done) < START:
        return {k: s.draw(rng, []) for k, s in space.items()}
    ordered = sorted(done, key=lambda d: d[1])
    cut = max(2, round(GOOD * len(done)))
    good, bad = ordered[:cut], ordered[cut:]
    drawn = [{k: s.draw(rng, [d[0][k] for d in good]) for k, s in space.items()} for _ in range(DRAWS)]
    gain = lambda p: sum(np.log(s.density(p[k], [d[0][k] for d in good])) - np.log(s.density(p[k], [d[0][k] for d in bad])) for k, s in space.items())
    return max(drawn, key=gain)


def search(space: Space, loss: Callable[[dict], float], trials: int = 25, seed: int = 42) -> list[tuple[dict, float]]:
    """Settings and losses in the order of trials. A trial that fails has an infinite loss and goes on as a bad one."""
    rng, done = np.random.default_rng(seed), []

    def tried(p: dict) -> float:
        try:
            value = float(loss(p))
        except Exception:  # noqa: BLE001  (settings that cannot be fitted are the worst)
            return float("inf")
        return value if value == value else float("inf")

    with ThreadPool(AT_ONCE) as pool:
        while len(done) < trials:
            batch = [propose(space, done, rng) for _ in range(min(AT_ONCE, trials - len(done)))]
            done += zip(batch, pool.map(inheritable_thread_target(tried), batch), strict=True)
    return done


#: What is searched for each candidate.
SPACES: dict[str, Space] = {
    "linear": {"regParam": Number(1e-5, 10, log=True), "elasticNetParam": Number(0, 1)},
    "logistic": {"regParam": Number(1e-5, 10, log=True), "elasticNetParam": Number(0, 1)},
    "forest": {"numTrees": Number(50, 400, whole=True), "maxDepth": Number(3, 20, whole=True), "minInstancesPerNode": Number(1, 10, whole=True)},
    "boosted": {"maxIter": Number(10, 100, whole=True), "maxDepth": Number(2, 8, whole=True), "stepSize": Number(0.01, 0.3, log=True), "subsamplingRate": Number(0.5, 1)},
    "mlp": {"maxIter": Number(50, 300, whole=True), "stepSize": Number(0.003, 0.3, log=True)},
}


def tune(df: DataFrame, target: str, features: list[str], task: str, name: str, id_col: str, trials: int = 25, space: Space | None = None, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The model of the best trial, and a row per trial: trial, params, metric, value. Trials are fitted on four fifths and judged on the held-out rest."""
    spark: SparkSession = df.sparkSession
    fit, held = split(df, target, features, task, id_col)
    first, label = stages(target, features, task)
    judged, less = judge(task, label), task == "regression"
    classes = fit.select(target).distinct().count() + 1 if task != "regression" else 1
    prepared = Pipeline(stages=first).fit(fit)
    fit, held = prepared.transform(fit), prepared.transform(held)
    make = lambda p: candidates(task, len(features), classes)[name].setLabelCol(label).setParams(**p)

    def loss(p: dict) -> float:
        value = judged.evaluate(make(p).fit(fit).transform(held))
        return value if less else -value

    done = search(space or SPACES[name], loss, trials, seed)
    best = min(range(len(done)), key=lambda k: (done[k][1], k))
    rows = [(k, json.dumps(p, sort_keys=True), judged.getMetricName(), None if v == float("inf") else v if less else -v) for k, (p, v) in enumerate(done, 1)]
    return PipelineModel([*prepared.stages, make(done[best][0]).fit(fit)]), spark.createDataFrame(rows, "trial int, params string, metric string, value double")
