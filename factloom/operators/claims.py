"""Sentences held against the ledger: each check returns what contradicts the evidence, and stays quiet otherwise."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ledger import EvidenceLedger

TREND = re.compile(r"\b(trend\w*|ris(?:e|es|ing)|rose|fall(?:s|ing)?|fell|grow(?:s|th|ing)?|decreas\w+|increas\w+|declin\w+|improv\w+)\b", re.IGNORECASE)
NEGATED = re.compile(r"\b(no|not|without|hardly|never)\b", re.IGNORECASE)
TOP_N = re.compile(r"\btop[\s-]?(\d{1,3})\b", re.IGNORECASE)
SHARE = re.compile(r"\btop (\d{1,3}) ?%.{0,60}?(\d{1,3}(?:\.\d+)?) ?%", re.IGNORECASE | re.DOTALL)


def _names(word: str, sentence: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(word.lower())}(?!\w)", sentence.lower()) is not None


def check_trend(sentence: str, ledger: EvidenceLedger) -> list[str]:
    if not TREND.search(sentence) or NEGATED.search(sentence):
        return []
    weak = [c for c in ledger.correlations if abs(c["r"]) < 0.1 and _names(c["a"], sentence) and _names(c["b"], sentence)]
    return [f"{c['a']} and {c['b']} hardly move together (r = {c['r']:.2f})" for c in weak]


def places(ranking: dict, sentence: str) -> list[tuple[int, str]]:
    """Rank and label of what a sentence names in a ranking. Beyond the head that the ledger holds, the whole ranking is a table, and what it has
    that the sentence holds is looked up there."""
    known = [(k, label) for k, (label, _) in enumerate(ranking["order"], 1)]
    if ranking.get("table") is not None and ranking["groups"] > len(known):
        label = F.col("label").cast("string")
        held = F.contains(F.lower(F.lit(sentence)), F.lower(label)) & (F.length(label) > 1)
        known = [(r["rank"], r["label"]) for r in ranking["table"].filter(held).select("rank", label.alias("label")).collect()]
    return [(k, label) for k, label in known if _names(label, sentence)]


def check_top_n(sentence: str, ledger: EvidenceLedger) -> list[str]:
    """Labels called top N that no recorded ranking has there; quiet unless at least two labels are named."""
    if not (m := TOP_N.search(sentence)):
        return []
    n = int(m[1])
    named: dict[str, int] = {}
    for ranking in ledger.rankings:
        for k, label in places(ranking, sentence):
            named[label] = min(k, named.get(label, k))
    return [f"{label} ranks {k}, not within {n}" for label, k in named.items() if k > n] if len(named) >= 2 else []


def check_share(sentence: str, ledger: EvidenceLedger) -> list[str]:
    """'The top X % make Y %' against running shares, to five points, for rankings of at least five groups."""
    if not (m := SHARE.search(sentence)):
        return []
    x, claimed, found = int(m[1]), float(m[2]), []
    for ranking in ledger.rankings:
        values, groups = [v for _, v in ranking["order"]], ranking.get("groups") or len(ranking["order"])
        total, head = ranking.get("total", sum(values)), max(1, round(groups * x / 100))
        if groups >= 5 and ranking["how"] in ("sum", "count") and total:
            if head in ranking.get("running", {}):
                found.append(ranking["running"][head])
            elif head <= len(values):
                found.append(100 * sum(values[:head]) / total)
    return [f"the top {x} % make {found[0]:.0f} %, not {claimed:.0f} %"] if found and all(abs(f - claimed) > 5 for f in found) else []


def check_duration(sentence: str, ledger: EvidenceLedger) -> list[str]:
    """'takes 12 days' against recorded means, to a tenth."""
    out = []
    for m in re.finditer(r"(\d+(?:\.\d+)?)\s*(seconds|minutes|hours|days|weeks)", sentence, re.IGNORECASE):
        same = [d["mean"] for d in ledger.durations if d["unit"] == m[2].lower() and d["mean"]]
        if same and all(abs(float(m[1]) - v) > 0.1 * abs(v) for v in same):
            out.append(f"the mean is {same[0]:.1f} {m[2].lower()}, not {m[1]}")
    return out


def check_noise(sentence: str, ledger: EvidenceLedger) -> list[str]:
    """A leader named where the ranking is within noise."""
    if NEGATED.search(sentence) or not re.search(r"\b(best|worst|leads?|highest|lowest)\b", sentence, re.IGNORECASE):
        return []
    noise = [r for r in ledger.rankings if r.get("p_counts", 0) > 0.05 and (r["how"] == "count" or r.get("p_values", 0) > 0.05) and "p_counts" in r]
    return [f"the ranking by {r['group']} is within noise" for r in noise if places(r, sentence)]


def check_imputed(sentence: str, ledger: EvidenceLedger) -> list[str]:
    """A group named whose values were all filled in: the cleaner made them, so they say nothing of the group. Only groups that the sentence names are collected."""
    out = []
    for note in ledger.imputed_groups:
        label = F.col(note["groups"].columns[0]).cast("string")
        named = note["groups"].filter(F.contains(F.lower(F.lit(sentence)), F.lower(label)) & (F.length(label) > 1))
        out += [f"all values of {r[0]} were filled in ({note['column']})" for r in named.select(label).distinct().collect() if _names(r[0], sentence)]
    return out


def review(text: str, ledger: EvidenceLedger) -> list[str]:
    sentences = re.split(r"(?<=[.!?])\s+", text)
    return [x for s in sentences for check in (check_trend, check_top_n, check_share, check_duration, check_noise, check_imputed) for x in check(s, ledger)]


def pairing_laggards(df: DataFrame, a: str, b: str, value: str | None = None) -> DataFrame:
    """Levels of ``b`` within each level of ``a`` and their place; a laggard stands behind max(3, half of the levels)."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg((F.sum(value) if value else F.count("*")).cast("double").alias("v"))
    w = Window.partitionBy("a")
    place = F.row_number().over(w.orderBy(F.desc("v"), "b"))
    rows = cells.withColumns({"place": place, "levels": F.count("*").over(w)})
    behind = F.col("place") > F.greatest(F.lit(3), F.floor((F.col("levels") + 1) / 2))
    return rows.filter("levels >= 3").withColumn("laggard", behind)
