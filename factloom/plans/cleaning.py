"""Cleaning as a plan: diagnose, approve, apply in order, record, replay."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.frames import numeric_columns, text_columns
from ..limits import LIMITS
from ..operators import cleaning as C
from ..operators import profile as P

FORMAT = "factloom.cleaning/1"
#: The order in which steps run, whatever order they are approved in.
ORDER = {
    "flag_missing": 1, "cast_types": 2, "convert_booleans": 2, "uniform_dates": 2, "harmonize_units": 2, "parse_years": 2, "trim_text": 3, "normalize_case": 3, "fix_syntax": 3, "split_column": 3,
    "standardize_categories": 3.5, "fuzzy_merge": 3.6, "impute": 4, "deduplicate": 5, "drop_columns": 6, "drop_rows": 7, "filter_rows": 7, "cap_outliers": 8, "cross_field": 9, "rule_validate": 9,
}


@dataclass
class CleaningOp:
    id: str
    action: str
    columns: list[str] = field(default_factory=list)
    extra: dict[str, Any] = field(default_factory=dict)
    label: str = ""
    recommended: bool = True


def diagnose(df: DataFrame, target: str | None = None) -> list[CleaningOp]:
    """Steps worth proposing, from a few wide aggregates over all rows."""
    ops: list[CleaningOp] = []

    def propose(action: str, columns: list[str], label: str, recommended: bool = True, **extra: Any) -> None:
        ops.append(CleaningOp(f"op{len(ops) + 1}", action, columns, extra, label, recommended))

    profile = {r["column"]: r for r in P.profile(df).collect()}  # a row per column
    n = max((r["n_rows"] for r in profile.values()), default=0)
    if not n:
        return ops
    sparse = [c for c, r in profile.items() if r["nulls"] / n >= LIMITS.null_column_share and c != target]
    for c in sparse:
        propose("drop_columns", [c], f"{c} is {100 * profile[c]['nulls'] / n:.0f} % empty", recommended=False)
    if target and profile[target]["nulls"]:
        propose("drop_rows", [target], f"{target} is empty in {profile[target]['nulls']} rows", rule="target_null")
    words = [c for c in text_columns(df) if c not in sparse]
    if words:
        counted = P.value_counts(df, words).persist()  # labels repeat: each is read once
        for r in P.text_shapes(df, words, counted).collect():
            c = r["column"]
            if (r["number"] or 0) >= LIMITS.looks_like_share and not r["padded"]:
                propose("cast_types", [c], f"{c} holds numbers as text")
            elif (r["date"] or 0) >= LIMITS.looks_like_share and not (r["clock"] or 0) >= LIMITS.looks_like_share:
                propose("uniform_dates", [c], f"{c} holds dates as text")
        value = F.col("value")
        per = counted.groupBy("column", text.canonical(value).alias("label")).agg(F.count("*").alias("spellings"), F.count_if(value != text.collapse(value)).alias("loose"))
        checks = {r["column"]: r for r in per.groupBy("column").agg(F.sum(F.col("spellings") - 1).alias("spellings"), F.sum("loose").alias("loose")).collect()}  # a row per column
        counted.unpersist()
        loose = [c for c in words if c in checks and checks[c]["loose"]]
        if loose:
            propose("trim_text", loose, "outer white space")
        for c in words:
            if c in checks and checks[c]["spellings"] > 0:
                propose("standardize_categories", [c], f"{checks[c]['spellings']} spellings of {c} repeat others")
    for c, r in profile.items():
        if r["nulls"] and c not in sparse and c != target and not C.is_marker(c):
            propose("impute", [c], f"{r['nulls']} blanks in {c}", recommended=False, how="median" if c in numeric_columns(df) else "mode")
    copies = P.duplicate_rows(df).first()["n_duplicates"]
    if copies:
        propose("deduplicate", [], f"{copies} rows repeat others in full")
    numbers = [c for c in numeric_columns(df) if c != target and profile[c]["distinct"] > 2 and not re.search(r"(?i)(^|_)(id|key|code|no)$|key$", c)]
    if numbers:
        for r in P.outlier_fences(df, numbers).collect():
            if r["n_outliers"]:
                propose("cap_outliers", [r["column"]], f"{r['n_outliers']} values of {r['column']} beyond the fences", recommended=False, low=r["low"], high=r["high"])
    return ops


def approve(reply: str, ops: list[CleaningOp]) -> list[CleaningOp]:
    """``all`` (what is recommended), ``none``, ids, and ids with parameters: ``op4:factor=2.54;how=mean``."""
    known = {o.id: o for o in ops}
    chosen: dict[str, CleaningOp] = {}
    for word in re.split(r"[\s,]+", reply.strip()):
        name, _, params = word.partition(":")
        name = name.lower()  # parameters keep their case
        if name == "none":
            return []
        if name == "all":
            chosen |= {o.id: o for o in ops if o.recommended and o.id not in chosen}
        elif name in known:
            o = known[name]
            extra = dict(p.split("=", 1) for p in params.split(";") if "=" in p)
            chosen[name] = CleaningOp(o.id, o.action, o.columns, o.extra | {k: _value(v) for k, v in extra.items()}, o.label, o.recommended)
    return list(chosen.values())


def _value(s: str) -> Any:
    try:
        return float(s)
    except ValueError:
        return s


def _step(op: CleaningOp) -> Callable[[DataFrame], DataFrame]:
    c, x = op.columns, op.extra
    return {
        "flag_missing": lambda d: C.flag_missing(d, c), "cast_types": lambda d: C.cast_types(d, c), "convert_booleans": lambda d: C.convert_booleans(d, c), "uniform_dates": lambda d: C.uniform_dates(d, c[0]),
        "harmonize_units": lambda d: C.harmonize_units(d, c[0], x["factor"]), "parse_years": lambda d: C.parse_years(d, c), "trim_text": lambda d: C.trim_text(d, c), "normalize_case": lambda d: C.normalize_case(d, c, x.get("case", "lower")),
        "fix_syntax": lambda d: C.fix_syntax(d, c), "split_column": lambda d: C.split_column(d, c[0], x["sep"]), "standardize_categories": lambda d: C.standardize_categories(d, c[0]), "fuzzy_merge": lambda d: C.fuzzy_merge(d, c[0], x.get("threshold")),
        "impute": lambda d: C.impute(d, c, x.get("how", "median"), x["by"].split("|") if x.get("by") else None, x.get("value")), "deduplicate": C.deduplicate, "drop_columns": lambda d: d.drop(*c),
        "drop_rows": lambda d: d.dropna(subset=c) if x.get("rule") == "target_null" else C.drop_sparse_rows(d, x.get("share", LIMITS.null_row_share)), "filter_rows": lambda d: C.filter_date_range(d, c[0], x.get("start"), x.get("end")),
        "cap_outliers": lambda d: C.cap_outliers(d, c[0], x["low"], x["high"], x.get("mode", "clip")), "cross_field": lambda d: C.cross_field(d, *c), "rule_validate": lambda d: C.rule_validate(d, c[0], x["pattern"]),
    }[op.action]


def apply_plan(df: DataFrame, ops: list[CleaningOp]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The cleaned frame, and what became of each step: applied, or skipped with the reason."""
    log = []
    for op in sorted(ops, key=lambda o: ORDER[o.action]):
        if missing := [c for c in op.columns if c not in df.columns]:
            log.append((op.id, f"skipped: no column {', '.join(missing)}"))
            continue
        try:
            done = _step(op)(df)
            _ = done.schema
        except (PySparkException, KeyError, ValueError) as e:
            log.append((op.id, f"failed: {str(e).splitlines()[0][:200]}"))
            continue
        df = done
        log.append((op.id, "applied"))
    return df, log


def manifest(ops: list[CleaningOp]) -> str:
    return json.dumps({"format": FORMAT, "ops": [asdict(o) for o in ops]}, indent=1)


def replay(df: DataFrame, recipe: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Runs a recorded plan on another frame by actions and columns; rows are found again by rule, never by position."""
    data = json.loads(recipe)
    if data.get("format") != FORMAT:
        raise ValueError(f"not a {FORMAT} recipe")
    return apply_plan(df, [CleaningOp(**o) for o in data["ops"]])
