"""Grouping, ranking, pivots, grain and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import numeric_columns
from ..functions.ranks import with_medians
from ..limits import LIMITS, Refusal

ADDITIVE = ("sum", "count")


def aggregate(how: str, value: Column) -> Column:
    """An aggregate by its public name; quantiles are exact and interpolate, modes take the smallest on ties."""
    known = {
        "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
        "median": lambda c: F.percentile(c, 0.5), "nunique": F.count_distinct, "mode": lambda c: F.mode(c, True), "first": F.first, "last": F.last,
    }
    if how not in known:
        raise ValueError(f"unknown aggregation {how!r}; known: {', '.join(known)}")
    return known[how](value)


def group_dataset(df: DataFrame, keys: list[str], aggregations: dict[str, str] | None = None) -> DataFrame:
    """Groups by ``keys`` (null is a group) and always adds ``n_rows``; without aggregations the distinct keys."""
    if missing := [c for c in (*keys, *(aggregations or {})) if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    if not aggregations:
        return df.select(*keys).distinct()
    name = "n_rows"
    while name in (*keys, *aggregations):
        name += "_"
    medians = {c: f"{c}_median" for c, how in aggregations.items() if how == "median"}
    out = df.groupBy(*keys).agg(*[aggregate(how, F.col(c)).alias(f"{c}_{how}") for c, how in aggregations.items() if c not in medians], F.count("*").alias(name))
    return with_medians(out, df, keys, medians).select(*keys, *[f"{c}_{how}" for c, how in aggregations.items()], name)


def rank_by(df: DataFrame, group_col: str, value_col: str | None = None, how: str = "sum", top: int | None = None, ascending: bool = False, include_null: bool = True) -> DataFrame:
    """rank, label, value and, for sums and counts, share and running share of the total in per cent.

    Only the groups, never the rows, pass through the ordered windows.
    """
    rows = df if include_null else df.filter(F.col(group_col).isNotNull())
    if value_col is not None and how == "median":
        rows = rows.select(F.col(group_col).cast("string").alias("label"), value_col)
        groups = with_medians(rows.select("label").distinct(), rows, ["label"], {value_col: "value"})
    else:
        value = F.count("*") if value_col is None else aggregate(how, F.col(value_col))
        groups = rows.groupBy(F.col(group_col).cast("string").alias("label")).agg(value.cast("double").alias("value"))
    order = [F.asc_nulls_last("value") if ascending else F.desc_nulls_last("value"), F.asc_nulls_last("label")]
    w = Window.orderBy(*order)
    ranked = groups.orderBy(*order).limit(top) if top else groups  # with ``top`` each task passes on its own first groups only
    out = ranked.withColumn("rank", F.row_number().over(w))
    if value_col is None or how in ADDITIVE:
        running = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_running", running).crossJoin(groups.agg(F.sum("value").alias("_total")))  # one row
        out = out.withColumns({"share_pct": F.try_divide(F.col("value") * 100, F.col("_total")), "cumulative_pct": F.try_divide(F.col("_running") * 100, F.col("_total"))}).drop("_running", "_total")
    return out


def near_tie(ranked: DataFrame, top: int) -> DataFrame:
    """The gap between the last rank inside the cut and the first outside, and whether it is a near tie."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("value")))
    gap = F.try_divide(F.abs(F.col("inside") - F.col("outside")), F.abs("inside"))
    return ranked.agg(at(top).alias("inside"), at(top + 1).alias("outside")).withColumn("gap", gap).withColumn("tie", F.coalesce(F.col("gap") < LIMITS.near_tie, F.lit(False)))


def uniformity(df: DataFrame, group_col: str) -> DataFrame:
    """Chi-square statistic of the groups' row counts against equal counts: groups, n, statistic, dof."""
    counts = df.groupBy(group_col).agg(F.count("*").alias("c"))
    return counts.agg(F.count("*").alias("groups"), F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("sq")).select(
        "groups", "n", (F.col("sq") * F.col("groups") / F.col("n") - F.col("n")).alias("statistic"), (F.col("groups") - 1).alias("dof")
    )


def label_collisions(df: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """Labels that stand for more than one id."""
    return df.groupBy(label_col).agg(F.count_distinct(id_col).alias("n_ids"), F.count("*").alias("n_rows")).filter("n_ids > 1")


def levels(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values of each column, null counted as one."""
    row = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]).first()
    return {c: row[c] or 0 for c in columns}


def pivot_dataset(df: DataFrame, rows: list[str], columns: list[str], value: str | None = None, how: str = "sum", percent: bool = False, column_levels: list[str] | None = None) -> DataFrame | Refusal:
    """Rows by columns, zero where nothing is; ``percent`` gives shares of the grand total, to two digits."""
    wide = [c for c, n in levels(df, [*rows, *columns]).items() if n > LIMITS.pivot_levels]
    if wide:
        return Refusal(f"more than {LIMITS.pivot_levels} levels in {', '.join(wide)}")
    known = df.dropna(subset=[*rows, *columns]).withColumn("_column", F.concat_ws(" ", *columns))
    names = column_levels or [r[0] for r in known.select("_column").distinct().orderBy("_column").collect()]
    cell = F.count(F.lit(1)) if value is None else aggregate(how, F.col(value))
    out = known.groupBy(*rows).pivot("_column", names).agg(cell).fillna(0)
    if percent:
        out = out.crossJoin(out.agg(F.sum(sum(F.col(f"`{n}`") for n in names)).alias("_total")))  # one row
        out = out.withColumns({n: F.round(F.try_divide(F.col(f"`{n}`") * 100.0, F.col("_total")), 2) for n in names}).drop("_total")
    return out


def grain_candidates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, distinct values, uniqueness; columns named like ids first."""
    columns = columns or df.columns
    wide = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct"), F.try_divide(F.col(c), F.col("n")).alias("uniqueness")) for c in columns])
    named = F.col("column").rlike(r"(?i)(^|_)(id|key|no|code|uuid)$|key$")
    out = wide.select(F.explode(cells).alias("r")).select("r.*").withColumn("named", named)
    return out.filter(F.col("named") | (F.col("uniqueness") >= 0.9))


def grain_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys, keys that repeat, rows beyond the first of each."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows")
    )


def grain_measure_cost(df: DataFrame, keys: list[str], order: list[str], measures: list[str]) -> DataFrame:
    """Each measure's total as the rows stand and with one (the first) row per key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    sums = [x for m in measures for x in (F.sum(m).alias(f"{m}__as_is"), F.sum(F.when(F.col("_first"), F.col(m))).alias(f"{m}__once"))]
    wide = df.withColumn("_first", first).agg(*sums)
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}__as_is").cast("double").alias("as_is"), F.col(f"{m}__once").cast("double").alias("once")) for m in measures])
    return wide.select(F.explode(cells).alias("r")).select("r.*").withColumn("excess", F.col("as_is") - F.col("once"))


def conflicting_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of the other columns: in how many repeated keys the column takes more than one value (null counts as one)."""
    others = [c for c in df.columns if c not in keys]
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in others]).filter("_n > 1")
    wide = per_key.agg(*[F.count_if(F.col(c) > 1).alias(c) for c in others])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("conflicting_keys")) for c in others])).alias("r")).select("r.*")


def reconcile(df: DataFrame, column: str, expected: float, how: str = "sum") -> DataFrame:
    """actual, gap, relative gap and whether it matches; an expected zero never matches."""
    relative = F.try_divide(F.abs(F.col("actual") - F.lit(expected)), F.abs(F.lit(expected)))
    out = df.agg(aggregate(how, F.col(column)).cast("double").alias("actual"))
    return out.withColumns({"expected": F.lit(float(expected)), "gap": F.col("actual") - F.lit(float(expected)), "relative_gap": relative, "matches": F.coalesce(relative <= LIMITS.reconcile_tolerance, F.lit(False))})


def imputed_share(df: DataFrame, group_col: str, marker: str) -> DataFrame:
    """Share of filled-in rows per group, and whether the group is filled fully or mostly."""
    share = F.avg(F.col(marker).cast("double"))
    verdict = F.when(F.col("share") >= 0.999, "fully").when(F.col("share") >= 0.5, "mostly").otherwise("no")
    return df.groupBy(group_col).agg(share.alias("share"), F.count("*").alias("n_rows")).withColumn("imputed", verdict)


def measures(df: DataFrame, keys: list[str]) -> list[str]:
    """Number columns that are not keys nor named like ids."""
    return [c for c in numeric_columns(df) if c not in keys and not c.lower().endswith(("id", "key", "zip", "year"))]
