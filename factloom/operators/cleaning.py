"""Cleaning steps: each takes a DataFrame and returns a new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.ranks import by_parts, in_parts, number_of, wide_quantiles, with_medians


def is_marker(name: str) -> bool:
    return name.endswith(("_was_missing", "_was_capped", "_valid"))


def flag_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns})


def statistic(column: str, how: str) -> Column:
    return {"mean": F.avg(column), "mode": F.mode(column, True), "most_frequent": F.mode(column, True)}[how]


def impute(df: DataFrame, columns: list[str], how: str = "median", by: list[str] | None = None, value=None) -> DataFrame:
    """Fills nulls; with ``by`` from the row's group first, then from all rows. Statistics are small tables joined back."""
    if how == "constant":
        kinds = dict(df.dtypes)
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value if value is not None else "Unknown" if kinds[c] == "string" else 0)) for c in columns})
    def per(keys: list[str], named: str) -> DataFrame:
        rows = df.select(*[F.col(k).alias(f"_by_{k}") for k in keys], *columns)
        keys = [f"_by_{k}" for k in keys]
        if how == "median":
            return with_medians(rows.select(*keys).distinct() if keys else df.sparkSession.range(1).select(), rows, keys, {c: f"{named}{c}" for c in columns})
        return rows.groupBy(*keys).agg(*[statistic(c, how).alias(f"{named}{c}") for c in columns])

    out = df.crossJoin(per([], "_all_"))  # one row
    if by:
        groups = per(by, "_own_")
        out = out.join(groups, reduce(Column.__and__, [out[k].eqNullSafe(groups[f"_by_{k}"]) for k in by]), "left")
    fill = lambda c: F.coalesce(F.col(c), F.col(f"_own_{c}"), F.col(f"_all_{c}")) if by else F.coalesce(F.col(c), F.col(f"_all_{c}"))
    return out.select(*[fill(c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def _nearest(df: DataFrame, column: str, order_by: str, by: list[str] | None, numbered: bool = False) -> DataFrame:
    """``df`` with ``_back`` and ``_ahead``: the nearest known value on either side (the row's own, where known), each with its place ``at``.

    The order is cut into parts (``functions.ranks``), so neither a table nor a large group is one task's; of each part only its count of rows
    and its first and last known value are carried over to the others.
    """
    by = by or []
    w = Window.partitionBy(*by, "_part").orderBy(order_by)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(column).alias("v")))
    numbered = lambda rows: rows.withColumn("_at", F.row_number().over(w)).withColumn("_known", known)
    parts = numbered(in_parts(df, order_by, by)).groupBy(*by, "_part").agg(F.min("_number").alias("_lo"), F.count("*").alias("_n"), F.min_by("_known", "_known.at").alias("_first"), F.max_by("_known", "_known.at").alias("_last"))
    across = Window.partitionBy(*by).orderBy("_part")
    moved = lambda c, by_: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.at") + F.col(by_)).alias("at"), F.col(f"{c}.v").alias("v")))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumns({"_first": moved("_first", "_before"), "_last": moved("_last", "_before")})
    parts = parts.withColumns({"_prev": F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.first("_first", True).over(across.rowsBetween(1, Window.unboundedFollowing))})
    rows = numbered(by_parts(df, number_of(df, order_by), parts, ["_before", "_prev", "_next"], by))
    rows = rows.withColumns({"_known": moved("_known", "_of._before"), "_at": F.col("_at") + F.col("_of._before")})
    # Both sides are running values: a frame from a row to the end would be gone through anew for every row.
    near = lambda order: F.last("_known", True).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_back": F.coalesce(near(F.asc("_at")), "_of._prev"), "_ahead": F.coalesce(near(F.desc("_at")), "_of._next")})


def ffill(df: DataFrame, column: str, order_by: str, by: list[str] | None = None) -> DataFrame:
    return _nearest(df, column, order_by, by).withColumn(column, F.col("_back.v")).select(*df.columns)


def bfill(df: DataFrame, column: str, order_by: str, by: list[str] | None = None) -> DataFrame:
    return _nearest(df, column, order_by, by).withColumn(column, F.col("_ahead.v")).select(*df.columns)


def interpolate(df: DataFrame, column: str, order_by: str, by: list[str] | None = None) -> DataFrame:
    """Linear by position; both ends take the nearest value."""
    rows = _nearest(df, column, order_by, by)
    a, z = F.col("_back"), F.col("_ahead")
    between = a["v"] + (z["v"] - a["v"]) * (F.col("_at") - a["at"]) / (z["at"] - a["at"])
    value = F.when(F.col(column).isNotNull(), F.col(column)).when(a.isNull(), z["v"]).when(z.isNull(), a["v"]).otherwise(between)
    return rows.withColumn(column, value).select(*df.columns)


def deduplicate(df: DataFrame) -> DataFrame:
    return df.distinct()


def normalised_duplicates(df: DataFrame, label_columns: list[str]) -> DataFrame:
    """n_rows, and rows that repeat another once labels are canonical."""
    keys = [text.canonical(F.col(c)).alias(c) if c in label_columns else F.col(c) for c in df.columns]
    per = df.select(*keys).groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def trim_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: dates.strip(F.col(c)) for c in columns})


def normalize_case(df: DataFrame, columns: list[str], case: str = "lower") -> DataFrame:
    change = {"lower": F.lower, "upper": F.upper}[case]
    return df.withColumns({c: change(F.col(c)) for c in columns})


def fix_syntax(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.fix_syntax(F.col(c)) for c in columns})


def split_column(df: DataFrame, column: str, sep: str, names: tuple[str, str] | None = None) -> DataFrame:
    """At the first separator; both parts null where there is none; the source column goes."""
    first, second = names or (f"{column}_1", f"{column}_2")
    at = F.instr(F.col(column), sep)
    whole = at > 0
    return df.withColumns({
        first: F.when(whole, F.trim(F.left(F.col(column), at - 1))),
        second: F.when(whole, F.trim(F.substring(F.col(column), at + len(sep), F.length(column)))),
    }).drop(column)


def cast_types(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.number(F.col(c)) for c in columns})


def parse_years(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.year(F.col(c)) for c in columns})


def uniform_dates(df: DataFrame, column: str) -> DataFrame:
    """ISO text under one convention for the whole column; the clock stays unless every value is at midnight."""
    parsed, proof = dates.parse_column(df, column)
    if proof is None:
        other = dates.parse_date(F.col(column), True)
        n = df.agg(F.count(parsed).alias("a"), F.count(other).alias("b")).first()
        parsed = other if n["b"] > n["a"] else parsed
    midnight = df.agg(F.coalesce(F.bool_and(parsed == F.date_trunc("day", parsed)), F.lit(True))).first()[0]
    return df.withColumn(column, F.date_format(parsed, "yyyy-MM-dd" if midnight else "yyyy-MM-dd HH:mm:ss"))


def convert_booleans(df: DataFrame, columns: list[str]) -> DataFrame:
    """Boolean columns; a column that holds other words too stays text, with those words as they are."""
    unknown = df.agg(*[F.count_if(F.col(c).isNotNull() & text.boolean(F.col(c)).isNull()).alias(c) for c in columns]).first()
    left = lambda c: F.coalesce(text.boolean(F.col(c)).cast("string"), F.col(c)) if unknown[c] else text.boolean(F.col(c))
    return df.withColumns({c: left(c) for c in columns})


def harmonize_units(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, text.first_number(F.col(column)) * factor)


def cap_outliers(df: DataFrame, column: str, low: float, high: float, mode: str = "clip") -> DataFrame:
    """Clips to the fences, or blanks what is beyond; nulls stay null, and a marker tells which rows changed."""
    beyond = (F.col(column) < low) | (F.col(column) > high)
    changed = F.when(beyond, F.lit(None)) if mode == "null" else F.when(F.col(column) < low, F.lit(low)).when(F.col(column) > high, F.lit(high))
    value = F.when(~beyond, F.col(column)) if mode == "null" else F.coalesce(changed, F.col(column))
    return df.withColumn(f"{column}_was_capped", F.coalesce(beyond, F.lit(False)).cast("int")).withColumn(column, value)


def _spelling(df: DataFrame, column: str, key: Column) -> DataFrame:
    """label -> the most frequent spelling among labels with the same key (ties: the smallest)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_label")).agg(F.count("*").alias("_n"))
    first = F.first("_label").over(Window.partitionBy("_key").orderBy(F.desc("_n"), "_label"))
    return counts.withColumn("_key", key).withColumn("_best", first).select("_label", "_best")


def _respelled(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    out = df.join(mapping, df[column] == mapping["_label"], "left")
    return out.withColumn(column, F.coalesce("_best", column)).drop("_label", "_best")


def standardize_categories(df: DataFrame, column: str) -> DataFrame:
    """The most common spelling wins inside each canonical label."""
    return _respelled(df, column, _spelling(df, column, text.canonical(F.col("_label"))))


def fuzzy_merge(df: DataFrame, column: str, threshold: float | None = None) -> DataFrame:
    """Labels with one entity key merge; with a threshold also similar ones of equal digits and first letter.

    The second pass compares labels greedily by frequency. Only labels of equal digits and first letter can merge, so each
    such block is dealt with on its own, on the executors; there is no limit of labels.
    """
    merged = _respelled(df, column, _spelling(df, column, text.entity_key(F.col("_label"))))
    if threshold is None:
        return merged
    counts = merged.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_label")).agg(F.count("*").alias("_n"))
    blocks = counts.withColumns({"_digits": text.digits(F.col("_label")), "_first": F.lower(F.substring("_label", 1, 1))})

    def choose(pdf):
        from difflib import SequenceMatcher

        import pandas as pd

        chosen, mapping = [], []
        for label in (r[1] for r in sorted(zip(-pdf["_n"], pdf["_label"], strict=True))):
            for k in chosen:
                m = SequenceMatcher(None, k.lower(), label.lower())
                if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:  # the first two are upper bounds
                    mapping.append((label, k))
                    break
            else:
                chosen.append(label)
        return pd.DataFrame(mapping, columns=["_label", "_best"])

    return _respelled(merged, column, blocks.groupBy("_digits", "_first").applyInPandas(choose, "_label string, _best string"))


def cross_field(df: DataFrame, a: str, b: str) -> DataFrame:
    """1 where ``b`` is not before ``a`` (or either is missing), else 0."""
    return df.withColumn(f"{b}_vs_{a}_valid", F.when(F.col(b) < F.col(a), 0).otherwise(1))


def rule_validate(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.withColumn(f"{column}_valid", text.full_match(F.col(column), pattern).cast("int"))


def drop_sparse_rows(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows lose out when at least ``share`` of their columns are null."""
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    return df.filter(nulls / len(df.columns) < share)


def filter_date_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    out = df
    if start:
        out = out.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.filter(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return out


def drift_report(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Mean before and after, the shift in deviations of the former, and a mark from a quarter on."""
    a, b = (df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"))]) for df in (before, after))
    from ..functions.frames import wide_to_rows

    both = wide_to_rows(a, columns, ["mean", "std"]).join(wide_to_rows(b, columns, ["mean"]).withColumnRenamed("mean", "after"), "column")
    shift = F.try_divide(F.abs(F.col("after") - F.col("mean")), F.col("std"))
    return both.select("column", F.col("mean").alias("before"), "after", shift.alias("shift"), F.coalesce(shift >= 0.25, F.lit(False)).alias("marked"))


def heavy_tail(df: DataFrame, column: str) -> DataFrame:
    """Whether positives spread like a log-normal: far above the median, with fewer outliers once logged."""
    pos = df.filter(F.col(column) > 0).select(F.col(column).cast("double").alias("v"), F.log10(column).alias("l"))
    q = wide_quantiles(pos, ["v", "l"], [0.25, 0.5, 0.75]).select(F.col("v").alias("qv"), F.array(F.col("l")[0], F.col("l")[2]).alias("ql"))
    rows = pos.crossJoin(q)  # one row
    out = lambda c, q1, q3: F.avg(((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))).cast("double"))
    one = rows.agg(F.count("*").alias("n"), F.count_distinct("v").alias("levels"), (F.max("v") / F.max(F.col("qv")[1])).alias("reach"), out("v", F.col("qv")[0], F.col("qv")[2]).alias("raw_share"), out("l", F.col("ql")[0], F.col("ql")[1]).alias("log_share"))
    heavy = (F.col("n") >= 8) & (F.col("levels") >= 5) & (F.col("reach") >= 50) & (F.col("raw_share") > 0.02) & (F.col("log_share") < F.col("raw_share") / 2)
    return one.withColumn("heavy", heavy)
