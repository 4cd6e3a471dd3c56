"""Profiles, roles and validation: one wide aggregate each, then one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.frames import date_columns, numeric_columns, text_columns, wide_to_rows
from ..functions.ranks import wide_quantiles
from ..limits import LIMITS

#: Formulas tested in one pass over all rows.
FORMULAS_A_PASS = 200


def profile(df: DataFrame) -> DataFrame:
    """column, n_rows, non_null, nulls and distinct values of every column."""
    cells = [x for c in df.columns for x in (F.count("*").alias(f"{c}__n_rows"), F.count(c).alias(f"{c}__non_null"), F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.count_distinct(c).alias(f"{c}__distinct"))]
    return wide_to_rows(df.agg(*cells), df.columns, ["n_rows", "non_null", "nulls", "distinct"], dict.fromkeys(("n_rows", "non_null", "nulls", "distinct"), "long"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """mean, sample deviation, extremes and exact quartiles of number columns."""
    columns = columns or numeric_columns(df)
    cells = []
    for c in columns:
        v = F.col(c).cast("double")
        cells += [F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    quartiles = wide_quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = df.agg(*cells).crossJoin(quartiles.select(*[F.col(f"`{c}`").alias(f"{c}__q") for c in columns]))  # one row each
    wide = wide.withColumns({f"{c}__{name}": F.col(f"`{c}__q`")[k] for c in columns for k, name in enumerate(("q1", "median", "q3"))})
    return wide_to_rows(wide, columns, ["mean", "std", "min", "q1", "median", "q3", "max"])


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """value, rows and share of all rows of the most frequent values."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    few = counts.orderBy(F.desc("n"), "value").limit(n)
    return few.crossJoin(df.agg(F.count("*").alias("_all"))).withColumn("share", F.col("n") / F.col("_all")).drop("_all").orderBy(F.desc("n"), "value")  # one row


def outlier_fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """q1, q3, fences and rows beyond them; a column without spread has no outliers."""
    q = wide_quantiles(df, columns, [0.25, 0.75])
    q = q.select(*[F.col(c).alias(f"q__{c}") for c in columns])
    rows = df.select(*columns).crossJoin(q)  # one row
    reach = lambda c: LIMITS.iqr_reach * (F.col(f"q__{c}")[1] - F.col(f"q__{c}")[0])
    cells = []
    for c in columns:
        lo, hi = F.col(f"q__{c}")[0] - reach(c), F.col(f"q__{c}")[1] + reach(c)
        beyond = ((F.col(c) < lo) | (F.col(c) > hi)) & (reach(c) > 0)
        cells += [F.max(lo).alias(f"{c}__low"), F.max(hi).alias(f"{c}__high"), F.count_if(beyond).alias(f"{c}__n_outliers")]
    return wide_to_rows(rows.agg(*cells), columns, ["low", "high", "n_outliers"], {"n_outliers": "long"})


def zscore_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows further than the limit from the mean in population deviations, where there are at least 8 values."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"m__{c}"), F.stddev_pop(c).alias(f"s__{c}"), F.count(c).alias(f"n__{c}"))])
    rows = df.select(*columns).crossJoin(stats)  # one row
    z = lambda c: F.abs(F.try_divide(F.col(c) - F.col(f"m__{c}"), F.col(f"s__{c}")))
    wide = rows.agg(*[F.count_if((z(c) > LIMITS.outlier_z) & (F.col(f"n__{c}") >= 8)).alias(f"{c}__n_outliers") for c in columns])
    return wide_to_rows(wide, columns, ["n_outliers"], {"n_outliers": "long"})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows, n_distinct, n_duplicates over whole rows."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def category_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of two label columns: shared, union, Jaccard, and whether the columns agree row by row. Meant for small vocabularies."""
    trimmed = lambda c: F.collect_set(F.trim(c))
    one = df.agg(trimmed(a).alias("a"), trimmed(b).alias("b"), (F.count_if(~F.col(a).eqNullSafe(F.col(b))) == 0).alias("identical"))
    shared, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return one.select(F.size("a").alias("n_a"), F.size("b").alias("n_b"), shared.alias("shared"), F.try_divide(shared, union).alias("jaccard"), "identical")


def coded_column(df: DataFrame, column: str) -> DataFrame:
    """Whether a number column holds codes: few, recurring whole values over a wide range.

    The values are counted once; only their counts are judged. One row: n, levels, recurring levels, range, coded.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    kept = counts.crossJoin(df.agg(F.count(column).alias("n"))).withColumn("floor", F.greatest(F.lit(2), F.floor(F.col("n") * 0.001)))  # one row
    one = kept.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.count("*").alias("levels"), F.count_if(F.col("c") >= F.col("floor")).alias("recurring"),
        F.max(F.when(F.col("c") >= F.col("floor"), F.col("v"))).alias("hi"), F.min(F.when(F.col("c") >= F.col("floor"), F.col("v"))).alias("lo"), F.coalesce(F.max(F.col("v") != F.floor("v")), F.lit(False)).alias("fractional"),
    )
    span = F.col("hi") - F.col("lo")
    years = F.col("lo").between(1800, 2100) & F.col("hi").between(1800, 2100) & (span <= 200)
    few = (F.col("levels") >= 2) & (F.col("levels") <= 25) & (F.col("levels") <= F.greatest(F.lit(2.0), 0.05 * F.col("n")))
    named = column.lower().endswith(("_code", "_no", "_id", "_type", "status", "code"))
    wide = F.lit(True) if named else span >= 5 * F.col("recurring")
    coded = (F.col("n") >= 10) & ~F.col("fractional") & few & (F.col("recurring") >= 2) & ~years & wide
    return one.select("n", "levels", "recurring", span.alias("span"), F.coalesce(coded, F.lit(False)).alias("coded"))


def row_counter(df: DataFrame, column: str) -> DataFrame:
    """Share of steps of one between neighbouring values in order; 0.99 of at least three values make a counter."""
    values = df.select(F.col(column).cast("double").alias("v")).dropna()
    # A step of one from a value is the presence of its successor, so no global order is needed.
    counts = values.groupBy("v").agg(F.count("*").alias("c"))
    nexts = counts.select((F.col("v") - 1).alias("v"), F.lit(1).alias("next"))
    one = counts.join(nexts, "v", "left").agg(F.sum("c").alias("n"), F.count("next").alias("steps"))
    return one.select("n", F.try_divide(F.col("steps"), F.col("n") - 1).alias("share"), ((F.col("n") >= 3) & (F.try_divide(F.col("steps"), F.col("n") - 1) >= 0.99)).alias("counter"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: the distinct values of text columns, nulls aside, and how many rows have each."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def text_shapes(df: DataFrame, columns: list[str] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Shares of each text column's values that look like numbers, dates, years, emails or padded codes. Each distinct value is looked at once;
    ``counted``: the columns' ``value_counts``, where they are known."""
    columns = columns or text_columns(df)
    tests = {
        "number": lambda c: text.number(c).isNotNull(), "date": lambda c: dates.parse_date(c, False).isNotNull() | dates.parse_date(c, True).isNotNull(), "year": lambda c: text.year(c).isNotNull(),
        "email": lambda c: text.full_match(c, text.EMAIL), "clock": lambda c: c.rlike(dates.CLOCK), "padded": lambda c: c.rlike(r"^0\d+$"),
    }
    counted = value_counts(df, columns) if counted is None else counted
    n, value = F.col("n"), F.col("value")
    shares = counted.groupBy("column").agg(*[(F.sum(F.when(test(value), n).otherwise(0)) / F.sum(n)).alias(k) for k, test in tests.items()])  # a row per column
    wide = shares.agg(*[F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{c}__{k}") for c in columns for k in tests])
    return wide_to_rows(wide, columns, list(tests))


def roles(df: DataFrame) -> DataFrame:
    """column and role: constant, id, date, number, category or text, from counts of one pass."""
    numbers, stamps = numeric_columns(df), date_columns(df)
    n, distinct = F.col("non_null"), F.col("distinct")
    named = F.col("column").rlike(r"(?i)(^|_)(id|key|uuid)$|key$")
    role = (
        F.when(distinct <= 1, "constant").when(named & (distinct == n), "id").when(F.col("column").isin(*stamps or [""]), "date")
        .when(F.col("column").isin(*numbers or [""]), F.when(named, "id").otherwise("number")).when(distinct <= LIMITS.high_cardinality, "category").otherwise("text")
    )
    return profile(df).select("column", role.alias("role"))


def derived_formulas(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Triples c = a * b or c = a + b that hold in every complete row; what a probe leaves is tested in passes of FORMULAS_A_PASS."""
    import numpy as np

    columns = columns or numeric_columns(df)
    whole = df.select(*columns).dropna()
    # A probe of 200 rows, tested on the driver, leaves few candidates for the passes over all rows.
    probe = np.array([tuple(r) for r in whole.select(*[F.col(c).cast("double") for c in columns]).limit(200).collect()], np.float64).reshape(-1, len(columns))
    left: list[tuple[str, str, str, str, Column]] = []
    for i, a in enumerate(columns if len(probe) else []):
        for j, b in enumerate(columns[i:], i):
            for op in "*+":
                with np.errstate(all="ignore"):
                    seen = probe[:, i] * probe[:, j] if op == "*" else probe[:, i] + probe[:, j]
                    holds = (np.abs(probe - seen[:, None]) <= 1e-9 * np.abs(seen)[:, None]).all(axis=0)
                value = F.col(a).cast("double") * F.col(b) if op == "*" else F.col(a).cast("double") + F.col(b)
                left += [(c, a, op, b, F.abs(F.col(c) - value) <= 1e-9 * F.abs(value)) for c, h in zip(columns, holds, strict=True) if h and c not in (a, b)]
    out = df.sparkSession.createDataFrame([], "target string, a string, op string, b string")
    for at in range(0, len(left), FORMULAS_A_PASS):
        part = left[at : at + FORMULAS_A_PASS]
        wide = whole.agg(*[F.bool_and(m[4]).alias(f"f{k}") for k, m in enumerate(part)], F.count("*").alias("n"))
        cells = [F.struct(*[F.lit(x).alias(name) for x, name in zip(m[:4], ("target", "a", "op", "b"), strict=True)], F.col(f"f{k}").alias("holds")) for k, m in enumerate(part)]
        rows = wide.filter("n >= 5").select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("holds").drop("holds")
        out = out.union(rows) if at else rows
    return out


def placeholder_share(df: DataFrame, column: str, lexicon: list[str]) -> DataFrame:
    """Share of a column's words (four letters and more) that stand in a closed lexicon of filler."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"[a-z]{4,}"), F.lit(0))).alias("w"))
    return words.agg(F.count("*").alias("n_words"), F.avg(F.col("w").isin(lexicon).cast("double")).alias("share"))


def cleaning_warnings(df: DataFrame) -> DataFrame:
    """column, kind (imputed from 2 % on, capped from 1 % on) and share, by the markers that cleaning leaves."""
    marks = [(c, k) for c in numeric_columns(df) for k in ("imputed", "capped") if c.endswith("_was_missing" if k == "imputed" else "_was_capped")]
    if not marks:
        return df.sparkSession.createDataFrame([], "column string, kind string, share double")
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c, _ in marks])
    cells = [F.struct(F.lit(c.rsplit("_was_", 1)[0]).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("share")) for c, k in marks]
    rows = wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return rows.filter(F.col("share") >= F.when(F.col("kind") == "imputed", 0.02).otherwise(0.01))
