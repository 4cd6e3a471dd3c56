"""Exact ranks, running sums and quantiles that no single task has to order.

Values are counted first. Their range is cut into ``PARTS`` parts at approximate quantiles, sums over the parts before are added
to running sums within a part, so each task orders one part and the results are exact however good the cuts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 64
#: Rows of a group that are looked at whole; half a bracket's width as a share of the rows, for groups too small for a narrow one; places that a bracket must reach beyond its quantile.
FEW, WIDE, PLACES = 2_000, 0.0015, 3
#: Rows of a group from which its marks are broadcast: one row of marks for each so many rows of the input, at most.
MANY = 100_000


def running(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """``counts`` (a row per distinct number ``value``, within ``by``) with ``<c>_before``, the sum of c over smaller values, and ``<c>_all`` over all."""
    by = by or []
    cuts = [k / PARTS for k in range(1, PARTS)]
    marks = counts.groupBy(*by).agg(F.percentile_approx(value, cuts, F.lit(10_000)).alias("_marks"))
    rows = _attach(counts, marks, by).withColumn("_part", F.size(F.filter("_marks", lambda m: m <= F.col(value))))
    parts = rows.groupBy(*by, "_part").agg(F.min(value).alias("_lo"), *[F.sum(c).alias(f"_{c}") for c in sums])  # PARTS rows, for each of ``by``
    order = Window.partitionBy(*by).orderBy("_part")
    parts = parts.withColumns({f"_b{c}": F.sum(f"_{c}").over(order) - F.col(f"_{c}") for c in sums} | {f"_a{c}": F.sum(f"_{c}").over(Window.partitionBy(*by)) for c in sums})
    out = by_parts(counts, F.col(value), parts, [x for c in sums for x in (f"_b{c}", f"_a{c}")], by)
    within = Window.partitionBy(*by, "_part").orderBy(value)
    out = out.withColumns({f"{c}_all": F.col(f"_of._a{c}") for c in sums} | {f"{c}_before": F.col(f"_of._b{c}") + F.sum(c).over(within) - F.col(c) for c in sums})
    return out.drop("_part", "_of")


def by_parts(rows: DataFrame, number: Column, parts: DataFrame, keep: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``_part`` and, in ``_of``, what is kept of their part. ``parts``: a row per part (within ``by``), with ``_lo``, its least number.

    Sketches differ from one evaluation to the next (by the order in which they are merged), and a plan that names ``_part`` twice may evaluate them twice:
    rows would then be summed in one part and looked up in another. So parts are made once, and rows find theirs by the least numbers that came out.
    """
    few = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_lo", *keep))).alias("_parts"))
    place = F.greatest(F.size(F.filter("_parts", lambda p: p["_lo"].isNull() | (p["_lo"] <= number))), F.lit(1))
    out = _attach(rows, few, by).withColumn("_part", place)
    return out.withColumn("_of", F.element_at("_parts", F.col("_part"))).drop("_parts")


def number_of(df: DataFrame, order_by: str) -> Column:
    """A number, date or timestamp as a double in the same order; null for texts, which are left in one part."""
    kind = df.schema[order_by].dataType
    if isinstance(kind, T.StringType):
        return F.lit(None).cast("double")
    number = F.unix_date(F.col(order_by)) if isinstance(kind, T.DateType) else F.col(order_by).cast("timestamp").cast("double") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(order_by)
    return number.cast("double")


def in_parts(df: DataFrame, order_by: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``_part`` and ``_number``: parts of the order of a number, date or timestamp, within ``by``. Evaluate it once (``by_parts`` says why)."""
    by = by or []
    rows = df.withColumn("_number", number_of(df, order_by))
    marks = rows.groupBy(*by).agg(F.percentile_approx("_number", [k / PARTS for k in range(1, PARTS)], F.lit(10_000)).alias("_marks"))
    return _attach(rows, marks, by).withColumn("_part", F.coalesce(F.size(F.filter("_marks", lambda m: m <= F.col("_number"))), F.lit(0))).drop("_marks")


def _attach(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the row of ``few`` for its ``by`` (the only one, without)."""
    if not by:
        return rows.crossJoin(few)  # one row
    few = few.withColumnsRenamed({k: f"_k_{k}" for k in by})
    return rows.join(few, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]).drop(*[f"_k_{k}" for k in by])


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, column and q: exact interpolated quantiles of each column (of nulls only: no row).

    A sketch gives two marks around each quantile, further apart than its error and the two places an interpolation looks at. What lies below the lower mark
    is counted, what lies between is counted by value, and the quantile is found among those few: nothing but they is shuffled. Groups of up to
    ``FEW`` rows are their own bracket. Rows meet their marks where they are read, so no task gets a whole column or group; only the rows of groups under
    ``MANY`` rows are shuffled to theirs.
    """
    by = by or []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    values = df.select(*[F.col(f"`{k}`") for k in by], F.explode(cells).alias("_x")).select(*by, "_x.*").filter("v IS NOT NULL")
    accuracy = 10_000 if by else 100_000
    reach = (WIDE, 5 / accuracy)
    ends = [min(1.0, max(0.0, s + sign * r)) for s in shares for sign in (-1, 1) for r in reach]
    marks = values.groupBy(*by, "column").agg(F.count("*").alias("n"), F.percentile_approx("v", ends, F.lit(accuracy)).alias("_m"))
    mark = lambda at: F.when(F.col("n") * reach[1] >= PLACES, F.col("_m")[at + 1]).otherwise(F.col("_m")[at])
    low = F.array(*[F.when(F.col("n") <= FEW, float("-inf")).otherwise(mark(4 * k)) for k in range(len(shares))])
    high = F.array(*[F.when(F.col("n") <= FEW, float("nan")).otherwise(mark(4 * k + 2)) for k in range(len(shares))])  # not-a-number is the largest
    marks = marks.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col("column").alias("_column"), "n", F.arrays_zip(low.alias("lo"), high.alias("hi")).alias("_m"))
    same = [F.col("column") == F.col("_column"), *[F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by]]
    if by:
        large = F.broadcast(marks.filter(F.col("n") >= MANY))  # at most a row for each MANY values
        rows = values.join(large, same).unionByName(values.join(large, same, "left_anti").join(marks.filter(F.col("n") < MANY), same))
    else:
        rows = values.join(F.broadcast(marks), same)  # a row per column
    rows = rows.select(*by, "column", "n", "v", F.posexplode("_m").alias("k", "m")).filter(F.col("v") <= F.col("m.hi"))
    counts = rows.groupBy(*by, "column", "n", "k", F.when(F.col("v") >= F.col("m.lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by, "column", "n", "k").orderBy(F.asc_nulls_first("v"))
    placed = counts.withColumn("before", F.sum("c").over(order) - F.col("c"))

    def at(place: Column) -> Column:
        """The value that stands at a place, from 0, in order."""
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("v")))

    spot = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("k") + 1)
    found = placed.groupBy(*by, "column", "n", "k").agg(at(F.floor(spot)).alias("a"), at(F.ceil(spot)).alias("b"))
    found = found.select(*by, "column", "k", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (spot - F.floor(spot))).alias("q"))
    return found.groupBy(*by, "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))  # a value a share


def wide_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """One row with an array of quantiles under each column's name; null where a column has no value."""
    q = quantiles(df, columns, shares)
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in columns])


def with_medians(grouped: DataFrame, df: DataFrame, keys: list[str], medians: dict[str, str]) -> DataFrame:
    """``grouped`` (a row per group of ``keys``) with the exact median of each of the columns, under the given names."""
    if not medians:
        return grouped
    q = quantiles(df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], *[F.col(f"`{c}`") for c in medians]), list(medians), [0.5], [f"_k{i}" for i in range(len(keys))])
    q = q.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(name) for c, name in medians.items()])
    if not keys:
        return grouped.crossJoin(q)  # one row
    return grouped.join(q, [grouped[k].eqNullSafe(q[f"_k{i}"]) for i, k in enumerate(keys)], "left").drop(*[f"_k{i}" for i in range(len(keys))])
