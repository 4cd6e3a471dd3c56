"""Time series on calendar periods, and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import with_medians
from .aggregate import aggregate

#: Frequency -> (truncation unit, step, periods in a year).
FREQUENCIES = {"D": ("day", "1 day", 365), "W": ("week", "7 days", 52), "ME": ("month", "1 month", 12), "QE": ("quarter", "3 months", 4), "YE": ("year", "1 year", None)}
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800}


def period_start(ts: Column, freq: str) -> Column:
    return F.date_trunc(FREQUENCIES[freq][0], ts).cast("date")


def period_end(start: Column, freq: str) -> Column:
    """The last day of a period, given its first one; weeks end on Sunday."""
    if freq == "D":
        return start
    if freq == "W":
        return F.date_add(start, 6)
    months = {"ME": 0, "QE": 2, "YE": 11}[freq]
    return F.last_day(F.add_months(start, months))


def over_time(df: DataFrame, date_col: str, freq: str = "ME", value_col: str | None = None, how: str = "sum") -> DataFrame:
    """period (its end), value, change_pct, year_on_year_pct (where the frequency has one), complete.

    Empty periods appear: as 0 for sums and counts, and not at all for other aggregates. The last period
    is incomplete while its last day is later than the last date seen.
    """
    unit, step, year = FREQUENCIES[freq]
    day = F.col(date_col).cast("date")
    value = F.count("*") if value_col is None else aggregate(how, F.col(value_col))
    grouped = df.filter(day.isNotNull()).groupBy(period_start(F.col(date_col), freq).alias("start")).agg(value.cast("double").alias("value"), F.max(day).alias("last_seen"))
    ends = grouped.agg(F.min("start").alias("a"), F.max("start").alias("z"), F.max("last_seen").alias("last"))
    spine = ends.select(F.explode(F.expr(f"sequence(a, z, interval {step})")).alias("start"), "last")
    out = spine.join(grouped.drop("last_seen"), "start", "left")
    out = out.fillna(0.0, subset=["value"]) if value_col is None or how in ("sum", "count") else out.filter(F.col("value").isNotNull())
    w = Window.orderBy("start")  # a row per period

    def change(n: int) -> Column:
        before = F.lag("value", n).over(w)
        return F.try_divide(F.col("value") - before, F.abs(before)) * 100

    out = out.withColumn("period", period_end(F.col("start"), freq)).withColumn("change_pct", change(1))
    if year:
        out = out.withColumn("year_on_year_pct", change(year))
    return out.withColumn("complete", F.col("period") <= F.col("last")).drop("start", "last")


def settled_extremes(series: DataFrame) -> DataFrame:
    """The largest rise and fall among complete periods whose base is not tiny (at least a fifth of the median)."""
    w = Window.orderBy("period")
    base = series.filter("complete").withColumn("base", F.lag("value").over(w))
    known = base.crossJoin(base.agg(F.percentile("value", 0.5).alias("mid"))).filter((F.col("base") >= 0.2 * F.col("mid")) & F.col("change_pct").isNotNull())  # one row
    return known.agg(F.max_by("period", "change_pct").alias("rise_period"), F.max("change_pct").alias("rise_pct"), F.min_by("period", "change_pct").alias("fall_period"), F.min("change_pct").alias("fall_pct"))


def partial_last_period(df: DataFrame, date_col: str, freq: str = "ME") -> DataFrame:
    """last date, end of its period, and whether the period is still filling."""
    last = df.agg(F.max(F.col(date_col).cast("date")).alias("last_date"))
    return last.withColumn("period_end", period_end(period_start(F.col("last_date"), freq), freq)).withColumn("partial", F.col("last_date") < F.col("period_end"))


def duration(start: Column, end: Column, unit: str = "days") -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6 / UNITS[unit]


def duration_stats(df: DataFrame, start: str, end: str, unit: str = "days", by: str | None = None, exclude_negative: bool = False) -> DataFrame:
    """n, mean, median, range and negative gaps; negative ones stay in the mean unless excluded."""
    gaps = df.withColumn("_gap", duration(F.col(start), F.col(end), unit)).filter(F.col("_gap").isNotNull())
    gaps = gaps.filter("_gap >= 0") if exclude_negative else gaps
    out = [F.count("*").alias("n"), F.avg("_gap").alias("mean"), F.min("_gap").alias("min"), F.max("_gap").alias("max"), F.count_if(F.col("_gap") < 0).alias("n_negative")]
    if by is None:
        return with_medians(gaps.agg(*out), gaps, [], {"_gap": "median"})
    gaps = gaps.select(F.col(by).alias("label"), "_gap")
    return with_medians(gaps.groupBy("label").agg(*out), gaps, ["label"], {"_gap": "median"})
