"""Event-time forms of batch operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import aggregate


def over_time_stream(df: DataFrame, time_col: str, every: str = "1 day", late: str = "1 day", value_col: str | None = None, how: str = "sum") -> DataFrame:
    """Value per window of a stream; windows close once the watermark has passed."""
    value = F.count("*") if value_col is None else aggregate(how, F.col(value_col))
    w = df.withWatermark(time_col, late).groupBy(F.window(time_col, every).alias("w")).agg(value.alias("value"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")


def first_of_each(df: DataFrame, keys: list[str], time_col: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return df.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
