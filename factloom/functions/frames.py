"""Small building blocks that several operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans are not numbers here."""
    return [f.name for f in df.schema if isinstance(f.dataType, NUMBERS)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one thing from loading on."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is named several times there: as a lambda's argument it is computed once, not wherever it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def same_keys(pairs: list[tuple[str, str]], null_safe: bool = True) -> Column:
    """Equality of the keys of two frames aliased ``l`` and ``r``."""
    eq = [F.col(f"l.`{a}`").eqNullSafe(F.col(f"r.`{b}`")) if null_safe else F.col(f"l.`{a}`") == F.col(f"r.`{b}`") for a, b in pairs]
    return reduce(Column.__and__, eq)


def wide_to_rows(wide: DataFrame, columns: list[str], fields: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """One row of ``<column>__<field>`` values as a row per column: the second half of a one-pass profile."""
    types = types or {}
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").cast(types.get(f, "double")).alias(f) for f in fields]) for c in columns]
    return wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
