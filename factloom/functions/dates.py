"""Dates in text: one convention for a whole column, proved from the data where it can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts tried in order, with separators made dashes and the day or month first.
ISO = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d")
DAY_FIRST = ("d-M-yyyy H:m:s", "d-M-yyyy H:m", "d-M-yyyy")
MONTH_FIRST = ("M-d-yyyy H:m:s", "M-d-yyyy H:m", "M-d-yyyy")
CLOCK = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([AaPp][Mm])?\s*$"


def strip(c: Column) -> Column:
    """Unicode strip; the built-in trim leaves tabs and line ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def dashed(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?<=\d)[/.](?=\d)", "-")


def shape(layout: str) -> str:
    """A pattern that every text of a layout has: its separators, and in their place its year of four digits or more."""
    day, _, clock = layout.replace("'T'", " ").partition(" ")
    day = "-".join(r"[+-]?\d{4,}" if part == "yyyy" else r"[+-]?\d+" for part in day.split("-"))
    between = "[Tt]" if "T" in layout else " "
    return f"^{day}{between}{':'.join([r'[+-]?\d+'] * len(clock.split(':')))}$" if clock else f"^{day}$"


def parse_date(c: Column, day_first: bool) -> Column:
    """A timestamp, or null; ISO layouts, then the given convention. Clock times are never dates.

    A layout is tried on texts of its shape only: a try that fails costs an exception. Separators are made dashes once, not once a try.
    """
    layouts = (*ISO, *(DAY_FIRST if day_first else MONTH_FIRST))
    read = lambda text: F.coalesce(*[F.when(text.rlike(shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in layouts])
    return F.when(~c.rlike(CLOCK), F.transform(F.array(dashed(c)), read)[0])


def convention_counts(df: DataFrame, column: str) -> DataFrame:
    """Values that only day-first can read, values that only month-first can, and values that both can."""
    text = dashed(F.col(column))
    a = F.regexp_extract(text, r"^(\d{1,2})-(\d{1,2})-\d{4}", 1).try_cast("int")
    b = F.regexp_extract(text, r"^(\d{1,2})-(\d{1,2})-\d{4}", 2).try_cast("int")
    return df.agg(F.count_if((a > 12) & (b <= 12)).alias("day_first"), F.count_if((b > 12) & (a <= 12)).alias("month_first"), F.count_if((a <= 12) & (b <= 12)).alias("ambiguous"))


def proved_convention(df: DataFrame, column: str) -> bool | None:
    """True: day first; False: month first; None: no proof, or both kinds occur."""
    x = convention_counts(df, column).first()
    if bool(x["day_first"]) == bool(x["month_first"]):
        return None
    return bool(x["day_first"])


def parse_column(df: DataFrame, column: str) -> tuple[Column, bool | None]:
    """The column's dates under its one convention; month first where nothing proves one."""
    proof = proved_convention(df, column)
    return parse_date(F.col(column), bool(proof)), proof
