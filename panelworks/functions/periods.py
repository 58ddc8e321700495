"""Half-year arithmetic.

A period is the integer ``year * 2 + half`` (half 0 starts in March, half 1 in
September); its label is ``YYYY_1C`` / ``YYYY_2C``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(label: str) -> int:
    """Index of a label known when the plan is built."""
    year, half = label.split("_")
    return int(year) * 2 + int(half[0]) - 1


def label_of(index: int) -> str:
    return f"{index // 2}_{index % 2 + 1}C"


def shift_label(label: str, earlier: int) -> str:
    """The label ``earlier`` half-years before (negative: after)."""
    return label_of(index_of(label) - earlier)


def period_of_day(day: Column) -> Column:
    """March–August is half 0, September–February half 1 of the year it began in."""
    return (F.year(day) * 2 + F.floor((F.month(day) - 3) / 6)).cast("int")


def period_of_label(label: Column) -> Column:
    """Index of a ``YYYY_nC`` text; NULL for every other text (summer, annual, ...)."""
    year = F.substring(label, 1, 4).try_cast("int")
    half = F.substring(label, 6, 1).try_cast("int")
    return F.when(label.rlike(r"^[1-9]\d{3}_[12]C$"), year * 2 + half - 1)


def period_label(index: Column) -> Column:
    half = F.when(index % 2 == 0, F.lit("_1C")).otherwise(F.lit("_2C"))
    return F.concat(F.shiftright(index.cast("int"), 1).cast("string"), half)


def period_start(index: Column) -> Column:
    month = F.when(index % 2 == 0, F.lit(3)).otherwise(F.lit(9))
    return F.make_date(F.shiftright(index.cast("int"), 1), month, F.lit(1))


def shift_period(label: Column, earlier: int | Column) -> Column:
    return period_label(period_of_label(label) - earlier)
