"""Shared helpers of the query families."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions.numeric import rounded


def r6(df: DataFrame, columns: Iterable[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))
