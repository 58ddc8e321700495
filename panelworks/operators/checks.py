"""Constraint checks as queries: an empty result means the constraint holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, or by a row with a NULL in them."""
    missing = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where((F.col("n_rows") > 1) | (missing == 1))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each named rule, counted in one pass. A NULL breaks a rule."""
    counted = df.agg(*[
        F.sum((~F.coalesce(rule, F.lit(False))).cast("long")).alias(name) for name, rule in rules.items()
    ])
    pairs = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0).cast("long")).alias("n_rows"))
        for n in rules
    ])
    return counted.select(F.inline(pairs))


def require(df: DataFrame, what: str) -> None:
    """Raise when a check query returns any row."""
    found = df.limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")
