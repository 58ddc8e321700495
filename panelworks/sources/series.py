"""Economic time series: CSV to a typed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.sources.delimited import read_csv_text


def typed_series(
    raw: DataFrame, columns: Sequence[tuple[str, str, int, int]], required: Sequence[str] | None = None
) -> DataFrame:
    """``indice_tiempo`` as date, the others as decimals.

    Rows with a missing cell are dropped; with ``required`` only those columns count.
    """
    subset = list(required) if required else raw.columns
    present = raw.dropna(subset=subset) if required else raw.dropna()
    for c in subset:
        present = present.where(F.trim(F.col(c)) != "")
    return present.select(
        F.col("indice_tiempo").cast("date").alias("indice_tiempo"),
        *[F.col(src).cast(f"decimal({p},{s})").alias(dst) for src, dst, p, s in columns],
    )


def load_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the known series from its CSV file."""
    columns = K.SERIES[name]
    required = [columns[0][0]] if name == "unemployment_rates" else None
    return typed_series(read_csv_text(spark, path), columns, required)
