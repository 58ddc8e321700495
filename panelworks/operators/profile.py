"""Table profile in one pass: rows, columns, missing values, mean and range of numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_profile(df: DataFrame) -> DataFrame:
    """(column_name, metric, value); only columns with missing values have a null count."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(df.columns)]
    for i, c in enumerate(numeric):
        aggs += [F.avg(c).alias(f"_mean_{i}"), F.min(c).cast("double").alias(f"_min_{i}"),
                 F.max(c).cast("double").alias(f"_max_{i}")]

    def cell(column: str | None, metric: str, value):
        return F.struct(F.lit(column).cast("string").alias("column_name"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"))

    cells = [cell(None, "row_count", F.col("_rows")), cell(None, "column_count", F.lit(len(df.columns)))]
    cells += [cell(c, "null_count", F.when(F.col(f"_null_{i}") > 0, F.col(f"_null_{i}")))
              for i, c in enumerate(df.columns)]
    for i, c in enumerate(numeric):
        cells += [cell(c, m, F.col(f"_{m}_{i}")) for m in ("mean", "min", "max")]
    return df.agg(*aggs).select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
