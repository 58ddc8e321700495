"""Writers: delimited files and the table write modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, delimiter: str = ",", encoding: str = "utf-8", header: bool = True) -> None:
    """Delimited files, one per partition; NULL is written as an empty cell."""
    (df.write.mode("overwrite").option("sep", delimiter).option("encoding", encoding)
     .option("header", header).option("nullValue", "").option("emptyValue", "")
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full refresh."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_by_key(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace only the partitions of the keys present in ``df``.

    Each partition is swapped as a whole, so a repeated run gives the same table.
    Rows are brought together by key and a heavy key is split by size at run time.
    """
    (df.hint("rebalance", *keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def replaced_by_key(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after a replace-by-key, as a query."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_documents(df: DataFrame, path: str, key: str, name: str = "version") -> None:
    """One JSON document per row under ``<path>/<key>=<value>/``; the document repeats its key as ``name``.

    Missing values are written as null, so every document has all fields.
    """
    rows = df.select("*", F.col(key).alias(name)).hint("rebalance", key)
    rows.write.mode("overwrite").option("ignoreNullFields", False).partitionBy(key).json(path)


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """Documents read back with the schema they were written with; a field that does not fit it raises."""
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stored table; with its schema partition values keep their type (half-years are text)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
