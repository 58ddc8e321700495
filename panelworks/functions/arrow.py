"""Arrow-batched Python steps for what no built-in expression says."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Let the Python workers find this package where it is installed by path only."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def in_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    reachable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def fields(df: DataFrame, columns) -> str:
    """``columns`` of ``df`` as part of a schema."""
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in columns)
