"""The stored tables later steps read: canonical tables, status and panel.

A table is built once per application and input folder and kept as Parquet in
the shared folder, as a warehouse would keep it; every later report reads the
stored table with column pruning and filter pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions.text import clean_id, decimal_point
from panelworks.operators import panel as PN
from panelworks.operators import splits as SP
from panelworks.operators import status as ST
from panelworks.operators.snapshot import in_whitelist, latest_delivery
from panelworks.plans import fixtures as X
from panelworks.session import materialise, scratch_path
from panelworks.sources.delivery import latest_partition
from panelworks.sources.sinks import read_table, replace_table

_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stored:
        _stored[key] = materialise(build(), name)
    return _stored[key]


_staging: dict[tuple[str, str, str], str] = {}


def staging(spark: SparkSession, folder: str, name: str, build) -> str:
    """Path of a dataset's deliveries, stored once in one partition per delivery."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _staging:
        path = scratch_path(spark, f"staging-{name}")
        replace_table(build(), path, ["academic_period"])
        _staging[key] = path
    return _staging[key]


def history_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical history from the partition of the last staged delivery (not stored)."""
    raw = X.history(spark, folder)
    rows = latest_partition(spark, staging(spark, folder, "history", lambda: raw), raw.schema)
    rows = rows.select(*raw.columns).withColumn("legajo", clean_id(F.col("legajo")))
    return in_whitelist(rows.where(F.col("legajo").isNotNull()), "cod_carrera", X.WHITELIST).distinct()


def students_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_delivery(X.students(spark, folder)).withColumn("legajo", clean_id(F.col("legajo")))
    return in_whitelist(rows.where(F.col("legajo").isNotNull()), "codigo_carrera", X.WHITELIST).distinct()


def progress_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_delivery(X.progress(spark, folder)).withColumn("legajo", clean_id(F.col("legajo")))
    rows = rows.withColumn("porcentaje_avance", decimal_point(F.col("porcentaje_avance")))
    return in_whitelist(rows.where(F.col("legajo").isNotNull()), "cod_carrera", X.WHITELIST).distinct()


def history(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "history", lambda: history_rows(spark, folder))


def students(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "students", lambda: students_rows(spark, folder))


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "progress", lambda: progress_rows(spark, folder))


def status(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "status", lambda: ST.student_status(
        students(spark, folder), history(spark, folder), progress(spark, folder)))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The stored panel, in one partition per half-year: a cutoff or a period prunes files."""
    key = (spark.sparkContext.applicationId, folder, "panel")
    if key not in _stored:
        rows = PN.student_panel(history(spark, folder), progress(spark, folder), X.SPEC)
        path = scratch_path(spark, "panel")
        replace_table(rows.hint("rebalance", "academic_period"), path, ["academic_period"])
        _stored[key] = read_table(spark, path, rows.schema).select(*rows.columns)
    return _stored[key]


def modelled(spark: SparkSession, folder: str) -> DataFrame:
    return SP.modelling_rows(panel(spark, folder), unique=True)
