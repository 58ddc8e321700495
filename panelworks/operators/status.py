"""Rule-based student status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.text import iso_day, strict_number


def status_cutoff(history: DataFrame, months: int = K.STATUS_CUTOFF_MONTHS) -> DataFrame:
    """One row: last date in the data and the cutoff ``months`` before it."""
    last = history.agg(F.max(iso_day(F.col("fecha"))).alias("data_max_date"))
    return last.withColumn("cutoff_date", F.add_months("data_max_date", -months))


def last_course_date(history: DataFrame) -> DataFrame:
    """Last course date per student, taken on the text as delivered."""
    last = history.groupBy("legajo").agg(F.max("fecha").alias("_last"))
    return last.select("legajo", F.col("_last").try_cast("date").alias("fecha_ultima_cursada"))


def completed_students(progress: DataFrame, threshold: float = K.COMPLETION_THRESHOLD) -> DataFrame:
    """Students with any progress value at or above the threshold."""
    done = strict_number(F.col("porcentaje_avance")) >= threshold
    return progress.where(done).select("legajo").distinct()


def student_status(
    students: DataFrame,
    history: DataFrame,
    progress: DataFrame,
    threshold: float = K.COMPLETION_THRESHOLD,
) -> DataFrame:
    """One row per student: last course date, status and 0/1 flag."""
    cutoff = status_cutoff(history).select("cutoff_date").scalar()
    done = completed_students(progress, threshold).withColumn("_done", F.lit(True))
    joined = (
        students.select("legajo").distinct()
        .join(last_course_date(history), "legajo", "left")
        .join(done, "legajo", "left")
    )
    # a date on the cutoff still counts as studying
    gone = F.col("fecha_ultima_cursada").isNull() | (F.col("fecha_ultima_cursada") < cutoff)
    status = (
        F.when(F.col("_done"), K.STATUS_DONE).when(gone, K.STATUS_LEFT).otherwise(K.STATUS_ACTIVE)
    )
    return joined.select(
        "legajo", "fecha_ultima_cursada", status.alias("status")
    ).withColumn("dropout_flag", (F.col("status") == K.STATUS_LEFT).cast("int"))
