"""Rows to score, predictions and their views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.numeric import ratio


def active_students(status: DataFrame) -> DataFrame:
    return status.where(F.col("status") == K.STATUS_ACTIVE).select("legajo").distinct()


def latest_risk_rows(panel: DataFrame, active: DataFrame) -> DataFrame:
    """Whole latest at-risk row per active student; never a mix of rows."""
    rows = panel.where(F.col("at_risk") == 1).join(active, "legajo", "left_semi")
    order = Window.partitionBy("legajo").orderBy(
        F.desc("academic_period"), F.asc_nulls_last("dias_desde_ult_actividad"))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def predictions(rows: DataFrame, probability, when, version) -> DataFrame:
    """Scored rows in the shape of the prediction table; class at one half."""
    return rows.select(
        "legajo", "academic_period", "cod_carrera", (probability >= 0.5).cast("int").alias("dropout_prediction"),
        probability.alias("dropout_probability"), when.alias("prediction_date"), version.alias("model_version"))


def scoring_summary(preds: DataFrame) -> DataFrame:
    return preds.agg(
        F.count(F.lit(1)).alias("total_students"), F.sum("dropout_prediction").cast("long").alias("predicted_dropouts"),
        ratio(F.sum("dropout_prediction"), F.count(F.lit(1))).alias("dropout_rate"),
        F.avg("dropout_probability").alias("avg_dropout_probability"))


def latest_predictions(preds: DataFrame) -> DataFrame:
    """Rows of each student's newest prediction date (ties kept) with a risk level."""
    p = F.col("dropout_probability")
    risk = None
    for bound, name in K.RISK_LEVELS:
        risk = F.when(p >= bound, name) if risk is None else risk.when(p >= bound, name)
    newest = preds.groupBy("legajo").agg(F.max("prediction_date").alias("prediction_date"))
    return preds.join(newest, ["legajo", "prediction_date"]).select(
        "legajo", "academic_period", "cod_carrera", "dropout_prediction", "dropout_probability",
        risk.otherwise(K.RISK_LOWEST).alias("risk_level"), "prediction_date", "model_version")
