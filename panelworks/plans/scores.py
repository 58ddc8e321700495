"""Deterministic score tables (id, y, p, groups) derived from the panel and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import scoring as SC
from panelworks.operators.evaluation import several_scores
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M


def panel_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled at-risk rows scored by recency; few distinct scores, so many ties."""
    days = F.coalesce("dias_desde_ult_actividad", F.lit(0.0))
    return M.modelled(spark, folder).select(
        F.col("legajo").alias("id"), "academic_period", "cod_carrera", F.col("dropout_next").alias("y"),
        F.round(days / (days + 200.0), 6).alias("p"), F.col("dias_desde_ult_actividad").alias("days"),
        F.col("promo_rate_win3").alias("alt"),
    )


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score of many distinct values."""
    labels = X.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = X.table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    score = (F.lit(0.7) * F.least(F.lit(1.0), F.col("n_chars") / 5000.0)
             + F.lit(0.3) * (F.col("doc_id") * 7919 % 1000) / 1000.0)
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), "lang", "source", "y", F.round(score, 4).alias("p"))


def all_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables under one group column: ``panel`` and the document languages."""
    panel = panel_scores(spark, folder).select(F.lit("panel").alias("grp"), "id", "y", "p")
    docs = document_scores(spark, folder).select(
        F.col("lang").alias("grp"), F.col("id").cast("string").alias("id"), "y", "p")
    return panel.unionByName(docs)


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three deterministic candidates scored on every half-year (the cycle)."""
    rows = panel_scores(spark, folder)
    promo = 1 - F.coalesce("alt", F.lit(0.0))
    scored = rows.select(F.col("academic_period").alias("cycle_period"), "y", F.col("p").alias("a"),
                         promo.alias("b"), ((F.col("p") + promo) / 2).alias("c"))
    return several_scores(scored, {"recency": "a", "promotion": "b", "blend": "c"})


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Latest rows of studying students scored on two dates, the second for every third student."""
    rows = SC.latest_risk_rows(M.panel(spark, folder), SC.active_students(M.status(spark, folder)))
    days, number = F.coalesce("dias_desde_ult_actividad", F.lit(0)), F.col("legajo").cast("long")
    scored = rows.withColumn("_p", F.round(days / (days + 200.0) * 0.9 + (number % 100) / 1000.0, 6))
    runs = F.array(F.struct(F.lit("2025-06-01").alias("_d"), F.lit("1").alias("_v")),
                   F.when(number % 3 == 0, F.struct(F.lit("2025-12-01").alias("_d"), F.lit("2").alias("_v"))))
    dated = scored.select("*", F.inline(F.filter(runs, lambda r: r.isNotNull())))
    return SC.predictions(dated, F.col("_p"), F.col("_d"), F.col("_v"))
