"""The evaluations table: one row per (cycle, model) with the winner marked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.operators import metrics as ME
from panelworks.operators.ordered import null_safe_join

KEYS = ("cycle_period", "model_name")


def evaluations(scored: DataFrame, keys: Sequence[str] = KEYS, y: str = "y", p: str = "p") -> DataFrame:
    """All metrics of every (cycle, model) in one grouped job; the best AUC of a cycle is selected."""
    keys = list(keys)
    ranked = ME.ranking_metrics(scored, keys, y, p)
    flat = ME.threshold_metrics(scored, keys, y, p)
    both = null_safe_join(ranked, flat, keys)
    # one row per candidate of a cycle; ties go to the first name
    order = Window.partitionBy(keys[0]).orderBy(F.desc_nulls_last("roc_auc"), keys[1])
    return both.select(
        *keys, "roc_auc", "brier_score", "average_precision", "ks_statistic", F.col("f1").alias("f1_dropout"),
        F.coalesce("precision", F.lit(0.0)).alias("precision_dropout"),
        F.coalesce("tpr", F.lit(0.0)).alias("recall_dropout"), F.col("n").alias("val_size"),
        (F.row_number().over(order) == 1).alias("is_selected_model"))


def several_scores(scored: DataFrame, models: dict[str, str], name: str = "model_name") -> DataFrame:
    """One row per (row, model): score columns of several models on the same rows."""
    keep = [c for c in scored.columns if c not in models.values()]
    pairs = F.array(*[F.struct(F.lit(m).alias(name), F.col(c).cast("double").alias("p")) for m, c in models.items()])
    return scored.select(*keep, F.inline(pairs))
