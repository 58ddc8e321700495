"""Demographics and subgroup metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.numeric import right_closed, rounded
from panelworks.operators import metrics as ME
from panelworks.operators.ordered import null_safe_join
from panelworks.session import materialise


def demographics(students: DataFrame, cohorts=K.COHORT_BINS, ages=K.AGE_BINS) -> DataFrame:
    """One row per student: first known sex by enrolment date, birth and entry years, cohort, age group."""
    entry, birth = F.col("fecha_inscripcion").try_cast("date"), F.col("fecha_nacimiento").try_cast("date")
    known = F.when(F.col("sexo").isNotNull(), F.struct(entry.isNull().alias("u"), entry.alias("e"), "sexo"))
    out = students.groupBy("legajo").agg(
        F.upper(F.trim(F.min(known)["sexo"])).alias("sexo"),
        F.min(F.year(birth)).alias("anio_nac"), F.min(F.year(entry)).alias("anio_ing"))
    age = F.col("anio_ing") - F.col("anio_nac")
    return out.select(
        "legajo", F.when(~F.col("sexo").isin("NAN", "NONE"), F.col("sexo")).alias("sexo"), "anio_nac", "anio_ing",
        age.alias("edad_ingreso"), right_closed(F.col("anio_ing"), cohorts).alias("cohorte"),
        right_closed(age, ages).alias("grupo_edad"))


def by_attribute(scored: DataFrame, attributes: dict[str, str], keep: Sequence[str] = ("id", "y", "p")) -> DataFrame:
    """One row per (row, attribute) with its value; rows without a value are left out."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("atributo"), F.col(c).cast("string").alias("valor"))
        for c, name in attributes.items()
    ])
    return scored.select(*keep, F.inline(pairs)).where(F.col("valor").isNotNull())


def subgroup_metrics(long: DataFrame, by: Sequence[str] = ("atributo", "valor"), least: int = 150) -> DataFrame:
    """Metrics of every subgroup of at least ``least`` rows with both classes."""
    by = list(by)
    long = materialise(long.select(*by, "id", "y", "p"), "subgroup_rows")  # four families of metrics read it
    flat = ME.threshold_metrics(long, by).where(
        (F.col("n") >= least) & (F.col("prevalence") > 0) & (F.col("prevalence") < 1))
    top = ME.top_share(long, by, shares=(10,), at_least_one=True).select(*by, F.col("precision_at").alias("p_at_10"))
    out = null_safe_join(flat, ME.roc_auc(long, by), by)
    out = null_safe_join(out, ME.calibration_fit(long, by), by)
    out = null_safe_join(out, top, by)
    return out.select(
        *by, "n", rounded(F.col("prevalence"), 4).alias("prevalencia"), rounded(F.col("auc"), 4).alias("auc"),
        rounded(F.col("tpr"), 4).alias("tpr"), rounded(F.col("fpr"), 4).alias("fpr"), rounded(F.col("precision"), 4).alias("precision"),
        rounded(F.col("calib_slope"), 3).alias("calib_slope"), rounded(F.col("ece"), 4).alias("ece"),
        rounded(F.col("brier_score"), 4).alias("brier"), rounded(F.col("p_at_10"), 4).alias("p_at_10"))


def auc_spread(groups: DataFrame) -> DataFrame:
    """Lowest and highest AUC over groups and their distance."""
    return groups.agg(F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"),
                      (F.max("auc") - F.min("auc")).alias("auc_range"))


def auc_extremes(groups: DataFrame, n: int = 5, key: str = "valor") -> DataFrame:
    """The ``n`` groups with the lowest and the ``n`` with the highest AUC."""
    low = groups.orderBy(F.asc("auc"), key).limit(n).withColumn("extremo", F.lit("peor"))
    high = groups.orderBy(F.desc("auc"), F.desc(key)).limit(n).withColumn("extremo", F.lit("mejor"))
    return low.unionByName(high)
