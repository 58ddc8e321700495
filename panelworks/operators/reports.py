"""Reporting queries on the canonical tables, marts and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.numeric import ratio
from panelworks.functions.text import blank, loose_number
from panelworks.operators.ordered import exact_quantiles, melt, null_safe_join

PERIOD = "academic_period"


def _n(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def modelling(panel: DataFrame) -> DataFrame:
    return panel.where((F.col("at_risk") == 1) & F.col("dropout_next").isNotNull())


def table_counts(spark: SparkSession, tables: dict[str, DataFrame | str | None]) -> DataFrame:
    """Rows per table, −1 for a table that does not exist."""
    out = None
    for name, table in tables.items():
        if isinstance(table, str):
            table = spark.table(table) if spark.catalog.tableExists(table) else None
        rows = (spark.range(1).select(F.lit(-1).cast("long").alias("n_rows")) if table is None
                else table.agg(F.count(F.lit(1)).alias("n_rows")))
        rows = rows.select(F.lit(name).alias("table_name"), "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def rows_per_delivery(staged: DataFrame) -> DataFrame:
    return staged.groupBy(PERIOD).agg(_n().alias("n")).orderBy(PERIOD)


def history_quality(history: DataFrame) -> DataFrame:
    return history.agg(
        _n().alias("total_filas"), F.count_distinct("legajo").alias("legajos_unicos"),
        F.count_distinct("cod_carrera").alias("carreras"), F.min(PERIOD).alias("primer_periodo"),
        F.max(PERIOD).alias("ultimo_periodo"), _n(blank(F.col("nota"))).alias("nulos_nota"))


def students_quality(students: DataFrame) -> DataFrame:
    return students.agg(
        _n().alias("total"), F.count_distinct("legajo").alias("legajos_unicos"),
        _n(blank(F.col("sexo"))).alias("nulos_sexo"), _n(blank(F.col("fecha_nacimiento"))).alias("nulos_fnac"))


def _numeric_progress(progress: DataFrame) -> DataFrame:
    """Rows whose progress text has only digits, commas and points; unreadable numbers are NULL."""
    loose = progress.where(F.col("porcentaje_avance").rlike(r"^[0-9,\.]+$"))
    return loose.withColumn("avance", loose_number(F.col("porcentaje_avance")))


def progress_quality(progress: DataFrame) -> DataFrame:
    return _numeric_progress(progress).agg(
        _n().alias("total"), F.count_distinct("legajo").alias("legajos_unicos"),
        F.avg("avance").alias("promedio_avance"), F.min("avance").alias("minimo"), F.max("avance").alias("maximo"),
        _n(F.col("avance") >= 90).alias("sobre_90"), _n(F.col("avance") >= 100).alias("sobre_100"),
        _n(blank(F.col("porcentaje_avance"))).alias("nulos"))


def progress_deciles(progress: DataFrame) -> DataFrame:
    decile = (F.floor(F.col("avance") / 10) * 10).cast("long")
    return _numeric_progress(progress).groupBy(decile.alias("decil_inicio")).agg(_n().alias("n")).orderBy("decil_inicio")


def status_distribution(status: DataFrame) -> DataFrame:
    counted = status.groupBy("status").agg(_n().alias("n"), F.count_distinct("legajo").alias("legajos_unicos"))
    whole = Window.partitionBy()  # one row per status
    return counted.withColumn("pct", F.col("n") / F.sum("n").over(whole) * 100).orderBy(F.desc("n"), "status")


def completions_by_programme(status: DataFrame, progress: DataFrame, top: int = 15) -> DataFrame:
    done = status.where(F.col("status") == K.STATUS_DONE)
    marks = progress.select("legajo", "cod_carrera", "porcentaje_avance")
    text = F.col("porcentaje_avance")
    joined = done.join(marks, "legajo", "left").where(text.isNull() | text.rlike(r"^[0-9,\.]+$"))
    return joined.groupBy("cod_carrera").agg(
        F.count_distinct("legajo").alias("n_finalizacion"), F.avg(loose_number(text)).alias("avance_promedio"),
    ).orderBy(F.desc("n_finalizacion"), F.asc_nulls_last("cod_carrera")).limit(top)


def completion_anomalies(status: DataFrame, progress: DataFrame, least: float = K.COMPLETION_THRESHOLD) -> DataFrame:
    """Progress rows of ``least`` % or more whose student is not completed, by status and in total."""
    high = progress.where(loose_number(F.col("porcentaje_avance")) >= least).select("legajo")
    odd = high.join(status.where(F.col("status") != K.STATUS_DONE), "legajo").groupBy("status").agg(_n().alias("n"))
    total = odd.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("status"), "n")
    return odd.unionByName(total)


def panel_composition(panel: DataFrame) -> DataFrame:
    labelled = F.col("dropout_next").isNotNull()
    return panel.agg(
        _n().alias("total_filas"), _n(F.col("at_risk") == 1).alias("filas_at_risk"),
        _n((F.col("at_risk") == 1) & labelled).alias("filas_modelado"), _n(~labelled).alias("filas_censuradas"))


def modelling_overview(panel: DataFrame) -> DataFrame:
    return modelling(panel).agg(
        _n().alias("total_filas"), F.count_distinct("legajo").alias("legajos_unicos"),
        F.count_distinct("cod_carrera").alias("carreras"), F.count_distinct(PERIOD).alias("periodos"),
        F.avg("dropout_next").alias("tasa_dropout_global"), _n(F.col("dropout_next") == 1).alias("filas_abandono"),
        _n(F.col("dropout_next") == 0).alias("filas_activo"))


def _split_tag(cutoff: str | Column) -> Column:
    return F.when(F.col(PERIOD) <= cutoff, "train").otherwise("val")


def split_summary(panel: DataFrame, cutoff: str) -> DataFrame:
    return modelling(panel).groupBy(_split_tag(F.lit(cutoff)).alias("split")).agg(
        _n().alias("n"), F.avg("dropout_next").alias("tasa_dropout"),
        _n(F.col("dropout_next") == 1).alias("n_abandono"), _n(F.col("dropout_next") == 0).alias("n_activo"),
    ).orderBy("split")


def period_summary(panel: DataFrame, cutoff: str) -> DataFrame:
    return modelling(panel).groupBy(PERIOD).agg(
        _n().alias("n"), F.count_distinct("legajo").alias("legajos"), F.avg("dropout_next").alias("tasa_dropout"),
    ).withColumn("split", _split_tag(F.lit(cutoff))).orderBy(PERIOD)


def label_pivot(panel: DataFrame) -> DataFrame:
    """Rows per half-year and label, side by side, with total and share."""
    wide = modelling(panel).groupBy(PERIOD).pivot("dropout_next", [0, 1]).agg(_n()).na.fill(0)
    total = F.col("0") + F.col("1")
    return wide.select(PERIOD, F.col("0").alias("activo"), F.col("1").alias("abandono"), total.alias("total"),
                       (ratio(F.col("1"), total) * 100).alias("pct_abandono")).orderBy(PERIOD)


def score_bands(preds: DataFrame, p: str = "dropout_probability") -> DataFrame:
    """High, medium and low risk with their shares, and the spread of the scores, in one row."""
    c = F.col(p)
    base = preds.agg(
        _n().alias("n_total"), _n(c >= 0.7).alias("n_high"), _n((c >= 0.5) & (c < 0.7)).alias("n_med"),
        _n(c < 0.5).alias("n_low"), F.avg(p).alias("media"), F.stddev_samp(p).alias("std"))
    q = exact_quantiles(preds, [], p, {"mediana": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    spread = q.select(F.struct("*").alias("q")).scalar()
    shares = {f"pct_{k}": ratio(F.col(f"n_{k}"), F.col("n_total")) * 100 for k in ("high", "med", "low")}
    return base.withColumn("_q", spread).withColumns(shares).select("*", "_q.*").drop("_q")


def risk_by_programme(preds: DataFrame) -> DataFrame:
    p = F.col("dropout_probability")
    return preds.groupBy("cod_carrera").agg(
        _n().alias("n"), F.avg(p).alias("riesgo_promedio"), _n(p >= 0.7).alias("alto_riesgo"),
    ).orderBy(F.desc("riesgo_promedio"), "cod_carrera")


def best_progress(progress: DataFrame) -> DataFrame:
    """Highest readable progress per student with any numeric-looking progress."""
    return _numeric_progress(progress).groupBy("legajo").agg(F.max("avance").alias("avance_max"))


def progress_by_status(status: DataFrame, progress: DataFrame) -> DataFrame:
    joined = status.join(best_progress(progress), "legajo", "left")
    base = joined.groupBy("status").agg(
        _n().alias("n"), F.round(F.avg("avance_max"), 2).alias("avance_promedio"),
        F.min("avance_max").alias("avance_min"), F.max("avance_max").alias("avance_max_val"),
        _n(F.col("avance_max").isNull()).alias("sin_avance"))
    middle = exact_quantiles(joined, ["status"], "avance_max", {"m": 0.5})
    return null_safe_join(base, middle, ["status"], "left").withColumn(
        "avance_mediana", F.round("m", 2)).drop("m").orderBy(F.desc("n"), "status")


def completed_activity(history: DataFrame, progress: DataFrame, threshold: float = K.COMPLETION_THRESHOLD,
                       buckets=K.ACTIVITY_BUCKETS) -> DataFrame:
    """Last delivery with courses of finished students, in five buckets."""
    done = best_progress(progress).where(F.col("avance_max") >= threshold)
    last = history.groupBy("legajo").agg(F.max(PERIOD).alias("_last"))
    bucket = F.when(F.col("_last").isNull(), K.ACTIVITY_NONE)
    for before, name in buckets:
        bucket = bucket.when(F.col("_last") < before, name)
    return done.join(last, "legajo", "left").groupBy(
        bucket.otherwise(K.ACTIVITY_RECENT).alias("actividad")).agg(_n().alias("n")).orderBy(F.desc("n"), "actividad")


def _status_pivot(joined: DataFrame, key: str, count: Column) -> DataFrame:
    names = (K.STATUS_LEFT, K.STATUS_ACTIVE, K.STATUS_DONE)
    wide = joined.groupBy(key).pivot("status", list(names)).agg(count).na.fill(0, list(names))
    total = sum((F.col(f"`{c}`") for c in names[1:]), F.col(f"`{names[0]}`"))
    return wide.withColumn("total", total).withColumns({
        f"pct_{c}": ratio(F.col(f"`{c}`"), F.col("total")) * 100 for c in names}).orderBy(key)


def cohort_retention(status: DataFrame, students: DataFrame, first_year: str = "2015") -> DataFrame:
    """Students per enrolment year and status, with total and shares."""
    entered = students.where(~blank(F.col("anio_academico")) & (F.col("anio_academico") >= first_year))
    # students with several programmes of one year count once
    once = entered.select("legajo", F.col("anio_academico").alias("cohorte")).distinct()
    return _status_pivot(status.join(once, "legajo"), "cohorte", F.count(F.lit(1)))


def status_by_sex(status: DataFrame, students: DataFrame) -> DataFrame:
    known = students.where(~blank(F.col("sexo"))).select("legajo", "sexo")
    return _status_pivot(status.join(known, "legajo"), "sexo", F.count(F.lit(1)))


def top_values(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Most frequent non-empty values of a column and their share of the listed rows."""
    best = df.where(~blank(F.col(column))).groupBy(column).agg(_n().alias("n")).orderBy(F.desc("n"), column).limit(top)
    whole = Window.partitionBy()  # at most ``top`` rows
    return best.withColumn("pct", F.col("n") / F.sum("n").over(whole) * 100).orderBy(F.desc("n"), column)


def feature_statistics(rows: DataFrame, features: Sequence[str] = K.REPORT_FEATURES, positive_only: bool = False,
                       label: str = "dropout_next") -> DataFrame:
    """Count, mean, median, deviation, p90 and correlation with the label per feature."""
    long = melt(rows, [label], features).where(F.col("value").isNotNull())
    if positive_only:
        long = long.where(F.col("value") > 0)
    base = long.withColumn("_y", F.col(label).cast("double")).groupBy("feature").agg(
        _n().alias("n"), F.avg("value").alias("media"), F.stddev_samp("value").alias("std"),
        F.corr("value", "_y").alias("corr"))
    q = exact_quantiles(long, ["feature"], "value", {"mediana": 0.5, "p90": 0.9})
    return base.join(q, "feature")


def listwise_correlation(rows: DataFrame, features: Sequence[str] = K.REPORT_FEATURES, label: str = "dropout_next"
                         ) -> DataFrame:
    """Pearson correlation with the label over rows where every feature is present, lowest first."""
    whole = rows.select(*features, label).dropna()
    one = whole.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in features])
    return one.select(F.inline(pairs)).orderBy("corr")


def dropout_by_programme(panel: DataFrame, least: int = 100, top: int = 20, lowest_first: bool = True) -> DataFrame:
    """Label rate per programme on the last row of each (student, programme), largest programmes only."""
    # the newest row wins as a whole; one row per half-year, so the order is strict
    last = modelling(panel).where(F.col("cod_carrera").isNotNull()).groupBy("legajo", "cod_carrera").agg(
        F.max_by("dropout_next", PERIOD).alias("dropout_next"))
    stats = last.groupBy("cod_carrera").agg(_n().alias("total"), F.sum("dropout_next").cast("long").alias("abandonos"))
    big = stats.where(F.col("total") >= least).orderBy(F.desc("total"), "cod_carrera").limit(top)
    rate = big.withColumn("tasa", ratio(F.col("abandonos"), F.col("total")) * 100)
    return rate.orderBy(F.asc("tasa") if lowest_first else F.desc("tasa"), "cod_carrera")


def leaderboard(evaluations: DataFrame, cycle: str | None = None) -> DataFrame:
    """Candidates of one cycle, or of all cycles, best AUC first."""
    if cycle is not None:
        return evaluations.where(F.col("cycle_period") == cycle).orderBy(F.desc("roc_auc"))
    return evaluations.orderBy("cycle_period", F.desc("roc_auc"))


def winners(evaluations: DataFrame) -> DataFrame:
    return evaluations.where("is_selected_model").orderBy("cycle_period")


def psi_evolution(drift: DataFrame) -> DataFrame:
    level = F.col("drift_level")
    return drift.groupBy("cycle_period").agg(
        F.max("psi_value").alias("psi_max"), _n(level == "high").alias("n_high"),
        _n(level == "moderate").alias("n_moderate"), _n(level == "none").alias("n_none")).orderBy("cycle_period")


def drift_report(drift: DataFrame, cycle: str) -> DataFrame:
    return drift.where(F.col("cycle_period") == cycle).orderBy(F.desc("psi_value"), "feature_name")


def cycles(results: DataFrame) -> DataFrame:
    return results.select("cycle_period").distinct().orderBy("cycle_period")


def selection_summary(evaluations: DataFrame) -> DataFrame:
    """One nested row per cycle: the winner and its candidates, best first."""
    won = F.col("is_selected_model")
    entry = F.struct((-F.col("roc_auc")).alias("_k"), *[c for c in evaluations.columns if c != "cycle_period"])
    out = evaluations.groupBy("cycle_period").agg(
        F.max(F.when(won, F.col("model_name"))).alias("winner"), F.max(F.when(won, F.col("roc_auc"))).alias("winner_auc"),
        F.max(F.when(won, F.col("ks_statistic"))).alias("winner_ks"), F.sort_array(F.collect_list(entry)).alias("_c"))
    return out.withColumn("candidates", F.transform("_c", lambda e: e.dropFields("_k"))).drop("_c")


def drift_summary_nested(drift: DataFrame) -> DataFrame:
    """One nested row per cycle: highest PSI, level counts and the features, worst first."""
    level = F.col("drift_level")
    entry = F.struct((-F.col("psi_value")).alias("_k"), "feature_name", "psi_value", "drift_level", "mean_reference",
                     "mean_current", "n_reference", "n_current")
    out = drift.groupBy("cycle_period").agg(
        F.max("psi_value").alias("psi_max"), _n(level == "high").alias("n_high"),
        _n(level == "moderate").alias("n_moderate"), _n(level == "none").alias("n_none"),
        F.sort_array(F.collect_list(entry)).alias("_f"))
    return out.withColumn("features", F.transform("_f", lambda e: e.dropFields("_k"))).drop("_f")
