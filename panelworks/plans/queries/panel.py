"""Panel and status queries, built from the stored canonical history in one plan each."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions import periods as P
from panelworks.operators import panel as PN
from panelworks.operators import status as ST
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M
from panelworks.plans.oracle import with_ctes
from panelworks.plans.queries.common import as_text, r6

PANEL_DOUBLES = ("nota_media_en_periodo", "nota_win3", "promo_rate_period", "promo_rate_win3")


def _dense(s, d):
    return PN.dense_panel(M.history(s, d), M.progress(s, d), X.SPEC).withColumn(
        "academic_period", P.period_label(F.col("period"))
    )


def _panel(s, d):
    return PN.student_panel(M.history(s, d), M.progress(s, d), X.SPEC)


def label_counts(s, d):
    """Flagship: rows, students and label rate of the modelling population per half-year."""
    rows = _panel(s, d).where((F.col("at_risk") == 1) & F.col("dropout_next").isNotNull())
    out = rows.groupBy("academic_period").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("legajo").alias("n_students"),
        F.sum("dropout_next").cast("long").alias("n_positive"),
        F.avg("dropout_next").alias("label_rate"),
    )
    return r6(out, ["label_rate"])


def pan_01(s, d):
    rows = PN.dated(M.history_rows(s, d))
    out = rows.groupBy("fecha", P.period_start(F.col("period")).alias("period_start"))
    return as_text(out.agg(F.count(F.lit(1)).alias("n")), "period_start")


def pan_02(s, d):
    index = PN.activity(M.history_rows(s, d)).groupBy("period").agg(F.count(F.lit(1)).alias("n_students"))
    label = P.period_label(F.col("period"))
    return index.select(
        F.col("period").cast("long").alias("pidx"), label.alias("academic_period"),
        P.shift_period(label, 4).alias("four_earlier"), P.shift_period(label, -1).alias("one_later"),
        P.period_of_label(label).cast("long").alias("pidx_back"), "n_students",
    )


def pan_03(s, d):
    return as_text(PN.calendar(M.history_rows(s, d), X.SPEC).drop("period"), "period_start")


def pan_04(s, d):
    rows = PN.activity(M.history_rows(s, d))
    return as_text(rows.select("legajo", P.period_start(F.col("period")).alias("period_start")), "period_start")


def pan_05(s, d):
    return _dense(s, d).select("legajo", "academic_period", F.col("active").alias("activo_en_periodo"))


def pan_06(s, d):
    return _dense(s, d).select("legajo", "academic_period", "at_risk")


def pan_07(s, d):
    return _dense(s, d).select(
        "legajo", "academic_period", F.col("max_ahead").alias("max_act_futura"),
        F.col("n_ahead").alias("n_periodos_futuros_obs"),
    )


def pan_08(s, d):
    return _dense(s, d).select("legajo", "academic_period", PN.outcome(X.SPEC).alias("dropout_next"))


def pan_09(s, d):
    rows = PN.dominant_programme(M.history_rows(s, d))
    return as_text(
        rows.select("legajo", P.period_start(F.col("period")).alias("period_start"), "cod_carrera"), "period_start"
    )


def pan_10(s, d):
    return _dense(s, d).select("legajo", "academic_period", "cod_carrera")


def pan_11(s, d):
    return r6(PN.term_metrics(M.history_rows(s, d)), ["nota_media_en_periodo"])


def _panel_columns(*columns):
    def query(s, d):
        rows = _panel(s, d).select("legajo", "academic_period", *columns)
        return r6(rows, [c for c in columns if c in PANEL_DOUBLES])

    return query


def pan_16(s, d):
    return r6(_panel(s, d), PANEL_DOUBLES)


def sta_01(s, d):
    return as_text(ST.status_cutoff(M.history_rows(s, d)), "data_max_date", "cutoff_date")


def sta_02(s, d):
    return as_text(ST.last_course_date(M.history_rows(s, d)), "fecha_ultima_cursada")


def sta_03(s, d):
    return ST.completed_students(M.progress_rows(s, d))


def sta_04(s, d):
    rows = ST.student_status(M.students_rows(s, d), M.history_rows(s, d), M.progress_rows(s, d))
    return as_text(rows, "fecha_ultima_cursada")


def _sql_columns(*columns: str) -> str:
    picked = [f"round({c}, 6) AS {c}" if c in PANEL_DOUBLES else c for c in columns]
    return with_ctes(f"SELECT legajo, academic_period, {', '.join(picked)} FROM panel")


_ALL = ("cod_carrera", "materias_en_periodo", "promo_en_periodo", "nota_media_en_periodo", "materias_win3",
        "promo_win3", "nota_win3", "materias_cum", "promo_rate_period", "promo_rate_win3",
        "dias_desde_ult_actividad", "at_risk", "dropout_next")

QUERIES = {
    "panel_label_counts": (label_counts, with_ctes("""
        SELECT academic_period, count(*) AS n_rows, count(DISTINCT legajo) AS n_students,
          CAST(sum(dropout_next) AS BIGINT) AS n_positive, round(avg(dropout_next), 6) AS label_rate
        FROM panel WHERE at_risk = 1 AND dropout_next IS NOT NULL GROUP BY 1""")),
    "pan_01_date_bucket": (pan_01, with_ctes("""
        SELECT fecha, CAST(ps AS VARCHAR) AS period_start, count(*) AS n FROM dated GROUP BY 1, 2""")),
    "pan_02_period_algebra": (pan_02, with_ctes("""
        SELECT CAST(i AS BIGINT) AS pidx, y || h AS academic_period, (y - 2) || h AS four_earlier,
          CASE WHEN h = '_1C' THEN y || '_2C' ELSE (y + 1) || '_1C' END AS one_later,
          CAST(i AS BIGINT) AS pidx_back, n_students
        FROM (SELECT year(ps) AS y, CASE WHEN month(ps) = 3 THEN '_1C' ELSE '_2C' END AS h,
                year(ps) * 2 + CASE WHEN month(ps) = 3 THEN 0 ELSE 1 END AS i, count(*) AS n_students
              FROM active GROUP BY 1, 2, 3) z""")),
    "pan_03_calendar": (pan_03, with_ctes(
        "SELECT CAST(ps AS VARCHAR) AS period_start, academic_period FROM calendar")),
    "pan_04_activity": (pan_04, with_ctes("SELECT legajo, CAST(ps AS VARCHAR) AS period_start FROM active")),
    "pan_05_grid": (pan_05, with_ctes("SELECT legajo, academic_period, act AS activo_en_periodo FROM grid")),
    "pan_06_at_risk": (pan_06, with_ctes("SELECT legajo, academic_period, at_risk FROM state")),
    "pan_07_future_window": (pan_07, with_ctes("""
        SELECT legajo, academic_period, max_ahead AS max_act_futura, n_ahead AS n_periodos_futuros_obs FROM state""")),
    "pan_08_label": (pan_08, with_ctes("SELECT legajo, academic_period, dropout_next FROM labelled")),
    "pan_09_dominant": (pan_09, with_ctes(
        "SELECT legajo, CAST(ps AS VARCHAR) AS period_start, cod_carrera FROM dominant")),
    "pan_10_carry_forward": (pan_10, with_ctes("""
        SELECT g.legajo, g.academic_period, c.cod_carrera FROM grid g
        JOIN carried c ON c.legajo = g.legajo AND c.ps = g.ps""")),
    "pan_11_term_metrics": (pan_11, with_ctes("""
        SELECT legajo, academic_period, n AS materias_en_periodo, CAST(promoted AS BIGINT) AS promo_en_periodo,
          round(grade, 6) AS nota_media_en_periodo FROM terms""")),
    "pan_12_rolling": (_panel_columns("materias_win3", "promo_win3", "nota_win3"),
                       _sql_columns("materias_win3", "promo_win3", "nota_win3")),
    "pan_13_cumulative": (_panel_columns("materias_cum"), _sql_columns("materias_cum")),
    "pan_14_ratios": (_panel_columns("promo_rate_period", "promo_rate_win3"),
                      _sql_columns("promo_rate_period", "promo_rate_win3")),
    "pan_15_recency": (_panel_columns("dias_desde_ult_actividad"), _sql_columns("dias_desde_ult_actividad")),
    "pan_16_student_panel": (pan_16, _sql_columns(*_ALL)),
    "sta_01_cutoff": (sta_01, with_ctes("""
        SELECT CAST(max(d) AS VARCHAR) AS data_max_date,
          CAST(CAST(max(d) - INTERVAL 2 YEAR AS DATE) AS VARCHAR) AS cutoff_date FROM dated""")),
    "sta_02_last_date": (sta_02, with_ctes(
        "SELECT legajo, CAST(last_date AS VARCHAR) AS fecha_ultima_cursada FROM last_dates")),
    "sta_03_completed": (sta_03, with_ctes("SELECT legajo FROM completed")),
    "sta_04_student_status": (sta_04, with_ctes("""
        SELECT legajo, CAST(fecha_ultima_cursada AS VARCHAR) AS fecha_ultima_cursada, status, dropout_flag
        FROM status""")),
}
