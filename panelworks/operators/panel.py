"""The dense (student, half-year) panel with point-in-time labels and rolling features.

The raw history is shuffled once, already collapsed to one row per (student,
real half-year, declared term, programme). That table is partitioned by student
and everything after it — sparse facts, dense grid, all windows — stays inside
that partitioning. A student holds at most a calendar's worth of rows by then,
however many raw rows were behind them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import periods as P
from panelworks.functions.numeric import ratio
from panelworks.functions.text import iso_day, number
from panelworks.operators.status import completed_students


@dataclass(frozen=True)
class PanelSpec:
    """Calendar bounds and label definition."""

    first: str = K.CALENDAR_FIRST
    last: str = K.CALENDAR_LAST
    horizon: int = K.LABEL_HORIZON
    window: int = K.LABEL_HORIZON
    threshold: float = K.COMPLETION_THRESHOLD
    use_completion: bool = True

    @property
    def first_index(self) -> int:
        return P.index_of(self.first)

    @property
    def last_index(self) -> int:
        return P.index_of(self.last)


def dated(history: DataFrame) -> DataFrame:
    """History with the half-year of the real course date; rows without a date dropped."""
    period = P.period_of_day(iso_day(F.col("fecha")))
    return history.withColumn("period", period).where(F.col("period").isNotNull())


def last_period(history: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """One row: last half-year with activity, within the calendar."""
    newest = history.agg(F.max(P.period_of_day(iso_day(F.col("fecha")))).alias("_m"))
    return newest.select(F.least("_m", F.lit(spec.last_index)).alias("last_index"))


def calendar(history: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Half-years from the calendar start to the last active one."""
    last = last_period(history, spec)
    span = F.when(
        F.col("last_index") >= spec.first_index,
        F.sequence(F.lit(spec.first_index), F.col("last_index")),
    )
    index = last.select(F.explode(span).alias("period"))
    return index.select(
        "period",
        P.period_start(F.col("period")).alias("period_start"),
        P.period_label(F.col("period")).alias("academic_period"),
    )


def activity(history: DataFrame) -> DataFrame:
    """Distinct (student, half-year) with activity; no calendar floor."""
    return dated(history).select("legajo", "period").distinct()


def dominant_programme(history: DataFrame) -> DataFrame:
    """Programme with most rows per (student, half-year); ties go to the smallest code."""
    counted = dated(history).groupBy("legajo", "period", "cod_carrera").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("cod_carrera", F.struct(-F.col("n"), "cod_carrera"))
    return counted.groupBy("legajo", "period").agg(best.alias("cod_carrera"))


def _declared_term(history: DataFrame):
    return F.concat(
        F.coalesce(F.col("anio"), F.lit("")), F.lit("_"), F.coalesce(F.col("tipo_cursada"), F.lit(""))
    )


def _course_sums():
    grade = number(F.col("nota"))
    return (
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("resultado").ilike("Promoc%").cast("long")).alias("promoted"),
        F.sum(grade).alias("grade_sum"),
        F.count(grade).alias("grade_n"),
    )


def term_metrics(history: DataFrame) -> DataFrame:
    """Courses, promotions and mean grade per (student, declared term)."""
    summed = history.groupBy("legajo", _declared_term(history).alias("academic_period")).agg(*_course_sums())
    return summed.select(
        "legajo",
        "academic_period",
        F.col("n").alias("materias_en_periodo"),
        F.coalesce("promoted", F.lit(0)).alias("promo_en_periodo"),
        ratio(F.col("grade_sum"), F.col("grade_n")).alias("nota_media_en_periodo"),
    )


def course_cells(history: DataFrame) -> DataFrame:
    """History collapsed to (student, real half-year, declared half-year, programme).

    Partial sums run before the shuffle, so a student with very many rows
    arrives as a handful of cells. Declared terms outside the half-year calendar
    (summer, annual, trimesters) keep only their real half-year.
    """
    keyed = history.select(
        "legajo",
        P.period_of_day(iso_day(F.col("fecha"))).alias("real"),
        P.period_of_label(_declared_term(history)).alias("declared"),
        "cod_carrera", "resultado", "nota",
    )
    # rows with neither period end in a few cells and drop out with them; a filter
    # here would parse every date a second time
    return keyed.groupBy("legajo", "real", "declared", "cod_carrera").agg(*_course_sums())


def period_facts(history: DataFrame, progress: DataFrame, spec: PanelSpec = PanelSpec(), last: Column | None = None) -> DataFrame:
    """Sparse facts: one row per (student, half-year) with activity or courses.

    Activity before the calendar start becomes one anchor row at the start, so
    the trajectory begins there without counting as active. ``last`` is the last
    half-year where the caller has it already.
    """
    floor = spec.first_index
    last = last_period(history, spec).scalar() if last is None else last
    cells = course_cells(history).repartition("legajo")
    real, declared = F.col("real"), F.col("declared")
    inside = real >= floor
    as_activity = F.struct(
        F.when(real.isNotNull(), F.greatest(real, F.lit(floor))).alias("period"),
        F.lit(1).alias("starts"),
        F.when(inside, 1).otherwise(0).alias("active"),
        F.when(inside, F.col("cod_carrera")).alias("code"),
        F.when(inside, F.col("n")).alias("code_n"),
        F.lit(0).cast("long").alias("courses"),
        F.lit(0).cast("long").alias("promoted"),
        F.lit(0.0).alias("grade_sum"),
        F.lit(0).cast("long").alias("grade_n"),
    )
    as_courses = F.struct(
        declared.alias("period"),
        F.lit(0).alias("starts"),
        F.lit(0).alias("active"),
        F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("long").alias("code_n"),
        F.col("n").alias("courses"),
        F.coalesce(F.col("promoted"), F.lit(0)).cast("long").alias("promoted"),
        F.coalesce(F.col("grade_sum"), F.lit(0.0)).alias("grade_sum"),
        F.col("grade_n").alias("grade_n"),
    )
    events = cells.select("legajo", F.inline(F.array(as_activity, as_courses)))
    events = events.where((F.col("period") >= floor) & (F.col("period") <= last))
    by_code = events.groupBy("legajo", "period", "code").agg(
        F.max("starts").alias("starts"), F.max("active").alias("active"),
        F.sum("code_n").alias("code_n"), F.sum("courses").alias("courses"),
        F.sum("promoted").alias("promoted"), F.sum("grade_sum").alias("grade_sum"),
        F.sum("grade_n").alias("grade_n"),
    )
    ranked = F.when(F.col("code").isNotNull(), F.struct(-F.col("code_n"), "code"))
    facts = by_code.groupBy("legajo", "period").agg(
        F.max("starts").alias("starts"), F.max("active").alias("active"),
        F.min_by("code", ranked).alias("programme"), F.sum("courses").alias("courses"),
        F.sum("promoted").alias("promoted"), F.sum("grade_sum").alias("grade_sum"),
        F.sum("grade_n").alias("grade_n"),
    )
    done = completed_students(progress, spec.threshold).withColumn("completed", F.lit(1))
    return facts.join(done, "legajo", "left")


def dense_panel(history: DataFrame, progress: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Every half-year from a student's first activity to the last one in the data.

    Gaps are filled from the sparse facts: each fact row is repeated up to the
    period before the next one, so no range join and no join with the grid.
    """
    # one scalar for both uses, from the date column alone
    last = last_period(history, spec).scalar()
    facts = period_facts(history, progress, spec, last)
    order = Window.partitionBy("legajo").orderBy("period")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sparse = facts.select(
        "*",
        F.lead("period").over(order).alias("_next"),
        F.max("starts").over(so_far).alias("_started"),
        F.last("programme", ignorenulls=True).over(so_far).alias("cod_carrera"),
        F.max(F.when(F.col("active") == 1, F.col("period"))).over(so_far).alias("last_active"),
    ).where(F.col("_started") == 1)
    spread = sparse.select(
        "*",
        F.explode(F.sequence(F.col("period"), F.coalesce(F.col("_next") - 1, last))).alias("at"),
    )
    here = F.col("at") == F.col("period")
    grid = spread.select(
        "legajo",
        F.col("at").alias("period"),
        "cod_carrera",
        "completed",
        "last_active",
        F.when(here, F.col("programme")).alias("programme"),
        F.when(here, F.col("active")).otherwise(0).alias("active"),
        F.when(here, F.col("courses")).otherwise(F.lit(0).cast("long")).alias("courses"),
        F.when(here, F.col("promoted")).otherwise(F.lit(0).cast("long")).alias("promoted"),
        F.when(here, ratio(F.col("grade_sum"), F.col("grade_n"))).alias("grade"),
    )
    past = order.rowsBetween(-(spec.window - 1), Window.currentRow)
    ahead = order.rowsBetween(1, spec.horizon)
    return grid.select(
        "*",
        F.max("active").over(past).alias("at_risk"),
        F.max("active").over(ahead).alias("max_ahead"),
        F.count(F.lit(1)).over(ahead).alias("n_ahead"),
        F.sum("courses").over(past).alias("courses_win"),
        F.sum("promoted").over(past).alias("promoted_win"),
        F.avg("grade").over(past).alias("grade_win"),
        F.sum("courses").over(so_far).alias("courses_cum"),
    )


def outcome(spec: PanelSpec = PanelSpec()):
    """Label of a dense row: censored first, then return, then completion."""
    label = F.when(F.col("n_ahead") < spec.horizon, F.lit(None).cast("int")).when(
        F.coalesce(F.col("max_ahead"), F.lit(0)) == 1, 0
    )
    if spec.use_completion:
        label = label.when(F.col("completed") == 1, 0)
    return label.otherwise(1)


def student_panel(history: DataFrame, progress: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The 15-column panel."""
    dense = dense_panel(history, progress, spec)
    start, seen = P.period_start(F.col("period")), P.period_start(F.col("last_active"))
    return dense.select(
        "legajo",
        "cod_carrera",
        P.period_label(F.col("period")).alias("academic_period"),
        F.col("courses").alias("materias_en_periodo"),
        F.col("promoted").alias("promo_en_periodo"),
        F.col("grade").alias("nota_media_en_periodo"),
        F.col("courses_win").alias("materias_win3"),
        F.col("promoted_win").alias("promo_win3"),
        F.col("grade_win").alias("nota_win3"),
        F.col("courses_cum").alias("materias_cum"),
        ratio(F.col("promoted"), F.col("courses")).alias("promo_rate_period"),
        ratio(F.col("promoted_win"), F.col("courses_win")).alias("promo_rate_win3"),
        F.datediff(start, seen).alias("dias_desde_ult_actividad"),
        "at_risk",
        outcome(spec).alias("dropout_next"),
    )
