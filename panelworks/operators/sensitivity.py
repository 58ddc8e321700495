"""Sensitivity of the label definition: horizon, completion proxy, threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import periods as P
from panelworks.functions.numeric import ratio
from panelworks.functions.text import loose_number


def internal_gaps(active: DataFrame) -> DataFrame:
    """Half-years without activity between two active ones of a student."""
    order = Window.partitionBy("legajo").orderBy("period")
    gap = F.col("period") - F.lag("period").over(order) - 1
    return active.select("legajo", "period", gap.alias("gap")).where(F.col("gap") >= 1)


def trailing_gaps(active: DataFrame) -> DataFrame:
    """Half-years between a student's last activity and the end of the data."""
    end = active.agg(F.max("period").alias("m")).scalar()
    return active.groupBy("legajo").agg(F.max("period").alias("last")).select(
        "legajo", (end - F.col("last")).alias("trailing"))


def horizon_table(active: DataFrame, completed: DataFrame, horizons: Sequence[int] = K.HORIZONS) -> DataFrame:
    """Dropouts, exclusions, gaps and reactivation rate per candidate horizon."""
    done = completed.select("legajo", F.lit(1).alias("_done"))
    ends = trailing_gaps(active).join(done, "legajo", "left")

    def spread(df: DataFrame, **counts) -> DataFrame:
        names = list(counts)
        one = df.agg(*[F.count_if(test(h)).alias(f"{n}_{h}") for n, test in counts.items() for h in horizons])
        rows = F.array(*[F.struct(F.lit(h).alias("h"), *[F.col(f"{n}_{h}").alias(n) for n in names]) for h in horizons])
        return one.select(F.inline(rows))

    zero = F.lit(0).cast("long")
    inner = spread(internal_gaps(active), inside=lambda h: F.col("gap") >= h).select(
        "h", "inside", zero.alias("ended"), zero.alias("dropped"))
    outer = spread(
        ends, ended=lambda h: F.col("trailing") >= h,
        dropped=lambda h: (F.col("trailing") >= h) & F.col("_done").isNull(),
    ).select("h", zero.alias("inside"), "ended", "dropped")
    total = inner.unionByName(outer).groupBy("h").agg(*[F.sum(c).alias(c) for c in ("inside", "ended", "dropped")])
    return total.select(
        F.col("h").cast("long").alias("horizonte_periodos"), (F.col("h") / 2).alias("anios"),
        F.col("dropped").alias("abandono_legajos"), (F.col("ended") - F.col("dropped")).alias("finalizacion_excluida"),
        F.col("inside").alias("inactividades_internas_geH"), F.col("ended").alias("inactividades_finales_geH"),
        F.round(ratio(F.col("inside"), F.col("inside") + F.col("ended")), 4).alias("tasa_reactivacion"),
    )


def relabelled(panel: DataFrame, active: DataFrame, completed: DataFrame, horizon: int = K.LABEL_HORIZON) -> DataFrame:
    """Both label variants recomputed from the activity set alone.

    A student's active periods, at most one per half-year of the data, come along
    as one array; no window is shared with the panel, so the two can check each other.
    """
    end = active.agg(F.max("period").alias("m")).scalar()
    rows = panel.withColumn("period", P.period_of_label(F.col("academic_period")))
    seen = active.groupBy("legajo").agg(F.collect_set("period").alias("_seen"))
    done = completed.select("legajo", F.lit(1).alias("_done"))
    joined = rows.join(seen, "legajo", "left").join(done, "legajo", "left")
    back = F.exists("_seen", lambda x: (x > F.col("period")) & (x <= F.col("period") + horizon))
    joined = joined.withColumn("_back", back.cast("int"))
    open_end = end - F.col("period") < horizon
    label = F.when(open_end, F.lit(None).cast("int")).when(F.col("_back") == 1, 0)
    return joined.select(
        *panel.columns, label.when(F.col("_done") == 1, 0).otherwise(1).alias("lab_con_grad"),
        label.otherwise(1).alias("lab_sin_grad"))


def label_agreement(rows: DataFrame) -> DataFrame:
    """Share of modelling rows whose recomputed label equals the stored one."""
    both = rows.where((F.col("at_risk") == 1) & F.col("dropout_next").isNotNull() & F.col("lab_con_grad").isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("dropout_next") == F.col("lab_con_grad")).cast("double")).alias("match_rate"))


def reclassified(rows: DataFrame) -> DataFrame:
    """Rows and students whose label turns from 0 to 1 without the completion rule."""
    known = rows.where((F.col("at_risk") == 1) & F.col("lab_con_grad").isNotNull())
    turned = (F.col("lab_con_grad") == 0) & (F.col("lab_sin_grad") == 1)
    per_student = known.groupBy("legajo").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(turned).alias("turned"))
    return per_student.agg(
        F.sum("n").alias("n_rows"), F.sum("turned").alias("n_reclassified"),
        F.count_if(F.col("turned") > 0).alias("n_students"))


def threshold_sweep(progress: DataFrame, thresholds: Sequence[int] = K.COMPLETION_THRESHOLDS) -> DataFrame:
    """Students at or above each completion threshold."""
    best = progress.groupBy("legajo").agg(F.max(loose_number(F.col("porcentaje_avance"))).alias("v"))
    one = best.agg(*[F.count_if(F.col("v") >= t).alias(f"t{t}") for t in thresholds])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(t).cast("long").alias("umbral"), F.col(f"t{t}").alias("n_legajos")) for t in thresholds])))
