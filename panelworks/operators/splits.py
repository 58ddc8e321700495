"""Point-in-time splits of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import periods as P
from panelworks.operators.ordered import null_safe_join

PERIOD = "academic_period"


def modelling_rows(panel: DataFrame, unique: bool = False) -> DataFrame:
    """At-risk rows with an observed label, exact duplicates removed, features numeric.

    ``unique`` states that (student, half-year) is a key, as the panel operator
    guarantees; the rows are then not shuffled to look for duplicates.
    """
    rows = panel.where((F.col("at_risk") == 1) & F.col("dropout_next").isNotNull())
    rows = rows if unique else rows.distinct()
    numbers = [
        F.col(c).try_cast("double").alias(c) if c in K.NUMERIC_FEATURES else F.col(c)
        for c in rows.columns
    ]
    return rows.select(*numbers).withColumn("dropout_next", F.col("dropout_next").cast("int"))


def embargo_bounds(rows: DataFrame, horizon: int = K.LABEL_HORIZON) -> DataFrame:
    """One row: newest labelled period and the last period training may use."""
    labelled = rows.where(F.col("dropout_next").isNotNull())
    newest = labelled.agg(F.max(PERIOD).alias("val_period"))
    return newest.withColumn("train_cutoff", P.shift_period(F.col("val_period"), horizon))


def embargo_split(rows: DataFrame, horizon: int = K.LABEL_HORIZON) -> DataFrame:
    """Adds ``split``: train up to the cutoff, val at the newest period; the gap is left out."""
    bounds = embargo_bounds(rows, horizon)
    cutoff, newest = bounds.select("train_cutoff").scalar(), bounds.select("val_period").scalar()
    split = F.when(F.col(PERIOD) <= cutoff, "train").when(F.col(PERIOD) == newest, "val")
    return rows.withColumn("split", split).where(F.col("split").isNotNull())


def stratified_sample(
    rows: DataFrame, fraction: float, label: str = "dropout_next",
    key: Sequence[str] = ("legajo", PERIOD), seed: int = K.SEED,
) -> DataFrame:
    """Exactly ``floor(fraction * n + 0.5)`` rows per label, picked by hash order.

    Rows are counted per hash prefix first; only the one prefix per label that
    holds the cut is ordered row by row, so no label is sorted in one task.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    hashed = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 4))
    cells = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(label).orderBy("_b")  # at most 65,536 prefixes
    cells = cells.select(
        label, "_b",
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.col("_n"),
        F.floor(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                * F.lit(fraction) + 0.5).alias("_take"),
    ).where(F.col("_before") < F.col("_take"))
    joined = null_safe_join(hashed, cells, [label, "_b"])
    whole = F.col("_before") + F.col("_n") <= F.col("_take")
    inside = Window.partitionBy(label, "_b").orderBy("_h", *key)
    cut = joined.where(~whole).withColumn("_r", F.row_number().over(inside)).where(
        F.col("_before") + F.col("_r") <= F.col("_take"))
    return joined.where(whole).select(*rows.columns).unionByName(cut.select(*rows.columns))


def origins(tests: Sequence[str], horizon: int = K.LABEL_HORIZON) -> list[tuple[str, str]]:
    """(training cutoff, test period) pairs of a rolling-origin backtest."""
    return [(P.shift_label(t, horizon), t) for t in tests]


def tagged_splits(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of every (cutoff, test) pair at once, with ``origin``, ``test_period`` and ``split``.

    The pairs are few and known when the plan is built; a row is repeated only
    for the pairs it belongs to.
    """
    period = F.col(PERIOD)
    tags = F.array(*[
        F.when(period <= cutoff, F.struct(F.lit(cutoff).alias("origin"), F.lit(test).alias("test_period"),
                                          F.lit("train").alias("split")))
        .when(period == test, F.struct(F.lit(cutoff).alias("origin"), F.lit(test).alias("test_period"),
                                       F.lit("test").alias("split")))
        for cutoff, test in pairs
    ])
    return rows.select("*", F.inline(F.filter(tags, lambda t: t.isNotNull())))


def mark_seen(test: DataFrame, train: DataFrame, key: str = "legajo") -> DataFrame:
    """Adds ``seen``: whether the student of a test row occurs in training."""
    known = train.select(key).distinct().withColumn("_known", F.lit(True))
    return test.join(known, key, "left").withColumn("seen", F.coalesce("_known", F.lit(False))).drop("_known")


def without_students_of(train: DataFrame, test: DataFrame, key: str = "legajo") -> DataFrame:
    """Training rows of students that do not occur in the test rows."""
    return train.join(test.select(key).distinct(), key, "left_anti")


def distinct_periods(df: DataFrame, column: str = PERIOD) -> DataFrame:
    """Sorted list of the periods present."""
    return df.select(column).distinct().orderBy(column)
