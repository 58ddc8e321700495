"""Ordered work on large groups: running totals and exact quantiles.

A plain ``Window.orderBy`` over a group sends the whole group to one task. Here
a group is first collapsed to its distinct values, the values are split into
order-preserving cells of bounded size, and running totals are taken inside a cell
and between cells separately. One group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.numeric import value_bucket
from panelworks.session import materialise

CELL_ROWS = 4096


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; keeps the left key columns."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, by: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """One row per (group, distinct value) with summed weights; NULL and NaN values dropped."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def with_cells(counts: DataFrame, group: Column, value: str) -> DataFrame:
    """Add ``_cell``: the group and a path of cuts, in the order of the values.

    The first cut is a value bucket. A cell of more than ``CELL_ROWS`` rows is cut
    evenly between its own least and greatest value, and its parts again as long as
    one of them is too large, so one outlier costs one round. Every round divides
    the range of a cell by 256 at least, and a double has 52 bits within a bucket,
    so rounds are few whatever the values. Only rows of equal value share a cell
    beyond that. Each round is one aggregate on a stored table.
    """
    number = F.col(value).cast("double")
    first = F.array(value_bucket(number).cast("long"))
    split = counts.withColumn("_cell", F.struct(group.alias("g"), first.alias("path")))
    while True:
        heavy = split.groupBy(F.col("_cell").alias("_at")).agg(
            F.min(number).alias("_low"), F.max(number).alias("_high"), F.count("*").alias("_rows")
        ).where((F.col("_rows") > CELL_ROWS) & (F.col("_low") < F.col("_high")))
        heavy = materialise(heavy, "ordered-heavy")
        if heavy.isEmpty():
            return split
        joined = split.join(heavy, F.col("_cell") == F.col("_at"), "left")
        parts = F.greatest(2 * F.ceil(F.col("_rows") / CELL_ROWS), F.lit(256))
        part = F.least(F.floor((number - F.col("_low")) / (F.col("_high") - F.col("_low")) * parts), parts - 1).cast("long")
        path = F.when(part.isNull(), F.col("_cell.path")).otherwise(F.concat("_cell.path", F.array(part)))
        split = materialise(joined.select(
            *counts.columns, F.struct(F.col("_cell.g").alias("g"), path.alias("path")).alias("_cell")), "ordered-cells")


def running_totals(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Sequence[str],
    within: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``before_<s>`` (sum over smaller values) and ``all_<s>`` (group sum).

    ``counts`` holds one row per (group, value, *within*). ``within`` are extra
    sort keys that break ties of ``value``. The counts are stored once; a table
    of up to ``CELL_ROWS`` rows needs no cells.
    """
    by = list(by)
    # one struct key: NULL groups match, and the window, the bucket sums and the join
    # below all agree on one partitioning
    group = F.struct(*by) if by else F.lit(0)
    if bucket is None:
        counts = materialise(counts, "ordered-counts")
        if counts.count() <= CELL_ROWS:  # from the files' footers
            whole = Window.partitionBy(group)
            order = whole.orderBy(value, *within).rowsBetween(Window.unboundedPreceding, -1)
            return counts.select(
                "*", *[F.coalesce(F.sum(s).over(order), F.lit(0)).alias(f"before_{s}") for s in sums],
                *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums])
        split = with_cells(counts, group, value)
    else:
        split = counts.withColumn("_cell", F.struct(group.alias("g"), F.array(bucket.cast("long")).alias("path")))
    inside = (
        Window.partitionBy("_cell").orderBy(value, *within).rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = split.select(
        "*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums]
    )
    per_bucket = split.groupBy("_cell").agg(*[F.sum(s).alias(s) for s in sums])
    # at most one row per non-empty bucket: small whatever the group size
    order = Window.partitionBy("_cell.g").orderBy("_cell.path")
    between = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_bucket.select(
        F.col("_cell").alias("_at"),
        *[F.coalesce(F.sum(s).over(between), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums],
    )
    joined = inner.join(offsets, F.col("_cell") == F.col("_at"))
    return joined.select(
        *counts.columns,
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"before_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums],
    )


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], value: str, weight: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group from (group, value, weight) counts."""
    ranked = running_totals(counts.where(F.col(weight) > 0), by, value, [weight])
    before, own, total = F.col(f"before_{weight}"), F.col(weight), F.col(f"all_{weight}")

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < before + own), F.col(value).cast("double")))

    picks, outs = [], []
    for name, q in probabilities.items():
        place = (total - 1) * F.lit(float(q))
        low = F.floor(place)
        high = F.least(low + 1, total - 1)
        picks += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"),
                  F.max(place - low).alias(f"_f_{name}")]
        lo, hi, part = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        outs.append((lo + (hi - lo) * part).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *outs)


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, NULLs ignored."""
    counts = value_counts(df, by, value, _n=F.lit(1))
    return quantiles_of_counts(counts, by, value, "_n", probabilities)


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str], as_type: str = "double",
         names: tuple[str, str] = ("feature", "value")) -> DataFrame:
    """Columns to (name, value) rows, so N columns cost one job."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias(names[0]), F.col(c).cast(as_type).alias(names[1])) for c in columns
    ])
    return df.select(*keep, F.inline(pairs))
