"""Comparison of two versions of a table: missing values, distinct values, distance.

All columns are melted and counted per value in one shuffle whose keys have a fixed
width: the 128-bit digest of a text and its number. Both tables are read once; the
counts are stored, and the kinds and all figures of the comparison derive from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.numeric import ratio
from panelworks.functions.text import number
from panelworks.operators.ordered import exact_quantiles, running_totals
from panelworks.session import materialise

MISSING = "<<NA>>"


def _names(a: DataFrame, b: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return sorted(columns or set(a.columns) | set(b.columns))


def _melted(a: DataFrame, b: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per cell of either side: column number ``_c``, ``side``, its text ``valor`` and as a number ``v``.

    Empty text and a not-a-number are missing. What follows works on this one text
    column, so the code that is generated for it does not grow with the table's width.
    """
    def cells(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"`{c}`").cast("string").alias("t"))
                          for i, c in enumerate(names) if c in df.columns])
        return df.select(F.inline(pairs), F.lit(side).alias("side"))

    both = cells(a, "a").unionByName(cells(b, "b")).withColumn("x", number(F.col("t")))  # read as a number once
    missing = (F.col("t") == "") | F.isnan(F.coalesce("x", F.lit(0.0)))
    return both.select("_c", "side", F.when(~missing, F.col("t")).alias("valor"), F.when(~missing, F.col("x")).alias("v"))


def _named(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col("_c") + 1).alias("columna")


def date_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that side A (side B when A lacks them) types as a date or time."""
    types = dict(b.dtypes) | dict(a.dtypes)
    return sorted(c for c, kind in types.items() if kind in ("date", "timestamp", "timestamp_ntz"))


def value_cells(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(columna, v, h1, h2, n_a, n_b), stored: cells counted by the digest of their text and its number.

    The only pass over both tables. A missing cell has neither digest nor number. A column
    without any cell has no row here.
    """
    names = _names(a, b, columns)
    present = F.col("valor").isNotNull()
    keys = ["v", "h1", "h2"]
    cells = _melted(a, b, names).select(
        "_c", "side", "v", F.when(present, F.xxhash64("valor")).alias("h1"),
        F.when(present, F.xxhash64(F.lit("other seed"), "valor")).alias("h2"))
    counts = cells.groupBy("_c", *keys).agg(*[F.count_if(F.col("side") == x).alias(f"n_{x}") for x in "ab"])
    return materialise(counts.select(_named(names), *keys, "n_a", "n_b"), "comparison-cells")


def column_kinds(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(columna, rows_a, rows_b, null_a, null_b, tipo) over the union of columns, stored: one row per column.

    A column one side lacks has no rows on that side. A column is numeric when every
    present value of side A (of side B when A lacks the column, or has no rows) is a
    number, and a date when its type says so. ``cells`` are stored ``value_cells``.
    """
    cells = value_cells(a, b, columns) if cells is None else cells
    present, zero = F.col("h1").isNotNull(), F.lit(0)
    sums = []
    for x in "ab":
        n = F.col(f"n_{x}")
        sums += [F.sum(n).alias(f"rows_{x}"), F.sum(F.when(present, zero).otherwise(n)).alias(f"null_{x}"),
                 F.sum(F.when(present & F.col("v").isNull(), n).otherwise(zero)).alias(f"_odd_{x}")]
    out = cells.groupBy("columna").agg(*sums).select("columna", *[f"{c}_{x}" for c in ("rows", "null", "_odd") for x in "ab"])
    odd = F.when(F.col("rows_a") > 0, F.col("_odd_a")).otherwise(F.col("_odd_b"))
    kind = F.when(F.col("columna").isin(date_columns(a, b)), "datetime").when(odd == 0, "numeric").otherwise("categorical")
    return materialise(out.withColumn("tipo", kind).drop("_odd_a", "_odd_b"), "comparison-kinds")


def cell_counts(a: DataFrame, b: DataFrame, kinds: DataFrame, columns: Sequence[str] | None = None, cells: DataFrame | None = None
                ) -> DataFrame:
    """(columna, v, h1, h2, n_a, n_b), stored: numeric columns by value, others by the digest of their text.

    A missing cell has neither. ``cells`` are stored ``value_cells``; texts of one number are added up.
    """
    cells = value_cells(a, b, columns) if cells is None else cells
    numeric = [r[0] for r in kinds.where("tipo = 'numeric'").select("columna").collect()]  # one row per column
    is_number, keys = F.col("columna").isin(numeric), ["columna", "v", "h1", "h2"]
    texts = cells.where(~is_number).withColumn("v", F.lit(None).cast("double"))
    numbers = cells.where(is_number).groupBy("columna", "v").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    none = F.lit(None).cast("long")
    return materialise(texts.unionByName(numbers.withColumns({"h1": none, "h2": none})).select(*keys, "n_a", "n_b"), "comparison-counts")


def text_counts(a: DataFrame, b: DataFrame, kinds: DataFrame) -> DataFrame:
    """(columna, valor, n_a, n_b) of the columns that are no numbers, with the texts themselves, stored."""
    names = sorted(r[0] for r in kinds.where("tipo <> 'numeric'").select("columna").collect())
    if not names:
        return a.sparkSession.createDataFrame([], "columna string, valor string, n_a long, n_b long")
    counts = _melted(a, b, names).groupBy("_c", "valor").agg(*[F.count_if(F.col("side") == x).alias(f"n_{x}") for x in "ab"])
    return materialise(counts.select(_named(names), "valor", "n_a", "n_b"), "comparison-texts")


def _of_kind(counts: DataFrame, kinds: DataFrame, numeric: bool) -> DataFrame:
    # one row per column name: bounded by the schema
    return counts.join(F.broadcast(kinds.where((F.col("tipo") == "numeric") == numeric)), "columna")


def numeric_distance(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Two-sample KS distance per numeric column; NULL when a side has no values."""
    numbers = _of_kind(counts, kinds, True).where(F.col("v").isNotNull()).select("columna", "v", "n_a", "n_b")
    ranked = running_totals(numbers, ["columna"], "v", ["n_a", "n_b"])
    cdf_a = ratio(F.col("before_n_a") + F.col("n_a"), F.col("all_n_a"))
    cdf_b = ratio(F.col("before_n_b") + F.col("n_b"), F.col("all_n_b"))
    return ranked.groupBy("columna").agg(
        F.max(F.abs(cdf_a - cdf_b)).alias("distancia"),
        F.count_if(F.col("n_a") > 0).alias("unique_a"), F.count_if(F.col("n_b") > 0).alias("unique_b"))


def categorical_distance(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Total variation distance per column that is no number, missing values being a category."""
    at, present = _of_kind(counts, kinds, False), F.col("h1").isNotNull()
    gap = F.abs(F.coalesce(ratio(F.col("n_a"), F.col("rows_a")), F.lit(0.0))
                - F.coalesce(ratio(F.col("n_b"), F.col("rows_b")), F.lit(0.0)))
    return at.groupBy("columna").agg(
        (F.sum(gap) * 0.5).alias("distancia"), F.count_if(present & (F.col("n_a") > 0)).alias("unique_a"),
        F.count_if(present & (F.col("n_b") > 0)).alias("unique_b"))


def comparison_table(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, largest distance first, unknown distance last."""
    cells = value_cells(a, b, columns)
    kinds = column_kinds(a, b, columns, cells)
    return compared(cell_counts(a, b, kinds, columns, cells), kinds)


def compared(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The comparison table from stored counts."""
    parts = numeric_distance(counts, kinds).unionByName(categorical_distance(counts, kinds))
    joined = kinds.join(parts, "columna", "left")

    def missing(side: str):
        return F.when(F.col(f"rows_{side}") == 0, F.lit(100.0)).otherwise(
            ratio(F.col(f"null_{side}"), F.col(f"rows_{side}")) * 100)

    return joined.select(
        "columna", "tipo", missing("a").alias("missing_a"), missing("b").alias("missing_b"),
        F.coalesce("unique_a", F.lit(0)).alias("unique_a"), F.coalesce("unique_b", F.lit(0)).alias("unique_b"),
        "distancia",
    ).orderBy(F.desc_nulls_last("distancia"), "columna")


def top_categories(values: DataFrame, kinds: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent categories of either side: share of each side and difference in points."""
    at = _of_kind(values, kinds, False).select(
        "columna", F.coalesce("valor", F.lit(MISSING)).alias("valor"), "n_a", "n_b", "rows_a", "rows_b")

    def best(side: str) -> DataFrame:
        order = Window.partitionBy("columna").orderBy(F.desc(f"n_{side}"), "valor")
        # the rank filter is applied before the shuffle as well, so a column sends few rows
        ranked = at.where(F.col(f"n_{side}") > 0).withColumn("_r", F.row_number().over(order))
        return ranked.where(F.col("_r") <= top).select(
            "columna", "valor",
            *[(ratio(F.col(f"n_{side}"), F.col(f"rows_{side}")) * 100 if s == side
               else F.lit(None).cast("double")).alias(f"pct_{s}") for s in ("a", "b")])

    merged = best("a").unionByName(best("b")).groupBy("columna", "valor").agg(
        F.coalesce(F.max("pct_a"), F.lit(0.0)).alias("pct_a"), F.coalesce(F.max("pct_b"), F.lit(0.0)).alias("pct_b"))
    gap = merged.withColumn("diferencia_pp", F.col("pct_b") - F.col("pct_a"))
    order = Window.partitionBy("columna").orderBy(F.desc(F.round(F.abs("diferencia_pp"), 9)), "valor")
    return gap.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing share, mean, sample deviation, minimum, quartiles and maximum per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("columna"), number(F.col(c).cast("string")).alias("v")) for c in columns])
    long = df.select(F.inline(pairs))
    base = long.groupBy("columna").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col("v").isNull().cast("double")) * 100).alias("missing_pct"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = exact_quantiles(long, ["columna"], "v", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return base.join(quartiles, "columna", "left")
