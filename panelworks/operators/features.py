"""Model inputs: exact imputation and scaling parameters fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.numeric import ratio
from panelworks.operators.ordered import melt, null_safe_join, quantiles_of_counts, value_counts


def numeric_parameters(train: DataFrame, features: Sequence[str] = K.NUMERIC_FEATURES, weight: str | None = None) -> DataFrame:
    """Per feature: median, and mean and population deviation after median imputation.

    A feature without deviation keeps a scale of one. ``weight`` is the column that
    tells how many rows a row stands for. Sums run over the distinct values.
    """
    weighted = train.withColumn("_w", F.col(weight) if weight else F.lit(1))
    long = melt(weighted, ["_w"], features)
    counts = long.groupBy("feature", "value").agg(F.sum("_w").alias("_n"))
    known = value_counts(counts, ["feature"], "value", _n=F.col("_n"))
    middle = quantiles_of_counts(known, ["feature"], "value", "_n", {"median": 0.5})
    # deviations from the median, which missing values take, so these add nothing
    off = F.coalesce(F.col("value") - F.coalesce("median", F.lit(0.0)), F.lit(0.0))
    joined = null_safe_join(counts, middle, ["feature"], "left").groupBy("feature").agg(
        F.sum("_n").alias("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("_n")).otherwise(0)).alias("_k"),
        F.max("median").alias("median"), F.sum(F.col("_n") * off).alias("_s"), F.sum(F.col("_n") * off * off).alias("_q"))
    n, centre = F.col("n"), F.coalesce("median", F.lit(0.0))
    shift = ratio(F.col("_s"), n)
    mean = centre + shift
    scale = F.sqrt(F.greatest(ratio(F.col("_q"), n) - shift * shift, F.lit(0.0)))
    return joined.select(
        "feature", "n", F.col("_k").alias("n_known"), "median", mean.alias("mean"),
        F.when(scale == 0, 1.0).otherwise(scale).alias("scale"))


def most_frequent(train: DataFrame, column: str = K.CATEGORY_FEATURE, weight: str | None = None) -> DataFrame:
    """Most frequent value, the smallest of equals."""
    counted = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(weight or F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(1)


@dataclass(frozen=True)
class Preparation:
    """Fitted parameters: one (median, mean, scale) per feature and the usual category."""

    numeric: dict[str, tuple[float, float, float]]
    category: str | None
    usual: str | None

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], category: str | None = K.CATEGORY_FEATURE,
            weight: str | None = None) -> Preparation:
        # one row per feature and one category come to the driver
        rows = {r["feature"]: r for r in numeric_parameters(train, features, weight).collect()}
        numeric = {f: (rows[f]["median"] or 0.0, rows[f]["mean"], rows[f]["scale"]) for f in features}
        usual = most_frequent(train, category, weight).head() if category else None
        return cls(numeric, category, usual[0] if usual else None)

    def expressions(self) -> list[str]:
        """SQL of the prepared columns ``x_<feature>`` and ``x_category``."""
        out = [f"(coalesce(cast(`{f}` as double), {m!r}D) - {mu!r}D) / {sd!r}D AS `x_{f}`"
               for f, (m, mu, sd) in self.numeric.items()]
        if self.category:
            usual = (self.usual or "").replace("'", "''")
            out.append(f"coalesce(`{self.category}`, '{usual}') AS x_category")
        return out

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.selectExpr("*", *self.expressions())
