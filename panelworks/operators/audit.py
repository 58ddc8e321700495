"""Second opinions on stored scores and models, by other means than the metrics they check.

Areas and squared errors come from Spark ML's own evaluators, the share of hits
among the top tenth from a plain ordered prefix, importances from the stored
nodes of the trees, and a linear model is certified by the gradient of its loss.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions.numeric import ratio
from panelworks.operators.modeling import LABEL, TrainSpec
from panelworks.session import materialise, scratch_path


def area(scored: DataFrame, y: str = "y", p: str = "p", weight: str | None = None) -> float:
    """ROC area by Spark ML, every distinct score a threshold; ``weight`` tells how many rows a row stands for."""
    rows = scored.select(F.col(y).cast("double").alias("label"), F.col(p).cast("double").alias("p"),
                         (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", weightCol="w", numBins=0).evaluate(rows)


def squared_error(scored: DataFrame, y: str = "y", p: str = "p") -> float:
    rows = scored.select(F.col(y).cast("double").alias("label"), F.col(p).cast("double").alias("p"))
    return RegressionEvaluator(predictionCol="p", labelCol="label", metricName="mse").evaluate(rows)


def top_hits(scored: DataFrame, share: int = 10, key: str = "id", y: str = "y", p: str = "p") -> float | None:
    """Share of positives among the top ``share`` percent, equal scores by the md5 of the key.

    A limit after a sort takes all rows to one task. Here the sorted rows lie in ranges:
    those above the cut are summed whole, and only the range of the cut is ordered.
    """
    order = [F.desc("_p"), F.asc("_h"), F.asc("_id")]
    rows = scored.select(F.col(y).cast("double").alias("_y"), F.col(p).alias("_p"),
                         F.md5(F.col(key).cast("string")).alias("_h"), F.col(key).alias("_id"))
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("hits")).orderBy("_range").collect()
    k = left = sum(r["n"] for r in ranges) * share // 100
    hits = 0.0
    for r in ranges:  # one row per range
        if r["n"] <= left:
            hits, left = hits + r["hits"], left - r["n"]
            continue
        cut = dealt.where(F.col("_range") == r["_range"]).orderBy(*order).limit(left)
        hits += cut.agg(F.coalesce(F.sum("_y"), F.lit(0.0))).first()[0]
        break
    return hits / k if k else None


def close(a: float | None, b: float | None, digits: int = 6) -> bool:
    """Equal once ``a`` or ``b`` was rounded to ``digits`` places."""
    if a is None or b is None:
        return a is b
    return abs(a - b) <= 0.5 * 10.0**-digits + 1e-9


def stored_importances(model: PipelineModel, spec: TrainSpec = TrainSpec()) -> DataFrame:
    """(feature, importance) of a boosted model from the nodes it stores: the share of all gain, weighted by rows.

    The one-hot columns of the category add up to one feature.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    data = F.col("nodeData") if "nodeData" in nodes.columns else F.struct("*")
    splits = nodes.select("treeID", data.alias("d")).where("d.leftChild >= 0").select(
        F.col("d.split.featureIndex").alias("at"), (F.col("d.gain") * F.col("d.impurityStats")[0]).alias("gain"))
    named = F.coalesce(F.get(F.array(*map(F.lit, spec.numeric)), F.col("at")), F.lit(spec.category))
    sums = splits.groupBy(named.alias("feature")).agg(F.sum("gain").alias("gain"))
    return sums.select("feature", ratio(F.col("gain"), splits.agg(F.sum("gain")).scalar()).alias("importance"))


def logistic_gradient(model: PipelineModel, train: DataFrame, label: str = LABEL, spec: TrainSpec = TrainSpec()) -> DataFrame:
    """(input, gradient) of the regularised mean log loss at a fitted logistic model, over all training rows.

    Input -1 is the intercept, which carries no penalty. All gradients of a settled fit are near zero.
    Rows that are equal in all inputs and the label are counted before they are spread out.
    """
    equal = train.groupBy(*spec.numeric, *([spec.category] if spec.category else []), label).agg(F.count(F.lit(1)).alias("n"))
    fitted, rows = model.stages[-1], model.transform(equal)
    error = vector_to_array("probability")[1] - F.col(label).cast("double")
    inputs = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    long = rows.select("n", error.alias("e"), F.posexplode(inputs).alias("at", "x"))
    weights = [float(w) for w in fitted.coefficients.toArray()] + [0.0]
    means = long.groupBy("at").agg(ratio(F.sum(F.col("n") * F.col("e") * F.col("x")), F.sum("n")).alias("g"))
    penalty = F.lit(float(fitted.getRegParam())) * F.element_at(F.array(*map(F.lit, weights)), F.col("at") + 1)
    return means.select(F.when(F.col("at") < len(weights) - 1, F.col("at")).otherwise(-1).alias("input"), (F.col("g") + penalty).alias("gradient"))
