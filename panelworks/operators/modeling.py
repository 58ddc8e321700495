"""Candidate models as Spark ML pipelines: fit, compete, store, score."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.operators.evaluation import evaluations
from panelworks.operators.features import Preparation
from panelworks.session import concurrently, fan_out, materialise

LABEL = "dropout_next"
WEIGHT = "x_weight"
PART_ROWS = 65_536  # stored training rows that one task works on, about


@dataclass(frozen=True)
class TrainSpec:
    """Size of the candidates and the model inputs."""

    trees: int = 100
    numeric: tuple[str, ...] = K.NUMERIC_FEATURES
    category: str | None = K.CATEGORY_FEATURE
    label: str = LABEL
    keys: tuple[str, ...] = ("legajo", "academic_period")
    parts: int = 32
    seed: int = K.SEED
    candidates: tuple[str, ...] = field(default=("GradientBoosting", "RandomForest", "LogisticRegression"))


def classifier(name: str, spec: TrainSpec, n_train: int):
    """One of the three candidates."""
    common = {"featuresCol": "features", "labelCol": "x_label", "weightCol": WEIGHT}
    if name == "GradientBoosting":
        return GBTClassifier(maxIter=spec.trees, maxDepth=3, subsamplingRate=0.8, stepSize=0.1, seed=spec.seed, **common)
    if name == "RandomForest":
        return RandomForestClassifier(numTrees=spec.trees, maxDepth=8, seed=spec.seed, **common)
    if name == "LogisticRegression":
        # L2 with C = 1 on the summed loss is 1 / n on the mean loss
        return LogisticRegression(maxIter=300, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, **common)
    raise ValueError(f"unknown candidate: {name}")


def preparation_stages(prepared: Preparation, spec: TrainSpec) -> list:
    """Imputation and scaling as SQL, one-hot category with unseen values all zero, one vector."""
    columns = ", ".join(["*", *prepared.expressions()])
    stages: list = [SQLTransformer(statement=f"SELECT {columns} FROM __THIS__")]
    inputs = [f"x_{f}" for f in prepared.numeric]
    if spec.category:
        stages += [
            StringIndexer(inputCol="x_category", outputCol="x_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=["x_index"], outputCols=["x_codes"], dropLast=True),
        ]
        inputs.append("x_codes")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def training_table(train: DataFrame, spec: TrainSpec) -> DataFrame:
    """The training columns, stored once: a fit passes over them many times.

    Rows are placed by a hash of their key (student and half-year), so equal
    feature rows are spread, in ``spec.parts`` parts whatever the cluster. Rows of a
    part that are equal in all features and the label are one row with their number
    as weight: features are small counts, shares and days, so their distinct rows
    grow far slower than the students. No row is left out.
    """
    columns = [*spec.numeric, *([spec.category] if spec.category else [])]
    keys = [c for c in spec.keys if c in train.columns] or columns
    part = F.pmod(F.xxhash64(*keys), F.lit(spec.parts)).cast("int")
    rows = train.select(*columns, F.col(spec.label).cast("double").alias("x_label"), part.alias("x_part"), F.xxhash64(*keys).alias("x_row"))
    return materialise(rows.groupBy(*columns, "x_label", "x_part").agg(
        F.min("x_row").alias("x_row"), F.count(F.lit(1)).alias(WEIGHT)), "train")


def training_rows(stored: DataFrame) -> int:
    """How many rows a stored training table stands for."""
    return stored.agg(F.sum(WEIGHT)).first()[0] or 0


def _dealt(rows: DataFrame, spec: TrainSpec) -> DataFrame:
    """Training rows in the same partitions and order on any number of cores: fits sample by partition.

    There are ``spec.parts`` of them, and more where these would be too large for a task.
    """
    parts = max(spec.parts, -(-rows.count() // PART_ROWS))  # counted from the files' footers
    order = [c for c in rows.columns if c not in ("x_part", "x_row")]
    dealt = rows.repartitionById(parts, F.pmod("x_row", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("x_row", *order)


def fit(train: DataFrame, name: str = "GradientBoosting", spec: TrainSpec = TrainSpec(), stored: bool = False
        ) -> PipelineModel:
    """Fit one candidate; preparation parameters come from the training rows only."""
    # dealt once for all passes of this fit; a lost part is dealt again from the stored table
    rows = _dealt(train if stored else training_table(train, spec), spec).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prepared = Preparation.fit(rows, spec.numeric, spec.category, WEIGHT)
        stages = [*preparation_stages(prepared, spec), classifier(name, spec, training_rows(rows))]
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel, rows: DataFrame, out: str = "p") -> DataFrame:
    """Rows with the probability of the positive class.

    A half-year of the stored panel is one small file of very many rows, which a scan
    gives to one task; its rows are spread before a hundred trees meet each of them.
    """
    return scored(fan_out(rows), {out: model})


def scored(rows: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Rows, where they lie, with one probability column per model."""
    for out, model in models.items():
        rows = model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias(out))
    return rows


def compete(train: DataFrame, val: DataFrame, cycle: str, spec: TrainSpec = TrainSpec()
            ) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit the candidates side by side, evaluate all on the same rows, mark the best AUC."""
    stacked, models, facts = compete_scores(train, val, cycle, spec)
    return evaluations(stacked).join(F.broadcast(facts), "model_name"), models


def compete_scores(train: DataFrame, val: DataFrame, cycle: str, spec: TrainSpec = TrainSpec()
                   ) -> tuple[DataFrame, dict[str, PipelineModel], DataFrame]:
    """Stored validation scores of every candidate, the models, and (model_name, seconds, training rows, time).

    The last is one row per candidate.
    """
    rows = training_table(train, spec)
    n_train = training_rows(rows)

    def timed(name: str) -> tuple[PipelineModel, float]:
        start = time.time()
        return fit(rows, name, spec, stored=True), time.time() - start

    done = concurrently(train.sparkSession, {name: partial(timed, name) for name in spec.candidates})
    models = {name: model for name, (model, _) in done.items()}
    stacked = None
    for name, model in models.items():
        part = score(model, val).select(
            F.lit(cycle).alias("cycle_period"), F.lit(name).alias("model_name"), *[c for c in spec.keys if c in val.columns],
            F.col(spec.label).alias("y"), "p")
        stacked = part if stacked is None else stacked.unionByName(part)
    facts = train.sparkSession.createDataFrame(
        [(name, seconds, n_train) for name, (_, seconds) in done.items()], "model_name string, training_time_seconds double, train_size long")
    return materialise(stacked, "candidates"), models, facts.withColumn("evaluated_at", F.current_timestamp())


def winner(evaluated: DataFrame) -> str:
    return evaluated.where("is_selected_model").select("model_name").head()[0]


def importances(model: PipelineModel, spec: TrainSpec = TrainSpec(), spark: SparkSession | None = None) -> DataFrame:
    """Importance per feature; the one-hot columns add up to one row for the category."""
    spark = spark or SparkSession.active()
    values = model.stages[-1].featureImportances.toArray()
    n = len(spec.numeric)
    rows = [(f, float(v)) for f, v in zip(spec.numeric, values[:n])]
    if spec.category:
        rows.append((spec.category, float(values[n:].sum())))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def save_model(model: PipelineModel, path: str) -> int:
    """Store a model as the next version under ``path``."""
    version = (_versions(SparkSession.active(), path) or [0])[-1] + 1
    model.write().save(f"{path}/version={version}")
    return version


def load_model(path: str, version: int | None = None) -> tuple[PipelineModel, int]:
    """A stored version, the newest unless named."""
    found = _versions(SparkSession.active(), path)
    if not found:
        raise FileNotFoundError(f"no stored model under {path}")
    version = found[-1] if version is None else version
    return PipelineModel.load(f"{path}/version={version}"), version
