"""Model queries on large half-years: no test rows in one task, nothing built twice."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from panelworks.operators import modeling as MO
from panelworks.plans import marts as M
from panelworks.plans.queries import models as Q


@pytest.fixture
def own_models(monkeypatch):
    """Two trees instead of a hundred, and no models or tables kept for or from other tests."""
    monkeypatch.setattr(Q, "SPEC", MO.TrainSpec(trees=2, parts=8))
    monkeypatch.setattr(Q, "_fitted", {})
    monkeypatch.setattr(M, "_stored", dict(M._stored))


def test_test_rows_of_one_file_are_scored_in_many_tasks(spark):
    rows = spark.range(400).select(F.col("id").alias("legajo"), (F.col("id") % 7).alias("a"), (F.col("id") % 7 < 3).cast("int").alias("dropout_next"))
    model = MO.fit(rows, "LogisticRegression", MO.TrainSpec(numeric=("a",), category=None, parts=2))
    scored = MO.score(model, rows.coalesce(1))
    filled = scored.select(F.spark_partition_id().alias("part")).distinct().count()
    assert filled > 1
    assert scored.count() == 400 and scored.where("p > 0.5").count() == rows.where("a < 3").count()


def test_candidates_share_one_training_table(spark, folder, monkeypatch, own_models):
    made, real = [], MO.training_table
    monkeypatch.setattr(MO, "training_table", lambda *args: made.append(1) or real(*args))
    sizes = Q.mod_scored(spark, folder).collect()
    names = Q.mod_04_sizes(spark, folder).collect()
    assert len(made) == 1
    test = Q._test(spark, folder)
    n, n_pos = test.count(), test.where("dropout_next = 1").count()
    assert {r["model_name"] for r in sizes} == {r["model_name"] for r in names} == set(Q.SPEC.candidates)
    assert {(r["academic_period"], r["n"], r["n_pos"], r["n_valid"]) for r in sizes} == {(Q.TEST, n, n_pos, n)}


def test_both_labels_read_one_stored_table(spark, folder, own_models):
    for label, rows in Q._label_rows(spark, folder).items():
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        assert rows.where(F.col(label).isNull() | (F.col(label) != F.col("dropout_next"))).count() == 0
    assert sum(key[2] == "relabelled" for key in M._stored) == 1


def test_subgroup_checks_read_one_stored_table(spark, folder, own_models):
    stored = Q._fairness_scores(spark, folder)
    assert "Join" not in stored._jdf.queryExecution().optimizedPlan().toString()
    assert {"sexo", "cohorte", "grupo_edad", "cod_carrera"} <= set(stored.columns)
    assert stored.count() == Q._test(spark, folder).count()


def test_versions_are_fitted_side_by_side(spark, folder, monkeypatch, own_models):
    met, real = threading.Barrier(2, timeout=60), MO.fit

    def fit(*args):
        met.wait()  # passes only if both fits are under way
        return real(*args)

    monkeypatch.setattr(MO, "fit", fit)
    assert [r["version"] for r in Q.mod_07_versions(spark, folder).collect()] == [2]
