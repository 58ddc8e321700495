"""Distributed operators against small brute-force versions, and invariants of the panel."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import experiments as EX
from panelworks.operators import metrics as ME
from panelworks.operators import modeling as MO
from panelworks.operators import ordered as OR
from panelworks.operators import panel as PN
from panelworks.operators import resample as RS
from panelworks.operators import splits as SP
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M
from panelworks.plans import scores as S
from panelworks.plans.queries import models as QM


def scored(spark, n, groups, distinct, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), distinct)
    rows = [(str(groups[i % len(groups)]) if groups[i % len(groups)] is not None else None, f"s{i % (n // 2)}",
             int(rng.random() < p[i]), float(p[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id string, y int, p double").repartition(7)


def brute_auc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    pos, neg = p[y == 1], p[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return None
    return float(((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg)))


@pytest.mark.parametrize("digits, seed", [(1, 1), (2, 2), (9, 3)])
def test_auc_brute(spark, digits, seed):
    rows, df = scored(spark, 400, ["a", "a", "b", None], digits, seed)
    got = {r["g"]: r["auc"] for r in ME.roc_auc(df, ["g"]).collect()}
    for g in ("a", "b", None):
        part = [r for r in rows if r[0] == g]
        assert math.isclose(got[g], brute_auc([r[2] for r in part], [r[3] for r in part]), rel_tol=1e-12)


def test_auc_of_reversed_scores(spark):
    _, df = scored(spark, 300, ["a"], 2, 5)
    a = ME.roc_auc(df).head()[0]
    b = ME.roc_auc(df.withColumn("p", 1 - F.col("p"))).head()[0]
    assert math.isclose(a, 1 - b, rel_tol=1e-12)


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(0, 1e-7, 200), rng.normal(0, 1, 300), rng.normal(0, 1e9, 100), [0.0, 5, 5, 5]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    counts = OR.value_counts(df, [], "v", n=F.lit(1))
    rows = sorted(OR.running_totals(counts, [], "v", ["n"]).collect(), key=lambda r: r["v"])
    seen = 0
    for r in rows:
        assert r["before_n"] == seen and r["all_n"] == len(values)
        seen += r["n"]
    probs = {f"q{i}": i / 10 for i in range(11)}
    got = OR.exact_quantiles(df, [], "v", probs).head()
    want = np.percentile(values, [10 * i for i in range(11)])
    assert all(math.isclose(got[f"q{i}"], want[i], rel_tol=1e-9, abs_tol=1e-15) for i in range(11))


@pytest.mark.parametrize("digits", [1, 6])
def test_top_share_brute(spark, digits):
    rows, df = scored(spark, 333, ["a", "b", "b"], digits, 11)
    rows = [(g, f"{i}x", y, p) for i, (g, _, y, p) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g string, id string, y int, p double")
    got = {(r["g"], r["top_pct"]): (r["k"], r["precision_at"], r["recall_at"]) for r in ME.top_share(df, ["g"]).collect()}
    for g in ("a", "b"):
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], hashlib.md5(r[1].encode()).hexdigest(), r[1]))
        for k in (5, 10, 20, 30):
            n = len(part) * k // 100
            hits = sum(r[2] for r in part[:n])
            want = (n, hits / n, hits / sum(r[2] for r in part))
            assert got[g, k] == pytest.approx(want)


def test_bootstrap_brute(spark):
    rows, df = scored(spark, 120, ["a"], 2, 21)
    ids = sorted({r[1] for r in rows}, key=lambda i: (hashlib.md5(i.encode()).hexdigest(), i))
    got = {r["replicate"]: r["auc"] for r in RS.bootstrap_auc(df, 9).collect()}
    for rep in range(9):
        y, p = [], []
        for place in range(len(ids)):
            word = hashlib.md5(f"42|{rep // 4}|{place}".encode()).hexdigest()[rep % 4 * 8:rep % 4 * 8 + 8]
            drawn = ids[int(word, 16) % len(ids)]
            y += [r[2] for r in rows if r[1] == drawn]
            p += [r[3] for r in rows if r[1] == drawn]
        assert math.isclose(got[rep], brute_auc(y, p), rel_tol=1e-12)


def test_every_student_slot_is_drawn(spark):
    _, df = scored(spark, 200, ["a"], 2, 3)
    per = RS.draw_weights(df, "id", 5).groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert [r["n"] for r in per] == [100] * 5


def test_calibration_fit_is_a_stationary_point(spark):
    rows, df = scored(spark, 500, ["a"], 3, 8)
    w, b = ME.calibration_fit(df).head()
    y = np.array([r[2] for r in rows])
    c = np.clip([r[3] for r in rows], 1e-6, 1 - 1e-6)
    x = np.log(c / (1 - c))
    mu = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(w + ((mu - y) * x).sum()) < 1e-6 and abs((mu - y).sum()) < 1e-6


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(4)
    values = np.round(rng.gamma(2, 3, 500), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["bin"]: r["n"] for r in ME.value_histogram(df, "v", 28).collect()}
    want, _ = np.histogram(values, bins=28)
    assert [got.get(i, 0) for i in range(28)] == list(want)


def test_stratified_sample_sizes(spark, folder):
    rows = M.modelled(spark, folder)
    sizes = {r["dropout_next"]: r["count"] for r in rows.groupBy("dropout_next").count().collect()}
    picked = SP.stratified_sample(rows, 0.3)
    got = {r["dropout_next"]: r["count"] for r in picked.groupBy("dropout_next").count().collect()}
    assert got == {k: math.floor(v * 0.3 + 0.5) for k, v in sizes.items()}


def test_panel_invariants(spark, folder):
    h, p = M.history(spark, folder), M.progress(spark, folder)
    dense = PN.dense_panel(h, p, X.SPEC).toPandas().sort_values(["legajo", "period"])
    last = dense["period"].max()
    for _, rows in dense.groupby("legajo"):
        periods = rows["period"].to_list()
        assert periods == list(range(periods[0], last + 1))
        assert rows["courses_cum"].is_monotonic_increasing
        assert (rows["at_risk"] >= rows["active"]).all()
        assert list(rows["n_ahead"]) == [min(4, last - t) for t in periods]
    panel = PN.student_panel(h, p, X.SPEC)
    assert panel.count() == panel.select("legajo", "academic_period").distinct().count() == len(dense)


def test_one_student_with_a_third_of_all_rows(spark):
    """A hot student reaches the student shuffle as cells, and the result is whole."""
    hot = spark.range(30000).select(
        F.lit("hot").alias("legajo"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("cod_carrera"),
        F.lit("2020").alias("anio"), F.lit("1C").alias("tipo_cursada"), (F.col("id") % 10).cast("string").alias("nota"),
        F.lit("2020-04-01").alias("fecha"), F.lit("Promocionó").alias("resultado"))
    cold = spark.range(60000).select(
        F.concat(F.lit("s"), (F.col("id") % 20000).cast("string")).alias("legajo"), F.lit("A").alias("cod_carrera"),
        F.lit("2020").alias("anio"), F.lit("1C").alias("tipo_cursada"), F.lit("7").alias("nota"),
        F.lit("2020-04-01").alias("fecha"), F.lit("Regular").alias("resultado"))
    history = hot.unionByName(cold)
    cells = PN.course_cells(history)
    assert cells.where("legajo = 'hot'").count() == 2
    none = spark.createDataFrame([], "legajo string, porcentaje_avance string")
    rows = PN.student_panel(history, none).where("legajo = 'hot'").collect()
    assert [(r["materias_en_periodo"], r["promo_en_periodo"], r["cod_carrera"], r["nota_media_en_periodo"]) for r in rows] == [
        (30000, 30000, "B", 4.5)]


def test_heavy_ties_in_one_score(spark):
    df = spark.range(20000).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 4 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, 0.9).otherwise(F.col("id") / 40000.0).alias("p"))
    row = {r["top_pct"]: r for r in ME.top_share(df).collect()}
    assert row[10]["k"] == 2000 and 0.2 < row[10]["precision_at"] < 0.3


def test_plans_have_no_cross_join_and_no_python(spark, folder):
    frames = [
        PN.student_panel(M.history(spark, folder), M.progress(spark, folder), X.SPEC),
        ME.ranking_metrics(S.all_scores(spark, folder), ["grp"]),
        RS.bootstrap_interval(S.panel_scores(spark, folder)),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_panel_shuffles_cells_once(spark, folder):
    """One shuffle of partial cells, one by student; windows, gaps and labels add none."""
    panel = PN.student_panel(M.history(spark, folder), M.progress(spark, folder), X.SPEC)
    lines = panel._jdf.queryExecution().executedPlan().toString().split("\n")
    shuffles = [line for line in lines if "Exchange hashpartitioning(legajo" in line]
    cells = [line for line in shuffles if "real#" in line]
    by_student = [line for line in shuffles if "REPARTITION_BY_COL" in line]
    completed = [line for line in shuffles if line not in cells + by_student]
    assert len(cells) == 1 and len(by_student) == 1 and len(completed) <= 1


def test_models_are_repeatable_and_bounded(spark, folder):
    rows = M.modelled(spark, folder)
    spec = MO.TrainSpec(trees=3)
    first = MO.score(MO.fit(rows, "GradientBoosting", spec), rows).select("legajo", "academic_period", "p")
    second = MO.score(MO.fit(rows.repartition(3), "GradientBoosting", spec), rows).select(
        "legajo", "academic_period", F.col("p").alias("q"))
    both = first.join(second, ["legajo", "academic_period"])
    out = both.agg(F.max(F.abs(F.col("p") - F.col("q"))).alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi")).head()
    assert out["d"] < 1e-12 and 0 <= out["lo"] <= out["hi"] <= 1


def test_competition_marks_one_winner(spark, folder):
    rows = M.modelled(spark, folder)
    table, models = MO.compete(rows, rows, "c", MO.TrainSpec(trees=2))
    got = table.collect()
    assert len(got) == 3 and sum(r["is_selected_model"] for r in got) == 1
    assert max(got, key=lambda r: r["roc_auc"])["is_selected_model"] and set(models) == {r["model_name"] for r in got}


def test_permutation_keeps_values(spark, folder):
    """A feature the model cannot see loses nothing when shuffled."""
    rows = M.modelled(spark, folder)
    spec = MO.TrainSpec(trees=2, numeric=("materias_win3", "materias_cum"), category=None)
    model = MO.fit(rows, "GradientBoosting", spec)
    one = rows.dropDuplicates(["legajo"])
    out = {r["feature"]: r for r in EX.permutation_importance(model, one, ["materias_win3", "materias_cum", "promo_win3"], 3).collect()}
    assert out["promo_win3"]["caida_auc_media"] == 0.0 and out["promo_win3"]["std"] == 0.0


def test_registered_model_queries_run(spark, folder, monkeypatch):
    """The queries without a SQL twin at a reduced forest size."""
    monkeypatch.setattr(QM, "SPEC", MO.TrainSpec(trees=2))
    monkeypatch.setattr(QM, "TREES", 2)
    for name in ("fea_04_one_hot", "mod_06_importances", "mod_07_save_load", "sco_03_score", "bkt_03_unseen_students",
                 "scm_01_versions"):
        assert QM.QUERIES[name][0](spark, folder).count() > 0, name
