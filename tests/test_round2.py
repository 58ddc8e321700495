"""Edge tests of the shared helpers: scratch folder, ordered cells, calibration, comparison, sinks, readers."""

from __future__ import annotations

import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import compare as CP
from panelworks.operators import metrics as ME
from panelworks.operators import ordered as OR
from panelworks.operators.profile import table_profile
from panelworks.session import scratch_path, shared_folder
from panelworks.sources import delimited as DL
from panelworks.sources import delivery as DV
from panelworks.sources import sinks as SK


@pytest.mark.parametrize("master, fine", [("local[2]", True), ("yarn", False), ("local-cluster[2,1,512]", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: None, applicationId="app", setCheckpointDir=lambda folder: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    if fine:
        assert shared_folder(session)
    else:
        with pytest.raises(RuntimeError):
            shared_folder(session)


@pytest.mark.parametrize("low, step", [(1e9, 1.0), (1e12, 1000.0), (1.7e9, 3.0), (-1e12, 7.0)])
def test_values_far_from_zero_are_spread(spark, low, step):
    counts = spark.range(100_000).select((F.col("id") * step + low).alias("v"), F.lit(1).alias("n"))
    cells = OR.with_cells(counts, F.lit(0), "v").groupBy("_cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 2 * OR.CELL_ROWS
    ranked = OR.running_totals(counts, [], "v", ["n"])
    wrong = ranked.where((F.col("before_n") != F.round((F.col("v") - low) / step)) | (F.col("all_n") != 100_000))
    assert wrong.count() == 0


def test_infinite_scores_and_values(spark):
    inf = float("inf")
    rows = [(0, -inf), (0, 0.1), (1, 0.2), (0, 0.3), (1, inf), (1, inf)]
    auc = ME.roc_auc(spark.createDataFrame(rows, "y int, p double")).first()["auc"]
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    assert auc == pytest.approx(wins / 9)
    a = spark.createDataFrame([("1",), ("2",), ("Infinity",), ("NaN",)], "c string")
    b = spark.createDataFrame([("1",), ("-Infinity",)], "c string")
    row = CP.comparison_table(a, b).first()
    assert (row["tipo"], row["missing_a"], row["unique_a"], row["unique_b"]) == ("numeric", 25.0, 3, 2)
    assert row["distancia"] == pytest.approx(2 / 3)


def test_dates_are_a_kind_of_their_own(spark):
    day = datetime.date(2024, 1, 1)
    a = spark.createDataFrame([(day, "x", 1), (None, "y", 2)], "d date, t string, n int")
    b = spark.createDataFrame([(day, "x", 1)], "d date, t string, n int")
    assert {r["columna"]: r["tipo"] for r in CP.comparison_table(a, b).collect()} == {
        "d": "datetime", "t": "categorical", "n": "numeric"}


def newton(p, y, clip=1e-6):
    c = np.clip(p, clip, 1 - clip)
    x, w, b = np.log(c / (1 - c)), 0.0, 0.0
    for _ in range(400):
        mu = 1 / (1 + np.exp(-(w * x + b)))
        g = np.array([((mu - y) * x).sum() + w, (mu - y).sum()])
        s = mu * (1 - mu)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum()]])
        w, b = np.array([w, b]) - np.linalg.solve(h, g)
    return w, b


def test_calibration_fit_settles(spark):
    hard = [("a", 1, 0.9)] * 2 + [("a", 0, 0.9)] * 3 + [("a", 0, 0.02)] * 5000
    rng = np.random.default_rng(0)
    easy = [("b", int(rng.random() < q), float(q)) for q in rng.random(400)]
    wide = [("c", 1, 1 - 1e-9), ("c", 0, 1e-9), ("c", 1, 0.5), ("c", 0, 0.5), ("c", 0, 0.999999)]
    one = [("d", 1, 0.5)]
    got = {r["g"]: r for r in ME.calibration_fit(spark.createDataFrame(hard + easy + wide + one, "g string, y int, p double"), ["g"]).collect()}
    for name, rows in (("a", hard), ("b", easy)):
        w, b = newton(np.array([r[2] for r in rows]), np.array([r[1] for r in rows]))
        assert got[name]["calib_slope"] == pytest.approx(w, abs=1e-6)
        assert got[name]["calib_intercept"] == pytest.approx(b, abs=1e-6)
    assert got["a"]["calib_slope"] == pytest.approx(1.5245, abs=1e-3)
    assert got["c"]["calib_slope"] is not None and got["d"]["calib_slope"] is None


def test_replace_by_key_splits_nothing_off(spark):
    path = scratch_path(spark, "replace")
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), "id")
    SK.replace_by_key(rows, path, ["k"])
    SK.replace_by_key(rows.where("k = '1'").withColumn("id", -F.col("id")), path, ["k"])
    back = SK.read_table(spark, path, "id long, k string")
    assert back.count() == 1000 and back.where("k = '1' and id > 0").count() == 0
    assert dict(back.dtypes)["k"] == "string"


def test_only_the_first_line_of_each_file_is_a_header(spark, tmp_path):
    (tmp_path / "a.txt").write_text('h|"i\n1|2\nh|"i\n')
    (tmp_path / "b.txt").write_text("other|head\n3|4\n")
    lines = [r[0] for r in DL.read_lines(spark, str(tmp_path), header=True).collect()]
    assert sorted(lines) == sorted(["1|2", 'h|"i', "3|4"])


def test_rows_of_special_spaces_are_empty(spark):
    df = spark.createDataFrame([(" ", " "), ("a", None), (None, " \t")], "a string, b string")
    assert [tuple(r) for r in DL.drop_empty_rows(df).collect()] == [("a", None)]


def test_a_delivery_is_read_once_per_header(spark, tmp_path):
    for name, text in (("x1.csv", "a,b\n1,2\n"), ("x2.csv", "a,b\n3,4\n"), ("x3.csv", "b,a\n5,6\n")):
        (tmp_path / name).write_text(text)
    groups = DV.by_header(spark, [str(tmp_path / f"x{i}.csv") for i in (1, 2, 3)])
    assert sorted(len(g) for g in groups) == [1, 2]


def test_headers_of_large_files_are_read_in_parts(spark, tmp_path):
    for name, head in (("x 1.csv", "a,b"), ("x2.csv", "a,b"), ("x3.csv", "b,a")):
        (tmp_path / name).write_text(head + "\r\n" + "b,a\n" * 200_000)
    (tmp_path / "x4.csv").write_text("")
    paths, sc = [str(tmp_path / n) for n in ("x 1.csv", "x2.csv", "x3.csv", "x4.csv")], spark.sparkContext
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    sc.setJobGroup("headers-in-parts", "")
    try:
        groups = DV.by_header(spark, paths)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [[p.rsplit("/", 1)[-1] for p in g] for g in groups] == [["x 1.csv", "x2.csv"], ["x3.csv"]]
    status = sc.statusTracker()
    stages = [i for j in status.getJobIdsForGroup("headers-in-parts") for i in status.getJobInfo(j).stageIds]
    assert max(status.getStageInfo(i).numTasks for i in stages if status.getStageInfo(i)) >= 20
    assert {tuple(read.columns): read.count() for read in (DL.read_csv_text(spark, g) for g in groups)} == {("a", "b"): 400_000, ("b", "a"): 200_000}


def test_profile_of_a_table_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "n int, t string")
    found = {(r["columna"] if "columna" in r else r[0]): r for r in table_profile(df).collect()}
    assert found
