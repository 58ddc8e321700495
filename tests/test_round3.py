"""Vector bootstrap, bounded cells, drift cube, archive and delivery plans, documents, readers, and second opinions on models."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.functions import text as TX
from panelworks.operators import audit as AU
from panelworks.operators import compare as CP
from panelworks.operators import drift as DR
from panelworks.operators import metrics as ME
from panelworks.operators import modeling as MO
from panelworks.operators import ordered as OR
from panelworks.operators import profile as PR
from panelworks.operators import resample as RS
from panelworks.operators import snapshot as SN
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M
from panelworks.session import concurrently, materialise, scratch_path
from panelworks.sources import delimited as DL
from panelworks.sources import delivery as DV
from panelworks.sources import sinks as SK


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_outlier_leaves_no_large_cell(spark):
    low, n = 1e12, 100_000
    counts = spark.range(n).select((F.col("id") * 0.01 + low).alias("v")).unionByName(
        spark.createDataFrame([(low + 1e6,), (-1e300,), (float("inf"),)], "v double")).withColumn("n", F.lit(1))
    cells = OR.with_cells(counts, F.lit(0), "v").groupBy("_cell").count()
    assert cells.agg(F.max("count")).first()[0] <= OR.CELL_ROWS
    ranked = OR.running_totals(counts, [], "v", ["n"]).where(F.col("v").between(low, low + 1000))
    assert ranked.where(F.col("before_n") != F.round((F.col("v") - low) / 0.01) + 1).count() == 0


@pytest.mark.parametrize("power", [3, 40])
def test_steep_values_are_cut_until_cells_are_small(spark, monkeypatch, power):
    monkeypatch.setattr(OR, "CELL_ROWS", 16)
    values = 1e9 * (1 + 1e-6 * np.linspace(0, 1, 1500) ** power)
    counts = spark.createDataFrame([(float(v),) for v in np.unique(values)], "v double").withColumn("n", F.lit(1))
    cells = OR.with_cells(counts, F.lit("g"), "v").groupBy("_cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 16
    got = [r["before_n"] for r in OR.running_totals(counts, [], "v", ["n"]).orderBy("v").collect()]
    assert got == list(range(len(np.unique(values))))


def brute_auc(rows, weights):
    wins = total = 0.0
    for i, (_, y, p) in enumerate(rows):
        for j, (_, z, q) in enumerate(rows):
            if y and not z:
                w = weights[rows[i][0]] * weights[rows[j][0]]
                wins += w * ((p > q) + 0.5 * (p == q))
                total += w
    return wins / total if total else None


def test_bootstrap_of_groups_and_two_scores(spark, monkeypatch):
    monkeypatch.setattr(RS, "CELL", 5)
    monkeypatch.setattr(RS, "SLAB", 4)
    rng = np.random.default_rng(7)
    rows = [("ab"[i % 2] if i % 5 else None, f"s{rng.integers(0, 14)}", int(rng.random() < 0.4), round(float(rng.random()), 1),
             None if i % 9 == 0 else round(float(rng.random()), 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, id string, y int, p double, q double").repartition(5)
    got = {(r["g"], r["replicate"], r["score"]): r["auc"] for r in RS.bootstrap_auc(df, 7, scores=("p", "q"), by=["g"]).collect()}
    weights = {(r["g"], r["replicate"], r["id"]): r["weight"] for r in RS.draw_weights(df, "id", 7, by=["g"]).collect()}
    checked = 0
    for g in ("a", "b", None):
        for r in range(7):
            for k, name in ((3, "p"), (4, "q")):
                part = [(x[1], x[2], x[k]) for x in rows if x[0] == g and x[k] is not None]
                want = brute_auc(part, {x[1]: weights.get((g, r, x[1]), 0) for x in rows})
                assert (g, r, name) not in got if want is None else math.isclose(got[g, r, name], want, rel_tol=1e-12)
                checked += want is not None
    assert checked > 30


def test_weights_are_one_row_per_student(spark):
    places = spark.range(300).select(F.col("id").alias("place"), F.lit(300).cast("long").alias("size"))
    rows = RS.weight_arrays(places, 40).collect()
    table = np.array([np.frombuffer(r["weights"], "<i4") for r in rows])
    assert len(rows) == len({r["place"] for r in rows}) <= 300 and table.shape[1] == 40
    assert (table.sum(axis=0) == 300).all()


def test_drift_of_a_cube_is_the_drift_of_its_rows(spark, folder):
    panel = M.panel(spark, folder)
    cycle, cut = "1998_1C", "1996_1C"
    rows = DR.drift_rows(panel.where(F.col("academic_period") <= cycle), unique=True)
    plain = DR.feature_drift(rows.withColumn("side", F.when(F.col("academic_period") <= cut, "ref").otherwise("cur")))
    cube = materialise(DR.drift_cube(panel, unique=True), "cube")
    both = DR.cube_drift(cube, [(cycle, cut), ("1999_1C", "1997_1C")]).where(F.col("cycle_period") == cycle).drop("cycle_period", "reference_period")
    key = lambda r: r["feature_name"]
    for a, b in zip(sorted(plain.collect(), key=key), sorted(both.collect(), key=key), strict=True):
        assert {c: pytest.approx(v) if isinstance(v, float) else v for c, v in a.asDict().items()} == b.asDict()
    assert "/panel-" not in plan_of(DR.cube_drift(cube, [(cycle, cut)]))


def test_archive_shuffles_the_new_delivery_only(spark):
    path = scratch_path(spark, "archive")
    table = f"archive_{path.rsplit('-', 1)[-1]}"
    half = F.concat(F.lit("2025_"), (F.col("id") % 2 + 1).cast("string"), F.lit("C"))
    rows = spark.range(200).select(F.md5(F.col("id").cast("string")).alias("row_hash"), half.alias("academic_period"), "id")
    for delivery in (rows, rows.withColumn("academic_period", F.concat("academic_period", F.lit("x"))), rows.where("id < 50"), rows):
        SN.append_archive(delivery, table, path, 4)
    assert spark.table(table).count() == 400
    new = SN.unarchived(rows.hint("merge"), spark.table(table))
    lines = plan_of(new).split("\n")
    assert new.count() == 0
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "Sort [row_hash" in line)
    above = lines[join:scan]  # from the history's side of the join down to its scan
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in above)


def test_latest_delivery_lists_one_partition(spark):
    path = scratch_path(spark, "deliveries")
    rows = spark.range(30).select("id", F.element_at(F.array(*map(F.lit, ("2024_2C", "2025_1C", "2025_2C"))), (F.col("id") % 3 + 1).cast("int")).alias("academic_period"))
    SK.replace_table(rows, path, ["academic_period"])
    last = DV.latest_partition(spark, path, rows.schema)
    assert {tuple(r) for r in last.select("id", "academic_period").collect()} == {(i, "2025_2C") for i in range(2, 30, 3)}
    assert all("academic_period=2025_2C" in f for f in last.inputFiles()) and DV.deliveries(spark, path)[-1] == "academic_period=2025_2C"
    assert DV.latest_partition(spark, path + "-none", rows.schema).count() == 0


def test_lines_behind_a_header_are_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("h1|h2\na|b\n\nc\x01d|e\nh1|h2\n")
    (tmp_path / "b.txt").write_text("only a header\n")
    (tmp_path / "c.txt").write_bytes("x\nñ\n".encode("ISO-8859-15") + b"\xa4\n")
    lines = lambda path, **kw: sorted(r[0] for r in DL.read_lines(spark, str(path), header=True, **kw).collect())
    assert lines(tmp_path / "a.txt") == ["", "a|b", "c\x01d|e", "h1|h2"]
    assert lines(tmp_path / "b.txt") == [] and lines(tmp_path / "c.txt", encoding="ISO-8859-15") == ["ñ", "€"]
    repaired = [tuple(r) for r in DL.read_delimited_repair(spark, str(tmp_path / "a.txt")).collect()]
    assert sorted(repaired) == [("", ""), ("a", "b"), ("c\x01d", "e"), ("h1", "h2")]


def test_first_lines_of_split_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("header\n" + "".join(f"{name}{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = DL.read_lines(spark, str(tmp_path), header=True)
        assert df.rdd.getNumPartitions() > 4
        assert df.count() == 10_000 and df.where("value = 'header'").count() == 0 and df.distinct().count() == 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_keep_every_value(spark):
    rows = spark.createDataFrame([("c/1", 1.5, [(1, None)]), ("c2", None, [])], "cycle string, v double, list array<struct<a: int, b: string>>")
    path = scratch_path(spark, "documents")
    SK.write_documents(rows, path, "cycle")
    back = SK.read_documents(spark, path, "v double, list array<struct<a: int, b: string>>, version string, cycle string")
    assert sorted((r["version"], r["cycle"], r["v"], [tuple(x) for x in r["list"]]) for r in back.collect()) == [
        ("c/1", "c/1", 1.5, [(1, None)]), ("c2", "c2", None, [])]


def test_numbers_and_days_read_as_a_cast_reads_them(spark):
    texts = ["1", " 1 ", "-1.5", "+.5", "5.", "1e3", "1E-3", "1d", "2f", "0x1p3", "inf", "-Infinity", "NaN", "+nan", "", " ", ".", "1.2.3", "1,5",
             "Brand#1", "1997_2C", "1995-01-01", "e5", "--1", "1 2", "d", "infinit", None, "\t7\n", "١"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", TX.number(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b")).collect():
        assert r["a"] == r["b"] or (r["a"] is not None and math.isnan(r["a"]) and math.isnan(r["b"])), r
    days = ["5/3/2020", "05/03/2020", "2020-3-5", "2020-03-05", "31/02/2020", "", None, "2020/03/05", "5-3-2020", "x/y/z", "2020-13-01"]
    parsed = F.coalesce(F.try_to_timestamp("t", F.lit("d/M/yyyy")), F.try_to_timestamp("t", F.lit("yyyy-M-d")))
    for r in spark.createDataFrame([(t,) for t in days], "t string").select(
            "t", TX.day_text(F.col("t")).alias("a"), F.date_format(parsed, "yyyy-MM-dd").alias("b")).collect():
        assert r["a"] == r["b"], r


def test_profile_figures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (5, None)], "col1 int, col2 string")
    got = {(r["column_name"], r["metric"]): r["value"] for r in PR.table_profile(df).collect()}
    assert got == {(None, "row_count"): 5, (None, "column_count"): 2, ("col1", "null_count"): 1, ("col2", "null_count"): 1,
                   ("col1", "mean"): 2.75, ("col1", "min"): 1, ("col1", "max"): 5}


def test_concurrent_jobs_return_by_name_and_raise(spark):
    jobs = {f"job{k}": (lambda k=k: spark.range(k).count()) for k in range(6)}
    assert concurrently(spark, jobs, 3) == {f"job{k}": k for k in range(6)}
    with pytest.raises(ZeroDivisionError):
        concurrently(spark, {"fine": lambda: 1, "bad": lambda: 1 // 0})


def test_mixed_columns_compare_by_text_and_numbers_by_value(spark):
    a = spark.createDataFrame([("01", "1"), ("1", "1.0"), ("x", None)], "t string, n string")
    b = spark.createDataFrame([("01", "1"), ("1", "")], "t string, n string")
    got = {r["columna"]: r for r in CP.comparison_table(a, b).collect()}
    assert (got["t"]["tipo"], got["t"]["unique_a"], got["t"]["unique_b"]) == ("categorical", 3, 2)
    assert (got["n"]["tipo"], got["n"]["unique_a"], got["n"]["unique_b"], got["n"]["missing_b"]) == ("numeric", 1, 1, 50.0)


@pytest.fixture(scope="module")
def competition(spark, folder):
    rows = M.modelled(spark, folder)
    train, test = (rows.where(F.col("academic_period") <= X.CUTOFF), rows.where(F.col("academic_period") == "1999_1C"))
    spec = MO.TrainSpec(trees=4, parts=4)
    return (train, test, spec, *MO.compete_scores(train, test, "c", spec))


def test_metrics_recomputed_from_the_stored_scores(competition):
    """AUC, Brier, KS and the top tenth in DuckDB from the files the study wrote."""
    _, _, _, scored, _, _ = competition
    files = [f.removeprefix("file://") for f in scored.inputFiles()]
    found = {r["model_name"]: r for r in ME.ranking_metrics(scored, ["model_name"]).join(
        ME.threshold_metrics(scored, ["model_name"]), "model_name").collect()}
    tops = {r["model_name"]: r["precision_at"] for r in ME.top_share(scored, ["model_name"], "legajo", shares=(10,)).collect()}
    want = duckdb.connect().execute("""
        WITH s AS (SELECT * FROM read_parquet(?)),
        r AS (SELECT *, rank() OVER (PARTITION BY model_name ORDER BY p) + (count(*) OVER (PARTITION BY model_name, p) - 1) / 2.0 AS rk,
                row_number() OVER (PARTITION BY model_name ORDER BY p DESC, md5(legajo), legajo) AS place, count(*) OVER (PARTITION BY model_name) AS n FROM s),
        c AS (SELECT a.model_name, a.p, avg(CASE WHEN b.y = 1 THEN CAST(b.p <= a.p AS INT) END) AS f1, avg(CASE WHEN b.y = 0 THEN CAST(b.p <= a.p AS INT) END) AS f0
              FROM (SELECT DISTINCT model_name, p FROM s) a JOIN s b USING (model_name) GROUP BY 1, 2)
        SELECT model_name, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc,
          avg((p - y) * (p - y)) AS brier, (SELECT max(abs(f1 - f0)) FROM c WHERE c.model_name = r.model_name) AS ks,
          avg(y) FILTER (WHERE place <= n * 10 // 100) AS top FROM r GROUP BY 1""", [files]).fetchall()
    assert len(want) == 3
    for name, auc, brier, ks, top in want:
        row = found[name]
        assert (row["roc_auc"], row["brier_score"], row["ks_statistic"], tops[name]) == pytest.approx((auc, brier, ks, top), rel=1e-9)


def test_linear_candidate_has_settled(competition):
    train, _, _, _, models, _ = competition
    gradients = AU.logistic_gradient(models["LogisticRegression"], train).collect()
    assert max(abs(r["gradient"]) for r in gradients) < 1e-5 and {r["input"] for r in gradients} >= {-1, 0}


def test_importances_follow_from_the_stored_trees(competition):
    _, _, spec, _, models, _ = competition
    other = {r["feature"]: r["importance"] for r in AU.stored_importances(models["GradientBoosting"], spec).collect()}
    for r in MO.importances(models["GradientBoosting"], spec).collect():
        assert r["importance"] == pytest.approx(other.get(r["feature"], 0.0), abs=1e-12)


def test_models_do_not_depend_on_company(spark, competition):
    """A fit beside others is the fit alone."""
    train, test, spec, scored, _, _ = competition
    alone = MO.score(MO.fit(train, "GradientBoosting", spec), test).select("legajo", "academic_period", F.col("p").alias("q"))
    both = scored.where("model_name = 'GradientBoosting'").join(alone, ["legajo", "academic_period"])
    assert both.count() == test.count() and both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12


def test_bootstrap_weights_are_never_broadcast(spark, monkeypatch):
    seen, plain = [], RS.in_batches
    monkeypatch.setattr(RS, "in_batches", lambda df, fn, schema: (seen.append(df), plain(df, fn, schema))[1])
    df = spark.range(40).selectExpr("cast(id as string) id", "cast(id % 2 as int) y", "id / 40.0 p")
    assert RS.bootstrap_auc(df, 5).count() == 5
    weighted = next(x for x in seen if "weights" in x.columns)
    joins = [line for line in weighted._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0] and "Broadcast" not in joins[0]


def test_equal_training_rows_are_stored_once_with_their_number(spark, folder):
    rows = M.modelled(spark, folder).select(*MO.TrainSpec().numeric, "cod_carrera", "dropout_next", "legajo", "academic_period")
    copies = rows.crossJoin(spark.range(12)).withColumn("legajo", F.concat_ws("-", "legajo", "id")).drop("id")
    spec = MO.TrainSpec(trees=2, parts=4)
    table = MO.training_table(copies, spec)
    assert table.count() <= 4 * rows.count() < MO.training_rows(table) == copies.count()
    # the weights say what the rows say
    plain, folded = MO.Preparation.fit(copies, spec.numeric, spec.category), MO.Preparation.fit(table, spec.numeric, spec.category, MO.WEIGHT)
    assert plain.usual == folded.usual
    for name, values in plain.numeric.items():
        assert folded.numeric[name] == pytest.approx(values, rel=1e-9)
    gradients = AU.logistic_gradient(MO.fit(copies, "LogisticRegression", spec), copies).collect()
    assert max(abs(r["gradient"]) for r in gradients) < 1e-5


def test_large_training_tables_have_more_parts(spark, folder, monkeypatch):
    spec = MO.TrainSpec(parts=3)
    table = MO.training_table(M.modelled(spark, folder), spec)
    assert MO._dealt(table, spec).rdd.getNumPartitions() == 3
    monkeypatch.setattr(MO, "PART_ROWS", 20)
    sizes = MO._dealt(table, spec).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == table.count() and max(r["count"] for r in sizes) < 60


def test_top_hits_orders_one_range_only(spark):
    rows = [(f"s{i}", int(i % 3 == 0), (i * 37 % 50) / 50) for i in range(431)]
    scored = spark.createDataFrame(rows, "id string, y int, p double")
    order = sorted(rows, key=lambda r: (-r[2], hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    for share in (1, 10, 50, 100):
        k = 431 * share // 100
        assert AU.top_hits(scored, share) == pytest.approx(sum(r[1] for r in order[:k]) / k)
    assert AU.top_hits(scored.limit(5)) is None
