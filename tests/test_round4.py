"""Comparison in one pass, and other steps that must not grow faster than their input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelworks.functions import text as TX
from panelworks.operators import audit as AU
from panelworks.operators import compare as CP
from panelworks.operators import experiments as EX
from panelworks.operators import metrics as ME


def test_comparison_melts_both_tables_once(spark, monkeypatch):
    calls, real = [], CP._melted
    monkeypatch.setattr(CP, "_melted", lambda *args: calls.append(1) or real(*args))
    a = spark.createDataFrame([("1", "x"), ("1.0", "1"), (" 1 ", None), ("2", "NaN"), (None, "")], "n string, t string")
    b = spark.createDataFrame([("01", "x"), ("3", "y"), ("+4", "inf")], "n string, t string")
    got = {r["columna"]: r for r in CP.comparison_table(a, b).collect()}
    assert len(calls) == 1
    n, t = got["n"], got["t"]
    assert (n["tipo"], n["unique_a"], n["unique_b"], n["missing_a"], n["distancia"]) == ("numeric", 2, 3, 20.0, pytest.approx(2 / 3))
    assert (t["tipo"], t["unique_a"], t["unique_b"], t["missing_a"]) == ("categorical", 2, 3, 60.0)


def test_first_sign_of_a_number(spark):
    texts = ["1", "+.5e3", "-0x1p3", "\t 7", "\x00 8", "inf", "Infinity", "nan", "NaN", "iNF", "1d", ".", "", "é1", "x", "Brand#1", "d", "２", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    wide = rows.selectExpr("t", "try_cast(t AS double) AS c").withColumn("v", TX.number(rows["t"]))
    assert all(r["c"] == r["v"] or repr(r["c"]) == repr(r["v"]) for r in wide.collect())


def test_equal_shuffled_rows_are_scored_once(spark, monkeypatch):
    sizes = []

    def score(model, rows):
        sizes.append(rows.count())
        return rows.withColumn("p", (F.col("a") + 2 * F.length("c")) / 10.0)

    monkeypatch.setattr(EX.MO, "score", score)
    n, repeats = 600, 4
    test = spark.range(n).select("id", (F.col("id") % 3).alias("a"), F.substring(F.lit("xy"), 1, (F.col("id") % 2 + 1).cast("int")).alias("c"),
                                 (F.col("id") % 7 < 3).cast("int").alias("y"))
    got = EX.permuted_scores(None, test, ["a", "c"], repeats, key="id", label="y")
    assert sizes[0] <= 3 * 6 * 2  # kinds of (feature, a, c, y)
    sums = {(r[0], r[1]): (r[2], r[3]) for r in got.groupBy("feature", "repeat").agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).collect()}
    assert set(sums) == {("", 0), *((f, r) for f in "ac" for r in range(1, repeats + 1))}
    assert set(sums.values()) == {(n, test.where("y = 1").count())}
    one = got.where("feature = 'a' and repeat = 2")
    assert ME.roc_auc(one, weight="n").first()["auc"] == pytest.approx(AU.area(one, weight="n"))
