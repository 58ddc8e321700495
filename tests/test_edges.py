"""Hand-made edge rows for the semantics that are easy to get wrong."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelworks.functions import periods as P
from panelworks.functions import text as TX
from panelworks.operators import cleaning as CL
from panelworks.operators import drift as DR
from panelworks.operators import metrics as ME
from panelworks.operators import panel as PN
from panelworks.operators import snapshot as SN
from panelworks.operators import status as ST
from panelworks.plans.layouts import LAYOUTS
from panelworks.session import scratch_path
from panelworks.sources import delimited as DL
from panelworks.sources import delivery as DV

HISTORY = ("legajo string, cod_carrera string, anio string, tipo_cursada string, nota string, fecha string, "
           "resultado string")


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluated(spark, values, expr, kind="string"):
    rows = one_column(spark, values, kind).select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


@pytest.mark.parametrize("raw, want", [
    ("123.0", "123"), (" 12-3 ", "123"), ("00123", "00123"), ("12a.0", "12"), ("FINAL", None), ("", None), (None, None),
])
def test_clean_id(spark, raw, want):
    assert evaluated(spark, [raw], TX.clean_id) == [want]


def test_decimal_point_and_numbers(spark):
    raw = ["89,99", "90", " 90.0 ", "1.2.3", "S/D", "-95", None]
    assert evaluated(spark, raw, TX.decimal_point) == ["89.99", "90", "90.0", "1.2.3", "S/D", "-95", None]
    assert evaluated(spark, raw, TX.strict_number) == [89.99, 90.0, 90.0, None, None, None, None]
    assert evaluated(spark, ["1.2.3", "7,5", "x", None], TX.loose_number) == [None, 7.5, None, None]


def test_completed_students(spark):
    rows = spark.createDataFrame(
        [("a", "89,99"), ("b", "90"), ("c", " 90.0 "), ("d", "1.2.3"), ("e", "S/D"), ("f", "-95"), ("g", None)],
        "legajo string, porcentaje_avance string")
    assert {r[0] for r in ST.completed_students(rows).collect()} == {"b", "c"}


def test_day_text(spark):
    raw = ["05/03/2020", "5/3/2020", "2020-02-29", "31/02/2020", "03-05-2020", "", "05/03/20", None]
    want = ["2020-03-05", "2020-03-05", "2020-02-29", None, None, None, None, None]
    assert evaluated(spark, raw, TX.day_text) == want


def test_grades_and_terms(spark):
    layout = LAYOUTS["history", "2025_1C"]
    rows = spark.createDataFrame(
        [("A", "2º Cuatrimestre"), ("R", "Verano 2023"), ("8", "texto"), ("x", "Anual"), ("NULL", "")],
        "NOTA string, TIPO_CURSADA string")
    out = CL.cast_columns(CL.null_tokens(CL.map_columns(rows, layout.value_mappings)), layout.types).collect()
    assert [r["NOTA"] for r in out] == [7.0, 1.0, 8.0, None, None]
    assert [r["TIPO_CURSADA"] for r in out] == ["2C", "V", "texto", "A", None]


def test_drop_must_be_a_list(spark):
    with pytest.raises(ValueError):
        CL.drop_listed(spark.range(1), {"a": 1})


@pytest.mark.parametrize("day, start", [
    ("2020-02-29", "2019-09-01"), ("2020-03-01", "2020-03-01"), ("2020-08-31", "2020-03-01"),
    ("2020-09-01", "2020-09-01"), ("2020-12-31", "2020-09-01"), ("2021-01-01", "2020-09-01"),
])
def test_half_year_of_day(spark, day, start):
    got = evaluated(spark, [day], lambda c: P.period_start(P.period_of_day(TX.iso_day(c))))
    assert got == [dt.date.fromisoformat(start)]


def test_impossible_days_are_null(spark):
    assert evaluated(spark, ["2020-13-45", "2020-1-5", "x", ""], TX.iso_day) == [None] * 4


def test_period_labels(spark):
    assert P.shift_label("2023_1C", 4) == "2021_1C"
    assert P.shift_label("2020_2C", -1) == "2021_1C"
    assert evaluated(spark, ["2020_1C", "2020_2C", "2020_V", "2020_A", None], P.period_of_label) == [
        4040, 4041, None, None, None]


def _course(student, day, term=None, grade="8", result="Promocionó", code="A"):
    year, kind = (term or "0000_V").split("_")
    return (student, code, year, kind, grade, day, result)


def _panel(spark, courses, progress=(), spec=None):
    h = spark.createDataFrame(courses, HISTORY)
    p = spark.createDataFrame(list(progress), "legajo string, porcentaje_avance string")
    rows = PN.student_panel(h, p, spec or PN.PanelSpec()).orderBy("legajo", "academic_period").collect()
    return [r.asDict() for r in rows]


def test_risk_and_label_of_one_activity(spark):
    """Activity 1,0,0,0,0,0; another student keeps the calendar open to the sixth period."""
    courses = [_course("a", "2020-04-01"), _course("z", "2022-10-01")]
    rows = [r for r in _panel(spark, courses) if r["legajo"] == "a"]
    assert [r["at_risk"] for r in rows] == [1, 1, 1, 1, 0, 0]
    assert [r["dropout_next"] for r in rows] == [1, 1, None, None, None, None]


def test_return_within_the_horizon(spark):
    courses = [_course("a", "2020-04-01"), _course("a", "2022-04-01"), _course("z", "2022-10-01")]
    rows = [r for r in _panel(spark, courses) if r["legajo"] == "a"]
    assert [r["dropout_next"] for r in rows] == [0, 0, None, None, None, None]


def test_completion_turns_the_label(spark):
    courses = [_course("a", "2020-04-01"), _course("z", "2022-10-01")]
    done = [r for r in _panel(spark, courses, [("a", "95,5")]) if r["legajo"] == "a"]
    assert [r["dropout_next"] for r in done][:2] == [0, 0]
    off = _panel(spark, courses, [("a", "95,5")], PN.PanelSpec(use_completion=False))
    assert [r["dropout_next"] for r in off if r["legajo"] == "a"][:2] == [1, 1]


def test_activity_before_the_calendar(spark):
    """The trajectory starts at the calendar start, not at risk and without recency."""
    rows = _panel(spark, [_course("a", "2009-04-01"), _course("a", "2012-04-01")])
    assert [r["academic_period"] for r in rows] == ["2011_1C", "2011_2C", "2012_1C"]
    assert [r["at_risk"] for r in rows] == [0, 0, 1]
    assert [r["dias_desde_ult_actividad"] for r in rows] == [None, None, 0]
    assert [r["cod_carrera"] for r in rows] == [None, None, "A"]


def test_real_date_and_declared_term_differ(spark):
    """Summer courses count as activity, never as courses; undated courses count only by term."""
    rows = _panel(spark, [
        _course("a", "2020-01-15", "2020_V"), _course("a", "2020-04-01", "2020_1C"),
        _course("a", "", "2020_1C", grade="4", result="No Promocionó"), _course("b", "", "2020_1C"),
    ])
    assert {r["legajo"] for r in rows} == {"a"}
    assert [(r["academic_period"], r["materias_en_periodo"]) for r in rows] == [("2019_2C", 0), ("2020_1C", 2)]
    last = rows[-1]
    assert (last["promo_en_periodo"], last["nota_media_en_periodo"], last["promo_rate_period"]) == (1, 6.0, 0.5)


def test_window_spans_four_rows(spark):
    days = ["2020-04-01", "2020-10-01", "2021-04-01", "2021-10-01", "2022-04-01"]
    terms = ["2020_1C", "2020_2C", "2021_1C", "2021_2C", "2022_1C"]
    rows = _panel(spark, [_course("a", d, t) for d, t in zip(days, terms)])
    assert [r["materias_win3"] for r in rows] == [1, 2, 3, 4, 4]
    assert [r["materias_cum"] for r in rows] == [1, 2, 3, 4, 5]


def test_programme_ties_and_carry_forward(spark):
    rows = _panel(spark, [
        _course("a", "2020-04-01", code="B"), _course("a", "2020-05-01", code="A"), _course("z", "2021-04-01")])
    assert [r["cod_carrera"] for r in rows if r["legajo"] == "a"] == ["A", "A", "A"]


def test_status_rules(spark):
    h = spark.createDataFrame([
        _course("on", "2020-06-30"), _course("before", "2020-06-29"), _course("last", "2022-06-30"),
        _course("blank", ""), _course("done", "2010-01-01")], HISTORY)
    s = spark.createDataFrame([(x,) for x in ("on", "before", "last", "blank", "done", "none")] + [("on",)], "legajo string")
    p = spark.createDataFrame([("done", "100"), ("done", "S/D")], "legajo string, porcentaje_avance string")
    got = {r["legajo"]: (r["status"], r["dropout_flag"]) for r in ST.student_status(s, h, p).collect()}
    assert got == {
        "on": ("estudiando", 0), "last": ("estudiando", 0), "before": ("abandonó", 1), "blank": ("abandonó", 1),
        "none": ("abandonó", 1), "done": ("finalizacion_estimada", 0)}


def test_width_rules(spark):
    path = scratch_path(spark, "widths")
    lines = ["|".join("abcdefghijklmn"[:n]) for n in (12, 13, 14)]
    spark.createDataFrame([("|".join(f"c{i}" for i in range(13)),)] + [(x,) for x in lines], "value string").coalesce(
        1).write.text(path)
    names = [f"c{i}" for i in range(13)]
    strict = DL.read_delimited_strict(spark, path, names, header=True, expected=13).collect()
    assert [tuple(r) for r in strict] == [tuple("abcdefghijklm")]
    fixed = {tuple(r) for r in DL.read_delimited_repair(spark, path).collect()}
    assert fixed == {tuple("abcdefghijkl") + ("",), tuple("abcdefghijklm"), tuple("abcdefghijkl") + ("m|n",)}


def test_width_guard_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    with pytest.raises(ValueError):
        DL.read_csv_text(spark, str(tmp_path / "a.csv"), expected=3)


def test_latin_fallback_and_blank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a,b\nañ,1\n ,\n".encode("latin-1"))
    rows = DL.read_csv_without_empty_rows(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("añ", "1")]


def test_latin9(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é€|Š\n".encode("iso-8859-15"))
    rows = DL.read_delimited_strict(spark, str(tmp_path / "a.txt"), ["a", "b"], encoding="ISO-8859-15").collect()
    assert [tuple(r) for r in rows] == [("é€", "Š")]


def test_delivery_routes(spark):
    assert DV.dataset_of("Historico_CURSADA.csv") == "history"
    assert DV.dataset_of("cursada_alumnos.csv") == "history"
    assert DV.dataset_of("x.csv") is None
    with pytest.raises(FileNotFoundError):
        DV.list_csv(spark, scratch_path(spark, "absent"))


def test_missing_payload_key_is_null(spark):
    staged = spark.createDataFrame([("2025_1C", '{"legajo":"1","a":""}')], "academic_period string, payload string")
    row = SN.flatten(staged, ("legajo", "a", "b")).head()
    assert (row["legajo"], row["a"], row["b"]) == ("1", "", None)


def test_archive_twice_adds_nothing(spark):
    cur = spark.createDataFrame([("h1", "2025_1C"), ("h2", "2025_1C")], "row_hash string, academic_period string")
    hist = spark.createDataFrame([("h1", "2024_2C")], cur.schema)
    once = SN.archived(cur, hist)
    assert once.count() == 3 and SN.archived(cur, once).count() == 3


def _scored(spark, rows):
    return spark.createDataFrame(rows, "id string, y int, p double")


def test_auc_edges(spark):
    flat = _scored(spark, [("a", 1, 0.3), ("b", 0, 0.3), ("c", 1, 0.3)])
    assert ME.roc_auc(flat).head()[0] == 0.5
    assert ME.roc_auc(flat.where("y = 1")).head()[0] is None
    assert ME.roc_auc(flat.where("y = 5")).head()[0] is None


def test_last_bin_is_closed(spark):
    rows = _scored(spark, [("a", 1, 1.0), ("b", 1, 0.95), ("c", 0, 0.0)])
    m = ME.threshold_metrics(rows).head()
    # one bin holds 0.95 and 1.0 (gap 0.05 over three rows), the other is exact
    assert math.isclose(m["ece"], 0.05 / 3, rel_tol=1e-9)


def test_bin_edges_follow_the_floating_grid(spark):
    """0.3 lies below the grid point 3 * 0.1."""
    rows = _scored(spark, [("a", 1, 0.3), ("b", 0, 0.25)])
    assert math.isclose(ME.threshold_metrics(rows).head()["ece"], abs(0.5 - 0.275), rel_tol=1e-9)


def _pair(spark, ref, cur):
    rows = [("f", float(v), "ref") for v in ref] + [("f", float(v), "cur") for v in cur]
    return spark.createDataFrame(rows, "feature string, value double, side string")


def test_psi_edges(spark):
    # the ends are widened before equal edges merge, so a constant reference still has two bins
    constant = DR.psi_numeric(_pair(spark, [1] * 20, range(20)), ["feature"]).head()["psi_value"]
    assert math.isclose(constant, (1 / 20 - 1) * math.log(1 / 20), rel_tol=1e-9)
    assert DR.psi_numeric(_pair(spark, range(20), []), ["feature"]).head()["psi_value"] == 0.0
    same = DR.psi_numeric(_pair(spark, range(50), range(50)), ["feature"]).head()["psi_value"]
    assert abs(same) < 1e-12
    few = DR.psi_numeric(_pair(spark, range(20), range(20)), ["feature"], segment_rules=True).head()["psi_value"]
    assert few is None


def test_psi_loses_values_out_of_range(spark):
    out = DR.psi_numeric(_pair(spark, range(100), [1000.0] * 10 + [5.0] * 10), ["feature"]).head()
    counts = [r["cur_count"] for r in DR.psi_bins(
        DR.value_counts(_pair(spark, range(100), [1000.0] * 10 + [5.0] * 10), ["feature"], "value", **DR._sides("side")),
        ["feature"]).collect()]
    assert sum(counts) == 10 and out["n_current"] == 20


def test_layout_from_a_nested_mapping(spark):
    layout = CL.Layout.from_mapping({
        "input": {"delimiter": "|", "encoding": "utf-8", "expected_columns": 2, "header_in_file": True},
        "columns": {"source": ["codigo", "nota"], "rename": {"codigo": "COD_CARRERA", "nota": "NOTA"}, "drop": []},
        "value_mappings": {"NOTA": {"A": 7, "R": 1}}, "types": {"NOTA": "float"}, "null_values": ["NULL", "null", ""],
    })
    rows = spark.createDataFrame([("X", "A"), ("Y", "")], "codigo string, nota string")
    assert [tuple(r) for r in CL.clean(rows, layout, "history").collect()] == [("X", 7.0), ("Y", None)]


def test_all_layouts_clean_an_empty_file(spark):
    for (kind, delivery), layout in LAYOUTS.items():
        rows = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in layout.source))
        columns = CL.clean(rows, layout, kind).columns
        assert not {"apellido", "nombres", "nro_documento", "email"} & set(columns), (kind, delivery)
        if layout.target:
            assert tuple(columns) == tuple(layout.target)
        else:
            assert {"legajo", "COD_CARRERA", "NOTA", "RESULTADO"} <= set(columns)
