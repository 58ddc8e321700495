"""Drift, version comparison, profiling and label sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import periods as P
from panelworks.operators import compare as CP
from panelworks.operators import drift as DR
from panelworks.operators import fairness as FA
from panelworks.operators import panel as PN
from panelworks.operators import profile as PR
from panelworks.operators import sensitivity as SN
from panelworks.operators import status as ST
from panelworks.operators.ordered import melt, value_counts
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M
from panelworks.plans.oracle import with_ctes
from panelworks.plans.queries.common import r6
from panelworks.session import scratch_path
from panelworks.sources import sinks as SK

_DOUBLES = ("psi_value", "mean_reference", "mean_current")


def _melted(s, d):
    return melt(DR.drift_rows(M.panel(s, d), unique=True), ["side"], K.DRIFT_FEATURES)


def drf_01(s, d):
    out = DR.psi_numeric(_melted(s, d), ["feature"])
    return r6(out, _DOUBLES)


def drf_01_lineitem(s, d):
    """Second drift pair: quantities and prices shipped before and after July 1998."""
    side = F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"), "ref").otherwise("cur")
    rows = X.table(s, d, "lineitem").select("l_quantity", "l_extendedprice", side.alias("side"))
    return r6(DR.psi_numeric(melt(rows, ["side"], ["l_quantity", "l_extendedprice"]), ["feature"]), _DOUBLES)


def drf_02(s, d):
    counts = value_counts(_melted(s, d), ["feature"], "value", **DR._sides("side"))
    out = DR.psi_bins(counts, ["feature"]).drop("all_ref", "all_cur")
    return r6(out, ["bin_low", "bin_high", "ref_pct", "cur_pct", "psi_bin"]).withColumn("bin", F.col("bin").cast("long"))


def drf_03(s, d):
    side = F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"), "ref").otherwise("cur")
    rows = X.table(s, d, "lineitem").select(
        F.lit("l_returnflag").alias("feature"), F.col("l_returnflag").alias("value"), side.alias("side"))
    codes = DR.drift_rows(M.panel(s, d), unique=True).select(
        F.lit("cod_carrera").alias("feature"), F.col("cod_carrera").alias("value"), "side")
    return r6(DR.psi_categorical(rows.unionByName(codes), ["feature"]), ["psi_value"])


def drf_05(s, d):
    return r6(DR.feature_drift(DR.drift_rows(M.panel(s, d), unique=True)), _DOUBLES)


def drf_04(s, d):
    return DR.feature_drift(DR.drift_rows(M.panel(s, d), unique=True)).select("feature_name", "drift_level")


def drf_06(s, d):
    out = DR.drift_summary(DR.feature_drift(DR.drift_rows(M.panel(s, d), unique=True)))
    return r6(out.withColumn("top3_features", F.concat_ws(",", "top3_features")), ["max_psi"])


def drf_07(s, d):
    doubled = M.panel(s, d).unionByName(M.panel(s, d))
    out = DR.drift_rows(doubled).groupBy("side", "academic_period").agg(
        F.count(F.lit(1)).alias("n"), F.avg("promo_rate_win3").alias("mean_rate"))
    return r6(out, ["mean_rate"])


CYCLES = ("1998_1C", "1998_2C", "1999_1C")


def cube(s, d):
    """Counts per (feature, value, half-year), stored once for all cycles."""
    return M._once(s, d, "drift_cube", lambda: DR.drift_cube(M.panel(s, d), unique=True))


def cycle_drift(s, d):
    return DR.cube_drift(cube(s, d), DR.shifted_cycles(CYCLES))


def stored_drift(s, d):
    """The drift table of the cycles, stored once as the reports read it."""
    return M._once(s, d, "drift_metrics", lambda: cycle_drift(s, d))


def drf_08(s, d):
    """Store the drift of three cycles, re-run one of them, read the table."""
    path = scratch_path(s, "drift_metrics")
    keys = ["cycle_period", "reference_period"]
    rows = stored_drift(s, d)
    SK.replace_by_key(rows, path, keys)
    SK.replace_by_key(DR.cube_drift(cube(s, d), DR.shifted_cycles(CYCLES[1:2])), path, keys)
    return r6(SK.read_table(s, path, rows.schema), _DOUBLES)


def drf_09(s, d):
    demo = FA.demographics(M.students(s, d), X.COHORTS).select("legajo", "sexo", "cohorte")
    rows = DR.drift_rows(M.panel(s, d), unique=True).join(demo, "legajo", "left")
    out = DR.segment_drift(rows, ["sexo", "cohorte"], ["promo_rate_win3", "dias_desde_ult_actividad"])
    return r6(out, ["psi_promo_rate_win3", "psi_dias_desde_ult_actividad", "psi_dropout_next"])


def _versions(s, d):
    rows = X.history(s, d)
    a = rows.where(F.col("academic_period") == "2025_1C").drop("nom_materia")
    b = rows.where(F.col("academic_period") == "2025_2C").drop("origen")
    return a, b


def _values(s, d):
    """Counts of both versions by text and number, stored once for all comparisons."""
    return M._once(s, d, "cmp_values", lambda: CP.value_cells(*_versions(s, d)))


def _kinds(s, d):
    return M._once(s, d, "cmp_kinds", lambda: CP.column_kinds(*_versions(s, d), cells=_values(s, d)))


def _cells(s, d):
    return M._once(s, d, "cmp_cells", lambda: CP.cell_counts(*_versions(s, d), _kinds(s, d), cells=_values(s, d)))


def cmp_01(s, d):
    return _kinds(s, d).select("columna", "rows_a", "rows_b")


def cmp_02(s, d):
    return _kinds(s, d).select("columna", "tipo")


def cmp_03(s, d):
    return r6(CP.compared(_cells(s, d), _kinds(s, d)).select("columna", "missing_a", "missing_b", "unique_a", "unique_b"),
              ["missing_a", "missing_b"])


def cmp_04(s, d):
    return r6(CP.numeric_distance(_cells(s, d), _kinds(s, d)).select("columna", "distancia"), ["distancia"])


def cmp_05(s, d):
    return r6(CP.categorical_distance(_cells(s, d), _kinds(s, d)).select("columna", "distancia"), ["distancia"])


def cmp_06(s, d):
    kinds = _kinds(s, d)
    return r6(CP.top_categories(CP.text_counts(*_versions(s, d), kinds), kinds), ["pct_a", "pct_b", "diferencia_pp"])


def cmp_07(s, d):
    return r6(CP.comparison_table(*_versions(s, d)), ["missing_a", "missing_b", "distancia"])


def cmp_08(s, d):
    out = CP.numeric_summary(X.history(s, d), ["nota", "anio", "nro_acta", "fecha"])
    return r6(out, ["missing_pct", "mean", "std", "min", "p25", "median", "p75", "max"])


def prf_01(s, d):
    return r6(PR.table_profile(M.panel(s, d)), ["value"])


def _active(s, d):
    return PN.activity(M.history(s, d))


def _done(s, d):
    return ST.completed_students(M.progress(s, d))


def sen_01(s, d):
    return _active(s, d).select("legajo", F.col("period").cast("long").alias("pidx"),
                                P.period_label(F.col("period")).alias("academic_period"))


def sen_02(s, d):
    return SN.internal_gaps(_active(s, d)).select("legajo", F.col("period").cast("long").alias("pidx"),
                                                  F.col("gap").cast("long").alias("gap"))


def sen_03(s, d):
    return SN.trailing_gaps(_active(s, d)).select("legajo", F.col("trailing").cast("long").alias("trailing"))


def sen_04(s, d):
    return SN.horizon_table(_active(s, d), _done(s, d))


def _relabelled(s, d):
    return SN.relabelled(M.panel(s, d), _active(s, d), _done(s, d))


def sen_05(s, d):
    return _relabelled(s, d).select("legajo", "academic_period", "lab_con_grad", "lab_sin_grad")


def sen_06(s, d):
    return r6(SN.label_agreement(_relabelled(s, d)), ["match_rate"])


def sen_07(s, d):
    return SN.reclassified(_relabelled(s, d))


def sen_09(s, d):
    return SN.threshold_sweep(M.progress(s, d))


# SQL
def _union(template: str, names) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


_MELT = _union("SELECT {k}side, '{{c}}' AS feature, CAST({{c}} AS DOUBLE) AS value FROM {t} WHERE {{c}} IS NOT NULL"
               .replace("{k}", "").replace("{t}", "drift_rows").replace("{{c}}", "{c}"), K.DRIFT_FEATURES)
_QS = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"


def psi_ctes(melted: str, keys: str = "feature", open_ends: bool = False) -> dict[str, str]:
    on = " AND ".join(f"m.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    low, high = ("e", "e") if open_ends else ("e - 1e-6", "e + 1e-6")
    bounds = f"""
        SELECT {keys}, CASE WHEN b = 0 AND {open_ends} THEN CAST('-inf' AS DOUBLE) ELSE low END AS low,
          CASE WHEN b = n - 2 AND {open_ends} THEN CAST('inf' AS DOUBLE) ELSE high END AS high, b, n FROM (
          SELECT {keys}, e AS low, lead(e) OVER w AS high, row_number() OVER w - 1 AS b,
            count(*) OVER (PARTITION BY {keys}) AS n
          FROM pts WINDOW w AS (PARTITION BY {keys} ORDER BY e)) z
        WHERE high IS NOT NULL AND n >= 3"""
    return {
        "melted": melted,
        "qs": f"SELECT {keys}, quantile_cont(value, {_QS}) AS q FROM melted WHERE side = 'ref' GROUP BY {keys}",
        "pts": f"""SELECT DISTINCT {keys}, CASE i WHEN 1 THEN {low} WHEN 11 THEN {high} ELSE e END AS e
            FROM (SELECT {keys}, unnest(q) AS e, generate_subscripts(q, 1) AS i FROM qs) z""",
        "bounds": bounds,
        "sizes": f"""SELECT {keys}, count(*) FILTER (WHERE side = 'ref') AS nr, count(*) FILTER (WHERE side = 'cur') AS nc,
            avg(value) FILTER (WHERE side = 'ref') AS mr, avg(value) FILTER (WHERE side = 'cur') AS mc
            FROM melted GROUP BY {keys}""",
        "cells": f"""SELECT b.{keys.replace(', ', ', b.')}, b.low, b.high, b.b,
              count(*) FILTER (WHERE m.side = 'ref') AS rc, count(*) FILTER (WHERE m.side = 'cur') AS cc
            FROM bounds b LEFT JOIN melted m ON {on} AND m.value >= b.low
              AND (m.value < b.high OR (m.value = b.high AND b.b = b.n - 2)) GROUP BY ALL""",
        "shares": f"""SELECT c.*, CASE WHEN rc = 0 THEN 1e-6 ELSE rc::DOUBLE / nr END AS rp,
              CASE WHEN cc = 0 THEN 1e-6 ELSE cc::DOUBLE / nc END AS cp
            FROM cells c JOIN sizes s USING ({keys}) WHERE nr > 0 AND nc > 0""",
        "psi": f"SELECT {keys}, sum((cp - rp) * ln(cp / rp)) AS psi FROM shares GROUP BY {keys}",
    }


def category_sql(rows: str, keys: str = "feature") -> str:
    """PSI over categories from (keys, value, side) rows."""
    return f"""
        SELECT {keys}, max(nr) AS nr, max(nc) AS nc,
          coalesce(sum(CASE WHEN nr > 0 AND nc > 0 THEN (c - r) * ln(c / r) END), 0) AS psi
        FROM (SELECT *, greatest(x / nullif(nr, 0)::DOUBLE, 1e-6) AS r, greatest(y / nullif(nc, 0)::DOUBLE, 1e-6) AS c FROM (
          SELECT {keys}, value, sum(a) AS x, sum(b) AS y, sum(sum(a)) OVER (PARTITION BY {keys}) AS nr,
            sum(sum(b)) OVER (PARTITION BY {keys}) AS nc
          FROM (SELECT *, CAST(side = 'ref' AS INT) AS a, CAST(side = 'cur' AS INT) AS b FROM ({rows}) q
                WHERE value IS NOT NULL) z GROUP BY {keys}, value) v) u GROUP BY {keys}"""


_LEVEL = "CASE WHEN psi < 0.10 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'high' END"


def drift_table_ctes(source: str, extra: str = "") -> dict[str, str]:
    """CTEs ending in ``drift``; ``extra`` are leading key columns, comma-terminated."""
    keys = f"{extra}feature"
    melted = _union(f"SELECT {extra}side, '{{c}}' AS feature, CAST({{c}} AS DOUBLE) AS value FROM {source} "
                    "WHERE {c} IS NOT NULL", K.DRIFT_FEATURES)
    ctes = psi_ctes(melted, keys)
    coded = _union(f"SELECT {extra}side, '{{c}}' AS feature, CAST({{c}} AS VARCHAR) AS value FROM {source}",
                   ("cod_carrera", "dropout_next"))
    ctes["cats"] = category_sql(coded, keys)
    lab = f"""SELECT {extra}avg(dropout_next) FILTER (WHERE side = 'ref') AS lr,
        avg(dropout_next) FILTER (WHERE side = 'cur') AS lc FROM {source} {'GROUP BY ALL' if extra else ''}"""
    ctes["lab"] = lab
    on = " AND ".join([f"l.{k.strip()} = c.{k.strip()}" for k in extra.split(",") if k.strip()]) or "true"
    ctes["drift"] = f"""
        SELECT {extra}feature AS feature_name, 'numeric' AS feature_type, coalesce(psi, 0) AS psi, mr, mc, nr, nc
        FROM sizes LEFT JOIN psi USING ({keys})
        UNION ALL
        SELECT {''.join(f'c.{k.strip()}, ' for k in extra.split(',') if k.strip())}feature,
          CASE feature WHEN 'dropout_next' THEN 'label' ELSE 'categorical' END, psi,
          CASE feature WHEN 'dropout_next' THEN lr END, CASE feature WHEN 'dropout_next' THEN lc END,
          CAST(nr AS BIGINT), CAST(nc AS BIGINT) FROM cats c JOIN lab l ON {on}"""
    return ctes


DRIFT_SELECT = f"""feature_name, feature_type, round(psi, 6) AS psi_value, {_LEVEL} AS drift_level,
    round(mr, 6) AS mean_reference, round(mc, 6) AS mean_current, nr AS n_reference, nc AS n_current"""
CYCLE_ROWS = """
    SELECT DISTINCT p.*, c.cycle_period, c.reference_period,
      CASE WHEN p.academic_period <= c.reference_period THEN 'ref' ELSE 'cur' END AS side
    FROM (SELECT DISTINCT * FROM panel WHERE at_risk = 1) p
    JOIN (VALUES ('1998_1C', '1996_1C'), ('1998_2C', '1996_2C'), ('1999_1C', '1997_1C')) c(cycle_period, reference_period)
      ON p.academic_period <= c.cycle_period"""


def cycle_drift_sql(body: str) -> str:
    return with_ctes(body, cycle_rows=CYCLE_ROWS, **drift_table_ctes("cycle_rows", "cycle_period, reference_period, "))


_PAIR = """SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'ref' ELSE 'cur' END AS side,
    '{c}' AS feature, {c} AS value FROM lineitem"""
_PSI_OUT = """
    SELECT feature, round(coalesce(psi, 0), 6) AS psi_value, round(mr, 6) AS mean_reference, round(mc, 6) AS mean_current,
      nr AS n_reference, nc AS n_current FROM sizes LEFT JOIN psi USING (feature)"""
_SEG = """
    SELECT r.*, u.segmento FROM drift_rows r LEFT JOIN demo d USING (legajo),
      LATERAL (SELECT 'sexo=' || d.sexo AS segmento UNION ALL SELECT 'cohorte=' || d.cohorte) u WHERE u.segmento IS NOT NULL"""
_SEG_MELT = _union("SELECT segmento, side, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM seg WHERE {c} IS NOT NULL",
                   ("promo_rate_win3", "dias_desde_ult_actividad"))

_COLS = ["academic_period", "legajo", "cod_carrera", "nom_carrera", "anio", "tipo_cursada", "cod_materia", "nom_materia",
         "nro_acta", "origen", "nota", "fecha", "fecha_vigencia", "resultado"]
_VALS = " UNION ALL ".join(
    [f"SELECT '{c}' AS columna, nullif({c}, '') AS valor, 1 AS a, 0 AS b FROM fx_history WHERE academic_period = '2025_1C'"
     for c in _COLS if c != "nom_materia"]
    + [f"SELECT '{c}', nullif({c}, ''), 0, 1 FROM fx_history WHERE academic_period = '2025_2C'"
       for c in _COLS if c != "origen"])
_CMP = {
    "cells": f"SELECT columna, valor, sum(a) AS a, sum(b) AS b FROM ({_VALS}) v GROUP BY 1, 2",
    "cols": """
        SELECT columna, sum(a) AS ra, sum(b) AS rb, coalesce(sum(a) FILTER (WHERE valor IS NULL), 0) AS za,
          coalesce(sum(b) FILTER (WHERE valor IS NULL), 0) AS zb, count(*) FILTER (WHERE valor IS NOT NULL AND a > 0) AS ua,
          count(*) FILTER (WHERE valor IS NOT NULL AND b > 0) AS ub,
          CASE WHEN coalesce(sum(CASE WHEN sa > 0 THEN a ELSE b END)
                 FILTER (WHERE valor IS NOT NULL AND try_cast(valor AS DOUBLE) IS NULL), 0) = 0
               THEN 'numeric' ELSE 'categorical' END AS tipo
        FROM (SELECT *, sum(a) OVER (PARTITION BY columna) AS sa FROM cells) z GROUP BY 1""",
    "ks": """
        SELECT columna, max(abs(ca - cb)) AS dist, count(*) FILTER (WHERE a > 0) AS ua, count(*) FILTER (WHERE b > 0) AS ub
        FROM (SELECT *, sum(a) OVER w / nullif(sum(a) OVER (PARTITION BY columna), 0)::DOUBLE AS ca,
                sum(b) OVER w / nullif(sum(b) OVER (PARTITION BY columna), 0)::DOUBLE AS cb
              FROM (SELECT columna, try_cast(valor AS DOUBLE) AS v, sum(a) AS a, sum(b) AS b FROM cells
                    JOIN cols USING (columna) WHERE tipo = 'numeric' AND valor IS NOT NULL GROUP BY 1, 2) q
              WINDOW w AS (PARTITION BY columna ORDER BY v ROWS UNBOUNDED PRECEDING)) z GROUP BY 1""",
    "tv": """
        SELECT columna, 0.5 * sum(abs(coalesce(a / nullif(ra, 0)::DOUBLE, 0) - coalesce(b / nullif(rb, 0)::DOUBLE, 0))) AS dist,
          max(ua) AS ua, max(ub) AS ub
        FROM cells JOIN cols USING (columna) WHERE tipo = 'categorical' GROUP BY 1""",
    "comparison": """
        SELECT c.columna, c.tipo, CASE WHEN ra = 0 THEN 100 ELSE za * 100.0::DOUBLE / ra END AS missing_a,
          CASE WHEN rb = 0 THEN 100 ELSE zb * 100.0::DOUBLE / rb END AS missing_b,
          coalesce(d.ua, 0) AS unique_a, coalesce(d.ub, 0) AS unique_b, d.dist
        FROM cols c LEFT JOIN (SELECT * FROM ks UNION ALL SELECT * FROM tv) d ON d.columna = c.columna""",
}
_TOP = """
    SELECT columna, valor, pct_a, pct_b, d AS diferencia_pp FROM (
      SELECT *, row_number() OVER (PARTITION BY columna ORDER BY round(abs(d), 9) DESC, valor) AS r FROM (
        SELECT columna, valor, pa AS pct_a, pb AS pct_b, pb - pa AS d FROM (
          SELECT columna, coalesce(valor, '<<NA>>') AS valor,
            CASE WHEN xa <= 10 AND a > 0 THEN a * 100.0::DOUBLE / ra ELSE 0 END AS pa,
            CASE WHEN xb <= 10 AND b > 0 THEN b * 100.0::DOUBLE / rb ELSE 0 END AS pb, xa, xb, a, b
          FROM (SELECT cells.*, ra, rb,
                  row_number() OVER (PARTITION BY columna ORDER BY a DESC, coalesce(valor, '<<NA>>')) AS xa,
                  row_number() OVER (PARTITION BY columna ORDER BY b DESC, coalesce(valor, '<<NA>>')) AS xb
                FROM cells JOIN cols USING (columna) WHERE tipo = 'categorical') z) y
        WHERE (xa <= 10 AND a > 0) OR (xb <= 10 AND b > 0)) x) w WHERE r <= 10"""


def cmp_sql(body: str) -> str:
    return with_ctes(body, **_CMP)


_SUMMARY = _union("""
    SELECT '{c}' AS columna, count(*) AS n, round(avg(CAST(v IS NULL AS INT)) * 100, 6) AS missing_pct,
      round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
      round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median,
      round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max
    FROM (SELECT try_cast({c} AS DOUBLE) AS v FROM fx_history) z""", ("nota", "anio", "nro_acta", "fecha"))
_PANEL_COLS = ("legajo", "cod_carrera", "academic_period", *K.NUMERIC_FEATURES, "at_risk", "dropout_next")
_PROFILE = " UNION ALL ".join(
    ["SELECT CAST(NULL AS VARCHAR) AS column_name, 'row_count' AS metric, count(*)::DOUBLE AS value FROM panel",
     f"SELECT NULL, 'column_count', {len(_PANEL_COLS)}::DOUBLE WHERE (SELECT count(*) FROM panel) > 0"]
    + [f"SELECT '{c}', 'null_count', n::DOUBLE FROM (SELECT count(*) - count({c}) AS n FROM panel) z WHERE n > 0"
       for c in _PANEL_COLS]
    + [f"SELECT '{c}', '{m}', round({f}({c}), 6)::DOUBLE FROM panel"
       for c in _PANEL_COLS[3:] for m, f in (("mean", "avg"), ("min", "min"), ("max", "max"))])

_IDX = {"ai": """SELECT legajo, year(ps) * 2 + CASE WHEN month(ps) = 3 THEN 0 ELSE 1 END AS i,
          year(ps) || CASE WHEN month(ps) = 3 THEN '_1C' ELSE '_2C' END AS academic_period FROM active"""}
_GAPS = {**_IDX, "gaps": """SELECT legajo, i, g FROM (
          SELECT legajo, i, i - lag(i) OVER (PARTITION BY legajo ORDER BY i) - 1 AS g FROM ai) z WHERE g >= 1""",
         "ends": "SELECT legajo, (SELECT max(i) FROM ai) - max(i) AS t FROM ai GROUP BY 1"}
_RELAB = {**_IDX, "pi": """SELECT *, CAST(left(academic_period, 4) AS INT) * 2
            + CAST(substr(academic_period, 6, 1) AS INT) - 1 AS i FROM panel""",
          "relab": """
            SELECT p.*, CASE WHEN (SELECT max(i) FROM ai) - p.i < 4 THEN NULL WHEN back THEN 0 WHEN done THEN 0 ELSE 1 END AS a,
              CASE WHEN (SELECT max(i) FROM ai) - p.i < 4 THEN NULL WHEN back THEN 0 ELSE 1 END AS b
            FROM (SELECT pi.*, EXISTS (SELECT 1 FROM ai WHERE ai.legajo = pi.legajo AND ai.i > pi.i AND ai.i <= pi.i + 4) AS back,
                    legajo IN (SELECT legajo FROM completed) AS done FROM pi) p"""}

QUERIES = {
    "drf_01_psi_numeric": (drf_01, with_ctes(_PSI_OUT, **psi_ctes(_MELT))),
    "drf_01_psi_shipments": (drf_01_lineitem, with_ctes(_PSI_OUT, **psi_ctes(
        _PAIR.format(c="l_quantity") + " UNION ALL " + _PAIR.format(c="l_extendedprice")))),
    "drf_02_psi_bins": (drf_02, with_ctes("""
        SELECT feature, b AS bin, round(low, 6) AS bin_low, round(high, 6) AS bin_high, rc AS ref_count, cc AS cur_count,
          round(rp, 6) AS ref_pct, round(cp, 6) AS cur_pct, round((cp - rp) * ln(cp / rp), 6) + 0.0 AS psi_bin
        FROM shares""", **psi_ctes(_MELT))),
    "drf_03_psi_categorical": (drf_03, with_ctes("""
        SELECT feature, CAST(nr AS BIGINT) AS n_reference, CAST(nc AS BIGINT) AS n_current, round(psi, 6) AS psi_value
        FROM cats""", cats=category_sql(_PAIR.format(c="l_returnflag") +
                                        " UNION ALL SELECT side, 'cod_carrera', cod_carrera FROM drift_rows"))),
    "drf_04_level": (drf_04, with_ctes(f"SELECT feature_name, {_LEVEL} AS drift_level FROM drift",
                                       **drift_table_ctes("drift_rows"))),
    "drf_05_feature_drift": (drf_05, with_ctes(f"SELECT {DRIFT_SELECT} FROM drift", **drift_table_ctes("drift_rows"))),
    "drf_06_summary": (drf_06, with_ctes(f"""
        SELECT CASE WHEN h > 0 THEN 'high' WHEN m > 0 THEN 'moderate' ELSE 'none' END AS overall_level, max_psi,
          h AS n_features_high, m AS n_features_mod, n - h - m AS n_features_none, n AS n_features, top3_features FROM (
          SELECT round(max(psi), 6) AS max_psi, count(*) FILTER (WHERE {_LEVEL} = 'high') AS h,
            count(*) FILTER (WHERE {_LEVEL} = 'moderate') AS m, count(*) AS n,
            array_to_string(list(feature_name ORDER BY round(psi, 6) DESC, feature_name)[1:3], ',') AS top3_features
          FROM drift) z""", **drift_table_ctes("drift_rows"))),
    "drf_07_drift_rows": (drf_07, with_ctes("""
        SELECT side, academic_period, count(*) AS n, round(avg(promo_rate_win3), 6) AS mean_rate
        FROM drift_rows GROUP BY 1, 2""")),
    "drf_08_stored_cycles": (drf_08, cycle_drift_sql(
        f"SELECT cycle_period, reference_period, {DRIFT_SELECT} FROM drift")),
    "drf_09_segment_psi": (drf_09, with_ctes("""
        SELECT segmento, nr0 AS n_ref, nc0 AS n_act, round(max(psi) FILTER (WHERE feature = 'promo_rate_win3'), 6)
            AS psi_promo_rate_win3,
          round(max(psi) FILTER (WHERE feature = 'dias_desde_ult_actividad'), 6) AS psi_dias_desde_ult_actividad,
          round(any_value((greatest(1 - lc, 1e-6) - greatest(1 - lr, 1e-6))
              * ln(greatest(1 - lc, 1e-6) / greatest(1 - lr, 1e-6))
            + (greatest(lc, 1e-6) - greatest(lr, 1e-6)) * ln(greatest(lc, 1e-6) / greatest(lr, 1e-6))), 6)
            AS psi_dropout_next
        FROM base LEFT JOIN (SELECT psi.* FROM psi JOIN sizes USING (segmento, feature) WHERE nr >= 50 AND nc >= 50) q
          USING (segmento) GROUP BY 1, 2, 3""",
        seg=_SEG, base="""SELECT segmento, count(*) FILTER (WHERE side = 'ref') AS nr0,
              count(*) FILTER (WHERE side = 'cur') AS nc0, avg(dropout_next) FILTER (WHERE side = 'ref') AS lr,
              avg(dropout_next) FILTER (WHERE side = 'cur') AS lc
            FROM seg GROUP BY 1 HAVING nr0 >= 200 AND nc0 >= 200""",
        **psi_ctes(_SEG_MELT, "segmento, feature", True))),
    "cmp_01_alignment": (cmp_01, cmp_sql(
        "SELECT columna, CAST(ra AS BIGINT) AS rows_a, CAST(rb AS BIGINT) AS rows_b FROM cols")),
    "cmp_02_kind": (cmp_02, cmp_sql("SELECT columna, tipo FROM cols")),
    "cmp_03_missing_unique": (cmp_03, cmp_sql("""
        SELECT columna, round(missing_a, 6) AS missing_a, round(missing_b, 6) AS missing_b, unique_a, unique_b
        FROM comparison""")),
    "cmp_04_ks": (cmp_04, cmp_sql("SELECT columna, round(dist, 6) AS distancia FROM ks")),
    "cmp_05_total_variation": (cmp_05, cmp_sql("SELECT columna, round(dist, 6) AS distancia FROM tv")),
    "cmp_06_top_categories": (cmp_06, cmp_sql(f"""
        SELECT columna, valor, round(pct_a, 6) AS pct_a, round(pct_b, 6) AS pct_b,
          round(diferencia_pp, 6) AS diferencia_pp FROM ({_TOP}) t""")),
    "cmp_07_comparison": (cmp_07, cmp_sql("""
        SELECT columna, tipo, round(missing_a, 6) AS missing_a, round(missing_b, 6) AS missing_b, unique_a, unique_b,
          round(dist, 6) AS distancia FROM comparison""")),
    "cmp_08_numeric_summary": (cmp_08, with_ctes(_SUMMARY)),
    "prf_01_profile": (prf_01, with_ctes(_PROFILE)),
    "sen_01_activity_index": (sen_01, with_ctes(
        "SELECT legajo, CAST(i AS BIGINT) AS pidx, academic_period FROM ai", **_IDX)),
    "sen_02_internal_gaps": (sen_02, with_ctes(
        "SELECT legajo, CAST(i AS BIGINT) AS pidx, CAST(g AS BIGINT) AS gap FROM gaps", **_GAPS)),
    "sen_03_trailing_gaps": (sen_03, with_ctes("SELECT legajo, CAST(t AS BIGINT) AS trailing FROM ends", **_GAPS)),
    "sen_04_horizons": (sen_04, with_ctes("""
        SELECT CAST(h AS BIGINT) AS horizonte_periodos, h / 2.0::DOUBLE AS anios, dropped AS abandono_legajos,
          ended - dropped AS finalizacion_excluida, inside AS "inactividades_internas_geH",
          ended AS "inactividades_finales_geH", round(inside::DOUBLE / nullif(inside + ended, 0), 4) AS tasa_reactivacion
        FROM (SELECT h, (SELECT count(*) FROM gaps WHERE g >= h) AS inside, (SELECT count(*) FROM ends WHERE t >= h) AS ended,
                (SELECT count(*) FROM ends WHERE t >= h AND legajo NOT IN (SELECT legajo FROM completed)) AS dropped
              FROM (VALUES (2), (3), (4), (6)) v(h)) z""", **_GAPS)),
    "sen_05_relabel": (sen_05, with_ctes(
        "SELECT legajo, academic_period, a AS lab_con_grad, b AS lab_sin_grad FROM relab", **_RELAB)),
    "sen_06_agreement": (sen_06, with_ctes("""
        SELECT count(*) AS n_rows, round(avg(CAST(dropout_next = a AS INT)), 6) AS match_rate FROM relab
        WHERE at_risk = 1 AND dropout_next IS NOT NULL AND a IS NOT NULL""", **_RELAB)),
    "sen_07_reclassified": (sen_07, with_ctes("""
        SELECT count(*) AS n_rows, count(*) FILTER (WHERE a = 0 AND b = 1) AS n_reclassified,
          count(DISTINCT CASE WHEN a = 0 AND b = 1 THEN legajo END) AS n_students
        FROM relab WHERE at_risk = 1 AND a IS NOT NULL""", **_RELAB)),
    "sen_09_threshold_sweep": (sen_09, with_ctes(r"""
        SELECT CAST(t AS BIGINT) AS umbral, count(DISTINCT legajo) FILTER (WHERE v >= t) AS n_legajos
        FROM (SELECT legajo, try_cast(replace(porcentaje_avance, ',', '.') AS DOUBLE) AS v FROM progress
              WHERE regexp_matches(porcentaje_avance, '^[0-9,\.]+$')) z,
          (VALUES (85), (88), (90), (92), (95), (100)) u(t) GROUP BY 1""")),
}
