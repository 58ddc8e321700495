"""Sources, sinks, cleaning, staging and canonical tables.

Raw files are rendered by Spark from the whole input tables into the shared
folder and read back through the readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import text as TX
from panelworks.operators import checks as CH
from panelworks.operators import cleaning as CL
from panelworks.operators import snapshot as SN
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M
from panelworks.plans import raw as R
from panelworks.plans.layouts import LAYOUTS
from panelworks.plans.oracle import CLEAN_ID, with_ctes
from panelworks.plans.queries.common import as_text, r6
from panelworks.session import scratch_path
from panelworks.sources import delimited as DL
from panelworks.sources import delivery as DV
from panelworks.sources import series as SE
from panelworks.sources import sinks as SK

_H24 = LAYOUTS["history", "2024_2C"]
_F = ", ".join(R.FIELDS)
_ACT = "CAST(NRO_ACTA AS BIGINT)"


# sources

def src_01(s, d):
    return DL.read_delimited_strict(s, R.history_txt(s, d), R.FIELDS, "|", "ISO-8859-15", False, 13)


def _student_csv(s, d):
    path = scratch_path(s, "students.csv")
    rows = X.students(s, d).withColumn("nombre", F.concat(F.lit('Plan "'), "codigo_carrera", F.lit('", ingreso '),
                                                          "anio_academico"))
    SK.write_csv(rows.drop("academic_period"), path)
    return path


def src_02(s, d):
    return DL.read_csv_text(s, _student_csv(s, d), expected=7)


def src_03(s, d):
    """Lines per field count, and whether the width guard would accept them."""
    lines = DL.read_lines(s, R.history_txt(s, d), "ISO-8859-15")
    width = F.size(F.split("value", r"\|", -1))
    return lines.groupBy(width.cast("long").alias("n_fields")).agg(F.count(F.lit(1)).alias("n_lines")).withColumn(
        "accepted", F.col("n_fields") == 13
    )


def src_04(s, d):
    path = scratch_path(s, "history.csv")
    SK.write_csv(R.raw_history(s, d).select(*R.FIELDS), path)
    return DL.read_csv_text(s, path)


def src_05(s, d):
    return DL.read_delimited_repair(s, R.history_txt_header(s, d))


def src_06(s, d):
    path = scratch_path(s, "gaps.csv")
    rows = X.students(s, d).select("legajo", "codigo_carrera", "sexo", "fecha_nacimiento")
    gap = F.col("legajo").cast("long") % 50 == 0
    SK.write_csv(rows.select(*[F.when(gap, F.lit("  ")).otherwise(F.col(c)).alias(c) for c in rows.columns]), path)
    return DL.read_csv_without_empty_rows(s, path)


def src_07(s, d):
    root = scratch_path(s, "deliveries")
    folder = f"{root}/2025_2C"
    SK.write_csv(X.history(s, d).drop("academic_period"), f"{folder}/Historico_CURSADA.csv")
    SK.write_csv(X.students(s, d).drop("academic_period"), f"{folder}/alumnos20251112.csv")
    SK.write_csv(X.progress(s, d).drop("academic_period"), f"{folder}/porcentaje_avance.csv")
    SK.write_csv(X.progress(s, d).select("legajo"), f"{folder}/otros.csv")
    out = None
    for dataset, staged in DV.load_delivery(s, root, "2025_2C").items():
        part = staged.groupBy(F.lit(dataset).alias("dataset"), "academic_period").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(F.get_json_object("payload", "$.legajo")).alias("n_students"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def src_08(s, d):
    path = scratch_path(s, "staged")
    rows = X.students(s, d)
    DV.append_staged(DV.stage(rows.drop("academic_period"), "2025_1C"), path)
    DV.append_staged(DV.stage(rows.drop("academic_period"), "2025_2C"), path)
    DV.append_staged(DV.stage(rows.drop("academic_period"), "2025_2C"), path)  # a re-load adds its rows again
    DV.append_staged(DV.stage(rows.drop("academic_period"), "2025_1C"), path, replace_period=True)
    return DV.read_staged(s, path).select("academic_period", "payload")


def _series_csv(s, d):
    path = scratch_path(s, "series.csv")
    monthly = X.table(s, d, "orders").groupBy(
        F.date_trunc("month", F.col("o_orderdate")).cast("date").cast("string").alias("indice_tiempo")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("k"))
    SK.write_csv(monthly.select(
        "indice_tiempo",
        F.concat((F.col("k") % 997).cast("string"), F.lit("."), (F.col("k") % 9973).cast("string")).alias("ipc_2016_nucleo"),
        F.when(F.col("n") % 5 != 0, F.col("n").cast("string")).alias("ipc_2016_regulados"),
        (F.col("n") * 3).cast("string").alias("ipc_2016_estacionales"),
    ), path)
    return path


def src_09(s, d):
    rows = SE.load_series(s, _series_csv(s, d), "ipc_categories")
    return r6(as_text(rows, "indice_tiempo"), ["ipc_nucleo", "ipc_regulados", "ipc_estacionales"], 4)


def _monthly_csv(s, d, name, source, value, missing):
    """One series over the months of the orders; some cells are empty, and a remark that may be empty comes along."""
    path = scratch_path(s, f"{name}.csv")
    monthly = X.table(s, d, "orders").groupBy(
        F.date_trunc("month", F.col("o_orderdate")).cast("date").cast("string").alias("indice_tiempo")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("long").alias("k"))
    SK.write_csv(monthly.select(
        "indice_tiempo", F.when(~missing, value.cast("string")).alias(source),
        F.when(F.col("n") % 3 != 0, F.lit("provisorio")).alias("observacion")), path)
    return path


def src_09_unemployment(s, d):
    """Only the rate decides whether a month is kept, an empty remark does not."""
    n, k = F.col("n"), F.col("k")
    name = K.SERIES["unemployment_rates"][0][0]
    path = _monthly_csv(s, d, "unemployment", name, F.concat(F.lit("0."), F.lpad(k % 997, 4, "0")), n % 7 == 0)
    return r6(as_text(SE.load_series(s, path, "unemployment_rates"), "indice_tiempo"), [name], 8)


def src_09_emae(s, d):
    """Every cell decides: a month with an empty remark goes as well."""
    n, k = F.col("n"), F.col("k")
    path = _monthly_csv(s, d, "emae", "s_original_nivel_gral", F.concat((k % 200).cast("string"), F.lit("."), (k % 89).cast("string")), n % 5 == 0)
    return r6(as_text(SE.load_series(s, path, "emae_indicators"), "indice_tiempo"), ["s_original_nivel_gral"], 8)


# sinks

def snk_01(s, d):
    path = scratch_path(s, "sink.csv")
    SK.write_csv(X.progress(s, d), path, delimiter=";")
    return DL.read_csv_text(s, path, delimiter=";")


def snk_02(s, d):
    path = scratch_path(s, "full_refresh")
    SK.replace_table(M.progress_rows(s, d), path)
    SK.replace_table(M.students_rows(s, d), path)
    return SK.read_table(s, path)


def _drift_like(s, d, offset):
    return M.students(s, d).groupBy(F.col("anio_academico").alias("cycle_period")).agg(
        (F.count(F.lit(1)) + offset).alias("n_rows"))


def snk_03(s, d):
    path = scratch_path(s, "by_key")
    first, again = _drift_like(s, d, 0), _drift_like(s, d, 1000).where("cycle_period >= '1997'")
    SK.replace_by_key(first, path, ["cycle_period"])
    SK.replace_by_key(again, path, ["cycle_period"])
    return SK.read_table(s, path).select(F.col("cycle_period").cast("string").alias("cycle_period"), "n_rows")


def snk_04(s, d):
    path = scratch_path(s, "appended")
    SK.append_table(_drift_like(s, d, 0), path)
    SK.append_table(_drift_like(s, d, 0), path)
    return SK.read_table(s, path)


def snk_05(s, d):
    path = scratch_path(s, "result")
    SK.replace_table(_drift_like(s, d, 0), path)
    SK.replace_table(_drift_like(s, d, 1000), path)
    return SK.read_table(s, path)


# cleaning, one step each on the raw history

def cln_01(s, d):
    return CL.rename_columns(R.raw_history(s, d).select("ID", "NRO_ACTA", "NOTA"), {"ID": "legajo", "absent": "x"})


def cln_02(s, d):
    return CL.drop_listed(R.raw_history(s, d), [*R.FIELDS[1:7], "absent"])


def cln_03(s, d):
    rows = R.raw_history(s, d).select(
        "NRO_ACTA", F.col("ID").alias("Nro_Documento"), F.col("NOM_MATERIA").alias("APELLIDO"),
        F.col("ORIGEN").alias("email"), "NOTA",
    )
    return CL.drop_personal(rows, K.STUDENT_PII)


def cln_04(s, d):
    rows = R.raw_history(s, d).select("NRO_ACTA", "COD_MATERIA", "TIPO_CURSADA", "NOTA")
    return CL.map_columns(rows, _H24.value_mappings)


def cln_05(s, d):
    return CL.null_tokens(R.raw_history(s, d).select("NRO_ACTA", "COD_MATERIA", "NOTA", "FECHA"))


def cln_06(s, d):
    rows = R.raw_history(s, d).select("NRO_ACTA", F.col("NOTA").alias("nota_float"), F.col("NOTA").alias("nota_int"),
                                      F.col("ANIO").alias("anio_int"))
    return CL.cast_columns(rows, {"nota_float": "float", "nota_int": "int", "anio_int": "int"}, whole=True)


def cln_07(s, d):
    return CL.normalise_days(R.raw_history(s, d).select("NRO_ACTA", "COD_MATERIA", "FECHA", "FECHA_VIGENCIA"))


def cln_08(s, d):
    return CL.conform(R.raw_history(s, d), ["NOTA", "NRO_ACTA", "persona_id"])


def cln_09(s, d):
    rows = CL.null_tokens(R.raw_history(s, d).select(F.col("FECHA").alias("ID"), "NRO_ACTA"))
    return CL.require_key(rows, "ID")


def cln_10(s, d):
    """Whole chain from the delivered file: strict read, then the history cleaning."""
    path = R.history_txt(s, d)
    raw = DL.read_delimited_strict(s, path, _H24.source, "|", "ISO-8859-15", False, 13)
    return CL.clean(raw, _H24, "history")


def cln_10_students(s, d):
    rows = X.students(s, d).select(
        "legajo", F.col("codigo_carrera").alias("codigo"), "fecha_inscripcion", "sexo",
        F.col("fecha_nacimiento").alias("fecha_nacimiento"), F.lit("x").alias("EMAIL"), F.col("legajo").alias("persona"),
    ).withColumn("legajo", F.when(F.col("legajo").cast("long") % 31 == 0, F.lit("NULL")).otherwise(F.col("legajo")))
    return CL.clean(rows, LAYOUTS["students", "2025_2C"], "students").select(
        "legajo", "codigo_carrera", "fecha_inscripcion", "fecha_nacimiento", "sexo", "calidad")


def cln_10_progress(s, d):
    rows = X.progress(s, d).select(
        F.col("legajo").alias("registro_id"), F.col("legajo").alias("persona_id"), "cod_carrera",
        F.lit("x").alias("Apellido"), "porcentaje_avance",
    )
    return CL.clean(rows, LAYOUTS["progress", "2025_1C"], "progress").select(
        "registro_id", "legajo", "cod_carrera", "porcentaje_avance", "vigente")


# staging to canonical

def can_01(s, d):
    return SN.flatten(R.staged_history(s, d), K.HISTORY_KEYS)


def can_01_absent(s, d):
    """Students of a delivery whose payload lacks most keys."""
    staged = DV.stage_payload(X.students(s, d).drop("academic_period"), "2025_2C")
    return SN.flatten(staged, K.STUDENT_KEYS).select(
        "academic_period", "legajo", "codigo_carrera", "sexo", "calidad", "pais_nombre")


def can_02(s, d):
    """The last delivery by its partition folder: the others are neither listed nor read."""
    raw = R.raw_history(s, d).select("academic_period", "ID", "NRO_ACTA", "COD_MATERIA")
    return DV.latest_partition(s, M.staging(s, d, "raw_history", lambda: raw), raw.schema)


def can_03(s, d):
    rows = R.raw_history(s, d).select("ID").distinct()
    return rows.select(F.col("ID").alias("raw_id"), TX.clean_id(F.col("ID")).alias("legajo"))


def can_04(s, d):
    rows = X.progress(s, d).select("legajo", F.col("porcentaje_avance").alias("raw_value"))
    return rows.withColumn("porcentaje_avance", TX.decimal_point(F.col("raw_value")))


def can_05(s, d):
    return SN.in_whitelist(X.progress(s, d), "cod_carrera", X.WHITELIST).select("legajo", "cod_carrera")


def can_06(s, d):
    rows = M.history_rows(s, d)
    columns = [k.lower() for k in K.HISTORY_KEYS]
    return rows.select("legajo", "nro_acta", "cod_materia", TX.row_digest(columns).alias("row_hash"))


def can_07(s, d):
    rows = X.progress(s, d)
    return rows.unionByName(rows).distinct()


def can_08_history(s, d):
    staged = R.staged_history(s, d)
    last = DV.latest_partition(s, M.staging(s, d, "history_payloads", lambda: staged), staged.schema)
    return SN.canonical_rows(SN.flatten(last, K.HISTORY_KEYS), SN.HISTORY, X.WHITELIST, several=False)


def _staged_canonical(rows, keys, spec):
    return SN.canonical_rows(SN.flatten(DV.stage_payload(rows, F.col("academic_period")), keys), spec, X.WHITELIST)


def can_08_students(s, d):
    return _staged_canonical(X.students(s, d), K.STUDENT_KEYS, SN.STUDENTS).select(
        "row_hash", "academic_period", "legajo", "codigo_carrera", "fecha_inscripcion", "sexo", "calidad")


def can_08_progress(s, d):
    return _staged_canonical(X.progress(s, d), K.PROGRESS_KEYS, SN.PROGRESS).select(
        "row_hash", "academic_period", "legajo", "cod_carrera", "porcentaje_avance", "persona_id")


def _hashed(s, d):
    columns = ["legajo", "cod_carrera", "nro_acta", "cod_materia", "fecha", "nota"]
    return X.history(s, d).select("academic_period", *columns).select(
        TX.row_digest(columns).alias("row_hash"), "*").distinct()


def can_09(s, d):
    """Archive a snapshot into a history that already holds part of it."""
    rows = _hashed(s, d)
    staged = M.staging(s, d, "hashed_history", lambda: rows)
    current = DV.latest_partition(s, staged, rows.schema).select(*rows.columns)
    held = SK.read_table(s, staged, rows.schema).select(*rows.columns).where(
        (F.col("academic_period") < X.LATEST) | (F.col("nro_acta").cast("long") % 3 == 0))
    path = scratch_path(s, "archive")
    table = f"archive_{path.rsplit('-', 1)[-1]}"
    for delivery in (held, current, current):  # a second archiving of the same delivery adds nothing
        SN.append_archive(delivery, table, path, 8)
    return s.table(table).groupBy("academic_period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_hash").alias("n_hashes"))


def chk_01(s, d):
    """Duplicate (student, programme) keys of the latest history."""
    return CH.duplicate_keys(M.history(s, d), ["legajo", "cod_carrera"])


def chk_01_status(s, d):
    return CH.duplicate_keys(M.status(s, d), ["legajo"])


def chk_02(s, d):
    p = M.panel(s, d)
    return CH.violations(p, {
        "label_is_0_or_1": F.col("dropout_next").isin(0, 1),
        "risk_is_0_or_1": F.col("at_risk").isin(0, 1),
        "rate_in_unit_range": F.col("promo_rate_win3").between(0, 1),
    })


_HASH_COLS = ", ".join(f"coalesce({k.lower()}, '<null>')" for k in K.HISTORY_KEYS)


def _hash(given: str, keys) -> str:
    have = given.split()
    return "md5(concat_ws('-', " + ", ".join(
        f"coalesce({k}, '<null>')" if k in have else "'<null>'" for k in keys) + "))"


QUERIES = {
    "src_01_strict_delimited": (src_01, with_ctes(
        f"SELECT {_F} FROM raw_history WHERE {_ACT} % 89 <> 0 AND {_ACT} % 83 <> 0")),
    "src_02_csv_text": (src_02, with_ctes("""
        SELECT legajo, codigo_carrera, fecha_inscripcion, fecha_nacimiento, anio_academico, sexo,
          'Plan "' || codigo_carrera || '", ingreso ' || anio_academico AS nombre FROM fx_students""")),
    "src_03_width_guard": (src_03, with_ctes(f"""
        SELECT CAST(w AS BIGINT) AS n_fields, count(*) AS n_lines, w = 13 AS accepted FROM (
          SELECT CASE WHEN {_ACT} % 89 = 0 THEN 12 WHEN {_ACT} % 83 = 0 THEN 14 ELSE 13 END AS w
          FROM raw_history) z GROUP BY w""")),
    "src_04_history_csv": (src_04, with_ctes(f"SELECT {_F} FROM raw_history")),
    "src_05_ragged_repair": (src_05, with_ctes(f"""
        SELECT {_F.replace('NOTA', "CASE NOTA WHEN 'NULL' THEN '' ELSE NOTA END AS NOTA").replace(', RESULTADO', '')},
          CASE WHEN {_ACT} % 89 = 0 THEN '' WHEN {_ACT} % 83 = 0 THEN RESULTADO || '|extra' ELSE RESULTADO END AS RESULTADO
        FROM raw_history""")),
    "src_06_empty_rows": (src_06, with_ctes("""
        SELECT legajo, codigo_carrera, sexo, fecha_nacimiento FROM fx_students
        WHERE CAST(legajo AS BIGINT) % 50 <> 0""")),
    "src_07_delivery_loader": (src_07, with_ctes("""
        SELECT 'history' AS dataset, '2025_2C' AS academic_period, count(*) AS n_rows,
          count(DISTINCT legajo) AS n_students FROM fx_history
        UNION ALL SELECT 'students', '2025_2C', count(*), count(DISTINCT legajo) FROM fx_students
        UNION ALL SELECT 'progress', '2025_2C', count(*), count(DISTINCT legajo) FROM fx_progress""")),
    "src_08_json_staging": (src_08, with_ctes("""
        SELECT p AS academic_period, CAST(to_json({'legajo': legajo, 'codigo_carrera': codigo_carrera,
          'fecha_inscripcion': fecha_inscripcion, 'fecha_nacimiento': fecha_nacimiento,
          'anio_academico': anio_academico, 'sexo': sexo}) AS VARCHAR) AS payload
        FROM fx_students, (VALUES ('2025_1C'), ('2025_2C'), ('2025_2C')) v(p)""")),
    "src_09_series": (src_09, """
        SELECT m AS indice_tiempo, CAST(CAST((k % 997) || '.' || (k % 9973) AS DECIMAL(10, 4)) AS DOUBLE) AS ipc_nucleo,
          CAST(n AS DOUBLE) AS ipc_regulados, CAST(n * 3 AS DOUBLE) AS ipc_estacionales
        FROM (SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, count(*) AS n,
                CAST(sum(o_custkey) AS BIGINT) AS k FROM orders GROUP BY 1) z WHERE n % 5 <> 0"""),
    "src_09_unemployment": (src_09_unemployment, """
        SELECT m AS indice_tiempo, CAST(CAST('0.' || lpad(CAST(k % 997 AS VARCHAR), 4, '0') AS DECIMAL(10, 8)) AS DOUBLE)
            AS eph_continua_tasa_desempleo_total_gran_san_juan
        FROM (SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, count(*) AS n,
                CAST(sum(o_custkey) AS BIGINT) AS k FROM orders GROUP BY 1) z WHERE n % 7 <> 0"""),
    "src_09_emae": (src_09_emae, """
        SELECT m AS indice_tiempo, CAST(CAST((k % 200) || '.' || (k % 89) AS DECIMAL(15, 8)) AS DOUBLE) AS s_original_nivel_gral
        FROM (SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, count(*) AS n,
                CAST(sum(o_custkey) AS BIGINT) AS k FROM orders GROUP BY 1) z WHERE n % 5 <> 0 AND n % 3 <> 0"""),
    "snk_01_csv": (snk_01, with_ctes("SELECT * FROM fx_progress")),
    "snk_02_full_refresh": (snk_02, with_ctes("SELECT * FROM students")),
    "snk_03_replace_by_key": (snk_03, with_ctes("""
        SELECT anio_academico AS cycle_period,
          count(*) + CASE WHEN anio_academico >= '1997' THEN 1000 ELSE 0 END AS n_rows FROM students GROUP BY 1""")),
    "snk_04_append": (snk_04, with_ctes("""
        SELECT anio_academico AS cycle_period, count(*) AS n_rows
        FROM students GROUP BY 1 UNION ALL
        SELECT anio_academico, count(*) FROM students GROUP BY 1""")),
    "snk_05_replace_result": (snk_05, with_ctes(
        "SELECT anio_academico AS cycle_period, count(*) + 1000 AS n_rows FROM students GROUP BY 1")),
    "cln_01_rename": (cln_01, with_ctes("SELECT ID AS legajo, NRO_ACTA, NOTA FROM raw_history")),
    "cln_02_drop": (cln_02, with_ctes("""
        SELECT academic_period, ID, NRO_ACTA, ORIGEN, NOTA, FECHA, FECHA_VIGENCIA, RESULTADO FROM raw_history""")),
    "cln_03_personal": (cln_03, with_ctes("SELECT NRO_ACTA, NOTA FROM raw_history")),
    "cln_04_value_map": (cln_04, with_ctes("""
        SELECT NRO_ACTA, COD_MATERIA, CASE TIPO_CURSADA WHEN '1° cuatrimestre' THEN '1C'
          WHEN '2° cuatrimestre' THEN '2C' ELSE TIPO_CURSADA END AS TIPO_CURSADA,
          CASE NOTA WHEN 'A' THEN '7' WHEN 'R' THEN '1' ELSE NOTA END AS NOTA FROM raw_history""")),
    "cln_05_null_tokens": (cln_05, with_ctes("""
        SELECT NRO_ACTA, COD_MATERIA, CASE WHEN NOTA IN ('NULL', 'null', '') THEN NULL ELSE NOTA END AS NOTA,
          CASE WHEN FECHA IN ('NULL', 'null', '') THEN NULL ELSE FECHA END AS FECHA FROM raw_history""")),
    "cln_06_casts": (cln_06, with_ctes("""
        SELECT NRO_ACTA, try_cast(NOTA AS DOUBLE) AS nota_float, try_cast(NOTA AS BIGINT) AS nota_int,
          CAST(ANIO AS BIGINT) AS anio_int FROM raw_history""")),
    "cln_07_dates": (cln_07, with_ctes("""
        SELECT NRO_ACTA, COD_MATERIA,
          strftime(coalesce(try_strptime(FECHA, '%d/%m/%Y'), try_strptime(FECHA, '%Y-%m-%d')), '%Y-%m-%d') AS FECHA,
          FECHA_VIGENCIA FROM raw_history""")),
    "cln_08_conform": (cln_08, with_ctes("SELECT NOTA, NRO_ACTA, CAST(NULL AS VARCHAR) AS persona_id FROM raw_history")),
    "cln_09_key": (cln_09, with_ctes("SELECT FECHA AS ID, NRO_ACTA FROM raw_history WHERE FECHA <> 'null'")),
    "cln_10_clean_history": (cln_10, with_ctes(f"""
        SELECT * EXCLUDE (academic_period) FROM cleaned_history WHERE {_ACT} % 89 <> 0 AND {_ACT} % 83 <> 0""")),
    "cln_10_clean_students": (cln_10_students, with_ctes("""
        SELECT legajo, codigo_carrera, fecha_inscripcion, fecha_nacimiento, nullif(sexo, '') AS sexo,
          CAST(NULL AS VARCHAR) AS calidad FROM fx_students WHERE CAST(legajo AS BIGINT) % 31 <> 0""")),
    "cln_10_clean_progress": (cln_10_progress, with_ctes("""
        SELECT legajo AS registro_id, legajo, cod_carrera, porcentaje_avance, CAST(NULL AS VARCHAR) AS vigente
        FROM fx_progress""")),
    "can_01_flatten": (can_01, with_ctes("""
        SELECT academic_period, ID AS legajo, COD_CARRERA AS cod_carrera, NOM_CARRERA AS nom_carrera, ANIO AS anio,
          TIPO_CURSADA AS tipo_cursada, COD_MATERIA AS cod_materia, NOM_MATERIA AS nom_materia,
          NRO_ACTA AS nro_acta, ORIGEN AS origen, NOTA AS nota, FECHA AS fecha, FECHA_VIGENCIA AS fecha_vigencia,
          RESULTADO AS resultado FROM raw_history""")),
    "can_01_absent_keys": (can_01_absent, with_ctes("""
        SELECT '2025_2C' AS academic_period, legajo, codigo_carrera, sexo, CAST(NULL AS VARCHAR) AS calidad,
          CAST(NULL AS VARCHAR) AS pais_nombre FROM fx_students""")),
    "can_02_latest_delivery": (can_02, with_ctes("""
        SELECT academic_period, ID, NRO_ACTA, COD_MATERIA FROM raw_history
        WHERE academic_period = (SELECT max(academic_period) FROM raw_history)""")),
    "can_03_clean_id": (can_03, with_ctes(
        f"SELECT ID AS raw_id, {CLEAN_ID.format(c='ID')} AS legajo FROM (SELECT DISTINCT ID FROM raw_history) z")),
    "can_04_decimal_point": (can_04, with_ctes(r"""
        SELECT legajo, porcentaje_avance AS raw_value,
          CASE WHEN regexp_matches(trim(porcentaje_avance), '^\d+,\d+$') THEN replace(trim(porcentaje_avance), ',', '.')
               ELSE trim(porcentaje_avance) END AS porcentaje_avance FROM fx_progress""")),
    "can_05_whitelist": (can_05, with_ctes("""
        SELECT legajo, cod_carrera FROM fx_progress WHERE cod_carrera NOT IN ('Brand#24', 'Brand#25')""")),
    "can_06_row_hash": (can_06, with_ctes(f"""
        SELECT legajo, nro_acta, cod_materia, md5(concat_ws('-', {_HASH_COLS})) AS row_hash FROM history""")),
    "can_07_dedup": (can_07, with_ctes("SELECT DISTINCT * FROM fx_progress")),
    "can_08_history": (can_08_history, with_ctes(
        f"SELECT md5(concat_ws('-', {_HASH_COLS})) AS row_hash, * FROM messy",
        messy=f"""SELECT DISTINCT academic_period, {CLEAN_ID.format(c='ID')} AS legajo,
          COD_CARRERA AS cod_carrera, NOM_CARRERA AS nom_carrera, ANIO AS anio, TIPO_CURSADA AS tipo_cursada,
          COD_MATERIA AS cod_materia, NOM_MATERIA AS nom_materia, NRO_ACTA AS nro_acta, ORIGEN AS origen,
          NOTA AS nota, FECHA AS fecha, FECHA_VIGENCIA AS fecha_vigencia, RESULTADO AS resultado FROM raw_history
          WHERE academic_period = '2025_2C' AND COD_CARRERA NOT IN ('Brand#24', 'Brand#25')""")),
    "can_08_students": (can_08_students, with_ctes(f"""
        SELECT {_hash('legajo anio_academico fecha_inscripcion codigo_carrera fecha_nacimiento sexo', K.STUDENT_KEYS)}
          AS row_hash, academic_period, legajo, codigo_carrera, fecha_inscripcion, sexo,
          CAST(NULL AS VARCHAR) AS calidad FROM students""")),
    "can_08_progress": (can_08_progress, with_ctes(f"""
        SELECT {_hash('legajo cod_carrera porcentaje_avance', K.PROGRESS_KEYS)} AS row_hash, academic_period, legajo,
          cod_carrera, porcentaje_avance, CAST(NULL AS VARCHAR) AS persona_id FROM progress""")),
    "can_09_archive": (can_09, with_ctes("""
        SELECT academic_period, count(*) AS n_rows, count(DISTINCT h) AS n_hashes FROM (
          SELECT DISTINCT academic_period, legajo, cod_carrera, nro_acta, cod_materia, fecha, nota,
            md5(concat_ws('-', legajo, cod_carrera, nro_acta, cod_materia, fecha, nota)) AS h FROM fx_history) z
        GROUP BY 1""")),
    "chk_01_duplicate_keys": (chk_01, with_ctes("""
        SELECT legajo, cod_carrera, count(*) AS n_rows FROM history GROUP BY 1, 2 HAVING count(*) > 1""")),
    "chk_01_status_key": (chk_01_status, with_ctes(
        "SELECT legajo, count(*) AS n_rows FROM status GROUP BY 1 HAVING count(*) > 1")),
    "chk_02_value_rules": (chk_02, with_ctes("""
        SELECT 'label_is_0_or_1' AS rule, count(*) FILTER (WHERE dropout_next IS NULL) AS n_rows FROM panel
        UNION ALL SELECT 'risk_is_0_or_1', count(*) FILTER (WHERE at_risk NOT IN (0, 1)) FROM panel
        UNION ALL SELECT 'rate_in_unit_range', count(*) FILTER (WHERE promo_rate_win3 IS NULL) FROM panel""")),
}
