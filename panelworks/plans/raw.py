"""Raw-looking deliveries rendered from the adapter views, for the reading and cleaning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.plans import fixtures as X
from panelworks.session import scratch_path
from panelworks.sources.delivery import stage_payload

RAW_HISTORY_SQL = """
SELECT academic_period,
  CASE WHEN CAST(legajo AS BIGINT) % 7 = 0 THEN legajo || '.0'
       WHEN CAST(legajo AS BIGINT) % 11 = 0 THEN ' ' || legajo || '-' ELSE legajo END AS ID,
  cod_carrera AS COD_CARRERA, nom_carrera AS NOM_CARRERA, anio AS ANIO,
  CASE tipo_cursada WHEN '1C' THEN '1° cuatrimestre' WHEN '2C' THEN '2° cuatrimestre'
       ELSE 'Término especial €' END AS TIPO_CURSADA,
  cod_materia AS COD_MATERIA, nom_materia AS NOM_MATERIA, nro_acta AS NRO_ACTA, origen AS ORIGEN,
  CASE nota WHEN '' THEN 'NULL' WHEN '9' THEN 'A' WHEN '1' THEN 'R' WHEN '3' THEN 'x' ELSE nota END AS NOTA,
  CASE WHEN fecha = '' THEN 'null'
       WHEN CAST(nro_acta AS BIGINT) % 2 = 0 THEN
         CASE WHEN substr(fecha, 9, 1) = '0' THEN substr(fecha, 10, 1) ELSE substr(fecha, 9, 2) END || '/'
         || substr(fecha, 6, 2) || '/' || substr(fecha, 1, 4)
       WHEN CAST(nro_acta AS BIGINT) % 23 = 0 THEN '31/02/' || substr(fecha, 1, 4)
       ELSE fecha END AS FECHA,
  fecha_vigencia AS FECHA_VIGENCIA, resultado AS RESULTADO
FROM {fx_history}
"""

FIELDS = ("ID", "COD_CARRERA", "NOM_CARRERA", "ANIO", "TIPO_CURSADA", "COD_MATERIA", "NOM_MATERIA",
          "NRO_ACTA", "ORIGEN", "NOTA", "FECHA", "FECHA_VIGENCIA", "RESULTADO")


def raw_history(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(RAW_HISTORY_SQL, fx_history=X.history(spark, folder)).withColumnsRenamed(
        {f.lower(): f for f in FIELDS}
    )


def _act() -> F.Column:
    return F.col("NRO_ACTA").cast("long")


def ragged_line():
    """Pipe-separated fields; some lines one field short, some one too long."""
    whole = F.concat_ws("|", *FIELDS)
    return F.when(_act() % 89 == 0, F.concat_ws("|", *FIELDS[:-1])).when(
        _act() % 83 == 0, F.concat(whole, F.lit("|extra"))
    ).otherwise(whole)


def write_lines(df: DataFrame, line, name: str, latin9: bool = False) -> str:
    path = scratch_path(df.sparkSession, name)
    text = line
    if latin9:
        text = F.encode(F.translate(line, "€", "¤"), "ISO-8859-1").cast("string")
    df.select(text.alias("value")).write.text(path)
    return path


def history_txt(spark: SparkSession, folder: str) -> str:
    """Ragged 13-field history, ISO-8859-15, no header."""
    return write_lines(raw_history(spark, folder), ragged_line(), "history.txt", latin9=True)


def history_txt_header(spark: SparkSession, folder: str) -> str:
    """The same lines in UTF-8, every part file starting with the header line."""
    rows = raw_history(spark, folder)
    path = scratch_path(spark, "history-header")
    # the CSV writer puts the header at the top of each part; no quoting
    name = "|".join(FIELDS)
    (rows.select(ragged_line().alias(name)).write.option("header", True).option("sep", "\u0001")
     .option("quote", "\u0000").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def staged_history(spark: SparkSession, folder: str) -> DataFrame:
    """All deliveries of the history as JSON payloads with messy ids."""
    rows = raw_history(spark, folder).withColumnRenamed("ID", "legajo")
    return stage_payload(rows.select("academic_period", *K.HISTORY_KEYS), F.col("academic_period"))
