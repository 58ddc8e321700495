"""Adapter views: the reference data model derived from the supplied star-schema tables.

The text is the dialect Spark SQL and DuckDB share, so the same definition
feeds a job and its SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.operators.panel import PanelSpec

# Parameters that go with the adapter views.
WHITELIST = tuple(f"Brand#{i}" for i in range(1, 24))
SPEC = PanelSpec(first="1994_2C")
LATEST = "2025_2C"
CUTOFF = "1997_1C"
COHORTS = ((1995, "<=1995"), (1997, "1996-1997"), (1998, "1998"), (2100, ">=1999"))
ACTIVITY_BUCKETS = (("2024_2C", "before 2024_2C"), ("2025_2C", "2024_2C-2025_1C"))

HISTORY_SQL = """
SELECT CASE o_orderstatus WHEN 'F' THEN '2024_2C' WHEN 'O' THEN '2025_1C' ELSE '2025_2C' END AS academic_period,
  CAST(o_custkey AS STRING) AS legajo, p_brand AS cod_carrera, p_type AS nom_carrera,
  CAST(year(l_shipdate) AS STRING) AS anio,
  CASE WHEN month(l_shipdate) BETWEEN 3 AND 8 THEN '1C' WHEN month(l_shipdate) >= 9 THEN '2C' ELSE 'V' END AS tipo_cursada,
  'M' || CAST(l_partkey AS STRING) AS cod_materia, p_name AS nom_materia,
  CAST(l_orderkey AS STRING) AS nro_acta, l_linestatus AS origen,
  CASE WHEN l_returnflag = 'A' THEN '' ELSE CAST(CAST(floor(l_quantity / 5) AS INT) AS STRING) END AS nota,
  CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS fecha,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS fecha_vigencia,
  CASE WHEN l_returnflag = 'R' THEN 'Promocionó' WHEN l_returnflag = 'A' THEN 'Abandonó'
       WHEN l_tax > 0.07 THEN 'No Promocionó' ELSE 'Regular' END AS resultado
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey
"""

STUDENTS_SQL = """
SELECT '2025_2C' AS academic_period, CAST(c_custkey AS STRING) AS legajo,
  'Brand#' || CAST(1 + c_custkey % 25 AS STRING) AS codigo_carrera,
  CAST(DATE '1994-01-01' + CAST(c_custkey % 2500 AS INT) AS STRING) AS fecha_inscripcion,
  CAST(DATE '1970-01-01' + CAST((c_custkey * 37) % 9000 AS INT) AS STRING) AS fecha_nacimiento,
  CAST(year(DATE '1994-01-01' + CAST(c_custkey % 2500 AS INT)) AS STRING) AS anio_academico,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'F' WHEN 'AUTOMOBILE' THEN 'F' WHEN 'MACHINERY' THEN 'M'
       WHEN 'HOUSEHOLD' THEN 'X' ELSE '' END AS sexo
FROM {customer}
"""

PROGRESS_SQL = """
SELECT '2025_2C' AS academic_period, CAST(c_custkey AS STRING) AS legajo,
  'Brand#' || CAST(1 + c_custkey % 25 AS STRING) AS cod_carrera,
  CASE WHEN c_custkey % 53 = 0 THEN 'S/D'
       ELSE CAST(CAST(floor(t / 10) AS INT) AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN ',' ELSE '.' END
            || CAST(t % 10 AS STRING) END AS porcentaje_avance
FROM (SELECT c_custkey, CAST(floor((c_acctbal + 1000) / 11) AS INT) AS t FROM {customer}) q
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _view(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, folder, n) for n in names})


def history(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, HISTORY_SQL, "lineitem", "orders", "part")


def students(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, STUDENTS_SQL, "customer")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, PROGRESS_SQL, "customer")
