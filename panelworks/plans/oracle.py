"""SQL checks: named common table expressions the DuckDB queries are put together from.

They state the semantics relationally (range-join grid, self-joins, ranks) and
share no code with the Spark operators except the adapter views.
"""

from __future__ import annotations

import re

from panelworks.plans import fixtures as X
from panelworks.plans.raw import RAW_HISTORY_SQL

_TABLES = {n: n for n in ("lineitem", "orders", "part", "customer")}
_CODES = ", ".join(f"'{c}'" for c in X.WHITELIST)
_ISO = r"'^\d{4}-\d{2}-\d{2}$'"
_STRICT = r"'^\d+([.,]\d+)?$'"
CLEAN_ID = r"nullif(regexp_replace(split_part(trim({c}), '.', 1), '[^0-9]', '', 'g'), '')"
NUM = "try_cast(replace({c}, ',', '.') AS DOUBLE)"
LOOSE = r"regexp_matches({c}, '^[0-9,\.]+$')"

CTES: dict[str, str] = {
    "fx_history": X.HISTORY_SQL.format(**_TABLES),
    "fx_students": X.STUDENTS_SQL.format(**_TABLES),
    "fx_progress": X.PROGRESS_SQL.format(**_TABLES),
    "raw_history": RAW_HISTORY_SQL.format(fx_history="fx_history"),
    "cleaned_history": """
        SELECT academic_period, nullif(ID, '') AS legajo, COD_CARRERA, NOM_CARRERA, ANIO,
          CASE TIPO_CURSADA WHEN '1° cuatrimestre' THEN '1C' WHEN '2° cuatrimestre' THEN '2C'
               ELSE TIPO_CURSADA END AS TIPO_CURSADA,
          COD_MATERIA, NOM_MATERIA, NRO_ACTA, ORIGEN,
          try_cast(CASE NOTA WHEN 'A' THEN '7' WHEN 'R' THEN '1' WHEN 'NULL' THEN NULL ELSE NOTA END AS DOUBLE) AS NOTA,
          strftime(coalesce(try_strptime(FECHA, '%d/%m/%Y'), try_strptime(FECHA, '%Y-%m-%d')), '%Y-%m-%d') AS FECHA,
          FECHA_VIGENCIA, RESULTADO
        FROM raw_history""",
    # canonical tables, business columns only
    "history": f"""
        SELECT DISTINCT * REPLACE ({CLEAN_ID.format(c='legajo')} AS legajo) FROM fx_history
        WHERE academic_period = (SELECT max(academic_period) FROM fx_history)
          AND {CLEAN_ID.format(c='legajo')} IS NOT NULL AND cod_carrera IN ({_CODES})""",
    "students": f"""
        SELECT DISTINCT * FROM fx_students WHERE codigo_carrera IN ({_CODES})""",
    "progress": f"""
        SELECT DISTINCT * REPLACE (
          CASE WHEN regexp_matches(trim(porcentaje_avance), '^\\d+,\\d+$')
               THEN replace(trim(porcentaje_avance), ',', '.') ELSE trim(porcentaje_avance) END AS porcentaje_avance)
        FROM fx_progress WHERE cod_carrera IN ({_CODES})""",
    "dated": f"""
        SELECT *, CASE WHEN month(d) BETWEEN 3 AND 8 THEN make_date(year(d), 3, 1)
                       WHEN month(d) >= 9 THEN make_date(year(d), 9, 1)
                       ELSE make_date(year(d) - 1, 9, 1) END AS ps
        FROM (SELECT *, try_cast(trim(fecha) AS DATE) AS d FROM history
              WHERE regexp_matches(trim(coalesce(fecha, '')), {_ISO})) z
        WHERE d IS NOT NULL""",
    "calendar": """
        SELECT CAST(g AS DATE) AS ps,
               year(g) || CASE WHEN month(g) = 3 THEN '_1C' ELSE '_2C' END AS academic_period
        FROM generate_series(DATE '1994-09-01', DATE '2035-09-01', INTERVAL 6 MONTH) t(g)
        WHERE g <= (SELECT max(ps) FROM dated)""",
    "active": "SELECT DISTINCT legajo, ps FROM dated",
    "completed": f"""
        SELECT DISTINCT legajo FROM progress
        WHERE regexp_matches(trim(porcentaje_avance), {_STRICT})
          AND {NUM.format(c='trim(porcentaje_avance)')} >= 90""",
    "grid": """
        SELECT f.legajo, c.academic_period, c.ps, CASE WHEN a.legajo IS NULL THEN 0 ELSE 1 END AS act
        FROM (SELECT legajo, min(ps) AS first_ps FROM dated GROUP BY 1) f
        JOIN calendar c ON c.ps >= f.first_ps
        LEFT JOIN active a ON a.legajo = f.legajo AND a.ps = c.ps""",
    "state": """
        SELECT *, max(act) OVER (PARTITION BY legajo ORDER BY ps ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS at_risk,
          max(act) OVER (PARTITION BY legajo ORDER BY ps ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS max_ahead,
          count(*) OVER (PARTITION BY legajo ORDER BY ps ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS n_ahead
        FROM grid""",
    "labelled": """
        SELECT s.*, CASE WHEN n_ahead < 4 THEN NULL WHEN coalesce(max_ahead, 0) = 1 THEN 0
                         WHEN c.legajo IS NOT NULL THEN 0 ELSE 1 END AS dropout_next
        FROM state s LEFT JOIN completed c ON c.legajo = s.legajo""",
    "dominant": """
        SELECT legajo, ps, cod_carrera FROM (
          SELECT legajo, ps, cod_carrera,
                 row_number() OVER (PARTITION BY legajo, ps ORDER BY n DESC, cod_carrera) AS r
          FROM (SELECT legajo, ps, cod_carrera, count(*) AS n FROM dated GROUP BY 1, 2, 3) z) y
        WHERE r = 1""",
    "carried": """
        SELECT g.legajo, g.ps, (SELECT arg_max(d.cod_carrera, d.ps) FROM dominant d
                                WHERE d.legajo = g.legajo AND d.ps <= g.ps
                                  AND d.ps >= (SELECT min(ps) FROM calendar)) AS cod_carrera
        FROM grid g""",
    "terms": """
        SELECT legajo, coalesce(anio, '') || '_' || coalesce(tipo_cursada, '') AS academic_period,
          count(*) AS n, sum(CASE WHEN resultado ILIKE 'Promoc%' THEN 1 ELSE 0 END) AS promoted,
          avg(try_cast(nullif(nota, '') AS DOUBLE)) AS grade
        FROM history GROUP BY 1, 2""",
    "panel_raw": """
        SELECT l.legajo, f.cod_carrera, l.academic_period, l.ps,
          coalesce(t.n, 0) AS materias_en_periodo, coalesce(t.promoted, 0) AS promo_en_periodo,
          t.grade AS nota_media_en_periodo,
          sum(coalesce(t.n, 0)) OVER w AS materias_win3, sum(coalesce(t.promoted, 0)) OVER w AS promo_win3,
          avg(t.grade) OVER w AS nota_win3, sum(coalesce(t.n, 0)) OVER c AS materias_cum,
          CASE WHEN coalesce(t.n, 0) > 0 THEN t.promoted::DOUBLE / t.n END AS promo_rate_period,
          CASE WHEN sum(coalesce(t.n, 0)) OVER w > 0
               THEN (sum(coalesce(t.promoted, 0)) OVER w)::DOUBLE / sum(coalesce(t.n, 0)) OVER w END AS promo_rate_win3,
          l.ps - max(CASE WHEN l.act = 1 THEN l.ps END) OVER c AS dias_desde_ult_actividad,
          l.at_risk, l.dropout_next, l.act, l.max_ahead, l.n_ahead
        FROM labelled l
        LEFT JOIN carried f ON f.legajo = l.legajo AND f.ps = l.ps
        LEFT JOIN terms t ON t.legajo = l.legajo AND t.academic_period = l.academic_period
        WINDOW w AS (PARTITION BY l.legajo ORDER BY l.ps ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
               c AS (PARTITION BY l.legajo ORDER BY l.ps ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "panel": """
        SELECT legajo, cod_carrera, academic_period, CAST(materias_en_periodo AS BIGINT) AS materias_en_periodo,
          CAST(promo_en_periodo AS BIGINT) AS promo_en_periodo, nota_media_en_periodo,
          CAST(materias_win3 AS BIGINT) AS materias_win3, CAST(promo_win3 AS BIGINT) AS promo_win3, nota_win3,
          CAST(materias_cum AS BIGINT) AS materias_cum, promo_rate_period, promo_rate_win3,
          CAST(dias_desde_ult_actividad AS INT) AS dias_desde_ult_actividad, CAST(at_risk AS INT) AS at_risk,
          CAST(dropout_next AS INT) AS dropout_next
        FROM panel_raw""",
    "modelled": "SELECT DISTINCT * FROM panel WHERE at_risk = 1 AND dropout_next IS NOT NULL",
    "last_dates": "SELECT legajo, try_cast(max(fecha) AS DATE) AS last_date FROM history GROUP BY 1",
    "status": f"""
        SELECT DISTINCT s.legajo, l.last_date AS fecha_ultima_cursada,
          CASE WHEN c.legajo IS NOT NULL THEN 'finalizacion_estimada' WHEN l.last_date IS NULL THEN 'abandonó'
               WHEN l.last_date < p.cutoff THEN 'abandonó' ELSE 'estudiando' END AS status,
          CASE WHEN c.legajo IS NOT NULL THEN 0 WHEN l.last_date IS NULL THEN 1
               WHEN l.last_date < p.cutoff THEN 1 ELSE 0 END AS dropout_flag
        FROM students s LEFT JOIN last_dates l ON l.legajo = s.legajo
        LEFT JOIN completed c ON c.legajo = s.legajo
        CROSS JOIN (SELECT CAST(max(d) - INTERVAL 2 YEAR AS DATE) AS cutoff FROM dated) p""",
    # score tables
    "panel_scores": """
        SELECT legajo AS id, academic_period, cod_carrera, CAST(dropout_next AS INT) AS y,
          round(coalesce(dias_desde_ult_actividad, 0) / (coalesce(dias_desde_ult_actividad, 0) + 200.0), 6)::DOUBLE AS p,
          dias_desde_ult_actividad AS days, promo_rate_win3 AS alt
        FROM modelled""",
    "doc_scores": """
        SELECT d.doc_id AS id, d.lang, d.source, l.quality AS y,
          CAST(round(0.7::DOUBLE * least(1.0::DOUBLE, d.n_chars / 5000.0::DOUBLE)
               + 0.3::DOUBLE * ((d.doc_id * 7919) % 1000) / 1000.0::DOUBLE, 4) AS DOUBLE) AS p
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "all_scores": """
        SELECT 'panel' AS grp, CAST(id AS VARCHAR) AS id, y, p FROM panel_scores
        UNION ALL SELECT lang, CAST(id AS VARCHAR), y, p FROM doc_scores""",
    "cut": """
        SELECT max(academic_period) AS val_period,
          ((n - 4) // 2) || CASE WHEN (n - 4) % 2 = 0 THEN '_1C' ELSE '_2C' END AS train_cutoff
        FROM (SELECT max(academic_period) AS academic_period,
                CAST(left(max(academic_period), 4) AS INT) * 2 + CAST(substr(max(academic_period), 6, 1) AS INT) - 1 AS n
              FROM modelled) z GROUP BY n""",
    "drift_rows": """
        SELECT DISTINCT * REPLACE (promo_en_periodo::DOUBLE / nullif(materias_en_periodo, 0) AS promo_rate_period,
            promo_win3::DOUBLE / nullif(materias_win3, 0) AS promo_rate_win3),
          CASE WHEN academic_period <= (SELECT train_cutoff FROM cut) THEN 'ref' ELSE 'cur' END AS side
        FROM panel WHERE at_risk = 1""",
    "demo": """
        SELECT legajo, upper(trim(sexo)) AS sexo, anio_nac, anio_ing, anio_ing - anio_nac AS edad_ingreso,
          CASE WHEN anio_ing <= 1995 THEN '<=1995' WHEN anio_ing <= 1997 THEN '1996-1997'
               WHEN anio_ing <= 1998 THEN '1998' ELSE '>=1999' END AS cohorte,
          CASE WHEN anio_ing - anio_nac <= 0 THEN NULL WHEN anio_ing - anio_nac <= 20 THEN '<=20'
               WHEN anio_ing - anio_nac <= 25 THEN '21-25' WHEN anio_ing - anio_nac <= 30 THEN '26-30'
               WHEN anio_ing - anio_nac <= 120 THEN '>30' END AS grupo_edad
        FROM (SELECT legajo, arg_min(sexo, fecha_inscripcion) AS sexo,
                min(year(CAST(fecha_nacimiento AS DATE))) AS anio_nac,
                min(year(CAST(fecha_inscripcion AS DATE))) AS anio_ing FROM students GROUP BY 1) z""",
    "latest_rows": """
        SELECT * EXCLUDE (r) FROM (
          SELECT p.*, row_number() OVER (PARTITION BY p.legajo ORDER BY academic_period DESC) AS r
          FROM panel p WHERE at_risk = 1 AND legajo IN (SELECT legajo FROM status WHERE status = 'estudiando')) z
        WHERE r = 1""",
    "preds": """
        SELECT legajo, academic_period, cod_carrera, CAST(dropout_probability >= 0.5 AS INT) AS dropout_prediction,
          dropout_probability, prediction_date, model_version FROM (
          SELECT l.*, round(coalesce(dias_desde_ult_actividad, 0) / (coalesce(dias_desde_ult_actividad, 0) + 200.0)
                   * 0.9 + (CAST(legajo AS BIGINT) % 100) / 1000.0, 6)::DOUBLE AS dropout_probability,
            v.prediction_date, v.model_version
          FROM latest_rows l JOIN (VALUES ('2025-06-01', '1', 1), ('2025-12-01', '2', 3)) v(prediction_date, model_version, m)
            ON CAST(l.legajo AS BIGINT) % v.m = 0) z""",
    "model_scores": """
        SELECT academic_period AS cycle_period, 'recency' AS model_name, y, p FROM panel_scores
        UNION ALL SELECT academic_period, 'promotion', y, 1 - coalesce(alt, 0.0::DOUBLE) FROM panel_scores
        UNION ALL SELECT academic_period, 'blend', y, (p + (1 - coalesce(alt, 0.0::DOUBLE))) / 2 FROM panel_scores""",
}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [n for n in CTES if n in words]


def with_ctes(body: str, **extra: str) -> str:
    """``body`` behind the common table expressions it uses, directly or not.

    ``extra`` adds expressions of the query's own, in order, before the body.
    """
    wanted: set[str] = set()

    def visit(sql: str) -> None:
        for name in _needs(sql):
            if name not in wanted:
                wanted.add(name)
                visit(CTES[name])

    for sql in [body, *extra.values()]:
        visit(sql)
    parts = [f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in CTES if n in wanted]
    parts += [f"{n} AS MATERIALIZED ({s.strip()})" for n, s in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()
