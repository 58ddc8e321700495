"""The layouts of the three delivered files in each of three deliveries."""

from __future__ import annotations

from panelworks import constants as K
from panelworks.operators.cleaning import Layout

_HISTORY_SOURCE = (
    "legajo", "apellido", "nombres", "tipo_documento", "nro_documento", "codigo", "nombre",
    "anio_academico", "nombre-2", "codigo-2", "nombre_abreviado", "nro_acta", "origen", "nota",
    "fecha", "fecha_vigencia", "nombre-3", "email",
)
_HISTORY_RENAME = {
    "codigo": "COD_CARRERA", "nombre": "NOM_CARRERA", "anio_academico": "ANIO",
    "nombre-2": "TIPO_CURSADA", "codigo-2": "COD_MATERIA", "nombre_abreviado": "NOM_MATERIA",
    "nro_acta": "NRO_ACTA", "origen": "ORIGEN", "nota": "NOTA", "fecha": "FECHA",
    "fecha_vigencia": "FECHA_VIGENCIA", "nombre-3": "RESULTADO",
}
_HISTORY_DROP = ("apellido", "nombres", "tipo_documento", "nro_documento", "email")
_HISTORY_RULES = {"TIPO_CURSADA": K.TERM_CODES, "NOTA": K.GRADE_CODES}

_STUDENT_SOURCE = (
    "persona", "alumno", "tipo_documento", "nro_documento", "apellido", "nombres",
    "fecha_nacimiento", "nacionalidad", "localidad_nacimiento", "dto_nacimiento",
    "provicia_nacimiento", "pais_nacimiento", "sexo", "descripcion", "identidad_genero", "legajo",
    "calidad", "nombre", "plan_nombre", "plan_codigo", "anio_academico", "fecha_inscripcion",
    "tipo_ingreso", "regular", "codigo", "nombre-2", "codigo-2", "nombre-3",
    "periodo_lectivo_calle", "periodo_lectivo_numero", "periodo_lectivo_piso",
    "periodo_lectivo_departamento", "localidad_nombre", "dpto_partido_nombre", "provincia_nombre",
    "pais_nombre", "telefono_numero", "email",
)
_STUDENT_RENAME = {
    "codigo": "codigo_carrera", "nombre-2": "nombre_carrera",
    "codigo-2": "codigo_pertenece", "nombre-3": "nombre_pertenece",
}
_STUDENT_DROP = (
    "persona", "alumno", "tipo_documento", "nro_documento", "apellido", "nombres",
    "localidad_nacimiento", "dto_nacimiento", "provicia_nacimiento", "descripcion",
    "periodo_lectivo_calle", "periodo_lectivo_numero", "periodo_lectivo_piso",
    "periodo_lectivo_departamento", "provincia_nombre", "telefono_numero", "email",
)
_STUDENT_SHORT = (
    "legajo", "calidad", "nombre", "plan_nombre", "plan_codigo", "anio_academico",
    "fecha_inscripcion", "regular", "codigo", "nombre-2", "codigo-2", "nombre-3",
    "Unnamed: 12", "Unnamed: 13", "Unnamed: 14", "Unnamed: 15",
)

_PROGRESS_TARGET = (
    "registro_id", "legajo", "es_regular", "orden_titulo", "cod_carrera", "nombre_carrera",
    "cod_titulo", "titulo_obtenido", "estado_titulo", "reserva_1", "reserva_2", "vigente",
    "porcentaje_avance", "materias_aprobadas",
)
_PROGRESS_2024 = (
    "registro_id", "persona_id", "cod_carrera", "nombre_carrera", "cod_titulo", "titulo_obtenido",
    "estado_titulo", "reserva_1", "reserva_2", "vigente", "porcentaje_avance", "materias_aprobadas",
)
_PROGRESS_2025 = (
    "registro_id", "persona_id", "es_regular", "tipo_documento", "nro_documento", "apellido",
    "nombres", "orden_titulo", "cod_carrera", "nombre_carrera", "cod_titulo", "titulo_obtenido",
    "estado_titulo", "reserva_1", "reserva_2", "vigente", "porcentaje_avance", "materias_aprobadas",
)

# (dataset, delivery) -> layout
LAYOUTS: dict[tuple[str, str], Layout] = {
    ("history", "2024_2C"): Layout(
        source=("ID", "COD_CARRERA", "NOM_CARRERA", "ANIO", "TIPO_CURSADA", "COD_MATERIA",
                "NOM_MATERIA", "NRO_ACTA", "ORIGEN", "NOTA", "FECHA", "FECHA_VIGENCIA", "RESULTADO"),
        rename={"ID": "legajo"},
        # the first delivery knows two term labels less
        value_mappings={
            "TIPO_CURSADA": {k: v for k, v in K.TERM_CODES.items()
                             if k not in ("2º Cuatrimestre", "POSGRADO - 2do Cuatrimestre")},
            "NOTA": K.GRADE_CODES,
        },
        types={"NOTA": "float"}, delimiter="|", encoding="ISO-8859-15",
        expected_columns=13, header_in_file=False,
    ),
    ("history", "2025_1C"): Layout(
        _HISTORY_SOURCE, _HISTORY_RENAME, _HISTORY_DROP, value_mappings=_HISTORY_RULES,
        types={"NOTA": "float"}, delimiter="|", expected_columns=18,
    ),
    # the 2025_2C history file is read by its header without a width check
    ("history", "2025_2C"): Layout(
        _HISTORY_SOURCE, _HISTORY_RENAME, _HISTORY_DROP, value_mappings=_HISTORY_RULES,
        types={"NOTA": "float"},
    ),
    ("students", "2024_2C"): Layout(
        _STUDENT_SHORT, _STUDENT_RENAME, _STUDENT_SHORT[12:], target=K.STUDENT_KEYS[:12],
        expected_columns=16,
    ),
    ("students", "2025_1C"): Layout(
        _STUDENT_SOURCE, _STUDENT_RENAME, _STUDENT_DROP, target=K.STUDENT_KEYS,
        encoding="ISO-8859-1", expected_columns=38,
    ),
    ("students", "2025_2C"): Layout(
        _STUDENT_SOURCE, _STUDENT_RENAME, _STUDENT_DROP, target=K.STUDENT_KEYS, expected_columns=38,
    ),
    ("progress", "2024_2C"): Layout(
        _PROGRESS_2024, {"registro_id": "legajo"}, target=("legajo",) + _PROGRESS_2024[1:],
        expected_columns=12,
    ),
    ("progress", "2025_1C"): Layout(
        _PROGRESS_2025, {"persona_id": "legajo"},
        ("tipo_documento", "nro_documento", "apellido", "nombres"), target=_PROGRESS_TARGET,
        expected_columns=18,
    ),
    ("progress", "2025_2C"): Layout(_PROGRESS_TARGET, target=_PROGRESS_TARGET, expected_columns=14),
}
