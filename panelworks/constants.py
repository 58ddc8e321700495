"""Word lists, lookup tables and cut-offs the results depend on.

Nothing in this file is derived; every value has to equal the published
definition of the data model for the results to be right.
"""

# Programme codes kept by the canonical tables.
PROGRAMME_WHITELIST = (
    "SA5", "AB5", "AF3", "PT2", "PT7", "AF1", "CA2", "AB1", "TA06", "PT6",
    "TA1", "SA2", "PT8", "CA1", "CS2", "AF0", "CA4", "PT1", "SA1", "CS0",
    "CS3", "PT3", "CS1", "CS9", "CS4", "AB4", "PT9", "SA4", "PT4",
)

# Texts that mean "no value" in a raw delivery.
NULL_TOKENS = ("NULL", "null", "")

# Labels of a course term and the code each one is stored under.
TERM_CODES = {
    "2º Cuatrimestre": "2C",
    "POSGRADO - 2do Cuatrimestre": "2C",
    "1° cuatrimestre": "1C",
    "2° cuatrimestre": "2C",
    "1º Cuatrimestre": "1C",
    "Cursada de verano": "V",
    "Curso de Verano": "V",
    "Cursada de Verano": "V",
    "Verano 2023": "V",
    "Anual": "A",
    "3° trimestre": "3T",
    "1° trimestre": "1T",
    "2° trimestre": "2T",
    "1° mensual": "M",
    "2° Trimestre": "2T",
    "2° bimestre": "2B",
    "Microcredito-EAD": "MC",
}

# Letter grades and the number each one counts as.
GRADE_CODES = {"A": "7", "R": "1"}

# Personal columns that never leave the cleaning step.
STUDENT_PII = ("apellido", "nombres", "nro_documento", "telefono_numero", "telefono", "email")
PROGRESS_PII = ("apellido", "nombres", "nro_documento", "tipo_documento")

# Columns holding dates in the cleaned files.
DATE_COLUMNS = ("FECHA", "FECHA_VIGENCIA", "fecha_inscripcion", "fecha_nacimiento")

# Delivered file name pattern -> dataset, tried in this order.
DELIVERY_ROUTES = (("cursada", "history"), ("alumno", "students"), ("porcentaje", "progress"))

# Payload keys of the three staged datasets, in canonical column order.
HISTORY_KEYS = (
    "legajo", "COD_CARRERA", "NOM_CARRERA", "ANIO", "TIPO_CURSADA", "COD_MATERIA",
    "NOM_MATERIA", "NRO_ACTA", "ORIGEN", "NOTA", "FECHA", "FECHA_VIGENCIA", "RESULTADO",
)
STUDENT_KEYS = (
    "legajo", "calidad", "nombre", "plan_nombre", "plan_codigo", "anio_academico",
    "fecha_inscripcion", "regular", "codigo_carrera", "nombre_carrera", "codigo_pertenece",
    "nombre_pertenece", "fecha_nacimiento", "nacionalidad", "pais_nacimiento", "sexo",
    "identidad_genero", "tipo_ingreso", "dpto_partido_nombre", "localidad_nombre", "pais_nombre",
)
PROGRESS_KEYS = (
    "legajo", "persona_id", "es_regular", "orden_titulo", "cod_carrera", "nombre_carrera",
    "cod_titulo", "titulo_obtenido", "estado_titulo", "reserva_1", "reserva_2", "vigente",
    "porcentaje_avance", "materias_aprobadas",
)

# Student states.
STATUS_DONE = "finalizacion_estimada"
STATUS_LEFT = "abandonó"
STATUS_ACTIVE = "estudiando"

# Calendar and label definition.
CALENDAR_FIRST = "2011_1C"
CALENDAR_LAST = "2035_2C"
LABEL_HORIZON = 4
COMPLETION_THRESHOLD = 90.0
STATUS_CUTOFF_MONTHS = 24

# Model inputs.
BASE_FEATURES = (
    "materias_en_periodo", "promo_en_periodo", "nota_media_en_periodo",
    "materias_win3", "promo_win3", "nota_win3", "dias_desde_ult_actividad",
)
DERIVED_FEATURES = ("promo_rate_period", "promo_rate_win3", "materias_cum")
NUMERIC_FEATURES = BASE_FEATURES + DERIVED_FEATURES
CATEGORY_FEATURE = "cod_carrera"
RECENCY_FEATURE = "dias_desde_ult_actividad"
IMMEDIATE_RECENCY = (
    "dias_desde_ult_actividad", "materias_en_periodo", "promo_en_periodo", "nota_media_en_periodo",
)
REPORT_FEATURES = (
    "materias_en_periodo", "promo_en_periodo", "nota_media_en_periodo",
    "materias_win3", "promo_win3", "nota_win3",
)

# Drift.
DRIFT_FEATURES = (
    "materias_en_periodo", "promo_en_periodo", "nota_media_en_periodo",
    "materias_win3", "promo_win3", "nota_win3", "dias_desde_ult_actividad",
    "promo_rate_period", "promo_rate_win3",
)
PSI_LOW = 0.10
PSI_HIGH = 0.25
PSI_FLOOR = 1e-6
PSI_BINS = 10

# Risk levels of the latest-predictions view: lower bound -> name.
RISK_LEVELS = ((0.8, "Muy Alto"), (0.6, "Alto"), (0.4, "Medio"), (0.2, "Bajo"))
RISK_LOWEST = "Muy Bajo"

# Subgroup bins: (upper bound inclusive, name); the last name is open.
COHORT_BINS = ((2014, "<=2014"), (2017, "2015-2017"), (2020, "2018-2020"), (2100, ">=2021"))
COHORT_BINS_COARSE = ((2017, "<=2017"), (2020, "2018-2020"), (2100, ">=2021"))
AGE_BINS = ((20, "<=20"), (25, "21-25"), (30, "26-30"), (120, ">30"))

# Last-activity buckets of finished students: (period before which, name).
ACTIVITY_BUCKETS = (
    ("2020_1C", "Último período < 2020"),
    ("2022_1C", "Último período 2020-2021"),
    ("2024_1C", "Último período 2022-2023"),
)
ACTIVITY_NONE = "Sin cursadas registradas"
ACTIVITY_RECENT = "Último período >= 2024"

# Studies.
HORIZONS = (2, 3, 4, 6)
COMPLETION_THRESHOLDS = (85, 88, 90, 92, 95, 100)
TOP_SHARES = (5, 10, 20, 30)
BOOTSTRAP_REPLICATES = 300
PAIRED_REPLICATES = 500
PERMUTATION_REPEATS = 10
SEED = 42

# Economic series: file column -> (table column, decimal precision, scale).
SERIES = {
    "ipc_categories": (
        ("ipc_2016_nucleo", "ipc_nucleo", 10, 4),
        ("ipc_2016_regulados", "ipc_regulados", 10, 4),
        ("ipc_2016_estacionales", "ipc_estacionales", 10, 4),
    ),
    "unemployment_rates": (
        ("eph_continua_tasa_desempleo_total_gran_san_juan",
         "eph_continua_tasa_desempleo_total_gran_san_juan", 10, 8),
    ),
    "emae_indicators": (("s_original_nivel_gral", "s_original_nivel_gral", 15, 8),),
}
