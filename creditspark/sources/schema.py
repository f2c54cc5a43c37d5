"""Table definitions: the raw loan file and the governance tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: column names of the raw loan file ---------------------------
LOAN_DOUBLES = [
    "puntuacion_crediticia_min", "puntuacion_crediticia_max", "importe_solicitado", "importe_financiado",
    "ratio_prestamo_ingresos", "ingresos_anuales", "puntuacion_crediticia_media", "bancarrotas_publicas",
    "consultas_credito_ultimos_6_meses", "impago_ultimos_2_anios", "cuota_mensual", "lineas_credito_abiertas",
    "registros_publicos_negativos", "saldo_credito_revolving", "total_lineas_credito", "capital_pendiente",
    "total_pagado", "capital_pagado", "intereses_pagados", "importe_ultimo_pago", "cuentas_hipotecarias",
    "importe_no_financiado", "ratio_financiacion",
]
LOAN_STRINGS = [
    "tipo_interes", "plazo_prestamo", "antiguedad_laboral", "grado_riesgo", "finalidad_prestamo",
    "estado_prestamo", "tipo_vivienda", "porcentaje_uso_credito_revolving", "fecha_emision",
    "estado_verificacion_ingresos", "plan_pagos_activo", "tipo_solicitud", "fecha_primera_linea_credito",
    "fecha_ultimo_pago", "fecha_proximo_pago",
]
# Governance tables: (column, type, required). The last column is filled with the
# load time by default.
GOVERNANCE_TABLES = {
    "t_modelo_campeon_kpis": [
        ("run_id", "string", False), ("model_name", "string", True), ("accuracy", "double", True),
        ("precision", "double", True), ("recall", "double", True), ("f1_score", "double", True),
        # a month whose loans are all of one class has no AUC
        ("roc_auc", "double", False), ("pipeline_latency", "bigint", False),
        ("pipeline_error_rate", "double", False), ("fecha_registro", "timestamp", False),
    ],
    "t_modelo_comparativa": [
        ("run_id", "string", False), ("model_name", "string", True), ("accuracy", "double", True),
        ("precision", "double", True), ("recall", "double", True), ("f1_score", "double", True),
        ("roc_auc", "double", True), ("es_campeon", "boolean", True), ("fecha_evaluacion", "timestamp", False),
    ],
    "t_modelo_evaluacion_temporal": [
        ("semana_etiqueta", "string", True), ("f1_score", "double", True), ("roc_auc", "double", True),
        ("fecha_auditoria", "date", False),
    ],
    "t_modelo_data_drift_psi": [
        ("feature_name", "string", True), ("psi_value", "double", True), ("fecha_auditoria", "timestamp", False),
    ],
    "t_modelo_shap_global": [
        ("feature_name", "string", True), ("shap_importance", "double", True), ("fecha_calculo", "timestamp", False),
    ],
    "t_modelo_shap_local": [
        ("perfil_tipo", "string", True), ("probability_pct", "double", True), ("feature_name", "string", True),
        ("feature_value", "string", True), ("shap_impact", "double", True), ("orden", "bigint", True),
        ("fecha_calculo", "timestamp", False),
    ],
    "t_quality_test_log": [
        ("gcp_project", "string", False), ("gcs_bucket", "string", False), ("results", "string", False),
        ("fecha_registro", "timestamp", False),
    ],
}
# -----------------------------------------------------------------------------

LOAN_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in LOAN_STRINGS]
    + [T.StructField(c, T.DoubleType()) for c in LOAN_DOUBLES]
)

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("champion_name", T.StringType()),
    T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.StructType([
            T.StructField(m, T.DoubleType()) for m in ("accuracy", "precision", "recall", "f1", "roc_auc")
        ])),
    ]))),
])

QUALITY_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("results", T.MapType(T.StringType(), T.StringType())),
    T.StructField("gcp_project", T.StringType()),
    T.StructField("gcs_bucket", T.StringType()),
])


def required_columns(table: str) -> list[str]:
    return [c for c, _, required in GOVERNANCE_TABLES[table] if required]


def table_ddl(table: str, full_name: str) -> str:
    """CREATE TABLE with the last column defaulting to the load time."""
    parts = []
    columns = GOVERNANCE_TABLES[table]
    for i, (name, kind, _) in enumerate(columns):
        default = ""
        if i == len(columns) - 1:
            default = " DEFAULT current_date()" if kind == "date" else " DEFAULT current_timestamp()"
        parts.append(f"`{name}` {kind}{default}")
    return f"CREATE TABLE IF NOT EXISTS {full_name} ({', '.join(parts)}) USING parquet"
