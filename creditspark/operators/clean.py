"""Target definition and feature engineering of the loan table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.functions import scalars as S
from creditspark.functions.semantics import clean_percent, log1p_np, or_default

# --- fixed values -----------------------------------------------------------
PAID = ["Pagado completamente"]
DEFAULTED = ["Incobrable", "Default", "Retraso de 31 a 120 días"]
PERCENT_COLUMNS = ["tipo_interes", "porcentaje_uso_credito_revolving"]
MODEL_NUMERIC = [
    "importe_solicitado_log", "ingresos_anuales_log", "ratio_prestamo_ingresos", "puntuacion_crediticia_media",
    "bancarrotas_publicas", "consultas_credito_ultimos_6_meses", "impago_ultimos_2_anios", "tipo_interes",
    "porcentaje_uso_credito_revolving", "plazo_meses", "antiguedad_laboral_num", "grado_riesgo_num",
    "cuota_mensual_estimada", "ratio_carga_financiera", "ingreso_residual_anual", "alerta_sobreendeudamiento",
]
MODEL_CATEGORICAL = ["finalidad_prestamo", "tipo_vivienda"]
PROFILE_NUMERIC = [
    "importe_solicitado", "ingresos_anuales", "ratio_prestamo_ingresos", "puntuacion_crediticia_media",
    "bancarrotas_publicas", "consultas_credito_ultimos_6_meses", "impago_ultimos_2_anios", "tipo_interes",
    "porcentaje_uso_credito_revolving", "plazo_meses", "antiguedad_laboral_num", "grado_riesgo_num",
    "cuota_mensual_estimada", "ratio_carga_financiera", "ingreso_residual_anual", "alerta_sobreendeudamiento",
    "ingresos_anuales_log", "importe_solicitado_log",
]
PROFILE_CATEGORICAL = ["grado_riesgo", "finalidad_prestamo"]
# -----------------------------------------------------------------------------


def mature_filter(df: DataFrame, status: str = "estado_prestamo") -> DataFrame:
    """Loans whose outcome is known; unknown and NULL states go."""
    return df.where(F.col(status).isin(PAID + DEFAULTED))


def binarize_target(df: DataFrame, status: str = "estado_prestamo", target: str = "target") -> DataFrame:
    return df.withColumn(target, F.when(F.col(status).isin(DEFAULTED), 1).otherwise(0))


def ensure_target(df: DataFrame, status: str = "estado_prestamo") -> DataFrame:
    """A frame without a target gets the maturity filter and the target."""
    return df if "target" in df.columns else binarize_target(mature_filter(df, status))


def loan_features(df: DataFrame) -> DataFrame:
    """Cleaned percentages and the nine engineered columns.

    Source columns keep their NULLs; defaults apply inside the formulas only.
    """
    have = set(df.columns)
    parsed = {c: clean_percent(c) for c in PERCENT_COLUMNS if c in have}
    parsed["plazo_meses"] = (
        S.term_months("plazo_prestamo") if "plazo_prestamo" in have else F.lit(S.DEFAULT_TERM_MONTHS)
    )
    parsed["antiguedad_laboral_num"] = (
        S.map_ordinal("antiguedad_laboral", S.SENIORITY, 0.0) if "antiguedad_laboral" in have else F.lit(0.0)
    )
    parsed["grado_riesgo_num"] = (
        S.map_ordinal("grado_riesgo", S.GRADE, 4.0) if "grado_riesgo" in have else F.lit(4.0)
    )
    amount = or_default("importe_solicitado", 0.0)
    income = or_default("ingresos_anuales", 1.0)
    installment = F.col("cuota_mensual_estimada")
    return (
        df.withColumns(parsed)
        .withColumn(
            "cuota_mensual_estimada",
            S.est_installment(amount, or_default("tipo_interes", S.DEFAULT_RATE), F.col("plazo_meses")),
        )
        .withColumns({
            "ratio_carga_financiera": S.burden_ratio(installment, income),
            "ingreso_residual_anual": S.residual_income(installment, income),
            "alerta_sobreendeudamiento": S.overdebt_alert(
                or_default("porcentaje_uso_credito_revolving", 0.0),
                or_default("consultas_credito_ultimos_6_meses", 0.0),
            ),
            "ingresos_anuales_log": log1p_np("ingresos_anuales"),
            "importe_solicitado_log": log1p_np("importe_solicitado"),
        })
    )


def clean(df: DataFrame) -> DataFrame:
    """Raw loans to the clean table."""
    return df.transform(mature_filter).transform(binarize_target).transform(loan_features)


def select_present(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist, after the `keep` columns."""
    return df.select(*keep, *[c for c in cols if c in df.columns])
