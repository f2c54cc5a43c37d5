"""Frames that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.operators import attribute as A
from creditspark.operators import clean as C
from creditspark.operators import drift as D
from creditspark.operators import evaluate as E
from creditspark.operators import split as S
from creditspark.sources import fixtures as X

# a fixed linear score for the attribution queries
COEF = {
    "grado_riesgo_num": 0.45, "plazo_meses": 0.02, "tipo_interes": 0.03, "bancarrotas_publicas": 0.1,
    "consultas_credito_ultimos_6_meses": 0.08, "antiguedad_laboral_num": -0.05, "importe_solicitado_log": 0.2,
    "puntuacion_crediticia_media": -0.004,
}
MEAN = {
    "grado_riesgo_num": 4.0, "plazo_meses": 44.0, "tipo_interes": 17.0, "bancarrotas_publicas": 1.25,
    "consultas_credito_ultimos_6_meses": 4.0, "antiguedad_laboral_num": 4.5, "importe_solicitado_log": 12.0,
    "puntuacion_crediticia_media": 650.0,
}


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A run log: every pseudo-model by issue year, decided at 0.5."""
    by_year = X.scored(spark, d, ["fecha_emision"]).withColumn("anio", F.year("fecha_emision"))
    metrics = E.compare(by_year, ["model_name", "anio"], 0.5)
    name = F.concat(F.lower("model_name"), F.lit("-"), F.col("anio").cast("string"))
    return metrics.select(name.alias("run_name"), "model_name", "anio", "accuracy", "precision", "recall", "f1", "roc_auc")


def comparison(spark: SparkSession, d: str) -> DataFrame:
    return E.compare(X.scored(spark, d), ["model_name"], 0.5).withColumnRenamed("model_name", "name")


def kpis(spark: SparkSession, d: str) -> DataFrame:
    """Champion KPI rows by issue month, as percentages."""
    rows = (
        X.scored(spark, d, ["fecha_emision"])
        .where("model_name = 'CatBoost'")
        .withColumn("mes", F.trunc("fecha_emision", "month"))
    )
    n = F.year("mes") * 12 + F.month("mes")
    percent = [
        F.round(F.col(a) * 100, 2).alias(b)
        for a, b in (("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"),
                     ("roc_auc", "roc_auc"))
    ]
    return E.compare(rows, ["mes"], 0.25).select(
        F.concat(F.lit("run_"), n.cast("string")).alias("run_id"),
        F.lit("CatBoost").alias("model_name"),
        *percent,
        F.when(n % 4 != 0, 35 + n % 20).cast("long").alias("pipeline_latency"),
        F.when(n % 3 != 0, (n % 8) / F.lit(100.0)).alias("pipeline_error_rate"),
        F.col("mes").cast("timestamp_ntz").alias("fecha_registro"),
    )


def drift_input(loans: DataFrame) -> DataFrame:
    """The columns the drift report needs, of the clean table."""
    return C.clean(loans).select("loan_id", "fecha_emision", *D.DRIFT_FEATURES.values())


DRIFT_RAW = [
    "loan_id", "fecha_emision", "estado_prestamo", "importe_solicitado", "puntuacion_crediticia_media",
    "antiguedad_laboral", "ratio_prestamo_ingresos", "ingresos_anuales", "tipo_interes", "plazo_prestamo",
    "grado_riesgo", "porcentaje_uso_credito_revolving", "consultas_credito_ultimos_6_meses",
]


def psi_table(spark: SparkSession, d: str, drifted: bool = False) -> DataFrame:
    source = X.loans_drift if drifted else X.loans
    rows = drift_input(source(spark, d, DRIFT_RAW))
    return D.psi_report(rows, "fecha_emision", "loan_id", cut=baseline(spark, d))


def baseline(spark: SparkSession, d: str) -> tuple[Column, int]:
    """First 80% of the mature loans by issue date; the cut reads orders only."""
    keys = X.mature_loans(spark, d, ["loan_id", "fecha_emision"])
    return S.chrono_cut(keys, "fecha_emision", D.BASELINE_FRACTION, "loan_id")


def split_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean table with its split; the cuts are found on two columns of orders."""
    keys = X.mature_loans(spark, d, ["loan_id"])
    return S.with_split(X.clean_loans(spark, d), "target", "loan_id", fit=keys)


def contributions(spark: SparkSession, d: str) -> DataFrame:
    return A.linear_contributions(X.clean_loans(spark, d), COEF, MEAN)


def champion_scores(spark: SparkSession, d: str) -> DataFrame:
    return X.scored(spark, d).where("model_name = 'CatBoost'")


def local_profiles(spark: SparkSession, d: str) -> DataFrame:
    raw = C.select_present(X.clean_loans(spark, d), C.MODEL_NUMERIC + C.MODEL_CATEGORICAL, ["loan_id"])
    return A.local_document(contributions(spark, d), champion_scores(spark, d), raw)
