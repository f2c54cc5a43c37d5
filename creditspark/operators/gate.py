"""Quality gates: each yields rows (test, passed, message, drift)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.operators.drift import PSI_LIMIT
from creditspark.operators.profile import missing_columns
from creditspark.operators.reshape import model_exists, with_default

# --- fixed values -----------------------------------------------------------
REQUIRED_COLUMNS = ["target", "importe_solicitado", "ingresos_anuales"]
MINIMA = {"f1_score": ("F1-score", 35.0), "roc_auc": ("ROC-AUC", 65.0), "recall": ("Recall", 50.0)}
EDA_SECTIONS = ["dimensions", "nulls", "target_distribution", "descriptive_stats", "correlation"]
EDA_PREFIX = "eda_"
TESTS = ["Test 1", "Test 2", "Test 3", "Test 4", "Test 5", "Test 6"]
# -----------------------------------------------------------------------------


def _row(df: DataFrame, test: str, passed: Column, good: Column | str, bad: Column, drift: Column | None = None) -> DataFrame:
    ok = F.coalesce(passed, F.lit(False))
    good = F.lit(good) if isinstance(good, str) else good
    return df.select(
        F.lit(test).alias("test"),
        ok.alias("passed"),
        F.when(ok, F.concat(F.lit("Pass: "), good)).otherwise(F.concat(F.lit("Fail: "), bad)).alias("message"),
        (F.lit(False) if drift is None else F.coalesce(drift, F.lit(False))).alias("drift"),
    )


def gate_schema(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Required columns present, at least one row."""
    missing = missing_columns(df, required)
    rows = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    if missing:
        return _row(rows, TESTS[0], F.lit(False), "", F.lit(f"Columnas requeridas ausentes: {missing}"))
    return _row(rows, TESTS[0], F.col("n") > 0, "Dataset limpio válido.", F.lit("Tabla vacía."))


def gate_performance(kpis: DataFrame, minima=MINIMA) -> DataFrame:
    """Champion percentages reach their minima; the message lists the ones that do not. Without a KPI row the gate fails."""
    nothing = kpis.sparkSession.range(1).select(
        *[F.lit(None).cast(kpis.schema[c].dataType).alias(c) for c in minima], F.lit(False).alias("__known"),
    )
    kpis = with_default(kpis.select(*minima, F.lit(True).alias("__known")), nothing)
    failures = [
        F.when(
            F.col(c).isNull() | (F.col(c) < limit),
            F.concat(F.lit(f"{label} "), F.coalesce(F.col(c).cast("string"), F.lit("nan")), F.lit(f"% < {limit}%")),
        )
        for c, (label, limit) in minima.items()
    ]
    text = F.concat_ws(", ", *failures)
    return _row(
        kpis, TESTS[1], F.col("__known") & (text == ""), "Umbrales de rendimiento cumplidos.",
        F.when(F.col("__known"), F.concat(F.lit("Incumplimiento de umbral: "), text)).otherwise("Sin métricas del campeón."),
    )


def gate_drift(psi: DataFrame, limit: float = PSI_LIMIT) -> DataFrame:
    """No feature reaches the PSI limit. Skip the gate when there are no metrics."""
    over = F.col("psi_value") >= limit
    named = F.struct(
        (-F.col("psi_value")).alias("o"),
        F.concat(F.col("feature_name"), F.lit(" (PSI="), F.col("psi_value").cast("string"), F.lit(")")).alias("t"),
    )
    one = psi.agg(F.count_if(over).alias("n"), F.array_sort(F.collect_list(F.when(over, named))).alias("hits"))
    text = F.concat_ws(", ", F.transform("hits", lambda h: h["t"]))
    return _row(
        one, TESTS[2], F.col("n") == 0, "Sin drift crítico.", F.concat(F.lit("Drift crítico en: "), text), F.col("n") > 0
    )


def gate_model(champion: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """The champion's display name is in the model list. Without a champion the gate fails."""
    nobody = champion.sparkSession.range(1).select(F.lit(None).cast("string").alias(name))
    seen = model_exists(with_default(champion.select(F.col(name).cast("string").alias(name)), nobody), models, name)
    return _row(
        seen, TESTS[3], F.col("found") & F.col("display_name").isNotNull(),
        F.concat(F.lit("Modelo "), F.col("display_name"), F.lit(" localizado.")),
        F.coalesce(F.concat(F.lit("No se encontró el modelo '"), F.col("display_name"), F.lit("'.")), F.lit("No hay campeón.")),
    )


def gate_model_path(spark, exists: bool, path: str) -> DataFrame:
    """Fallback without a model list: the saved model is there."""
    return _row(
        spark.range(1), TESTS[3], F.lit(exists), "Modelo guardado encontrado.",
        F.lit(f"No se encontró el modelo guardado '{path}'."),
    )


def gate_attribution(doc: DataFrame, col: str = "shap") -> DataFrame:
    """The JSON document has `global` and `local` and no `error`."""
    keys = F.json_object_keys(col)
    ok = F.array_contains(keys, "global") & F.array_contains(keys, "local") & ~F.array_contains(keys, "error")
    return _row(doc, TESTS[4], ok, "Integración de atribución validada.", F.lit("Estructura de atribución inválida."))


def gate_eda(doc: DataFrame, col: str = "eda", sections: Sequence[str] = EDA_SECTIONS) -> DataFrame:
    """The JSON document has every section, all plain or all prefixed."""
    keys = F.json_object_keys(col)

    def has_all(names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.array_contains(keys, n) for n in names])

    ok = has_all(sections) | has_all([EDA_PREFIX + s for s in sections])
    return _row(doc, TESTS[5], ok, "Estructura de EDA validada.", F.lit("Faltan secciones estructuradas en el EDA."))


def all_gates(gates: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def gate_rollup(gates: DataFrame, expected: Sequence[str] = TESTS) -> DataFrame:
    """All passed, and whether to retrain: only a drift breach asks for it. An expected test without a row has failed."""
    absent = F.size(F.array_except(F.array(*map(F.lit, expected)), F.collect_set("test")))
    return gates.agg(
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("__passed"),
        F.coalesce(F.bool_or("drift"), F.lit(False)).alias("retrain"),
        F.count_if(~F.col("passed")).alias("__failed"), absent.cast("long").alias("__absent"),
    ).select(
        (F.col("__passed") & (F.col("__absent") == 0)).alias("all_passed"), "retrain",
        (F.col("__failed") + F.col("__absent")).alias("failed"),
    )
