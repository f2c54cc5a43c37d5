"""Queries of filters, projections and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions import scalars as S
from creditspark.functions.hashing import bernoulli
from creditspark.functions.semantics import clean_percent, log1p_np, or_default, round_k
from creditspark.operators import clean as C
from creditspark.operators import drift as D
from creditspark.operators import rank as R
from creditspark.operators import reshape as H
from creditspark.operators import split as P
from creditspark.plans import inputs as I
from creditspark.plans import sql as Q
from creditspark.plans.registry import query
from creditspark.sources import fixtures as X


@query("loans", Q.sql(Q.LOANS, "SELECT * FROM loans"))
def _(spark, d):
    return X.loans(spark, d)


@query("mature_filter", Q.sql(Q.MATURE, "SELECT loan_id, estado_prestamo FROM mature"))
def _(spark, d):
    return C.mature_filter(X.loans(spark, d, ["loan_id", "estado_prestamo"]))


@query("binarize_target", Q.sql(Q.MATURE, "SELECT loan_id, target FROM mature"))
def _(spark, d):
    return C.ensure_target(X.loans(spark, d, ["loan_id", "estado_prestamo"])).select("loan_id", "target")


@query("clean_percent", Q.sql(Q.LOANS, f"""SELECT loan_id, {Q.percent('tipo_interes')} AS tipo_interes,
  {Q.percent('porcentaje_uso_credito_revolving')} AS porcentaje_uso_credito_revolving FROM loans"""))
def _(spark, d):
    raw = X.loans(spark, d, ["loan_id", *C.PERCENT_COLUMNS])
    return raw.select("loan_id", *[clean_percent(c).alias(c) for c in C.PERCENT_COLUMNS])


@query("parse_term", Q.sql(Q.LOANS, f"SELECT loan_id, {Q.TERM} AS plazo_meses FROM loans"))
def _(spark, d):
    return X.loans(spark, d, ["loan_id", "plazo_prestamo"]).select(
        "loan_id", S.term_months("plazo_prestamo").alias("plazo_meses")
    )


@query("map_seniority", Q.sql(Q.LOANS, f"SELECT loan_id, {Q.SENIORITY_CASE} AS antiguedad_laboral_num FROM loans"))
def _(spark, d):
    return X.loans(spark, d, ["loan_id", "antiguedad_laboral"]).select(
        "loan_id", S.map_ordinal("antiguedad_laboral", S.SENIORITY, 0.0).alias("antiguedad_laboral_num")
    )


@query("map_grade", Q.sql(Q.LOANS, f"SELECT loan_id, {Q.GRADE_CASE} AS grado_riesgo_num FROM loans"))
def _(spark, d):
    return X.loans(spark, d, ["loan_id", "grado_riesgo"]).select(
        "loan_id", S.map_ordinal("grado_riesgo", S.GRADE, 4.0).alias("grado_riesgo_num")
    )


DEFAULTS = {
    "importe_solicitado": 0.0, "tipo_interes": S.DEFAULT_RATE, "ingresos_anuales": 1.0,
    "porcentaje_uso_credito_revolving": 0.0, "consultas_credito_ultimos_6_meses": 0.0,
}


@query("fill_defaults", Q.sql(Q.CLEAN, "SELECT loan_id, " + ", ".join(
    f"coalesce({c}, {v}e0) AS {c}" for c, v in DEFAULTS.items()) + " FROM clean"))
def _(spark, d):
    return X.clean_loans(spark, d).select("loan_id", *[or_default(c, v).alias(c) for c, v in DEFAULTS.items()])


FORMULAS = ["cuota_mensual_estimada", "ratio_carga_financiera", "ingreso_residual_anual", "alerta_sobreendeudamiento"]


def _formula(name: str, column: str) -> None:
    @query(name, Q.sql(Q.CLEAN, f"SELECT loan_id, {column} FROM clean"))
    def _(spark, d):
        return X.clean_loans(spark, d).select("loan_id", column)


for _name, _column in zip(["est_installment", "burden_ratio", "residual_income", "overdebt_alert"], FORMULAS):
    _formula(_name, _column)


@query("log_features", Q.sql(Q.LOANS, """SELECT loan_id, round(ln(1e0 + coalesce(ingresos_anuales, 0e0)), 6) AS ingresos_anuales_log,
  round(ln(1e0 + coalesce(importe_solicitado, 0e0)), 6) AS importe_solicitado_log FROM loans"""))
def _(spark, d):
    return X.loans(spark, d, ["loan_id", "ingresos_anuales", "importe_solicitado"]).select(
        "loan_id",
        F.round(log1p_np("ingresos_anuales"), 6).alias("ingresos_anuales_log"),
        F.round(log1p_np("importe_solicitado"), 6).alias("importe_solicitado_log"),
    )


ROUNDED = ["ingresos_anuales_log", "importe_solicitado_log"]


@query("loan_features", Q.sql(Q.CLEAN, "SELECT * REPLACE (" + ", ".join(
    f"round({c}, 4) AS {c}" for c in ROUNDED) + ") FROM clean"))
def _(spark, d):
    return X.clean_loans(spark, d).withColumns({c: F.round(c, 4) for c in ROUNDED})


@query("select_present", Q.sql(Q.CLEAN, "SELECT loan_id, " + ", ".join(
    f"round({c}, 4) AS {c}" if c in ROUNDED else c for c in C.MODEL_NUMERIC + C.MODEL_CATEGORICAL) + " FROM clean"))
def _(spark, d):
    wanted = C.MODEL_NUMERIC + C.MODEL_CATEGORICAL + ["columna_ausente"]
    present = C.select_present(X.clean_loans(spark, d), wanted, ["loan_id"])
    return present.withColumns({c: F.round(c, 4) for c in ROUNDED if c in present.columns})


@query("parse_issue_date", Q.sql(Q.LOANS, """SELECT loan_id, CASE WHEN loan_id % 50 = 0 THEN NULL
  ELSE strftime(fecha_emision, '%Y-%m-%d %H:%M:%S') END AS fecha FROM loans"""))
def _(spark, d):
    raw = X.loans(spark, d, ["loan_id", "fecha_emision"])
    text = F.when(F.col("loan_id") % 50 == 0, "sin fecha").otherwise(F.date_format("fecha_emision", "yyyy-MM-dd"))
    parsed = S.parse_issue_date(text)
    return raw.select("loan_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("fecha"))


@query("label_nan", Q.sql(Q.LOANS, """SELECT loan_id, coalesce(grado_riesgo, 'nan') AS grado,
  coalesce(antiguedad_laboral, 'nan') AS antiguedad FROM loans"""))
def _(spark, d):
    return X.loans(spark, d, ["loan_id", "grado_riesgo", "antiguedad_laboral"]).select(
        "loan_id", S.label_nan("grado_riesgo").alias("grado"), S.label_nan("antiguedad_laboral").alias("antiguedad")
    )


@query("scale_pct_value", Q.sql(Q.SCORED, """, x AS (SELECT loan_id, model_name, CASE WHEN loan_id % 2 = 0 THEN prob
  ELSE prob * 100 END AS v FROM scored) SELECT loan_id, model_name,
  round(CASE WHEN v <= 1 THEN v * 100 ELSE v END, 6) AS percent, round(CASE WHEN v > 1 THEN v / 100 ELSE v END, 6) AS fraction
  FROM x"""))
def _(spark, d):
    v = F.when(F.col("loan_id") % 2 == 0, F.col("prob")).otherwise(F.col("prob") * 100)
    return X.scored(spark, d).select(
        "loan_id", "model_name",
        F.round(S.to_percent(v), 6).alias("percent"), F.round(S.to_fraction(v), 6).alias("fraction"),
    )


@query("scale_pct_column", Q.sql(Q.KPIS, """SELECT run_id,
  round(CASE WHEN (SELECT max(f1_score) > 1 FROM kpis) THEN f1_score / 100 ELSE f1_score END, 3) AS f1_score,
  round(CASE WHEN (SELECT max(pipeline_error_rate) > 1 FROM kpis) THEN pipeline_error_rate / 100
    ELSE pipeline_error_rate END, 3) AS pipeline_error_rate FROM kpis"""))
def _(spark, d):
    rows = I.kpis(spark, d).select("run_id", "f1_score", "pipeline_error_rate")
    return H.scale_column(H.scale_column(rows, "f1_score"), "pipeline_error_rate")


@query("label_time", Q.sql(Q.LOANS, """SELECT loan_id,
  strftime(fecha_emision + to_minutes(CAST(loan_id % 1440 AS INT)), '%d/%m %H:%M') AS etiqueta FROM loans"""))
def _(spark, d):
    minute = F.make_dt_interval(mins=(F.col("loan_id") % 1440).cast("int"))
    return X.loans(spark, d, ["loan_id", "fecha_emision"]).select(
        "loan_id", S.label_time(F.col("fecha_emision") + minute).alias("etiqueta")
    )


@query("model_family", Q.sql(Q.RUNS, """SELECT run_name, CASE WHEN run_name LIKE '%catboost%' THEN 'CatBoost'
  WHEN run_name LIKE '%xgboost%' THEN 'XGBoost' ELSE 'LightGBM' END AS family FROM runs"""))
def _(spark, d):
    return I.runs(spark, d).select("run_name", S.model_family("run_name").alias("family"))


@query("find_metric_col", Q.sql(Q.RUNS, "SELECT run_name, f1, roc_auc, accuracy, recall, precision FROM runs"))
def _(spark, d):
    tracked = I.runs(spark, d).select(
        "run_name", *[F.col(c).alias(f"metric.{c.upper()}_score") for c in ("accuracy", "precision", "recall", "f1", "roc_auc")]
    )
    flat = tracked.toDF(*[c.replace(".", "_") for c in tracked.columns])
    return S.standard_metrics(flat)


@query("rename_features", Q.sql(Q.CLEAN, "SELECT loan_id, " + ", ".join(
    f"{c} AS {label}" for label, c in D.DRIFT_FEATURES.items()) + " FROM clean"))
def _(spark, d):
    return D.rename_features(X.clean_loans(spark, d), D.DRIFT_FEATURES, ["loan_id"])


CONTRIBUTION_SQL = "SELECT loan_id, feature, value, contribution FROM (" + " UNION ALL ".join(
    f"SELECT loan_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
    f"{b!r}e0 * (coalesce(CAST({c} AS DOUBLE), {I.MEAN[c]!r}e0) - {I.MEAN[c]!r}e0) AS contribution FROM clean"
    for c, b in I.COEF.items()) + ")"


@query("effect_label", Q.sql(Q.CLEAN + f", contrib AS ({CONTRIBUTION_SQL})", """SELECT loan_id, feature,
  CASE WHEN contribution > 0 THEN 'Incrementa riesgo' ELSE 'Reduce riesgo' END AS effect FROM contrib"""))
def _(spark, d):
    from creditspark.operators.attribute import long_form

    return long_form(I.contributions(spark, d)).select("loan_id", "feature", S.effect_label("contribution").alias("effect"))


@query("round_k", Q.sql(Q.SCORED, """SELECT loan_id, model_name, round(prob, 2) AS r2, round(prob, 3) AS r3,
  round(prob, 4) AS r4, round(prob * 100, 2) AS pct FROM scored"""))
def _(spark, d):
    return X.scored(spark, d).select(
        "loan_id", "model_name", *[round_k("prob", k).alias(f"r{k}") for k in (2, 3, 4)],
        round_k(F.col("prob") * 100, 2).alias("pct"),
    )


@query("null_to_default", Q.sql(Q.KPIS, """SELECT run_id, coalesce(pipeline_latency, 45) AS pipeline_latency,
  coalesce(pipeline_error_rate, 0e0) AS pipeline_error_rate FROM kpis"""))
def _(spark, d):
    return I.kpis(spark, d).select(
        "run_id", or_default("pipeline_latency", 45).alias("pipeline_latency"),
        or_default("pipeline_error_rate", 0.0).alias("pipeline_error_rate"),
    )


# --- scans, samples and splits ---------------------------------------------------


@query("scan_projection", Q.sql(Q.CLEAN, """SELECT fecha_emision, importe_solicitado, puntuacion_crediticia_media,
  antiguedad_laboral_num, ratio_prestamo_ingresos, ingresos_anuales FROM clean"""))
def _(spark, d):
    return X.clean_loans(spark, d).select("fecha_emision", *D.DRIFT_FEATURES.values())


@query("scan_head", Q.sql(Q.MATURE, "SELECT loan_id, importe_solicitado, target FROM mature ORDER BY loan_id LIMIT 10"))
def _(spark, d):
    return R.head(X.mature_loans(spark, d, ["loan_id", "importe_solicitado"]).drop("estado_prestamo"), 10, ["loan_id"])


@query("scan_sample", Q.sql(Q.LOANS, f"""SELECT loan_id, importe_solicitado FROM loans
  WHERE substr({Q.hash_text('loan_id', 42)}, 1, 8) < '1999999a'"""))
def _(spark, d):
    return P.scan_sample(X.loans(spark, d, ["loan_id", "importe_solicitado"]), 0.1, "loan_id")


@query("eda_sample", Q.sql(Q.MATURE, f"""SELECT 'raw' AS source, loan_id FROM (SELECT loan_id,
  row_number() OVER (ORDER BY {Q.hash_order()}) AS r, round_even(count(*) OVER () * 0.1e0, 0) AS k FROM loans) WHERE r <= k
  UNION ALL SELECT 'clean', loan_id FROM (SELECT loan_id, row_number() OVER (ORDER BY {Q.hash_order(salt='42-clean')}) AS r,
  round_even(count(*) OVER () * 0.1e0, 0) AS k FROM mature) WHERE r <= k"""))
def _(spark, d):
    raw = P.sample_exact(X.loans(spark, d, ["loan_id"]), 0.1, "loan_id")
    clean = P.sample_exact(X.mature_loans(spark, d, ["loan_id"]), 0.1, "loan_id", "42-clean")
    return raw.select(F.lit("raw").alias("source"), "loan_id").union(clean.select(F.lit("clean"), "loan_id"))


@query("sample_n", Q.sql(Q.MATURE + Q.split("mature", "parted", 42), f"""SELECT loan_id FROM parted WHERE NOT train
  ORDER BY {Q.hash_order(salt='42-n')} LIMIT 500"""))
def _(spark, d):
    rows = X.mature_loans(spark, d, ["loan_id"])
    _, test = P.stratified_split(rows, "target", 0.2, "loan_id")
    return P.sample_n(test.select("loan_id"), 500, "loan_id", "42-n")


@query("stratified_split", Q.sql(Q.MATURE + Q.split("mature", "parted", 42),
                                 "SELECT loan_id, target, train FROM parted"))
def _(spark, d):
    rows = X.mature_loans(spark, d, ["loan_id"]).select("loan_id", "target")
    return P.with_train(rows, "target", 0.2, "loan_id")


@query("nested_split", Q.sql(Q.SPLIT, "SELECT loan_id, target, split FROM parted"))
def _(spark, d):
    return P.with_split(X.mature_loans(spark, d, ["loan_id"]).select("loan_id", "target"), "target", "loan_id")


@query("chrono_split", Q.sql(Q.LOANS + Q.chrono("loans", "timed"), "SELECT loan_id, fecha_emision, first FROM timed"))
def _(spark, d):
    rows = X.loans(spark, d, ["loan_id", "fecha_emision"])
    return rows.withColumn("first", P.chrono_predicate(rows, "fecha_emision", 0.8, "loan_id"))


@query("kfold_column", Q.sql(Q.MATURE, f"""SELECT loan_id, target,
  CAST(r > n // 3 AS INT) + CAST(r > n * 2 // 3 AS INT) AS fold FROM (SELECT *, count(*) OVER (PARTITION BY target) AS n,
  row_number() OVER (PARTITION BY target ORDER BY {Q.hash_order()}) AS r FROM mature)"""))
def _(spark, d):
    rows = X.mature_loans(spark, d, ["loan_id"]).select("loan_id", "target")
    return P.kfold(rows, "target", 3, "loan_id")


@query("csv_row_sample", Q.sql(Q.LOANS, f"""SELECT loan_id, importe_solicitado, tipo_interes FROM loans
  WHERE substr({Q.hash_text('loan_id', 42)}, 1, 8) < '40000000'"""))
def _(spark, d):
    from creditspark.plans.q_files import loans_through_csv

    rows = loans_through_csv(spark, d).where(bernoulli("loan_id", 0.25, 42))
    return rows.select("loan_id", "importe_solicitado", "tipo_interes")
