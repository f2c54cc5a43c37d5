"""Queries of ranking, small joins, nested documents, attribution reports and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.functions.scalars import model_family
from creditspark.operators import attribute as A
from creditspark.operators import drift as D
from creditspark.operators import gate as G
from creditspark.operators import rank as R
from creditspark.operators import reshape as H
from creditspark.plans import inputs as I
from creditspark.plans import sql as Q
from creditspark.plans.q_columns import CONTRIBUTION_SQL
from creditspark.plans.registry import query
from creditspark.sources import fixtures as X

RUN_COLUMNS = "run_name, model_name, anio, accuracy, precision, recall, f1, roc_auc"
FAMILY = "CASE WHEN run_name LIKE '%catboost%' THEN 'CatBoost' WHEN run_name LIKE '%xgboost%' THEN 'XGBoost' ELSE 'LightGBM' END"


# --- winners and orders -----------------------------------------------------------


@query("best_run", Q.sql(Q.RUNS, f"SELECT {RUN_COLUMNS} FROM runs ORDER BY f1 DESC, run_name LIMIT 1"))
def _(spark, d):
    return R.best_run(I.runs(spark, d))


@query("best_per_family", Q.sql(Q.RUNS, f""", r AS (SELECT *, {FAMILY} AS name,
  row_number() OVER (PARTITION BY {FAMILY} ORDER BY f1 DESC, run_name) AS i FROM runs)
  SELECT name, round(f1, 3) AS f1, round(roc_auc, 3) AS roc_auc, round(accuracy, 3) AS accuracy, round(recall, 3) AS recall
  FROM r WHERE i = 1"""))
def _(spark, d):
    return R.best_per_family(I.runs(spark, d))


CHAMPION = """, champ AS (SELECT * FROM comparison WHERE f1 > (SELECT max(f1) FROM comparison) - 1e-5
  ORDER BY roc_auc DESC, name LIMIT 1)"""


@query("champion", Q.sql(Q.COMPARISON + CHAMPION, "SELECT * FROM champ"))
def _(spark, d):
    return R.champion(I.comparison(spark, d))


@query("champion_in_order", Q.sql("RECURSIVE " + Q.RUNS, """, numbered AS (
  SELECT *, row_number() OVER (ORDER BY run_name) AS i FROM runs), fold AS (
  SELECT i, run_name, f1, roc_auc FROM numbered WHERE i = 1 UNION ALL
  SELECT n.i,
    CASE WHEN n.f1 > f.f1 OR (abs(n.f1 - f.f1) < 1e-5 AND n.roc_auc > f.roc_auc) THEN n.run_name ELSE f.run_name END,
    CASE WHEN n.f1 > f.f1 OR (abs(n.f1 - f.f1) < 1e-5 AND n.roc_auc > f.roc_auc) THEN n.f1 ELSE f.f1 END,
    CASE WHEN n.f1 > f.f1 OR (abs(n.f1 - f.f1) < 1e-5 AND n.roc_auc > f.roc_auc) THEN n.roc_auc ELSE f.roc_auc END
  FROM fold f JOIN numbered n ON n.i = f.i + 1)
  SELECT run_name, f1, roc_auc FROM fold ORDER BY i DESC LIMIT 1"""))
def _(spark, d):
    log = I.runs(spark, d).select("run_name", "f1", "roc_auc")
    return R.champion_in_order(log, "run_name", name="run_name")


@query("latest_kpi", Q.sql(Q.KPIS, "SELECT * FROM kpis ORDER BY fecha_registro DESC LIMIT 1"))
def _(spark, d):
    return R.latest(I.kpis(spark, d), "fecha_registro")


@query("kpi_history", Q.sql(Q.KPIS, """SELECT * FROM (SELECT 'oldest' AS part, f1_score, roc_auc, fecha_registro FROM kpis
  ORDER BY fecha_registro LIMIT 7) UNION ALL SELECT * FROM (SELECT 'newest', f1_score, roc_auc, fecha_registro FROM kpis
  ORDER BY fecha_registro DESC LIMIT 7)"""))
def _(spark, d):
    rows = I.kpis(spark, d).select("f1_score", "roc_auc", "fecha_registro")
    old = R.history(rows, "fecha_registro").select(F.lit("oldest").alias("part"), "*")
    return old.union(R.history(rows, "fecha_registro", newest=True).select(F.lit("newest"), "*"))


@query("comparison_order", Q.sql(Q.COMPARISON, "SELECT name, f1, roc_auc, accuracy, recall FROM comparison ORDER BY f1 DESC, name"))
def _(spark, d):
    rows = I.comparison(spark, d).select("name", "f1", "roc_auc", "accuracy", "recall")
    return R.ordered(rows, F.col("f1").desc(), "name")


@query("evolution_order", Q.sql(Q.KPIS, """SELECT run_id AS semana_etiqueta, f1_score, roc_auc, CAST(fecha_registro AS DATE) AS fecha_auditoria
  FROM kpis ORDER BY fecha_auditoria, semana_etiqueta"""))
def _(spark, d):
    rows = I.kpis(spark, d).select(
        F.col("run_id").alias("semana_etiqueta"), "f1_score", "roc_auc",
        F.col("fecha_registro").cast("date").alias("fecha_auditoria"),
    )
    return R.ordered(rows, "fecha_auditoria", "semana_etiqueta")


@query("drift_order", Q.sql(Q.PSI, "SELECT feature_name, psi_value FROM psi ORDER BY psi_value DESC, feature_name"))
def _(spark, d):
    return R.ordered(I.psi_table(spark, d), F.col("psi_value").desc(), "feature_name")


CONTRIB = Q.CLEAN + f", contrib AS ({CONTRIBUTION_SQL})"
RANKED = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY abs(contribution) DESC, feature) AS orden
  FROM contrib)"""
EFFECT = "CASE WHEN contribution > 0 THEN 'Incrementa riesgo' ELSE 'Reduce riesgo' END"


@query("top_features", Q.sql(CONTRIB, """SELECT feature, round(avg(abs(contribution)), 4) AS importance FROM contrib
  GROUP BY feature ORDER BY importance DESC, feature LIMIT 12"""))
def _(spark, d):
    return A.top_features(A.global_importance(I.contributions(spark, d)))


@query("top_factors", Q.sql(CONTRIB + RANKED, f"""SELECT loan_id, orden, feature, round(value, 4) AS value,
  round(contribution, 4) AS shap, {EFFECT} AS effect FROM ranked WHERE orden <= 6"""))
def _(spark, d):
    return A.top_factors(I.contributions(spark, d))


@query("top_per_group", Q.sql(Q.MATURE, """SELECT * FROM (SELECT grado_riesgo, loan_id, importe_solicitado, row_number() OVER
  (PARTITION BY grado_riesgo ORDER BY importe_solicitado DESC, loan_id) AS orden FROM mature) WHERE orden <= 6"""))
def _(spark, d):
    rows = X.mature_loans(spark, d, ["grado_riesgo", "loan_id", "importe_solicitado"]).drop("estado_prestamo", "target")
    return R.top_per(rows, ["grado_riesgo"], F.col("importe_solicitado"), 6, ["loan_id"])


EXTREMES = """, pair AS (SELECT 'high_risk' AS perfil_tipo, * FROM (SELECT loan_id, prob FROM scored WHERE model_name = 'CatBoost' AND prob IS NOT NULL
  ORDER BY prob DESC, loan_id LIMIT 1) UNION ALL SELECT 'low_risk', * FROM (SELECT loan_id, prob FROM scored
  WHERE model_name = 'CatBoost' AND prob IS NOT NULL ORDER BY prob, loan_id LIMIT 1))"""


@query("extreme_loans", Q.sql(Q.SCORED + EXTREMES, "SELECT * FROM pair"))
def _(spark, d):
    return R.extremes(I.champion_scores(spark, d).select("loan_id", "prob"))


@query("linear_contributions", Q.sql(CONTRIB, "SELECT loan_id, feature, round(value, 6) AS value, round(contribution, 8) AS contribution FROM contrib"))
def _(spark, d):
    return A.long_form(I.contributions(spark, d)).withColumns({
        "value": F.round("value", 6), "contribution": F.round("contribution", 8)
    })


def _scored_beside_clean(after: str) -> str:
    tail = Q.SCORED[len(Q.MATURE):]
    return CONTRIB + tail + after


@query("flatten_local", Q.sql(_scored_beside_clean(EXTREMES) + RANKED, """SELECT p.perfil_tipo, round(p.prob * 100, 2) AS probability_pct,
  feature AS feature_name, CAST(round(value, 4) AS VARCHAR) AS feature_value, round(contribution, 4) AS shap_impact, orden
  FROM pair p JOIN ranked r ON r.loan_id = p.loan_id WHERE orden <= 6"""))
def _(spark, d):
    doc = I.local_profiles(spark, d).select(F.struct("high_risk", "low_risk").alias("local"))
    return H.flatten_local(doc)


@query("local_document", Q.sql(_scored_beside_clean(EXTREMES) + RANKED, """, top AS (SELECT * FROM ranked WHERE orden <= 6)
  SELECT p.perfil_tipo, CASE p.perfil_tipo WHEN 'high_risk' THEN 'Alto Riesgo' ELSE 'Bajo Riesgo' END AS risk_label,
  round(p.prob * 100, 2) AS probability, (SELECT count(*) FROM top t WHERE t.loan_id = p.loan_id) AS factors,
  c.tipo_interes, c.finalidad_prestamo FROM pair p JOIN clean c ON c.loan_id = p.loan_id"""))
def _(spark, d):
    both = F.array(*[F.struct(F.lit(p).alias("perfil_tipo"), F.col(p).alias("d")) for p in ("high_risk", "low_risk")])
    return I.local_profiles(spark, d).select(F.inline(both)).select(
        "perfil_tipo", "d.risk_label", "d.probability", F.size("d.factors").cast("long").alias("factors"),
        "d.raw_features.tipo_interes", "d.raw_features.finalidad_prestamo",
    )


# --- joins on small results --------------------------------------------------------


@query("champion_flag", Q.sql(Q.COMPARISON + CHAMPION,
                              "SELECT c.*, c.name = (SELECT name FROM champ) AS es_campeon FROM comparison c"))
def _(spark, d):
    rows = I.comparison(spark, d)
    return H.flag_champion(rows, R.champion(rows))


@query("previous_champion_lookup", Q.sql(Q.COMPARISON + CHAMPION, "SELECT c.name, c.f1, c.roc_auc FROM comparison c JOIN champ USING (name)"))
def _(spark, d):
    rows = I.comparison(spark, d)
    return H.lookup_run(rows, R.champion(rows)).select("name", "f1", "roc_auc")


@query("model_exists", Q.sql(Q.RUNS, f"""SELECT 'Champion_' || name || '_MVP_Balanced' AS display_name, name <> 'XGBoost' AS found
  FROM (SELECT DISTINCT {FAMILY} AS name FROM runs)"""))
def _(spark, d):
    names = R.best_per_family(I.runs(spark, d)).select("name")
    models = names.where("name <> 'XGBoost'").select(H.display_name(F.col("name")).alias("display_name"))
    return H.model_exists(names, models)


@query("zip_feature_psi", Q.sql(Q.PSI, "SELECT feature_name AS label, psi_value AS value FROM psi"))
def _(spark, d):
    arrays = I.psi_table(spark, d).agg(F.sort_array(F.collect_list(F.struct("feature_name", "psi_value"))).alias("s"))
    return H.zip_explode(arrays.select("s.feature_name", "s.psi_value"), "feature_name", "psi_value")


@query("as_percent_metrics", Q.sql(Q.COMPARISON, """SELECT name, round(accuracy * 100, 2) AS accuracy, round(precision * 100, 2) AS precision,
  round(recall * 100, 2) AS recall, round(f1 * 100, 2) AS f1_score, round(roc_auc * 100, 2) AS roc_auc FROM comparison"""))
def _(spark, d):
    return H.as_percent(I.comparison(spark, d), keep=["name"])


@query("with_default_rows", Q.sql(Q.PSI, """, hits AS (SELECT feature_name, psi_value FROM psi WHERE psi_value >= 0.25)
  SELECT * FROM hits UNION ALL SELECT 'sin_drift', max(psi_value) FROM psi HAVING (SELECT count(*) FROM hits) = 0"""))
def _(spark, d):
    table = I.psi_table(spark, d)
    defaults = table.agg(F.lit("sin_drift").alias("feature_name"), F.max("psi_value").alias("psi_value"))
    return H.with_default(D.breaches(table), defaults)


# --- gates ---------------------------------------------------------------------------

GATE1 = "SELECT 'Test 1' AS test, count(*) > 0 AS passed, 'Pass: Dataset limpio válido.' AS message, false AS drift FROM mature"
GATE2 = """SELECT 'Test 2' AS test, t = '' AS passed, CASE WHEN t = '' THEN 'Pass: Umbrales de rendimiento cumplidos.'
  ELSE 'Fail: Incumplimiento de umbral: ' || t END AS message, false AS drift FROM (SELECT concat_ws(', ',
  CASE WHEN f1_score < 35 THEN 'F1-score ' || CAST(f1_score AS VARCHAR) || '% < 35.0%' END,
  CASE WHEN roc_auc IS NULL OR roc_auc < 65 THEN 'ROC-AUC ' || coalesce(CAST(roc_auc AS VARCHAR), 'nan') || '% < 65.0%' END,
  CASE WHEN recall < 50 THEN 'Recall ' || CAST(recall AS VARCHAR) || '% < 50.0%' END) AS t FROM {source})"""
GATE3 = """SELECT 'Test 3' AS test, n = 0 AS passed, CASE WHEN n = 0 THEN 'Pass: Sin drift crítico.' ELSE 'Fail: Drift crítico en: ' || t END
  AS message, n > 0 AS drift FROM (SELECT count(*) FILTER (psi_value >= 0.25) AS n, string_agg(feature_name || ' (PSI=' ||
  CAST(psi_value AS VARCHAR) || ')', ', ' ORDER BY psi_value DESC, feature_name) FILTER (psi_value >= 0.25) AS t FROM psi)"""
GATE4 = """SELECT 'Test 4' AS test, true AS passed, 'Pass: Modelo Champion_' || name || '_MVP_Balanced localizado.' AS message,
  false AS drift FROM champ"""
PERCENT = """, percented AS (SELECT round(f1 * 100, 2) AS f1_score, round(roc_auc * 100, 2) AS roc_auc,
  round(recall * 100, 2) AS recall FROM champ)"""


@query("gate_schema", Q.sql(Q.MATURE, GATE1))
def _(spark, d):
    return G.gate_schema(X.clean_loans(spark, d))


@query("gate_performance", Q.sql(Q.KPIS, GATE2.format(source="kpis")))
def _(spark, d):
    return G.gate_performance(I.kpis(spark, d))


@query("gate_drift", Q.sql(Q.PSI_DRIFT, GATE3))
def _(spark, d):
    return G.gate_drift(I.psi_table(spark, d, drifted=True))


def _gate_model(spark, d):
    compared = I.comparison(spark, d)
    models = compared.select(H.display_name(F.col("name")).alias("display_name"))
    return G.gate_model(R.champion(compared), models)


@query("gate_model", Q.sql(Q.COMPARISON + CHAMPION, GATE4))
def _(spark, d):
    return _gate_model(spark, d)


@query("gate_performance_empty", Q.sql(Q.KPIS, """SELECT 'Test 2' AS test, false AS passed, 'Fail: Sin métricas del campeón.' AS message,
  false AS drift WHERE (SELECT count(*) FROM kpis WHERE fecha_registro > TIMESTAMP '2100-01-01') = 0"""))
def _(spark, d):
    return G.gate_performance(I.kpis(spark, d).where("fecha_registro > timestamp_ntz '2100-01-01'"))


@query("gate_model_absent", Q.sql(Q.COMPARISON + CHAMPION, """SELECT 'Test 4' AS test, false AS passed,
  'Fail: No se encontró el modelo ''Champion_' || name || '_MVP_Balanced''.' AS message, false AS drift FROM champ
  UNION ALL SELECT 'Test 4', false, 'Fail: No hay campeón.', false"""))
def _(spark, d):
    compared = I.comparison(spark, d)
    best = R.champion(compared)
    others = compared.join(best.select("name"), "name", "left_anti").select(H.display_name(F.col("name")).alias("display_name"))
    return G.gate_model(best, others).union(G.gate_model(R.champion(compared.where("f1 > 2")), others))


@query("gate_rollup_absent", Q.sql(Q.MATURE, f"""SELECT false AS all_passed, false AS retrain,
  CAST(count(*) FILTER (NOT passed) + 5 AS BIGINT) AS failed FROM ({GATE1})"""))
def _(spark, d):
    return G.gate_rollup(G.gate_schema(X.clean_loans(spark, d)))


def _rollup(spark, d, drifted: bool):
    kpis = H.as_percent(R.champion(I.comparison(spark, d)))
    gates = [
        G.gate_schema(X.clean_loans(spark, d)), G.gate_performance(kpis), G.gate_drift(I.psi_table(spark, d, drifted)),
        _gate_model(spark, d),
    ]
    return G.gate_rollup(G.all_gates(gates), G.TESTS[:4])


# the champion comes from the undrifted loans, the PSI from either table
_ROLLUP_TAIL = Q.COMPARISON[len(Q.MATURE):] + CHAMPION + PERCENT + f""", gates AS ({GATE1} UNION ALL
  {GATE2.format(source='percented')} UNION ALL {GATE3} UNION ALL {GATE4})"""
ROLLUP = """SELECT bool_and(passed) AS all_passed, bool_or(drift) AS retrain, count(*) FILTER (NOT passed) AS failed FROM gates"""


@query("gate_rollup", Q.sql(Q.PSI + _ROLLUP_TAIL, ROLLUP))
def _(spark, d):
    return _rollup(spark, d, False)


@query("gate_rollup_drifted", Q.sql(Q.PSI_DRIFT + _ROLLUP_TAIL, ROLLUP))
def _(spark, d):
    return _rollup(spark, d, True)


@query("family_of_champion", Q.sql(Q.RUNS, f"SELECT run_name, {FAMILY} AS family FROM runs ORDER BY f1 DESC, run_name LIMIT 1"))
def _(spark, d):
    return R.best_run(I.runs(spark, d)).select("run_name", model_family("run_name").alias("family"))
