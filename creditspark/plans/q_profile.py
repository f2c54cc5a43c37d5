"""Queries of profiling aggregates, drift and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators import attribute as A
from creditspark.operators import clean as C
from creditspark.operators import drift as D
from creditspark.operators import evaluate as E
from creditspark.operators import profile as P
from creditspark.operators import reshape as H
from creditspark.operators import split as S
from creditspark.plans import inputs as I
from creditspark.plans import sql as Q
from creditspark.plans.q_columns import CONTRIBUTION_SQL
from creditspark.plans.registry import query
from creditspark.sources import fixtures as X

N_RAW = len(X.LOAN_COLUMNS)


@query("eda_dimensions", Q.sql(Q.MATURE, f"""SELECT (SELECT count(*) FROM loans) AS total_rows_raw_est,
  CAST((SELECT round_even(count(*) * 0.1e0, 0) FROM loans) AS BIGINT) AS sample_rows,
  CAST({N_RAW} AS BIGINT) AS total_columns, (SELECT count(*) FROM mature) AS filtered_rows"""))
def _(spark, d):
    raw = X.loans(spark, d)
    keys = X.loans(spark, d, ["loan_id"])
    sample = S.sample_exact(keys, 0.1, "loan_id")
    return P.dimensions(raw, sample, X.mature_loans(spark, d, ["loan_id"]))


@query("eda_nulls", Q.sql(Q.LOANS, " UNION ALL ".join(
    f"SELECT '{c}' AS campo, count(*) FILTER ({c} IS NULL) AS nulos, "
    f"{Q.percent_of(f'count(*) FILTER ({c} IS NULL)', 'count(*)')} AS porcentaje FROM loans" for c in X.LOAN_COLUMNS)))
def _(spark, d):
    return P.null_profile(X.loans(spark, d))


def _counts(ctes: str, c: str, table: str) -> str:
    share = Q.percent_of("count(*)", f"(SELECT count(*) FROM {table})")
    return f"SELECT coalesce({c}, 'nan') AS label, count(*) AS \"count\", {share} AS percentage FROM {table} GROUP BY 1"


@query("status_distribution", Q.sql(Q.LOANS, _counts(Q.LOANS, "estado_prestamo", "loans")))
def _(spark, d):
    return P.value_counts(X.loans(spark, d, ["estado_prestamo"]), "estado_prestamo")


TARGET_SQL = Q.sql(Q.MATURE, " UNION ALL ".join(
    f"SELECT '{label}' AS label, count(*) FILTER (target = {t}) AS \"count\", "
    f"{Q.percent_of(f'count(*) FILTER (target = {t})', 'count(*)')} AS percentage FROM mature"
    for label, t in ((P.SOLVENT, 0), (P.DEFAULTED, 1))))


@query("target_distribution", TARGET_SQL)
def target_distribution(spark, d):
    return P.target_distribution(X.mature_loans(spark, d, []))


STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS \"count\", coalesce(round(avg({c}), 2), 0e0) AS mean, "
    f"coalesce(round(stddev_samp({c}), 2), 0e0) AS std, coalesce(round(min({c}), 2), 0e0) AS \"min\", "
    f"coalesce(round(quantile_cont({c}, 0.5), 2), 0e0) AS median, coalesce(round(max({c}), 2), 0e0) AS \"max\" FROM clean"
    for c in C.PROFILE_NUMERIC)


@query("descriptive_stats", Q.sql(Q.CLEAN, STATS_SQL))
def _(spark, d):
    return P.describe(X.clean_loans(spark, d), C.PROFILE_NUMERIC)


@query("categorical_distribution", Q.sql(Q.LOANS, " UNION ALL ".join(
    f"SELECT '{c}' AS variable, * FROM ({_counts(Q.LOANS, c, 'loans')})" for c in C.PROFILE_CATEGORICAL)))
def _(spark, d):
    return P.categorical(X.loans(spark, d, C.PROFILE_CATEGORICAL), C.PROFILE_CATEGORICAL)


def _corr_sql(cols) -> str:
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    flat = ", ".join(f"min({a}) = max({a}) AS flat_{i}" for i, a in enumerate(cols))
    cells = ", ".join(
        f"corr({a}, {b}) AS c_{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j
    )
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS variable_x, '{b}' AS variable_y, "
        f"CASE WHEN flat_{i} OR flat_{j} THEN 0e0 ELSE round(c_{min(i, j)}_{max(i, j)}, 3) + 0e0 END AS correlation FROM one"
        for i, a in enumerate(cols) for j, b in enumerate(cols))
    return f""", whole AS MATERIALIZED (SELECT * FROM clean WHERE {known}), one AS MATERIALIZED (
SELECT {flat}, {cells} FROM whole) {pairs}"""


@query("correlation", Q.sql(Q.CLEAN, _corr_sql(C.PROFILE_NUMERIC)))
def _(spark, d):
    return P.correlation(X.clean_loans(spark, d), C.PROFILE_NUMERIC)


@query("imbalance_ratio", Q.sql(Q.SPLIT, """SELECT count(*) FILTER (target = 0) AS negatives, count(*) FILTER (target = 1) AS positives,
  CAST(count(*) FILTER (target = 0) AS DOUBLE) / count(*) FILTER (target = 1) AS ratio FROM parted WHERE split = 'base'"""))
def _(spark, d):
    rows = S.with_split(X.mature_loans(spark, d, ["loan_id"]), "target", "loan_id")
    return P.imbalance(rows.where("split = 'base'"))


@query("total_exposure", Q.sql(Q.COMPARISON, """SELECT round(sum(importe_solicitado), 2) AS total_risk,
  round(sum(importe_solicitado) * (SELECT recall FROM comparison WHERE name = 'CatBoost'), 2) AS avoided_loss FROM mature"""))
def _(spark, d):
    recall = E.classification_metrics(I.champion_scores(spark, d), 0.5).select("recall").scalar()
    out = E.avoided_loss(X.mature_loans(spark, d, ["importe_solicitado"]), recall)
    return out.select(F.round("total_risk", 2).alias("total_risk"), F.round("avoided_loss", 2).alias("avoided_loss"))


LOSS = "coalesce(importe_solicitado, 0e0) * 0.75e0"


@query("expected_loss", Q.sql(Q.SCORED, f"""SELECT loan_id, {LOSS} AS ead,
  {LOSS} * prob * 0.45e0 AS expected_loss FROM scored WHERE model_name = 'CatBoost'"""))
def _(spark, d):
    rows = X.scored(spark, d, ["importe_solicitado"]).where("model_name = 'CatBoost'")
    return E.expected_loss(rows).select("loan_id", "ead", "expected_loss")


@query("portfolio_loss", Q.sql(Q.SCORED, f"""SELECT model_name, grado_riesgo, count(*) AS loans, round(sum({LOSS}), 4) AS ead,
  round(sum({LOSS} * prob * 0.45e0), 4) AS expected_loss FROM scored GROUP BY model_name, grado_riesgo"""))
def _(spark, d):
    rows = E.expected_loss(X.scored(spark, d, ["importe_solicitado", "grado_riesgo"]))
    return E.portfolio_loss(rows, ["model_name", "grado_riesgo"]).withColumns({
        "ead": F.round("ead", 4), "expected_loss": F.round("expected_loss", 4)
    })


@query("mean_abs_contribution", Q.sql(Q.CLEAN + f", contrib AS ({CONTRIBUTION_SQL})",
       "SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM contrib GROUP BY feature"))
def _(spark, d):
    return A.global_importance(I.contributions(spark, d)).withColumn("importance", F.round("importance", 6))


# --- drift ---------------------------------------------------------------------


@query("max_psi", Q.sql(Q.PSI, "SELECT coalesce(max(psi_value), 0e0) AS max_psi FROM psi"))
def _(spark, d):
    return D.max_psi(I.psi_table(spark, d))


@query("quantile_edges", Q.sql(Q.PSI, """SELECT feature_name, CAST(i - 1 AS INT) AS position, round(es[i], 6) AS edge
  FROM (SELECT feature_name, es, unnest(range(1, len(es) + 1)) AS i FROM psi_l)"""))
def _(spark, d):
    rows = I.drift_input(X.loans(spark, d, I.DRIFT_RAW))
    first, _ = I.baseline(spark, d)
    named = D.rename_features(rows.where(first), D.DRIFT_FEATURES)
    edges = D.quantile_edges(named, list(D.DRIFT_FEATURES))
    return D.edges_frame(named, edges).withColumn("edge", F.round("edge", 6))


@query("histogram", Q.sql(Q.PSI, "SELECT feature_name, side, CAST(bin AS INT) AS bin, n FROM psi_h"))
def _(spark, d):
    rows = I.drift_input(X.loans(spark, d, I.DRIFT_RAW))
    first, _ = I.baseline(spark, d)
    named = D.rename_features(rows.withColumn("side", first), D.DRIFT_FEATURES, ["side"])
    edges = D.quantile_edges(named.where("side"), list(D.DRIFT_FEATURES))
    return D.bin_counts(named, edges, F.col("side"))


@query("psi", Q.sql(Q.PSI, "SELECT feature_name, round(psi_raw, 8) AS psi_value FROM psi"))
def _(spark, d):
    rows = I.drift_input(X.loans(spark, d, I.DRIFT_RAW))
    first, _ = I.baseline(spark, d)
    named = D.rename_features(rows.withColumn("side", first), D.DRIFT_FEATURES, ["side"])
    return D.psi(named, F.col("side"), list(D.DRIFT_FEATURES)).withColumn("psi_value", F.round("psi_value", 8))


@query("psi_table", Q.sql(Q.PSI, "SELECT feature_name, psi_value FROM psi"))
def _(spark, d):
    return I.psi_table(spark, d)


@query("psi_table_drifted", Q.sql(Q.PSI_DRIFT, "SELECT feature_name, psi_value FROM psi"))
def _(spark, d):
    return I.psi_table(spark, d, drifted=True)


@query("drift_breaches", Q.sql(Q.PSI_DRIFT, """SELECT feature_name, psi_value,
  (SELECT count(*) FROM psi WHERE psi_value >= 0.25) > 0 AS drift_detected FROM psi WHERE psi_value >= 0.25"""))
def _(spark, d):
    table = I.psi_table(spark, d, drifted=True)
    return D.breaches(table).withColumn("drift_detected", D.drift_flag(table).select("drift_detected").scalar())


# --- evaluation ------------------------------------------------------------------

SWEEP = Q.SCORED + f""", grid AS (SELECT (5 + i) / 100e0 AS t FROM range(91) AS r(i)), cells AS (
SELECT model_name, prob, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg
FROM scored WHERE prob IS NOT NULL GROUP BY model_name, prob), swept AS (
SELECT c.model_name, t, {Q.ratio('2 * sum(CASE WHEN prob >= t THEN pos ELSE 0 END)',
    'sum(CASE WHEN prob >= t THEN pos + neg ELSE 0 END) + sum(pos)')} AS f1
FROM cells c, grid GROUP BY c.model_name, t)"""


@query("threshold_table", Q.sql(SWEEP, "SELECT model_name, t AS threshold, f1 FROM swept"))
def _(spark, d):
    return E.threshold_table(X.scored(spark, d), ["model_name"])


@query("threshold_sweep", Q.sql(SWEEP, """, best AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY f1 DESC, t) AS r FROM swept)
  SELECT model_name, CASE WHEN f1 > 0 THEN t ELSE 0.5e0 END AS best_threshold, f1 AS best_f1 FROM best WHERE r = 1"""))
def _(spark, d):
    return E.threshold_sweep(X.scored(spark, d), ["model_name"])


@query("left_out", Q.sql(Q.SCORED, """SELECT model_name, count(*) AS filas, count(*) FILTER (prob IS NULL) AS sin_juzgar
  FROM scored GROUP BY model_name"""))
def _(spark, d):
    return E.left_out(X.scored(spark, d), ["model_name"])


@query("confusion_metrics", Q.sql(Q.SCORED + Q.metrics("scored", "model_name", "0.3e0", "m"), "SELECT * FROM m"))
def _(spark, d):
    return E.classification_metrics(X.scored(spark, d), 0.3, ["model_name"])


@query("roc_auc", Q.sql(Q.SCORED + Q.auc("scored", "model_name", "a"), "SELECT * FROM a"))
def _(spark, d):
    return E.roc_auc(X.scored(spark, d), ["model_name"])


@query("gini", Q.sql(Q.SCORED + Q.auc("scored", "model_name", "a"),
                     "SELECT model_name, roc_auc, roc_auc * 2 - 1 AS gini FROM a"))
def _(spark, d):
    return E.with_gini(E.roc_auc(X.scored(spark, d), ["model_name"]))


@query("model_comparison", Q.sql(Q.COMPARISON, "SELECT * FROM comparison"))
def _(spark, d):
    return I.comparison(spark, d)


@query("score", Q.sql(Q.SCORED, "SELECT loan_id, model_name, prob, CAST(prob >= 0.21e0 AS INT) AS decision FROM scored"))
def _(spark, d):
    return E.score(X.scored(spark, d), 0.21).select("loan_id", "model_name", "prob", "decision")


# --- reshaping of profiles ----------------------------------------------------------

NARROW = C.PROFILE_NUMERIC


@query("unpivot_stats", Q.sql(Q.CLEAN, " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, min({c}) AS lo, max({c}) AS hi FROM clean" for c in NARROW)))
def _(spark, d):
    aggs = []
    for c in NARROW:
        aggs += [F.count(c).alias(f"{c}__n"), F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
    return H.unpivot_stats(X.clean_loans(spark, d).agg(*aggs), NARROW, ["n", "lo", "hi"])


@query("corr_axes", Q.sql(Q.CLEAN, "SELECT unnest([" + ", ".join(f"'{c}'" for c in sorted(NARROW)) + "]) AS variable"))
def _(spark, d):
    return H.corr_axes(P.correlation(X.clean_loans(spark, d), NARROW))


MATRIX_SQL = _corr_sql(NARROW).replace(" SELECT 'importe_solicitado' AS variable_x, 'importe_solicitado'",
                                       ", corr AS (SELECT 'importe_solicitado' AS variable_x, 'importe_solicitado'", 1) + ")"


@query("corr_matrix", Q.sql(Q.CLEAN + MATRIX_SQL, """SELECT CAST(dense_rank() OVER (ORDER BY variable_x) - 1 AS INT) AS i,
  CAST(dense_rank() OVER (ORDER BY variable_y) - 1 AS INT) AS j, variable_x, variable_y, correlation FROM corr"""))
def _(spark, d):
    return H.matrix_cells(H.corr_matrix(P.correlation(X.clean_loans(spark, d), NARROW)))


@query("keyed_map", Q.sql(Q.LOANS, " UNION ALL ".join(
    f"SELECT '{c}' AS campo, count(*) FILTER ({c} IS NULL) AS nulos, "
    f"{Q.percent_of(f'count(*) FILTER ({c} IS NULL)', 'count(*)')} AS porcentaje FROM loans" for c in X.LOAN_COLUMNS)))
def _(spark, d):
    doc = H.keyed_map(P.null_profile(X.loans(spark, d)), "campo", ["nulos", "porcentaje"])
    return doc.select(F.explode("doc").alias("campo", "v")).select("campo", "v.nulos", "v.porcentaje")


@query("missing_columns", Q.sql(Q.LOANS, "SELECT unnest(['target', 'saldo']) AS campo, count(*) AS filas FROM loans"))
def _(spark, d):
    rows = X.loans(spark, d)
    absent = P.missing_columns(rows, ["target", "importe_solicitado", "ingresos_anuales", "saldo"])
    return rows.agg(F.count(F.lit(1)).alias("filas")).select(F.explode(F.array(*map(F.lit, absent))).alias("campo"), "filas")
