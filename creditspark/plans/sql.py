"""SQL fragments of the oracle: the loan tables and common steps as CTEs."""

from __future__ import annotations

from creditspark.functions.scalars import GRADE, SENIORITY
from creditspark.operators.drift import DRIFT_FEATURES

LI = """li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, MAX(l_tax) AS max_tax, MAX(l_discount) AS max_disc,
         SUM(l_quantity) AS qty,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS n_ret_f
  FROM lineitem GROUP BY l_orderkey)"""

LOANS = LI + """, loans AS (
SELECT o.o_orderkey AS loan_id,
  o.o_totalprice AS importe_solicitado,
  CASE WHEN o.o_orderkey % 97 = 0 THEN 'n/a'
       ELSE CAST(CAST(5 + li.max_tax * 100 + o.o_orderkey % 17 AS DECIMAL(6,2)) AS VARCHAR(16)) || '%' END AS tipo_interes,
  CASE WHEN o.o_orderkey % 97 = 3 THEN NULL WHEN o.o_orderkey % 3 = 0 THEN ' 60 months' ELSE ' 36 months' END AS plazo_prestamo,
  CASE c.c_custkey % 13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years' WHEN 11 THEN NULL WHEN 12 THEN 'n/a'
       ELSE CAST(c.c_custkey % 13 AS VARCHAR(4)) || ' years' END AS antiguedad_laboral,
  CASE WHEN c.c_custkey % 8 = 7 THEN NULL ELSE SUBSTRING('ABCDEFG', CAST(c.c_custkey % 8 + 1 AS INT), 1) END AS grado_riesgo,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal * 12 END AS ingresos_anuales,
  CASE WHEN c.c_acctbal > 0 THEN o.o_totalprice / (c.c_acctbal * 12) END AS ratio_prestamo_ingresos,
  CAST(600 + li.qty / 2 AS DOUBLE) AS puntuacion_crediticia_media,
  CAST(li.n_ret AS DOUBLE) AS bancarrotas_publicas,
  CAST(li.n_lines AS DOUBLE) AS consultas_credito_ultimos_6_meses,
  CAST(li.n_ret_f AS DOUBLE) AS impago_ultimos_2_anios,
  CAST(CAST(li.max_disc * 1000 AS DECIMAL(6,1)) AS VARCHAR(16)) || '%' AS porcentaje_uso_credito_revolving,
  o.o_orderpriority AS finalidad_prestamo, c.c_mktsegment AS tipo_vivienda,
  CASE o.o_orderstatus WHEN 'P' THEN 'Pagado completamente'
    WHEN 'O' THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'Al corriente' ELSE 'Pagado completamente' END
    ELSE CASE o.o_orderkey % 5 WHEN 0 THEN 'Incobrable' WHEN 1 THEN 'Default' WHEN 2 THEN 'Retraso de 31 a 120 días'
              WHEN 3 THEN 'Periodo de gracia' ELSE 'Pagado completamente' END END AS estado_prestamo,
  o.o_orderdate AS fecha_emision
FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""

DEFAULTED = "('Incobrable', 'Default', 'Retraso de 31 a 120 días')"

MATURE = LOANS + f""", mature AS (
SELECT *, CASE WHEN estado_prestamo IN {DEFAULTED} THEN 1 ELSE 0 END AS target
FROM loans WHERE estado_prestamo = 'Pagado completamente' OR estado_prestamo IN {DEFAULTED})"""

NUMBER = "^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def percent(c: str) -> str:
    text = f"trim(replace({c}, '%', ''))"
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') THEN CAST({text} AS DOUBLE) END"


def _labels(c: str, mapping, default: float) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in mapping.items())
    return f"CASE {c} {whens} ELSE {default}e0 END"


TERM = "coalesce(CAST(nullif(regexp_extract(plazo_prestamo, '[0-9]+'), '') AS DOUBLE), 36e0)"
SENIORITY_CASE = _labels("antiguedad_laboral", SENIORITY, 0.0)
GRADE_CASE = _labels("grado_riesgo", GRADE, 4.0)


def features(source: str, out: str) -> str:
    """CTEs from raw loans to engineered loans."""
    return f""", {out}_p AS (
SELECT * REPLACE ({percent('tipo_interes')} AS tipo_interes,
                  {percent('porcentaje_uso_credito_revolving')} AS porcentaje_uso_credito_revolving),
  {TERM} AS plazo_meses, {SENIORITY_CASE} AS antiguedad_laboral_num, {GRADE_CASE} AS grado_riesgo_num
FROM {source}), {out}_q AS (
SELECT *, coalesce(importe_solicitado, 0e0) * (1e0 + coalesce(tipo_interes, 12e0) / 100e0) / plazo_meses
  AS cuota_mensual_estimada FROM {out}_p), {out} AS (
SELECT *,
  cuota_mensual_estimada * 12e0 / (coalesce(ingresos_anuales, 1e0) + 1e0) AS ratio_carga_financiera,
  coalesce(ingresos_anuales, 1e0) - cuota_mensual_estimada * 12e0 AS ingreso_residual_anual,
  coalesce(porcentaje_uso_credito_revolving, 0e0) / 100e0 * coalesce(consultas_credito_ultimos_6_meses, 0e0)
    AS alerta_sobreendeudamiento,
  ln(1e0 + coalesce(ingresos_anuales, 0e0)) AS ingresos_anuales_log,
  ln(1e0 + coalesce(importe_solicitado, 0e0)) AS importe_solicitado_log
FROM {out}_q)"""


CLEAN = MATURE + features("mature", "clean")

SIGNAL = LOANS + features("loans", "featured") + """, signal AS (
SELECT *, CAST(grado_riesgo_num * 10 + (loan_id * 7919) % 100 >= 120 AS INT) AS target FROM featured)"""

SCORED = MATURE + """, scored AS (
SELECT m.*, k.name AS model_name,
  CASE WHEN loan_id % 89 <> 5 THEN CAST((loan_id * (7919 + 2 * k.k)) % 1000 + 250 * target AS DOUBLE) / 1250e0 END AS prob
FROM mature m, (VALUES (0, 'CatBoost'), (1, 'LightGBM'), (2, 'XGBoost')) AS k(k, name))"""


def hash_text(key: str, salt) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{salt}')"


def hash_order(key: str = "loan_id", salt=42) -> str:
    return f"{hash_text(key, salt)} || ':' || CAST({key} AS VARCHAR)"


def auc(source: str, by: str, out: str) -> str:
    """CTE with the exact AUC per group."""
    return f""", {out}_s AS (
SELECT {by}, prob, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg
FROM {source} WHERE prob IS NOT NULL GROUP BY {by}, prob), {out}_w AS (
SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY prob
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {out}_s), {out} AS (
SELECT {by}, CAST(sum(pos * (2 * below + neg)) AS DOUBLE)
  / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE) * 2e0, 0e0) AS roc_auc
FROM {out}_w GROUP BY {by})"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0e0), 0e0)"


def metrics(source: str, by: str, threshold: str, out: str) -> str:
    """CTE with the confusion metrics per group."""
    return f""", {out}_c AS (
SELECT {by},
  count(*) FILTER (prob >= {threshold} AND target = 1) AS tp, count(*) FILTER (prob >= {threshold} AND target = 0) AS fp,
  count(*) FILTER (prob < {threshold} AND target = 1) AS fn, count(*) FILTER (prob < {threshold} AND target = 0) AS tn
FROM {source} GROUP BY {by}), {out} AS (
SELECT {by}, tp, fp, fn, tn, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision,
  {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1
FROM {out}_c)"""


def percent_of(part: str, whole: str) -> str:
    return f"coalesce(round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0e0) * 100, 2), 0e0)"


# run log: every pseudo-model by issue year, decided at 0.5
RUNS = SCORED + """, by_year AS (SELECT *, year(fecha_emision) AS anio FROM scored)""" \
    + metrics("by_year", "model_name, anio", "0.5e0", "run_m") + auc("by_year", "model_name, anio", "run_a") + """, runs AS (
SELECT lower(m.model_name) || '-' || CAST(m.anio AS VARCHAR) AS run_name, m.model_name, m.anio, m.accuracy, m.precision,
  m.recall, m.f1, a.roc_auc
FROM run_m m JOIN run_a a ON a.model_name = m.model_name AND a.anio = m.anio)"""

# comparison of the three models over all loans
COMPARISON = SCORED + metrics("scored", "model_name", "0.5e0", "cmp_m") + auc("scored", "model_name", "cmp_a") + """, comparison AS (
SELECT m.model_name AS name, m.accuracy, m.precision, m.recall, m.f1, a.roc_auc
FROM cmp_m m JOIN cmp_a a ON a.model_name = m.model_name)"""

# champion KPIs by issue month, as percentages
KPIS = SCORED + """, by_month AS (
SELECT *, CAST(date_trunc('month', fecha_emision) AS DATE) AS mes FROM scored WHERE model_name = 'CatBoost')""" \
    + metrics("by_month", "mes", "0.25e0", "kpi_m") + auc("by_month", "mes", "kpi_a") + """, kpi_n AS (
SELECT m.*, a.roc_auc, year(m.mes) * 12 + month(m.mes) AS n FROM kpi_m m JOIN kpi_a a ON a.mes = m.mes), kpis AS (
SELECT 'run_' || CAST(n AS VARCHAR) AS run_id, 'CatBoost' AS model_name,
  round(accuracy * 100, 2) AS accuracy, round(precision * 100, 2) AS precision, round(recall * 100, 2) AS recall,
  round(f1 * 100, 2) AS f1_score, round(roc_auc * 100, 2) AS roc_auc,
  CASE WHEN n % 4 <> 0 THEN 35 + n % 20 END AS pipeline_latency,
  CASE WHEN n % 3 <> 0 THEN (n % 8) / 100e0 END AS pipeline_error_rate,
  CAST(mes AS TIMESTAMP) AS fecha_registro FROM kpi_n)"""


def split(source: str, out: str, salt, test: str = "0.2e0") -> str:
    """CTE with `train`: the stratified choice of ceil(test * rows) test rows."""
    return f""", {out}_n AS (
SELECT target, count(*) AS n, (SELECT count(*) FROM {source}) AS total FROM {source} GROUP BY target), {out}_f AS (
SELECT *, total - CAST(ceil(total * {test}) AS BIGINT) AS want FROM {out}_n), {out}_g AS (
SELECT *, (want * n) // total AS fl, (want * n) % total AS rest FROM {out}_f), {out}_k AS (
SELECT target, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, CAST(target AS VARCHAR))
  <= want - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM {out}_g), {out} AS (
SELECT s.*, row_number() OVER (PARTITION BY s.target ORDER BY {hash_order('s.loan_id', salt)}) <= k.quota AS train
FROM {source} s JOIN {out}_k k ON k.target = s.target)"""


SPLIT = CLEAN + split("clean", "outer_split", 42) + """, train_rows AS (
SELECT * EXCLUDE (train) FROM outer_split WHERE train)""" + split("train_rows", "inner_split", "42-calib") + """, parted AS (
SELECT o.* EXCLUDE (train), CASE WHEN NOT o.train THEN 'test' WHEN i.train THEN 'base' ELSE 'calib' END AS split
FROM outer_split o LEFT JOIN inner_split i ON i.loan_id = o.loan_id)"""


def chrono(source: str, out: str, fraction: str = "0.8e0") -> str:
    """CTE with `first`: the baseline part by issue date, hash order on equal dates."""
    return f""", {out} AS (
SELECT *, row_number() OVER (ORDER BY fecha_emision NULLS LAST, {hash_order()})
  <= CAST(floor(count(*) OVER () * {fraction}) AS BIGINT) AS first FROM {source})"""


def psi(source: str, out: str) -> str:
    """CTEs for edges, bins and PSI of the drift features of a chronologically split source."""
    long = " UNION ALL ".join(
        f"SELECT '{label}' AS feature_name, first, CAST({c} AS DOUBLE) AS x FROM {source} WHERE {c} IS NOT NULL"
        for label, c in DRIFT_FEATURES.items()
    )
    probs = ", ".join(f"{i / 10!r}" for i in range(11))
    return f""", {out}_x AS ({long}), {out}_l AS (
SELECT feature_name, list_sort(list_distinct(quantile_cont(x, [{probs}]))) AS es
FROM {out}_x WHERE first GROUP BY feature_name), {out}_b AS (
SELECT v.feature_name, v.first,
  CASE WHEN v.x < es[1] OR v.x > es[len(es)] THEN NULL
       ELSE least(len(list_filter(es, lambda e: e <= v.x)), len(es) - 1) - 1 END AS bin
FROM {out}_x v JOIN {out}_l USING (feature_name) WHERE len(es) >= 2), {out}_h AS (
SELECT feature_name, first AS side, bin, count(*) AS n FROM {out}_b GROUP BY feature_name, first, bin), {out}_t AS (
SELECT feature_name, sum(n) FILTER (side) AS nb, sum(n) FILTER (NOT side) AS nr FROM {out}_h GROUP BY feature_name), {out}_g AS (
SELECT feature_name, unnest(range(len(es) - 1)) AS bin FROM {out}_l), {out}_e AS (
SELECT g.feature_name, g.bin,
  coalesce(sum(h.n) FILTER (h.side), 0) / nullif(any_value(t.nb), 0) AS e0,
  coalesce(sum(h.n) FILTER (NOT h.side), 0) / nullif(any_value(t.nr), 0) AS a0
FROM {out}_g g LEFT JOIN {out}_h h ON h.feature_name = g.feature_name AND h.bin = g.bin
LEFT JOIN {out}_t t ON t.feature_name = g.feature_name GROUP BY g.feature_name, g.bin), {out}_s AS (
SELECT feature_name, CASE WHEN e0 = 0 THEN 1e-4 ELSE e0 END AS e, CASE WHEN a0 = 0 THEN 1e-4 ELSE a0 END AS a
FROM {out}_e), {out} AS (
SELECT feature_name, coalesce(sum((a - e) * ln(a / e)), 0e0) AS psi_raw,
  round(coalesce(sum((a - e) * ln(a / e)), 0e0), 4) AS psi_value FROM {out}_s GROUP BY feature_name)"""


PSI = CLEAN + chrono("clean", "timed") + psi("timed", "psi")
PSI_DRIFT = LOANS + """, shifted AS (
SELECT * REPLACE (CASE WHEN fecha_emision >= TIMESTAMP '2000-01-01' THEN importe_solicitado * 1.8e0
                       ELSE importe_solicitado END AS importe_solicitado) FROM loans), mature AS (
SELECT *, CASE WHEN estado_prestamo IN """ + DEFAULTED + """ THEN 1 ELSE 0 END AS target FROM shifted
WHERE estado_prestamo = 'Pagado completamente' OR estado_prestamo IN """ + DEFAULTED + ")" \
    + features("mature", "clean") + chrono("clean", "timed") + psi("timed", "psi")


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"
