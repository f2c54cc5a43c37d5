"""Queries of fitted preprocessing, training, calibration and tree attribution."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditspark.operators import attribute as A
from creditspark.operators import clean as C
from creditspark.operators import dictionary as D
from creditspark.operators import features as M
from creditspark.operators import split as S
from creditspark.operators import train as T
from creditspark.plans import inputs as I
from creditspark.plans import sql as Q
from creditspark.plans.registry import query
from creditspark.sources import fixtures as X
from creditspark.sources.scratch import scratch_path

CAT = ["finalidad_prestamo", "tipo_vivienda"]


def signal(spark, d):
    """Planted-signal loans with their split, written once: training reads them many times."""
    path = scratch_path(spark, "signal")
    X.loans_signal(spark, d).write.parquet(path)
    return S.with_split(spark.read.parquet(path), "target", "loan_id")


# what line items or customers leave empty, at every scale factor
GAPS = [
    "ratio_prestamo_ingresos", "puntuacion_crediticia_media", "bancarrotas_publicas",
    "consultas_credito_ultimos_6_meses", "impago_ultimos_2_anios", "tipo_interes", "porcentaje_uso_credito_revolving",
]
SIGNAL_SPLIT = Q.SIGNAL + Q.split("signal", "outer_split", 42) + """, train_rows AS (
SELECT * EXCLUDE (train) FROM outer_split WHERE train)""" + Q.split("train_rows", "inner_split", "42-calib") + """, parted AS (
SELECT o.* EXCLUDE (train), CASE WHEN NOT o.train THEN 'test' WHEN i.train THEN 'base' ELSE 'calib' END AS split
FROM outer_split o LEFT JOIN inner_split i ON i.loan_id = o.loan_id)"""


def _impute_sql(cols=tuple(C.MODEL_NUMERIC), flags=tuple(GAPS), carry="") -> str:
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in cols)
    cells = ", ".join(f"coalesce(p.{c}, m.{c}) AS imp_{c}" for c in cols)
    gaps = ", ".join(f"CAST(p.{c} IS NULL AS DOUBLE) AS imp_missing_{c}" for c in flags)
    return f""", med AS (SELECT {meds} FROM parted WHERE split = 'base'), imputed AS (
SELECT p.loan_id, p.split{carry}, {cells}, {gaps} FROM parted p, med m)"""


def _scale_sql(cols) -> str:
    return ", st AS (SELECT " + ", ".join(
        f"avg(imp_{c}) AS m_{c}, stddev_pop(imp_{c}) AS s_{c}" for c in cols) + " FROM imputed WHERE split = 'base')"


def _scaled(c: str) -> str:
    return f"round((imp_{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6)"


ALL_SCALED = C.MODEL_NUMERIC + [f"missing_{c}" for c in GAPS]


@query("impute_median_flag", Q.sql(SIGNAL_SPLIT + _impute_sql(), "SELECT loan_id, " + ", ".join(
    f"round(imp_{c}, 6) AS imp_{c}" for c in ALL_SCALED) + " FROM imputed"))
def _(spark, d):
    rows = signal(spark, d)
    out = M.MedianImputer(C.MODEL_NUMERIC).fit(rows.where("split = 'base'")).transform(rows)
    return out.select("loan_id", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith(M.IMPUTED)])


@query("standardize", Q.sql(SIGNAL_SPLIT + _impute_sql() + _scale_sql(ALL_SCALED), "SELECT loan_id, " + ", ".join(
    f"{_scaled(c)} AS std_{c}" for c in ALL_SCALED) + " FROM imputed, st"))
def _(spark, d):
    rows = signal(spark, d)
    model = Pipeline(stages=[M.MedianImputer(C.MODEL_NUMERIC), M.PopulationScaler()]).fit(rows.where("split = 'base'"))
    out = model.transform(rows)
    return out.select("loan_id", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith(M.SCALED)])


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM parted WHERE split = 'base' AND {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_mode", Q.sql(Q.SPLIT, f"""SELECT loan_id, coalesce(grado_riesgo, {_mode_sql('grado_riesgo')}) AS cat_grado_riesgo,
  coalesce(tipo_vivienda, {_mode_sql('tipo_vivienda')}) AS cat_tipo_vivienda FROM parted"""))
def _(spark, d):
    rows = I.split_clean(spark, d).select("loan_id", "split", "grado_riesgo", "tipo_vivienda")
    out = M.ModeImputer(["grado_riesgo", "tipo_vivienda"]).fit(rows.where("split = 'base'")).transform(rows)
    return out.select("loan_id", "cat_grado_riesgo", "cat_tipo_vivienda")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", Q.sql(Q.SPLIT, "SELECT loan_id, " + ", ".join(
    f"""CAST({c} = '{v}' AS INT) AS "{c}_{v}" """ for c, vs in (("finalidad_prestamo", PRIORITIES), ("tipo_vivienda", SEGMENTS))
    for v in vs) + " FROM parted"))
def _(spark, d):
    rows = I.split_clean(spark, d).select("loan_id", "split", *CAT)
    model = Pipeline(stages=[M.ModeImputer(CAT), *M.one_hot(CAT)]).fit(rows.where("split = 'base'"))
    return M.one_hot_columns(model.transform(rows), model, ["loan_id"])


def _code_sql(c: str) -> str:
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM r WHERE o_orderstatus = 'F'))"


WIDE = ["customer", "day"]


@query("one_hot_wide", f"""WITH r AS (SELECT o_orderkey AS loan_id, o_orderstatus, CAST(o_custkey AS VARCHAR) AS customer,
    strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
  a AS {_code_sql('customer')}, b AS {_code_sql('day')}, n AS (SELECT count(*) AS customers FROM a)
  SELECT loan_id, a.code AS idx_customer, b.code AS idx_day,
    concat_ws(',', CAST(a.code AS VARCHAR), CAST(b.code + customers AS VARCHAR)) AS slots
  FROM r CROSS JOIN n LEFT JOIN a ON a.v = r.customer LEFT JOIN b ON b.v = r.day""")
def _(spark, d):
    """One-hot slots of columns with very many values, by the dictionary of the finished orders; others may be unknown."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("loan_id"), "o_orderstatus", F.col("o_custkey").cast("string").alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    table = D.category_dictionary(rows.where("o_orderstatus = 'F'"), WIDE)
    out = D.encode(rows.drop("o_orderstatus"), table, WIDE, small=100)
    slots = F.array_join(D.slots(D.sizes(table, WIDE)).cast("array<string>"), ",")
    return out.select("loan_id", "idx_customer", "idx_day", slots.alias("slots"))


@query("feature_vector", Q.sql(
    SIGNAL_SPLIT + _impute_sql(C.MODEL_NUMERIC, GAPS, ", p.target, p.finalidad_prestamo, p.tipo_vivienda") + _scale_sql(ALL_SCALED),
    "SELECT loan_id, target, split, " + ", ".join(
        f"{_scaled(c)} AS {c.replace('missing_', 'missingindicator_', 1)}" for c in ALL_SCALED) + ", " + ", ".join(
        f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}_{v}" """
        for c, vs in (("finalidad_prestamo", PRIORITIES), ("tipo_vivienda", SEGMENTS)) for v in vs) + " FROM imputed, st"))
def _(spark, d):
    rows = signal(spark, d)
    model = M.feature_pipeline(C.MODEL_NUMERIC, C.MODEL_CATEGORICAL).fit(rows.where("split = 'base'"))
    out = model.transform(rows).withColumn("slots", vector_to_array("features"))
    names = [f"round(slots[{i}], 6) AS `{n}`" for i, n in enumerate(M.feature_names(model))]
    return out.selectExpr("loan_id", "target", "split", *names)


def _trained(spark, d):
    return T.train_candidates(signal(spark, d), C.MODEL_NUMERIC, C.MODEL_CATEGORICAL, "loan_id")


NAMES_SQL = ", ".join(f"({i}, '{c.name}')" for i, c in enumerate(T.CANDIDATES))


@query("train_candidates", Q.sql(SIGNAL_SPLIT, f""", n AS (SELECT count(*) FILTER (split = 'test') AS tested,
  count(*) FILTER (split = 'test' AND target = 1) AS defaults FROM parted)
  SELECT name, tested, defaults, true AS metrics_agree, true AS learned FROM n, (VALUES {NAMES_SQL}) AS c(position, name)"""))
def _(spark, d):
    """Each candidate on the test loans: how many were judged, whether its metrics follow from the counts, and whether it has learned."""
    rows = []
    for t, c in zip(_trained(spark, d), T.CANDIDATES, strict=True):
        tp, fp, fn, tn = (t.confusion[c] for c in ("tp", "fp", "fn", "tn"))
        ratio = lambda a, b: a / b if b else 0.0
        want = {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
        rounds = c.params.get("iterations", c.params.get("n_estimators"))
        agree = all(abs(t.metrics[m] - v) < 1e-12 for m, v in want.items()) and t.classifier.getNumTrees == rounds + 1
        rows.append((t.name, tp + fp + fn + tn, tp + fn, agree, t.metrics["roc_auc"] > 0.65))
    return spark.createDataFrame(rows, "name string, tested long, defaults long, metrics_agree boolean, learned boolean")


def _params_sql() -> str:
    own = [(i, c.name, k, str(v)) for i, c in enumerate(T.CANDIDATES) for k, v in c.params.items()]
    fixed = ", ".join(f"({i}, '{n}', '{k}', '{v}')" for i, n, k, v in own)
    weighed = "printf('%.6f', count(*) FILTER (target = 0) * 1e0 / count(*) FILTER (target = 1))"
    return f"""SELECT CAST(position AS BIGINT) AS position, name, param, value FROM (VALUES {fixed}) AS p(position, name, param, value)
  UNION ALL SELECT CAST(position AS BIGINT), name, 'scale_pos_weight', (SELECT {weighed} FROM parted WHERE split = 'base')
  FROM (VALUES {NAMES_SQL}) AS c(position, name)"""


@query("run_log", Q.sql(SIGNAL_SPLIT, _params_sql()))
def _(spark, d):
    """Parameters of all candidates; the thresholds, which only the training knows, are left to its test."""
    log = T.run_log(spark, _trained(spark, d))
    shown = F.when(F.col("param") == "scale_pos_weight", F.format_string("%.6f", F.col("value").cast("double"))).otherwise(F.col("value"))
    return log.select(F.col("position").cast("long").alias("position"), "name", F.explode("params").alias("param", "value")).where(
        "param <> 'decision_threshold'"
    ).withColumn("value", shown)


@query("random_search", Q.sql(SIGNAL_SPLIT, f"""SELECT CAST({T.SEARCH_DRAWS} AS BIGINT) AS draws, count(*) AS loans,
  count(*) FILTER (target = 1) AS defaults, true AS beats_yes_to_all FROM parted WHERE split = 'base'"""))
def _(spark, d):
    """Twenty draws from the grid of a candidate, over three folds, against saying yes to every loan."""
    rows = T.class_weights(_ready(spark, d).where("split = 'base'"), 3.8).cache()
    candidate = T.CANDIDATES[2]
    grid = {**candidate.grid, "weight_factor": T.WEIGHT_FACTORS}
    _, _, table = T.random_search(
        lambda p: candidate.make(p, "target", "features", T.weight_column(p["weight_factor"])), grid, rows, "loan_id"
    )
    n, p = rows.agg(F.count(F.lit(1)), F.count_if(F.col("target") == 1)).first()
    found = table.agg(F.countDistinct(F.map_entries("params")).alias("draws"), F.max("mean_f1").alias("best"))
    return found.select(
        "draws", F.lit(n).cast("long").alias("loans"), F.lit(p).cast("long").alias("defaults"), (F.col("best") > 2 * p / (n + p)).alias("beats_yes_to_all"),
    )


def _ready(spark, d):
    rows = signal(spark, d)
    model = M.feature_pipeline(C.MODEL_NUMERIC, C.MODEL_CATEGORICAL).fit(rows.where("split = 'base'"))
    return model.transform(rows).select("loan_id", "target", "split", "features")


@query("platt_calibrate", Q.sql(SIGNAL_SPLIT, """, n AS (SELECT count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n
  FROM parted WHERE split = 'calib') SELECT p + n AS loans, round((p * (p + 1e0) / (p + 2e0) + n / (n + 2e0)) / (p + n), 4) AS expected,
  round((p * (p + 1e0) / (p + 2e0) + n / (n + 2e0)) / (p + n), 4) AS calibrated FROM n"""))
def _(spark, d):
    """A calibrated model is right on average: mean probability equals mean smoothed target."""
    rows = T.class_weights(_ready(spark, d), 3.8)
    base = T.logistic({"iterations": 50}, "target", "features", T.weight_column(1.0)).fit(rows.where("split = 'base'"))
    raw = PipelineModel([base, VectorSlicer(inputCol="probability", outputCol=T.SCORE, indices=[1])])
    calib = raw.transform(rows.where("split = 'calib'"))
    out = T.with_probability(T.platt(calib).transform(calib))
    p, n = F.count_if(F.col("target") == 1), F.count_if(F.col("target") == 0)
    expected = (p * (p + 1.0) / (p + 2.0) + n / (n + 2.0)) / (p + n)
    return out.agg(
        F.count(F.lit(1)).alias("loans"), F.round(expected, 4).alias("expected"),
        F.round(F.avg("prob"), 4).alias("calibrated"),
    )


@query("tree_contributions", "SELECT o_orderkey AS loan_id, true AS additive, CAST(33 AS BIGINT) AS factors FROM orders")
def _(spark, d):
    """Attribution of every loan by a small boosted-tree model; it adds up to the margin."""
    rows = signal(spark, d)
    model = M.feature_pipeline(C.MODEL_NUMERIC, C.MODEL_CATEGORICAL).fit(rows.where("split = 'base'"))
    ready = model.transform(rows).select("loan_id", "target", "split", "features")
    ready = T.class_weights(ready, 3.8)
    params = {"iterations": 4, "depth": 4, "learning_rate": 0.3}
    trees = T.boosted_trees(params, "target", "features", T.weight_column(1.0)).fit(ready.where("split = 'base'"))
    contrib = A.tree_contributions(ready, trees, scratch_path(spark, "trees"), M.feature_names(model))
    margin = trees.transform(ready).select("loan_id", vector_to_array("rawPrediction")[1].alias("margin"))
    total = F.col("base") + F.reduce("factors", F.lit(0.0), lambda a, f: a + f["contribution"])
    # the sums meet the margins, not the factors with their names
    sums = contrib.select("loan_id", total.alias("total"), F.size("factors").cast("long").alias("factors"))
    return sums.join(margin, "loan_id").select("loan_id", (F.abs(F.col("total") - F.col("margin")) < 1e-9).alias("additive"), "factors")
