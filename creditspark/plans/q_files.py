"""Queries that write and read back: files, tables, documents, models, the stream."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.operators import clean as C
from creditspark.operators import features as M
from creditspark.operators import profile as P
from creditspark.operators import rank as R
from creditspark.operators import reshape as H
from creditspark.operators import train as TR
from creditspark.plans import inputs as I
from creditspark.plans import sql as Q
from creditspark.plans.q_model import signal
from creditspark.plans.q_profile import TARGET_SQL
from creditspark.plans.q_report import CHAMPION
from creditspark.plans.registry import query
from creditspark.sources import fixtures as X
from creditspark.sources import readers as IN
from creditspark.sources import sinks as OUT
from creditspark.sources.scratch import scratch_path
from creditspark.sources.schema import RUN_LOG_SCHEMA
from creditspark.streaming.quality_log import quality_log_stream

LOAN_SQL = """SELECT * REPLACE (strftime(fecha_emision, '%Y-%m-%d') AS fecha_emision,
  trim(plazo_prestamo) AS plazo_prestamo) FROM loans"""


def loans_through_csv(spark, d):
    """The loans written as a semicolon CSV with header, read back."""
    path = scratch_path(spark, "loans-csv")
    rows = X.loans(spark, d).withColumn("fecha_emision", F.date_format("fecha_emision", "yyyy-MM-dd"))
    rows.write.csv(path, sep=";", header=True, encoding="UTF-8")
    back = IN.read_loans_csv(spark, path)
    return back.withColumn("loan_id", F.col("loan_id").cast("long"))


def database(spark) -> str:
    """A fresh database whose tables live in the shared folder."""
    name = f"credit_{uuid.uuid4().hex[:10]}"
    OUT.ensure_db(spark, name, scratch_path(spark, name))
    return name


@query("read_loans_csv", Q.sql(Q.LOANS, LOAN_SQL))
def _(spark, d):
    return loans_through_csv(spark, d).withColumn("plazo_prestamo", F.trim("plazo_prestamo"))


@query("read_loans_csv_mixed", Q.sql(Q.LOANS, LOAN_SQL + " WHERE loan_id % 2 = 0 OR loan_id % 3 = 0"))
def _(spark, d):
    """Files whose headers name the columns in different orders."""
    path = scratch_path(spark, "loans-csv")
    rows = X.loans(spark, d).withColumn("fecha_emision", F.date_format("fecha_emision", "yyyy-MM-dd"))
    options = {"sep": ";", "header": True, "encoding": "UTF-8"}
    rows.where("loan_id % 2 = 0").write.csv(f"{path}/par", **options)
    rows.where("loan_id % 2 <> 0 AND loan_id % 3 = 0").select(*reversed(rows.columns)).write.csv(f"{path}/impar", **options)
    back = IN.read_loans_csv(spark, f"{path}/*")
    return back.withColumn("loan_id", F.col("loan_id").cast("long")).withColumn("plazo_prestamo", F.trim("plazo_prestamo"))


@query("broken_lines", Q.sql(Q.LOANS, "SELECT count(*) AS lineas, CAST(0 AS BIGINT) AS rotas FROM loans"))
def _(spark, d):
    path = scratch_path(spark, "loans-csv")
    rows = X.loans(spark, d).withColumn("fecha_emision", F.date_format("fecha_emision", "yyyy-MM-dd"))
    rows.write.csv(path, sep=";", header=True, encoding="UTF-8")
    return IN.broken_lines(spark, path)


@query("write_replace", Q.sql(Q.MATURE, "SELECT loan_id, target, importe_solicitado FROM mature"))
def _(spark, d):
    name = f"{database(spark)}.loans_clean"
    rows = X.mature_loans(spark, d, ["loan_id", "importe_solicitado"]).select("loan_id", "target", "importe_solicitado")
    OUT.write_replace(rows.where("target = 1"), name)
    return OUT.write_replace(rows, name)


@query("write_many", TARGET_SQL)
def _(spark, d):
    rows = X.mature_loans(spark, d, ["loan_id"])
    written = OUT.write_all({
        "eda_target_distribution": P.target_distribution(rows),
        "eda_estado_prestamo_distribution": P.value_counts(rows, "estado_prestamo"),
    }, database(spark))
    return written["eda_target_distribution"]



@query("append_rows", Q.sql(Q.KPIS, """SELECT run_id, model_name, accuracy, precision, recall, f1_score, roc_auc, pipeline_latency,
  pipeline_error_rate, true AS stamped FROM kpis"""))
def _(spark, d):
    db = database(spark)
    OUT.ensure_tables(spark, db)
    rows = I.kpis(spark, d).drop("fecha_registro")
    OUT.append_rows(rows.where("run_id <= 'run_23970'"), db, "t_modelo_campeon_kpis")
    OUT.append_rows(rows.where("run_id > 'run_23970'"), db, "t_modelo_campeon_kpis")
    back = spark.table(f"{db}.t_modelo_campeon_kpis")
    return back.withColumn("stamped", F.col("fecha_registro").isNotNull()).drop("fecha_registro")


@query("delete_reload", Q.sql(Q.COMPARISON + CHAMPION, """SELECT 'run_comp' AS run_id, name AS model_name, round(accuracy, 3) AS accuracy,
  round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1_score, round(roc_auc, 3) AS roc_auc,
  name = (SELECT name FROM champ) AS es_campeon FROM comparison"""))
def _(spark, d):
    db = database(spark)
    OUT.ensure_tables(spark, db, ["t_modelo_comparativa"])
    compared = I.comparison(spark, d)
    rows = H.flag_champion(compared, R.champion(compared)).select(
        F.lit("run_comp").alias("run_id"), F.col("name").alias("model_name"),
        *[F.round(a, 3).alias(b) for a, b in H.AS_PERCENT.items()], "es_campeon",
    )
    for _ in range(2):  # the second load replaces the first
        OUT.delete_reload(rows, db, "t_modelo_comparativa")
    return spark.table(f"{db}.t_modelo_comparativa").drop("fecha_evaluacion")


@query("ensure_namespace", Q.sql(Q.MATURE, "SELECT count(*) AS filas, 1 AS bases FROM mature"))
def _(spark, d):
    name = database(spark)
    OUT.ensure_db(spark, name)  # again: nothing happens
    OUT.write_replace(X.mature_loans(spark, d, ["loan_id"]), f"{name}.loans")
    found = [b.name for b in spark.catalog.listDatabases() if b.name == name]
    return spark.table(f"{name}.loans").agg(F.count(F.lit(1)).alias("filas"), F.lit(len(found)).alias("bases"))


@query("ensure_tables", Q.sql(Q.PSI, "SELECT feature_name, psi_value, 7 AS tables FROM psi"))
def _(spark, d):
    db = database(spark)
    OUT.ensure_tables(spark, db)
    OUT.ensure_tables(spark, db)
    n = spark.sql(f"SHOW TABLES IN {db}").where("NOT isTemporary").count()
    OUT.append_rows(I.psi_table(spark, d), db, "t_modelo_data_drift_psi")
    return spark.table(f"{db}.t_modelo_data_drift_psi").select("feature_name", "psi_value", F.lit(n).alias("tables"))


@query("write_json_doc", Q.sql(Q.PSI, "SELECT feature_name AS label, psi_value AS value FROM psi"))
def _(spark, d):
    path = scratch_path(spark, "drift-doc")
    drift = H.listed(I.psi_table(spark, d), ["feature_name", "psi_value"], order=["feature_name"])
    section = drift.select(F.struct(F.col("doc.feature_name").alias("labels"), F.col("doc.psi_value").alias("psi")).alias("s"))
    OUT.write_doc(H.report_document(spark, {"data_drift": section}), path)
    shape = "data_drift struct<labels: array<string>, psi: array<double>>"
    back = IN.read_doc(spark, path, T.StructType.fromDDL(shape))
    return H.zip_explode(back.select("data_drift.*"), "labels", "psi")


@query("read_json_doc", Q.sql(Q.COMPARISON, "SELECT name, accuracy, precision, recall, f1, roc_auc FROM comparison"))
def _(spark, d):
    path = scratch_path(spark, "run-log")
    metrics = F.struct("accuracy", "precision", "recall", "f1", "roc_auc").alias("metrics")
    compared = I.comparison(spark, d)
    runs = H.listed(
        compared.withColumn("metrics", metrics).withColumn("params", F.create_map(F.lit("decision_threshold"), F.lit("0.50"))),
        ["name", "params", "metrics"], order=["name"],
    )
    champ = R.champion(compared).select("name")
    OUT.write_doc(H.report_document(spark, {"champion_name": champ, "runs": runs}), path)
    return IN.run_rows(IN.read_doc(spark, path, RUN_LOG_SCHEMA)).select(
        "name", "accuracy", "precision", "recall", "f1", "roc_auc"
    )


@query("save_model", "SELECT o_orderkey AS loan_id, 'logistic' AS name, true AS same FROM orders")
def _(spark, d):
    """A logistic champion saved, loaded and compared with the one in memory on every loan."""
    rows = signal(spark, d).drop("split")
    features = M.feature_pipeline(C.MODEL_NUMERIC, C.MODEL_CATEGORICAL).fit(rows)
    ready = TR.class_weights(features.transform(rows), 3.8)
    base = TR.logistic({"iterations": 30}, "target", "features", TR.weight_column(1.0)).fit(ready)
    slicer = VectorSlicer(inputCol="probability", outputCol=TR.SCORE, indices=[1])
    sigmoid = TR.platt(slicer.transform(base.transform(ready)))
    path = scratch_path(spark, "champion")
    kept = PipelineModel([features, base, slicer, sigmoid])
    OUT.save_model(kept, 0.21, path, "logistic")
    model, threshold, name = OUT.load_model(spark, path)
    a = TR.score(kept, rows, 0.21).select("loan_id", "prob", "decision")
    b = TR.score(model, rows, threshold).select("loan_id", F.col("prob").alias("p"), F.col("decision").alias("d"))
    same = (F.col("prob") == F.col("p")) & (F.col("decision") == F.col("d"))
    return a.join(b, "loan_id").select("loan_id", F.lit(name).alias("name"), same.alias("same"))


@query("quality_log_stream", Q.sql(Q.KPIS, """SELECT 'proyecto' AS gcp_project, run_id AS gcs_bucket,
  '{"Test 2":"' || CASE WHEN f1_score < 35 OR roc_auc < 65 OR recall < 50 THEN 'Fail' ELSE 'Pass' END || '"}' AS results FROM kpis"""))
def _(spark, d):
    inbox, db = scratch_path(spark, "inbox"), database(spark)
    bad = (F.col("f1_score") < 35) | (F.col("roc_auc") < 65) | (F.col("recall") < 50)
    verdict = F.when(bad, "Fail").otherwise("Pass")
    payload = I.kpis(spark, d).select(
        F.create_map(F.lit("Test 2"), verdict).alias("results"), F.lit("proyecto").alias("gcp_project"),
        F.col("run_id").alias("gcs_bucket"),
    )
    # one posted result per file
    payload.write.option("maxRecordsPerFile", 1).json(inbox)
    table, checkpoint = f"{db}.t_quality_test_log", scratch_path(spark, "stream")
    for _ in range(2):  # the second run finds no new file
        quality_log_stream(spark, inbox, table, checkpoint)
    return spark.table(table).drop("fecha_registro")
