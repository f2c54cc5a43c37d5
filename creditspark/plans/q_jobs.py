"""Queries that run the jobs: profile tables, governance tables, report, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators import attribute as A
from creditspark.operators import clean as C
from creditspark.operators import gate as G
from creditspark.operators import reshape as H
from creditspark.plans import inputs as I
from creditspark.plans import jobs as J
from creditspark.plans import q_profile  # noqa: F401  (its twins are part of one here)
from creditspark.plans import sql as Q
from creditspark.plans.q_files import database
from creditspark.plans.q_report import CHAMPION, GATE1, GATE2, GATE3, GATE4, PERCENT
from creditspark.plans.registry import ORACLES, query
from creditspark.sources import fixtures as X
from creditspark.sources import sinks as OUT
from creditspark.sources.scratch import scratch_path


def governed(spark, d) -> str:
    """A database with the clean table, the profile tables and the governance tables."""
    db = database(spark)
    clean = J.clean_and_profile(X.loans(spark, d), db, "loan_id")
    contrib = A.linear_contributions(clean, I.COEF, I.MEAN)
    raw = C.select_present(clean, C.MODEL_NUMERIC + C.MODEL_CATEGORICAL, ["loan_id"])
    local = A.local_document(contrib, I.champion_scores(spark, d), raw)
    doc = OUT.write_replace(A.attribution_document(A.global_importance(contrib), local), f"{db}.attribution")
    log = OUT.write_replace(I.comparison(spark, d), f"{db}.run_log")
    J.consolidate(clean, log, doc, db, "loan_id", latency=50, error_rate=0.0)
    return db


DOC_SQL = Q.PSI + Q.COMPARISON[len(Q.MATURE):] + CHAMPION


@query("report_document", Q.sql(DOC_SQL, f"""SELECT (SELECT name FROM champ) AS champion, (SELECT round(f1 * 100, 2) FROM champ) AS f1_score,
  (SELECT count(*) FROM comparison) AS compared, (SELECT max(psi_value) FROM psi) AS highest_psi,
  (SELECT count(*) FROM loans) AS filas, (SELECT count(*) FROM clean) AS maduros,
  round((SELECT sum(importe_solicitado) FROM clean), 2) AS total_risk, CAST({len(I.COEF)} AS BIGINT) AS global_features,
  CAST({len(C.PROFILE_NUMERIC)} AS BIGINT) AS variables, CAST(7 AS BIGINT) AS sections"""))
def _(spark, d):
    doc = J.report(spark, governed(spark, d))

    def get(path: str):
        return F.get_json_object("document", path)

    return doc.select(
        get("$.champion.model_name").alias("champion"),
        get("$.champion.metrics.f1_score").cast("double").alias("f1_score"),
        F.json_array_length(get("$.comparison")).cast("long").alias("compared"),
        get("$.data_drift.psi[0]").cast("double").alias("highest_psi"),
        get("$.eda.dimensions.total_rows_raw_est").cast("long").alias("filas"),
        get("$.eda.dimensions.filtered_rows").cast("long").alias("maduros"),
        F.round(get("$.business.total_risk").cast("double"), 2).alias("total_risk"),
        F.json_array_length(get("$.shap.global")).cast("long").alias("global_features"),
        F.json_array_length(get("$.eda.correlation.matrix")).cast("long").alias("variables"),
        F.size(F.json_object_keys("document")).cast("long").alias("sections"),
    )


METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
STATS = ["mean", "median", "std", "min", "max"]
COMPARED = ["f1", "roc_auc", "accuracy", "recall"]


def _cells_sql(section: str, source: str, item: str, fields: dict[str, str], order: str = "") -> str:
    """Rows (section, place, item, field, value) of a twin's result; places are counted where the document has an order."""
    place = f"row_number() OVER (ORDER BY {order}) - 1" if order else "0"
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({place} AS BIGINT) AS place, {item} AS item, '{f}' AS field, CAST({v} AS DOUBLE) AS value FROM ({source})"
        for f, v in fields.items())


def _document_sql() -> str:
    percent = {m: f"round({'f1' if m == 'f1_score' else m} * 100, 2)" for m in METRICS}
    thirds = {m: f"round({m}, 3)" for m in COMPARED}
    return "SELECT * FROM (" + " UNION ALL ".join([
        _cells_sql("champion", ORACLES["champion"], "name", percent),
        _cells_sql("comparison", ORACLES["comparison_order"], "name", thirds, "round(f1, 3) DESC, name"),
        _cells_sql("data_drift", ORACLES["psi_table"], "feature_name", {"psi": "psi_value"}, "psi_value DESC, feature_name"),
        _cells_sql("nulls", ORACLES["eda_nulls"], "campo", {c: c for c in ("nulos", "porcentaje")}),
        _cells_sql("target_distribution", ORACLES["target_distribution"], "label", {c: c for c in ("count", "percentage")}, "label"),
        _cells_sql("descriptive_stats", ORACLES["descriptive_stats"], "variable", {c: c for c in STATS}),
        _cells_sql("correlation", ORACLES["correlation"], "variable_x || ' ' || variable_y", {"correlation": "correlation"}),
        _cells_sql("shap", ORACLES["mean_abs_contribution"], "feature", {"importance": "round(importance, 4)"}),
    ]) + ") WHERE value IS NOT NULL"


@query("report_cells", _document_sql())
def _(spark, d):
    """Every figure of the report's comparison, drift, profile, correlation and importance sections, with its place where these are ordered."""
    doc = J.report(spark, governed(spark, d))

    def read(path: str, schema: str):
        return F.from_json(F.get_json_object("document", path), schema)

    def cells(section: str, rows, fields, item, value, ordered: bool = False):
        def of(x, i):
            place = i.cast("long") if ordered else F.lit(0).cast("long")
            return F.array(*[F.struct(
                F.lit(section).alias("section"), place.alias("place"), item(x).alias("item"), F.lit(f).alias("field"), value(x, f).cast("double").alias("value"),
            ) for f in fields])

        return F.flatten(F.transform(rows, of))

    def doubles(fields) -> str:
        return ", ".join(f"{f}: double" for f in fields)

    def mapped(section: str, path: str, fields):
        rows = F.map_entries(read(path, f"map<string, struct<{doubles(fields)}>>"))
        return cells(section, rows, fields, lambda x: x["key"], lambda x, f: x["value"][f])

    def listed(section: str, path: str, name: str, fields, ordered: bool = True):
        rows = read(path, f"array<struct<{name}: string, {doubles(fields)}>>")
        return cells(section, rows, fields, lambda x: x[name], lambda x, f: x[f], ordered)

    champion = F.array(read("$.champion", f"struct<model_name: string, metrics: struct<{doubles(METRICS)}>>"))
    drift = F.arrays_zip(read("$.data_drift.labels", "array<string>").alias("label"), read("$.data_drift.psi", "array<double>").alias("psi"))
    names, matrix = read("$.eda.correlation.columns", "array<string>"), read("$.eda.correlation.matrix", "array<array<double>>")
    pairs = F.flatten(F.transform(matrix, lambda row, i: F.transform(row, lambda c, j: F.struct(
        F.concat_ws(" ", F.get(names, i), F.get(names, j)).alias("pair"), c.alias("correlation")))))
    parts = [
        cells("champion", champion, METRICS, lambda x: x["model_name"], lambda x, f: x["metrics"][f]),
        listed("comparison", "$.comparison", "name", COMPARED),
        cells("data_drift", drift, ["psi"], lambda x: x["label"], lambda x, f: x[f], ordered=True),
        mapped("nulls", "$.eda.nulls", ["nulos", "porcentaje"]),
        listed("target_distribution", "$.eda.target_distribution", "label", ["count", "percentage"]),
        mapped("descriptive_stats", "$.eda.descriptive_stats", STATS),
        cells("correlation", pairs, ["correlation"], lambda x: x["pair"], lambda x, f: x[f]),
        listed("shap", "$.shap.global", "feature", ["importance"], ordered=False),
    ]
    return doc.select(F.inline(F.concat(*parts))).where("value IS NOT NULL")


def _sections(spark, d):
    return J.report(spark, governed(spark, d)).select(
        F.get_json_object("document", "$.shap").alias("shap"), F.get_json_object("document", "$.eda").alias("eda")
    )


@query("gate_attribution", Q.sql(Q.MATURE, """SELECT 'Test 5' AS test, count(*) > 0 AS passed,
  'Pass: Integración de atribución validada.' AS message, false AS drift FROM mature"""))
def _(spark, d):
    doc = A.attribution_document(A.global_importance(I.contributions(spark, d)), I.local_profiles(spark, d))
    return G.gate_attribution(doc.select(F.to_json(F.struct("global", "local")).alias("shap")))


@query("gate_eda", Q.sql(Q.MATURE, """SELECT 'Test 6' AS test, count(*) > 0 AS passed, 'Pass: Estructura de EDA validada.' AS message,
  false AS drift FROM mature"""))
def _(spark, d):
    return G.gate_eda(_sections(spark, d))


GATES56 = """SELECT 'Test 5' AS test, count(*) > 0 AS passed, 'Pass: Integración de atribución validada.' AS message, false AS drift
  FROM clean UNION ALL SELECT 'Test 6', count(*) > 0, 'Pass: Estructura de EDA validada.', false FROM clean"""


@query("quality_check", Q.sql(DOC_SQL + PERCENT, f"""{GATE1} UNION ALL {GATE2.format(source='percented')} UNION ALL {GATE3}
  UNION ALL {GATE4} UNION ALL {GATES56}"""))
def _(spark, d):
    db = governed(spark, d)
    models = spark.table(f"{db}.run_log").select(H.display_name(F.col("name")).alias("display_name"))
    return J.quality_check(spark, db, J.report(spark, db), models)


@query("job_documents", Q.sql(Q.COMPARISON, "SELECT name, f1, roc_auc, CAST(7 AS BIGINT) AS sections FROM comparison"))
def _(spark, d):
    """The written documents read back: the runs of one, the sections of the other, whose drift table is missing."""
    db, path = governed(spark, d), scratch_path(spark, "documents")
    spark.sql(f"DROP TABLE {db}.t_modelo_data_drift_psi")
    none = spark.createDataFrame([], "feature_name string, psi_value double")
    J.write_documents(spark, db, path, {"t_modelo_data_drift_psi": none})
    runs = spark.read.json(f"{path}/run_log", schema="runs array<struct<name:string,f1:double,roc_auc:double>>")
    document = spark.read.text(f"{path}/report").agg(F.first(F.size(F.json_object_keys("value"))).cast("long").alias("sections"))
    return runs.select(F.inline("runs")).select("name", "f1", "roc_auc", document.scalar().alias("sections"))


@query("quality_payload", Q.sql(Q.MATURE, f"""SELECT test, message, 'p' AS gcp_project, 'b' AS gcs_bucket FROM ({GATE1})"""))
def _(spark, d):
    payload = J.quality_payload(G.gate_schema(X.clean_loans(spark, d)), "p", "b")
    return payload.select(F.explode("results").alias("test", "message"), "gcp_project", "gcs_bucket")


@query("train_and_report")
def _(spark, d):
    """Profile, train, consolidate and gate the planted-signal loans; one row per gate."""
    db = database(spark)
    clean = J.clean_and_profile(X.loans(spark, d), db, "loan_id")
    signal = OUT.write_replace(X.loans_signal(spark, d), f"{db}.signal")
    log, doc = J.train(signal, db, "loan_id", scratch_path(spark, "model"))
    J.consolidate(clean, log, doc, db, "loan_id")
    models = log.select(H.display_name(F.col("name")).alias("display_name"))
    return J.quality_check(spark, db, J.report(spark, db), models).select("test", "passed", "drift")
