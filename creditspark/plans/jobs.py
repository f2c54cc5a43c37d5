"""The batch jobs end to end, from raw loans to governance tables and one report.

Each job writes its tables; the next one reads them. A shared input is computed
once, and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.functions.hashing import bernoulli
from creditspark.functions.scalars import label_time, to_fraction, to_percent
from creditspark.operators import attribute as A
from creditspark.operators import clean as C
from creditspark.operators import drift as D
from creditspark.operators import evaluate as E
from creditspark.operators import gate as G
from creditspark.operators import profile as P
from creditspark.operators import rank as R
from creditspark.operators import reshape as H
from creditspark.operators import split as S
from creditspark.operators import train as T
from creditspark.sources import sinks as OUT
from creditspark.sources.scratch import scratch_path

RAW_TABLE, CLEAN_TABLE = "loans_raw", "loans_clean"
CHOSEN = "elegido"


def clean_and_profile(raw: DataFrame, db: str, key: str, fraction: float = 1.0) -> DataFrame:
    """Write the clean table and the seven profile tables; returns the clean table.

    The raw file is parsed once, into a columnar table; the profiles then read
    only the columns they need. `fraction` below 1 profiles exact samples of raw
    and clean, drawn independently.
    """
    OUT.ensure_db(raw.sparkSession, db)
    raw = OUT.write_replace(raw, f"{db}.{RAW_TABLE}")
    clean = OUT.write_replace(C.clean(raw), f"{db}.{CLEAN_TABLE}")
    raw_sample = S.sample_exact(raw, fraction, key)
    clean_sample = S.sample_exact(clean, fraction, key, f"{S.SEED}-clean")
    OUT.write_all({
        "eda_dimensions": P.dimensions(raw, raw_sample, clean),
        "eda_nulls": P.null_profile(raw_sample),
        "eda_estado_prestamo_distribution": P.value_counts(raw_sample, "estado_prestamo"),
        "eda_target_distribution": P.target_distribution(clean_sample),
        "eda_descriptive_stats": P.describe(clean_sample, C.PROFILE_NUMERIC),
        "eda_categorical_distribution": P.categorical(raw_sample, C.PROFILE_CATEGORICAL),
        "eda_correlation": P.correlation(clean_sample, C.PROFILE_NUMERIC),
    }, db)
    return clean


def train(
    clean: DataFrame, db: str, key: str, model_path: str, candidates: Sequence[T.Candidate] = T.CANDIDATES,
    search_draws: int = 0, fraction: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Train, pick and save the champion; returns (run log, attribution document).

    `fraction` below 1 trains on the loans whose key's hash falls below it. Every test
    loan is explained, not a sample of them.
    """
    spark = clean.sparkSession
    rows = S.with_split(C.ensure_target(clean).where(bernoulli(key, fraction, S.SEED)), "target", key)
    trained = T.train_candidates(rows, C.MODEL_NUMERIC, C.MODEL_CATEGORICAL, key, candidates, search_draws=search_draws)
    log = T.run_log(spark, trained)
    name = R.champion_in_order(log, "position").first()["name"]
    log = OUT.write_replace(log.withColumn(CHOSEN, F.col("name") == name), f"{db}.run_log")
    best = next(t for t in trained if t.name == name)
    OUT.save_model(best.model, best.threshold, model_path, name, spark)
    test = rows.where("split = 'test'")
    scored = OUT.write_replace(
        T.score(best.model, test, best.threshold).select(key, "target", "prob", "decision", "features"), f"{db}.scored_test"
    )
    contrib = A.model_contributions(scored, best.classifier, scratch_path(spark, "trees"), best.names, key)
    contrib = OUT.write_replace(contrib, f"{db}.attributions")
    raw = C.select_present(test, C.MODEL_NUMERIC + C.MODEL_CATEGORICAL, [key])
    local = A.local_document(contrib, scored, raw, key)
    doc = A.attribution_document(A.global_importance(contrib), local)
    return log, OUT.write_replace(doc, f"{db}.attribution")


def consolidate(
    clean: DataFrame, log: DataFrame, attribution: DataFrame, db: str, key: str,
    cut: tuple[Column, int] | None = None, latency: int | None = None, error_rate: float | None = None,
    newest: bool = False, at_least: int = 1,
) -> None:
    """Governance tables from a run log (name and metrics per run), the loans and an attribution document.

    The champion is the run that the training has marked as chosen, whose model it saved; a log without
    marks goes by `rank.champion`. The evolution shows seven KPI rows, the oldest or the `newest`, from `at_least`
    rows on. `latency` and `error_rate` are what the caller measured of its own run.
    """
    spark = clean.sparkSession
    OUT.ensure_tables(spark, db)
    champ = log.where(CHOSEN) if CHOSEN in log.columns else R.champion(log)
    measured = {
        "run_id": F.concat(F.lit("run_"), F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")),
        "pipeline_latency": F.lit(latency).cast("long"),
        "pipeline_error_rate": F.lit(error_rate).cast("double"),
    }
    kpis = H.as_percent(champ, keep=["name"]).withColumnRenamed("name", "model_name").withColumns(measured)
    OUT.append_rows(kpis, db, "t_modelo_campeon_kpis")
    compared = H.flag_champion(log, champ).select(
        F.lit("run_comp").alias("run_id"), F.col("name").alias("model_name"),
        *[F.round(a, 3).alias(b) for a, b in H.AS_PERCENT.items()], "es_campeon",
    )
    OUT.delete_reload(compared, db, "t_modelo_comparativa")
    past = R.history(spark.table(f"{db}.t_modelo_campeon_kpis"), "fecha_registro", newest=newest, at_least=at_least)
    past = H.scale_column(H.scale_column(past, "f1_score"), "roc_auc")
    evolution = past.select(
        label_time("fecha_registro").alias("semana_etiqueta"), "f1_score", "roc_auc",
        F.col("fecha_registro").cast("date").alias("fecha_auditoria"),
    )
    OUT.delete_reload(evolution, db, "t_modelo_evaluacion_temporal")
    psi = D.psi_report(clean, "fecha_emision", key, cut=cut)
    OUT.delete_reload(psi, db, "t_modelo_data_drift_psi")
    top = attribution.select(F.explode("global").alias("g")).select(
        F.col("g.feature").alias("feature_name"), F.col("g.importance").alias("shap_importance")
    )
    OUT.delete_reload(top, db, "t_modelo_shap_global")
    local = H.flatten_local(attribution).withColumn("feature_value", F.coalesce("feature_value", F.lit("nan")))
    OUT.delete_reload(local, db, "t_modelo_shap_local")


def report(spark: SparkSession, db: str, defaults: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One nested document of seven sections, from the tables of the jobs above.

    `defaults` has the caller's rows for tables that may be missing or empty.
    """
    defaults = defaults or {}

    def t(name: str) -> DataFrame:
        full = f"{db}.{name}"
        return OUT.table_or(spark, full, defaults[name]) if name in defaults else spark.table(full)

    last = R.latest(t("t_modelo_campeon_kpis"), "fecha_registro")
    metrics = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    champion = last.select(F.struct(
        "model_name", F.struct(*[to_percent(m).alias(m) for m in metrics]).alias("metrics")))
    exposure = E.total_exposure(t(CLEAN_TABLE)).select("total_risk").scalar()
    business = last.select(F.struct(
        exposure.alias("total_risk"),
        (exposure * F.col("recall") / 100.0).alias("avoided_loss"),
        F.coalesce("pipeline_latency", F.lit(45)).alias("pipeline_latency"),
        F.coalesce("pipeline_error_rate", F.lit(0.0)).alias("pipeline_error_rate")))
    comparison = H.listed(
        t("t_modelo_comparativa").select(
            F.col("model_name").alias("name"), F.col("f1_score").alias("f1"),
            *[to_fraction(m).alias(m) for m in ("roc_auc", "accuracy", "recall")]),
        ["name", "f1", "roc_auc", "accuracy", "recall"], order=[-F.col("f1"), "name"])
    evolution = H.listed(
        t("t_modelo_evaluacion_temporal"), ["semana_etiqueta", "f1_score", "roc_auc"],
        order=["fecha_auditoria", "semana_etiqueta"],
    ).select(F.struct(
        F.col("doc.semana_etiqueta").alias("labels"), F.col("doc.f1_score").alias("f1_score"),
        F.col("doc.roc_auc").alias("roc_auc")))
    drift = H.listed(
        t("t_modelo_data_drift_psi"), ["feature_name", "psi_value"], order=[-F.col("psi_value"), "feature_name"]
    ).select(F.struct(F.col("doc.feature_name").alias("labels"), F.col("doc.psi_value").alias("psi")))
    stats = ["mean", "median", "std", "min", "max"]
    eda = spark.range(1).select(F.struct(
        t("eda_dimensions").limit(1).select(F.struct("*")).scalar().alias("dimensions"),
        H.keyed_map(t("eda_nulls"), "campo", ["nulos", "porcentaje"]).scalar().alias("nulls"),
        H.listed(t("eda_target_distribution"), ["label", "count", "percentage"], order=["label"]).scalar()
        .alias("target_distribution"),
        H.keyed_map(t("eda_descriptive_stats"), "variable", stats).scalar().alias("descriptive_stats"),
        H.corr_matrix(t("eda_correlation")).select(F.struct("*")).scalar().alias("correlation")))
    return H.report_document(spark, {
        "champion": champion, "business": business, "comparison": comparison, "evolution": evolution,
        "data_drift": drift, "eda": eda, "shap": t("attribution").select(F.struct("*")),
    })


def quality_check(
    spark: SparkSession, db: str, document: DataFrame, models: DataFrame | None = None, model_path: str = "",
) -> DataFrame:
    """The six gates over the clean table, the governance tables and the report.

    Without a list of models the fourth gate looks for the model saved at `model_path`.
    """
    last = R.latest(spark.table(f"{db}.t_modelo_campeon_kpis"), "fecha_registro")
    champion = last.select(F.col("model_name").alias("name"))
    sections = document.select(
        F.get_json_object("document", "$.shap").alias("shap"), F.get_json_object("document", "$.eda").alias("eda")
    )
    return G.all_gates([
        G.gate_schema(spark.table(f"{db}.{CLEAN_TABLE}")),
        G.gate_performance(last),
        G.gate_drift(spark.table(f"{db}.t_modelo_data_drift_psi")),
        G.gate_model_path(spark, OUT.model_saved(spark, model_path), model_path) if models is None else G.gate_model(champion, models),
        G.gate_attribution(sections),
        G.gate_eda(sections),
    ])


def quality_payload(gates: DataFrame, project: str, bucket: str) -> DataFrame:
    """The results of the gates as one message for the quality log: {test: text}, project and place."""
    results = F.map_from_entries(F.sort_array(F.collect_list(F.struct("test", "message"))))
    return gates.agg(results.alias("results")).select("results", F.lit(project).alias("gcp_project"), F.lit(bucket).alias("gcs_bucket"))


def write_documents(spark: SparkSession, db: str, path: str, defaults: Mapping[str, DataFrame] | None = None) -> None:
    """The documents of the jobs as JSON: the run log and the report, one folder each."""
    log = spark.table(f"{db}.run_log")
    runs = log.agg(F.sort_array(F.collect_list(F.struct(*log.columns))).alias("runs"))
    OUT.write_doc(runs.select(F.to_json(F.struct("runs"), {"ignoreNullFields": "false"}).alias("document")), f"{path}/run_log")
    OUT.write_doc(report(spark, db, defaults), f"{path}/report")
