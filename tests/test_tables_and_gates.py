"""Sinks by write and read back, small joins, documents, gates, the stream."""

import json

import pytest
from pyspark.sql import functions as F

from creditspark.operators import gate as G
from creditspark.operators import reshape as H
from creditspark.plans.q_files import database
from creditspark.sources import readers as IN
from creditspark.sources import sinks as OUT
from creditspark.sources.scratch import scratch_path, shared_dir
from creditspark.streaming.quality_log import quality_log_stream


def test_scratch_is_the_sessions_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named.rstrip("/") and scratch_path(spark, "x").startswith(named.rstrip("/"))


def test_csv_columns_are_found_by_header(spark):
    path = scratch_path(spark, "csv")
    lines = ["importe_solicitado;otra;tipo_interes", "100.5;x;12%", "mal;y;n/a", "NaN;z;"]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    df = IN.read_loans_csv(spark, path)
    assert dict(df.dtypes) == {"importe_solicitado": "double", "otra": "string", "tipo_interes": "string"}
    assert [tuple(r) for r in df.collect()] == [(100.5, "x", "12%"), (None, "y", "n/a"), (None, "z", None)]


def test_readers_always_find_a_table(spark):
    name = f"{database(spark)}.t"
    OUT.write_replace(spark.range(5), name)
    under_way = spark.table(name)
    OUT.write_replace(spark.range(7), name)
    assert under_way.count() in (5, 7) and spark.table(name).count() == 7
    OUT.write_replace(spark.range(2).withColumnRenamed("id", "other"), name)
    assert spark.table(name).columns == ["other"] and spark.table(name).count() == 2
    with pytest.raises(Exception):
        OUT.write_replace(spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("other")), name)
    assert spark.table(name).count() == 2


def test_replace_may_read_the_table_it_replaces(spark):
    name = f"{database(spark)}.t"
    OUT.write_replace(spark.range(5), name)
    OUT.write_replace(spark.table(name).where("id > 2"), name)
    assert sorted(r[0] for r in spark.table(name).collect()) == [3, 4]
    OUT.append(spark.range(1), name)
    assert spark.table(name).count() == 3


def test_folders_left_long_ago_are_removed(spark):
    db = database(spark)
    name = f"{db}.t"
    assert OUT.remove_versions(spark, name) == []
    for n in (5, 6, 7):
        OUT.write_replace(spark.range(n), name)
    OUT.write_replace(spark.range(9), f"{db}.t__v_other")
    folders = [path for _, path in OUT._versions(spark, name)]
    assert len(folders) == 3 and OUT.remove_versions(spark, name, hours=1) == []
    first = spark.read.parquet(folders[0])
    assert first.count() == 5
    assert OUT.remove_versions(spark, name, hours=-1) == folders[:2]
    assert spark.table(name).count() == 7 and spark.table(f"{db}.t__v_other").count() == 9
    assert [path for _, path in OUT._versions(spark, name)] == folders[2:]
    assert OUT.remove_versions(spark, name, hours=-1) == []


def test_a_folder_in_use_outlives_newer_ones(spark):
    """A write that failed, or is under way, has left a newer folder."""
    name = f"{database(spark)}.t"
    OUT.write_replace(spark.range(5), name)
    spark.range(3).write.parquet(OUT._new_version(spark, name))
    spark.range(4).write.parquet(OUT._new_version(spark, name))
    assert len(OUT.remove_versions(spark, name, hours=-1)) == 1
    assert spark.table(name).count() == 5 and len(OUT._versions(spark, name)) == 2


def test_required_columns_and_load_time(spark):
    db = database(spark)
    OUT.ensure_tables(spark, db)
    good = spark.createDataFrame([("a", 0.1)], "feature_name string, psi_value double")
    OUT.append_rows(good, db, "t_modelo_data_drift_psi")
    assert spark.table(f"{db}.t_modelo_data_drift_psi").first()["fecha_auditoria"] is not None
    bad = spark.createDataFrame([("a", None)], "feature_name string, psi_value double")
    with pytest.raises(Exception, match="NULL in required column psi_value"):
        OUT.append_rows(bad, db, "t_modelo_data_drift_psi")
    with pytest.raises(Exception, match="NULL in required column psi_value"):
        OUT.delete_reload(bad, db, "t_modelo_data_drift_psi")
    assert spark.table(f"{db}.t_modelo_data_drift_psi").count() == 1


def test_defaults_for_missing_and_empty_tables(spark):
    db = database(spark)
    defaults = spark.createDataFrame([(9,)], "id long")
    assert OUT.table_or(spark, f"{db}.none", defaults).first()["id"] == 9
    OUT.write_replace(spark.range(0), f"{db}.empty")
    assert OUT.table_or(spark, f"{db}.empty", defaults).first()["id"] == 9
    OUT.write_replace(spark.range(2), f"{db}.full")
    assert OUT.table_or(spark, f"{db}.full", defaults).count() == 2


def test_documents_keep_null_fields(spark):
    path = scratch_path(spark, "doc")
    a = spark.createDataFrame([("k", None), ("b", 2.0)], "name string, v double")
    doc = H.report_document(spark, {"map": H.keyed_map(a, "name", ["v"]), "list": H.listed(a, ["name", "v"], order=["name"])})
    got = json.loads(doc.first()[0])
    assert got == {"map": {"b": {"v": 2.0}, "k": {"v": None}}, "list": [{"name": "b", "v": 2.0}, {"name": "k", "v": None}]}
    OUT.write_doc(doc, path)
    from pyspark.sql import types as T

    back = IN.read_doc(spark, path, T.StructType.fromDDL("list array<struct<name: string, v: double>>"))
    assert back.first()["list"][0]["v"] == 2.0


def test_small_joins(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, f1 double")
    champ = rows.where("name = 'b'")
    assert {r["name"]: r["es_campeon"] for r in H.flag_champion(rows, champ).collect()} == {"a": False, "b": True}
    assert {r["es_campeon"] for r in H.flag_champion(rows, champ.limit(0)).collect()} == {False}
    assert [r["name"] for r in H.lookup_run(rows, champ).collect()] == ["b"]
    models = spark.createDataFrame([("Champion_b_MVP_Balanced",)], "display_name string")
    assert {r["display_name"]: r["found"] for r in H.model_exists(rows, models).collect()} == {
        "Champion_a_MVP_Balanced": False, "Champion_b_MVP_Balanced": True}


def test_matrix_fills_gaps_and_mirrors(spark):
    corr = spark.createDataFrame([("b", "a", 0.5), ("a", "a", 1.0), ("c", "a", 0.1)], "variable_x string, variable_y string, correlation double")
    r = H.corr_matrix(corr).first()
    assert r["columns"] == ["a", "b", "c"]
    assert r["matrix"] == [[1.0, 0.5, 0.1], [0.5, 1.0, 1.0], [0.1, 1.0, 1.0]]
    assert [x[0] for x in H.corr_axes(corr).collect()] == ["a", "b", "c"]


def test_zip_and_scale(spark):
    df = spark.createDataFrame([(["a", "b"], [1.0])], "l array<string>, v array<double>")
    assert [tuple(r) for r in H.zip_explode(df, "l", "v").collect()] == [("a", 1.0)]
    s = spark.createDataFrame([(0.4,), (41.0,)], "f double")
    assert sorted(r[0] for r in H.scale_column(s, "f").collect()) == [0.004, 0.41]
    assert [r[0] for r in H.scale_column(s.limit(1), "f").collect()] == [0.4]


KPI = "f1_score double, roc_auc double, recall double"


def one(df):
    return tuple(df.first())


def test_gates(spark):
    clean = spark.createDataFrame([(1, 1.0, 1.0)], "target int, importe_solicitado double, ingresos_anuales double")
    assert one(G.gate_schema(clean))[1] is True
    assert one(G.gate_schema(clean.limit(0)))[1:3] == (False, "Fail: Tabla vacía.")
    assert "['target']" in one(G.gate_schema(clean.drop("target")))[2]
    ok = spark.createDataFrame([(35.0, 65.0, 50.0)], KPI)
    assert one(G.gate_performance(ok))[1] is True
    low = spark.createDataFrame([(34.9, 65.0, None)], KPI)
    assert one(G.gate_performance(low))[2] == "Fail: Incumplimiento de umbral: F1-score 34.9% < 35.0%, Recall nan% < 50.0%"
    psi = spark.createDataFrame([("a", 0.25), ("b", 0.3), ("c", 0.1)], "feature_name string, psi_value double")
    assert one(G.gate_drift(psi)) == ("Test 3", False, "Fail: Drift crítico en: b (PSI=0.3), a (PSI=0.25)", True)
    assert one(G.gate_drift(psi.limit(0)))[1:] == (True, "Pass: Sin drift crítico.", False)
    champ = spark.createDataFrame([("X",)], "name string")
    models = spark.createDataFrame([("Champion_X_MVP_Balanced",)], "display_name string")
    assert one(G.gate_model(champ, models))[1] is True and one(G.gate_model(champ, models.limit(0)))[1] is False
    assert one(G.gate_model_path(spark, False, "p"))[1] is False


@pytest.mark.parametrize("doc, passed", [
    ('{"global": [], "local": {}}', True), ('{"global": []}', False), ('{"global": [], "local": {}, "error": "x"}', False),
    (None, False), ("no json", False),
])
def test_gate_attribution(spark, doc, passed):
    assert one(G.gate_attribution(spark.createDataFrame([(doc,)], "shap string")))[1] is passed


@pytest.mark.parametrize("prefix, drop, passed", [("", None, True), ("eda_", None, True), ("", "nulls", False)])
def test_gate_eda(spark, prefix, drop, passed):
    doc = json.dumps({prefix + s: 1 for s in G.EDA_SECTIONS if s != drop})
    assert one(G.gate_eda(spark.createDataFrame([(doc,)], "eda string")))[1] is passed


def test_rollup_retrains_on_drift_only(spark):
    schema = "test string, passed boolean, message string, drift boolean"
    rows = [("Test 1", True, "", False), ("Test 2", False, "", False)]
    assert one(G.gate_rollup(spark.createDataFrame(rows, schema), G.TESTS[:2])) == (False, False, 1)
    assert one(G.gate_rollup(spark.createDataFrame([*rows, ("Test 3", False, "", True)], schema), G.TESTS[:3])) == (False, True, 2)
    assert one(G.gate_rollup(spark.createDataFrame(rows, schema), G.TESTS[:3])) == (False, False, 2)


def test_stream_appends_each_file_once(spark):
    inbox, db, checkpoint = scratch_path(spark, "inbox"), database(spark), scratch_path(spark, "stream")
    table = f"{db}.log"

    def post(n):
        body = F.create_map(F.lit("Test 1"), F.lit("Pass"))
        spark.range(n).select(body.alias("results"), F.lit("p").alias("gcp_project"), F.lit("b").alias("gcs_bucket")) \
            .repartition(n).write.mode("append").json(inbox)

    post(2)
    for want in (2, 2):
        quality_log_stream(spark, inbox, table, checkpoint)
        assert spark.table(table).count() == want
    post(1)  # the same content again is a new result
    quality_log_stream(spark, inbox, table, checkpoint)
    assert spark.table(table).count() == 3
    assert json.loads(spark.table(table).first()["results"]) == {"Test 1": "Pass"}


def test_csv_files_keep_their_own_column_order(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("importe_solicitado;ingresos_anuales",), ("300;7000",)], "value string").coalesce(1).write.text(f"{path}/a")
    spark.createDataFrame([("ingresos_anuales;importe_solicitado",), ("8000;400",), ("9000;x",), ("1",)], "value string").coalesce(1).write.text(f"{path}/b")
    rows = IN.read_loans_csv(spark, f"{path}/*", keep_broken=True).collect()
    assert {(r.importe_solicitado, r.ingresos_anuales) for r in rows if r.linea_rota is None} == {(300.0, 7000.0), (400.0, 8000.0)}
    assert sorted(r.linea_rota for r in rows if r.linea_rota) == ["1", "9000;x"]
    assert tuple(IN.broken_lines(spark, f"{path}/*").first()) == (4, 2)


def test_gates_fail_on_nothing(spark):
    kpis = spark.createDataFrame([], "f1_score double, roc_auc double, recall double")
    assert [tuple(r) for r in G.gate_performance(kpis).select("passed", "message").collect()] == [(False, "Fail: Sin métricas del campeón.")]
    nobody, models = spark.createDataFrame([], "name string"), spark.createDataFrame([("Champion_a_MVP_Balanced",)], "display_name string")
    assert [r.passed for r in G.gate_model(nobody, models).collect()] == [False]
    somebody = spark.createDataFrame([("a",)], "name string")
    assert [r.passed for r in G.gate_model(somebody, models).collect()] == [True]
    empty = G.gate_model(somebody, models).limit(0)
    assert tuple(G.gate_rollup(empty).first()) == (False, False, 6)
    assert tuple(G.gate_rollup(G.gate_model(somebody, models), ["Test 4"]).first()) == (True, False, 0)
    assert not OUT.model_saved(spark, scratch_path(spark, "no-model"))


HEADS = [("importe_solicitado", "ingresos_anuales", "otra"), ("otra", "ingresos_anuales", "importe_solicitado"), ("ingresos_anuales", "importe_solicitado")]


def many_files(spark, files):
    """`files` CSV files, written by one job, whose headers name the columns in three orders."""
    path = scratch_path(spark, "csv many 50%")
    fields = {"importe_solicitado": F.col("id") * 10, "ingresos_anuales": F.col("id") * 100, "otra": F.concat(F.lit("o"), "id")}
    text = [F.array(F.lit(";".join(head)), F.concat_ws(";", *[fields[c].cast("string") for c in head])) for head in HEADS]
    rows = F.get(F.array(*text), (F.col("id") % 3).cast("int"))
    spark.range(0, files, 1, files).select(F.explode(rows).alias("value")).write.text(path)
    return path


def jobs_of(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_headers_of_many_files_take_as_many_jobs_as_those_of_few(spark):
    few, many = many_files(spark, 3), many_files(spark, 200)
    small, jobs_small = jobs_of(spark, "few-files", lambda: IN.read_loans_csv(spark, few))
    df, jobs = jobs_of(spark, "many-files", lambda: IN.read_loans_csv(spark, many))
    # headers in one query, then a job for each distinct one; beyond 32 files Spark lists each group's in a job
    assert small.count() == 3 and 0 < jobs <= jobs_small + len(HEADS) <= 9
    got = {(r.importe_solicitado, r.ingresos_anuales, r.otra) for r in df.collect()}
    assert got == {(i * 10.0, i * 100.0, f"o{i}" if i % 3 < 2 else None) for i in range(200)}


def test_a_header_reads_no_more_than_the_first_lines(spark):
    """A large file is one task, which ends after its first batch."""
    path = scratch_path(spark, "csv")
    spark.range(400_000).coalesce(1).select(F.when(F.col("id") == 0, "importe_solicitado").otherwise(F.col("id").cast("string")).alias("value")).write.text(path)
    heads = IN.file_headers(spark, path)
    assert heads.rdd.getNumPartitions() == 1 and [r.header for r in heads.collect()] == ["importe_solicitado"]
    assert IN.read_loans_csv(spark, path).count() == 399_999


def test_files_without_a_line_and_blank_first_lines(spark):
    path = scratch_path(spark, "csv")
    spark.range(0).select(F.lit("").alias("value")).write.text(f"{path}/none")
    spark.createDataFrame([("",), ("  ",)], "value string").coalesce(1).write.text(f"{path}/blank")
    assert IN.read_loans_csv(spark, f"{path}/*").count() == 0
    spark.createDataFrame([("",), ("importe_solicitado",), ("7",)], "value string").coalesce(1).write.text(f"{path}/some")
    assert [tuple(r) for r in IN.read_loans_csv(spark, f"{path}/*").collect()] == [(7.0,)]
