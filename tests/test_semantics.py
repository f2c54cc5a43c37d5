"""The rules that differ between engines, with literal expected values."""

import math

import pytest
from pyspark.sql import functions as F

from creditspark.functions import scalars as S
from creditspark.functions import semantics as M
from creditspark.functions.hashing import bernoulli
from creditspark.operators import clean as C

INF = float("inf")


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_ieee_division(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0), (1.0, None)]
    assert values(spark, rows, "a double, b double", M.ieee_div(F.col("a"), F.col("b"))) == [INF, -INF, None, 2.0, None, None]


def test_log1p_edges(spark):
    got = values(spark, [(0.0,), (None,), (-1.0,), (-2.0,), (math.e - 1,)], "a double", M.log1p_np("a"))
    assert got[:4] == [0.0, 0.0, -INF, None]
    assert got[4] == pytest.approx(1.0)


@pytest.mark.parametrize("text, want", [
    ("12.5%", 12.5), (" 7 %", 7.0), ("12.5d", None), ("n/a", None), ("", None), ("1e3%", 1000.0), ("1_0", None),
    ("inf", INF), ("nan", None), (None, None), ("-3.", -3.0), (".5%", 0.5), ("0x10", None),
])
def test_clean_percent(spark, text, want):
    assert values(spark, [(text,)], "t string", M.clean_percent("t")) == [want]


def test_clean_percent_of_a_number(spark):
    assert values(spark, [(12500000.0,), (0.5,)], "t double", M.clean_percent("t")) == [12500000.0, 0.5]


def test_nan_becomes_null_and_infinity_stays(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (INF, "y"), (None, "z")], "a double, s string")
    assert [tuple(r) for r in M.frame_nan_to_null(df).collect()] == [(None, "x"), (INF, "y"), (None, "z")]


def test_term_and_labels(spark):
    rows = [(" 36 months",), ("60",), ("a12b34",), ("none",), (None,)]
    assert values(spark, rows, "t string", S.term_months("t")) == [36.0, 60.0, 12.0, 36.0, 36.0]
    rows = [("10+ years",), ("< 1 year",), ("n/a",), (None,)]
    assert values(spark, rows, "t string", S.map_ordinal("t", S.SENIORITY, 0.0)) == [10.0, 0.5, 0.0, 0.0]
    assert values(spark, [("A",), ("G",), ("H",), (None,)], "t string", S.map_ordinal("t", S.GRADE, 4.0)) == [1, 7, 4, 4]
    assert values(spark, [("x",), (None,)], "t string", S.label_nan("t")) == ["x", "nan"]


def test_rounding_is_half_up(spark):
    assert values(spark, [(2.675,), (2.5,), (-2.675,)], "a double", M.round_k("a", 2)) == [2.68, 2.5, -2.68]


def test_percent_and_fraction(spark):
    assert values(spark, [(0.5,), (1.0,), (41.5,), (None,)], "a double", S.to_percent("a")) == [50.0, 100.0, 41.5, None]
    assert values(spark, [(0.5,), (1.0,), (41.5,)], "a double", S.to_fraction("a")) == [0.5, 1.0, 0.415]


def test_dates_that_do_not_parse_are_null_and_counted(spark):
    df = spark.createDataFrame([("2020-01-31",), ("31/31/2020",), (None,)], "d string")
    assert [r[0] is None for r in df.select(S.parse_issue_date("d")).collect()] == [False, True, True]
    assert df.select(S.unparsed("d")).first()[0] == 1


def test_features_on_hand_made_rows(spark):
    row = {
        "importe_solicitado": 1000.0, "tipo_interes": "10%", "plazo_prestamo": "0 months", "antiguedad_laboral": "1 year",
        "grado_riesgo": "B", "ingresos_anuales": -1.0, "porcentaje_uso_credito_revolving": "50%",
        "consultas_credito_ultimos_6_meses": 2.0, "estado_prestamo": "Default",
    }
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items())
    got = C.clean(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert got["target"] == 1
    assert got["cuota_mensual_estimada"] == INF          # term of 0 months
    assert got["ratio_carga_financiera"] == INF          # income + 1 = 0
    assert got["ingreso_residual_anual"] == -INF
    assert got["ingresos_anuales_log"] == -INF
    assert got["alerta_sobreendeudamiento"] == 1.0


def test_features_without_optional_columns(spark):
    df = spark.createDataFrame(
        [(3600.0, None, None, None, None)],
        "importe_solicitado double, tipo_interes string, ingresos_anuales double, "
        "porcentaje_uso_credito_revolving string, consultas_credito_ultimos_6_meses double",
    )
    got = C.loan_features(df).first()
    assert got["plazo_meses"] == 36.0 and got["antiguedad_laboral_num"] == 0.0 and got["grado_riesgo_num"] == 4.0
    assert got["cuota_mensual_estimada"] == pytest.approx(3600 * 1.12 / 36)
    assert got["ratio_carga_financiera"] == pytest.approx(3600 * 1.12 / 36 * 12 / 2)
    assert got["tipo_interes"] is None and got["ingresos_anuales"] is None


def test_ensure_target_and_present_columns(spark):
    df = spark.createDataFrame([("Default", 1.0), ("Al corriente", 2.0), (None, 3.0)], "estado_prestamo string, x double")
    assert [(r["x"], r["target"]) for r in C.ensure_target(df).collect()] == [(1.0, 1)]
    assert C.select_present(df, ["x", "y"]).columns == ["x"]


def test_metric_columns_are_found_by_name(spark):
    df = spark.createDataFrame([("r", 1.0, 2.0, 3.0, 4.0, 5.0)], "run_name string, `m_F1` double, ROC double, accuracy double, recall_x double, precision double")
    assert S.standard_metrics(df).first().asDict() == {
        "run_name": "r", "f1": 1.0, "roc_auc": 2.0, "accuracy": 3.0, "recall": 4.0, "precision": 5.0,
    }
    with pytest.raises(KeyError):
        S.find_metric_col(df, ["gini"])


def test_bernoulli_share(spark):
    df = spark.range(20000)
    assert df.where(bernoulli("id", 0.1, 42)).count() == pytest.approx(2000, rel=0.1)
    assert df.where(bernoulli("id", 1.0, 42)).count() == 20000
    assert df.where(bernoulli("id", 0.0, 42)).count() == 0
