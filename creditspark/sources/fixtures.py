"""The loan schema on the order tables, one loan per order.

`loans` joins only what the wanted columns need: a query on states and dates
reads two columns of `orders` and no other table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.operators import clean as C

FROM_LINES = {
    "tipo_interes", "puntuacion_crediticia_media", "bancarrotas_publicas", "consultas_credito_ultimos_6_meses",
    "impago_ultimos_2_anios", "porcentaje_uso_credito_revolving",
}
FROM_CUSTOMER = {
    "antiguedad_laboral", "grado_riesgo", "ingresos_anuales", "ratio_prestamo_ingresos", "tipo_vivienda",
}
PSEUDO_MODELS = ["CatBoost", "LightGBM", "XGBoost"]


# a declared schema saves a footer-reading job per table and query
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_acctbal double, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_quantity double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string",
}

LOAN_SQL = {
    "loan_id": "o_orderkey",
    "importe_solicitado": "o_totalprice",
    "tipo_interes": """CASE WHEN o_orderkey % 97 = 0 THEN 'n/a'
        ELSE CAST(CAST(5 + max_tax * 100 + o_orderkey % 17 AS DECIMAL(6,2)) AS STRING) || '%' END""",
    "plazo_prestamo": """CASE WHEN o_orderkey % 97 = 3 THEN NULL WHEN o_orderkey % 3 = 0 THEN ' 60 months'
        ELSE ' 36 months' END""",
    "antiguedad_laboral": """CASE c_custkey % 13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 10 THEN '10+ years'
        WHEN 11 THEN NULL WHEN 12 THEN 'n/a' ELSE CAST(c_custkey % 13 AS STRING) || ' years' END""",
    "grado_riesgo": """CASE WHEN c_custkey % 8 = 7 THEN NULL
        ELSE substring('ABCDEFG', CAST(c_custkey % 8 + 1 AS INT), 1) END""",
    "ingresos_anuales": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 12 END",
    "ratio_prestamo_ingresos": "CASE WHEN c_acctbal > 0 THEN try_divide(o_totalprice, c_acctbal * 12) END",
    "puntuacion_crediticia_media": "CAST(600 + qty / 2 AS DOUBLE)",
    "bancarrotas_publicas": "CAST(n_ret AS DOUBLE)",
    "consultas_credito_ultimos_6_meses": "CAST(n_lines AS DOUBLE)",
    "impago_ultimos_2_anios": "CAST(n_ret_f AS DOUBLE)",
    "porcentaje_uso_credito_revolving": "CAST(CAST(max_disc * 1000 AS DECIMAL(6,1)) AS STRING) || '%'",
    "finalidad_prestamo": "o_orderpriority",
    "tipo_vivienda": "c_mktsegment",
    "estado_prestamo": """CASE o_orderstatus WHEN 'P' THEN 'Pagado completamente'
        WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Al corriente' ELSE 'Pagado completamente' END
        ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Incobrable' WHEN 1 THEN 'Default' WHEN 2 THEN 'Retraso de 31 a 120 días'
             WHEN 3 THEN 'Periodo de gracia' ELSE 'Pagado completamente' END END""",
    "fecha_emision": "o_orderdate",
}
LOAN_COLUMNS = list(LOAN_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _line_facts(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*map(F.expr, (
        "count(*) AS n_lines", "max(l_tax) AS max_tax", "max(l_discount) AS max_disc", "sum(l_quantity) AS qty",
        "count_if(l_returnflag = 'R') AS n_ret", "count_if(l_returnflag = 'R' AND l_linestatus = 'F') AS n_ret_f",
    )))


def loans(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    wanted = list(columns) if columns else LOAN_COLUMNS
    frame = table(spark, sf_dir, "orders")
    if FROM_LINES & set(wanted):
        # the facts come out of their aggregation partitioned by order: join them there
        # rather than ship one row per order to every executor
        facts = _line_facts(table(spark, sf_dir, "lineitem")).hint("merge")
        frame = frame.join(facts, "o_orderkey", "left")
    if FROM_CUSTOMER & set(wanted):
        customer = table(spark, sf_dir, "customer")
        frame = frame.join(customer, F.expr("c_custkey = o_custkey"), "left")
    return frame.selectExpr(*[f"{LOAN_SQL[c]} AS {c}" for c in wanted])


def mature_loans(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """`columns` of the mature loans, with their target."""
    need = list(dict.fromkeys([*columns, "estado_prestamo"]))
    return C.binarize_target(C.mature_filter(loans(spark, sf_dir, need)))


def clean_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table: mature loans with target and engineered features."""
    return C.clean(loans(spark, sf_dir))


def loans_drift(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Loans whose amounts rise by 80% from 2000 on."""
    shifted = F.expr("""CASE WHEN fecha_emision >= TIMESTAMP_NTZ '2000-01-01' THEN importe_solicitado * 1.8D
        ELSE importe_solicitado END""")
    return loans(spark, sf_dir, columns).withColumn("importe_solicitado", shifted)


def loans_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loans with features and a target that the grade explains in part."""
    planted = F.expr("CAST(grado_riesgo_num * 10 + (loan_id * 7919) % 100 >= 120 AS INT)")
    return C.loan_features(loans(spark, sf_dir)).withColumn("target", planted)


def scored(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> DataFrame:
    """Three pseudo-models' scores of every mature loan: loan_id, model_name, target, prob; some loans have no score."""
    base = mature_loans(spark, sf_dir, ["loan_id", *columns])
    models = ", ".join(f"struct({k}L AS k, '{m}' AS model_name)" for k, m in enumerate(PSEUDO_MODELS))
    points = "CASE WHEN loan_id % 89 <> 5 THEN CAST((loan_id * (7919 + 2 * m.k)) % 1000 + 250 * target AS DOUBLE) / 1250e0 END"
    return base.selectExpr("*", f"explode(array({models})) AS m").selectExpr(
        "loan_id", "m.model_name AS model_name", "target", f"{points} AS prob", *columns
    )
