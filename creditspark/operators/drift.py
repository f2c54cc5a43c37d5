"""Population stability index between a baseline and a recent population."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions.selection import quantiles
from creditspark.functions.semantics import sql_double, sql_text
from creditspark.operators.split import Key, chrono_cut

# --- fixed values -----------------------------------------------------------
BUCKETS = 10
EMPTY_SHARE = 1e-4
PSI_LIMIT = 0.25
BASELINE_FRACTION = 0.8
# report label: column of the clean table
DRIFT_FEATURES = {
    "importe_solicitado": "importe_solicitado",
    "puntuacion_buro": "puntuacion_crediticia_media",
    "antiguedad_laboral": "antiguedad_laboral_num",
    "ratio_deuda_ingresos": "ratio_prestamo_ingresos",
    "ingresos_anuales": "ingresos_anuales",
}
# -----------------------------------------------------------------------------


def rename_features(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Warehouse columns under their report labels."""
    return df.select(*keep, *[F.col(c).alias(label) for label, c in mapping.items()])


def quantile_edges(
    df: DataFrame, cols: Sequence[str], buckets: int = BUCKETS
) -> dict[str, list[float]]:
    """Distinct quantile edges per column: at most buckets + 1 numbers each."""
    probs = [i / buckets for i in range(buckets + 1)]
    found = quantiles(df, cols, probs)
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


def edges_frame(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Edges as rows (feature, position, edge)."""
    rows = [(f, i, float(e)) for f, es in edges.items() for i, e in enumerate(es)]
    return df.sparkSession.createDataFrame(rows, "feature_name string, position int, edge double")


def bin_of(column: str, edges: Sequence[float]) -> str:
    """SQL for the index of the bin [e_i, e_i+1), the last one closed; NULL outside the edges."""
    x = f"CAST(`{column}` AS DOUBLE)"
    e = [sql_double(v) for v in edges]
    inner = " ".join(f"WHEN {x} < {v} THEN {i}" for i, v in enumerate(e[1:-1]))
    last = f"WHEN {x} <= {e[-1]} THEN {len(e) - 2}"
    return f"CASE WHEN {x} < {e[0]} THEN NULL {inner} {last} END"


def bin_counts(df: DataFrame, edges: Mapping[str, Sequence[float]], side: Column | None = None) -> DataFrame:
    """(feature_name, side, bin, n) of all non-null values; bin is NULL outside the edges.

    One pass for all features: each row becomes one small struct per feature and
    is counted on the map side, so the shuffle carries counts only.
    """
    side = F.lit(True) if side is None else side
    usable = {f: es for f, es in edges.items() if len(es) >= 2}
    cells = ", ".join(
        f"struct({sql_text(f)} AS feature_name, __side AS side, `{f}` IS NOT NULL AS known, {bin_of(f, es)} AS bin)"
        for f, es in usable.items()
    )
    if not cells:
        empty = "feature_name string, side boolean, bin int, n bigint"
        return df.sparkSession.createDataFrame([], empty)
    return (
        df.select(*usable, side.alias("__side"))
        .selectExpr(f"inline(array({cells}))")
        .where("known")
        .groupBy("feature_name", "side", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def psi_of_counts(counts: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """(feature_name, psi_value) from bin counts with side true = baseline."""
    spark = counts.sparkSession
    grid = spark.createDataFrame(
        [(f, i) for f, es in edges.items() for i in range(max(len(es) - 1, 1))], "feature_name string, bin int"
    )
    base, n = F.col("side"), F.col("n")
    totals = counts.groupBy("feature_name").agg(
        F.sum(F.when(base, n)).alias("base_rows"), F.sum(F.when(~base, n)).alias("recent_rows")
    )
    cells = counts.groupBy("feature_name", "bin").agg(
        F.sum(F.when(base, n)).alias("base_n"), F.sum(F.when(~base, n)).alias("recent_n")
    )

    def share(part: str, whole: str) -> Column:
        s = F.try_divide(F.coalesce(F.col(part), F.lit(0)), F.col(whole))
        return F.when(s == 0, F.lit(EMPTY_SHARE)).otherwise(s)

    # NULL shares (a side without rows, or fewer than two edges) add nothing
    e, a = F.col("e"), F.col("a")
    return (
        grid.join(cells, ["feature_name", "bin"], "left")
        .join(totals, "feature_name", "left")
        .select("feature_name", share("base_n", "base_rows").alias("e"), share("recent_n", "recent_rows").alias("a"))
        .groupBy("feature_name")
        .agg(F.coalesce(F.sum((a - e) * F.ln(F.try_divide(a, e))), F.lit(0.0)).alias("psi_value"))
    )


def psi(
    df: DataFrame, side: Column, cols: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """PSI per column; `side` is true for baseline rows."""
    edges = quantile_edges(df.where(side), cols, buckets)
    return psi_of_counts(bin_counts(df, edges, side), edges)


def psi_report(
    df: DataFrame, ts: str, key: Key, features: Mapping[str, str] = DRIFT_FEATURES,
    fraction: float = BASELINE_FRACTION, cut: tuple[Column, int] | None = None,
) -> DataFrame:
    """PSI of the drift features, first part of the issue dates against the rest, 4 digits.

    `cut` is the result of `chrono_cut` where the caller has it already.
    """
    first = (cut or chrono_cut(df, ts, fraction, key))[0]
    sides = rename_features(df.withColumn("__first", first), features, keep=["__first"])
    values = psi(sides, F.col("__first"), list(features))
    return values.withColumn("psi_value", F.round("psi_value", 4))


def breaches(psi_frame: DataFrame, limit: float = PSI_LIMIT) -> DataFrame:
    return psi_frame.where(F.col("psi_value") >= limit)


def drift_flag(psi_frame: DataFrame, limit: float = PSI_LIMIT) -> DataFrame:
    over = F.col("psi_value") >= limit
    return psi_frame.agg(
        F.count_if(over).alias("breached"), F.coalesce(F.bool_or(over), F.lit(False)).alias("drift_detected")
    )


def max_psi(psi_frame: DataFrame) -> DataFrame:
    return psi_frame.agg(F.coalesce(F.max("psi_value"), F.lit(0.0)).alias("max_psi"))
