"""Joins on small results, long and wide forms, nested documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CHAMPION_DISPLAY = "Champion_{}_MVP_Balanced"
AS_PERCENT = {
    "accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1_score", "roc_auc": "roc_auc",
}
# -----------------------------------------------------------------------------


def flag_champion(comparison: DataFrame, champion: DataFrame, name: str = "name") -> DataFrame:
    """es_campeon: the row's name is the champion's name."""
    return comparison.withColumn("es_campeon", F.col(name).eqNullSafe(champion.select(name).scalar()))


def lookup_run(runs: DataFrame, champion: DataFrame, name: str = "name") -> DataFrame:
    """The run rows of the current champion."""
    return runs.where(F.col(name) == champion.select(name).scalar())


def display_name(champion: Column) -> Column:
    head, tail = CHAMPION_DISPLAY.split("{}")
    return F.concat(F.lit(head), champion, F.lit(tail))


def model_exists(champion: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """expected display name, and whether the model list has it."""
    expected = champion.select(display_name(F.col(name)).alias("display_name"))
    found = models.select("display_name").distinct().withColumn("found", F.lit(True))
    return expected.join(found, "display_name", "left").select(
        "display_name", F.coalesce("found", F.lit(False)).alias("found")
    )


def zip_explode(df: DataFrame, labels: str, values: str, label: str = "label", value: str = "value") -> DataFrame:
    """Two parallel arrays to rows; the longer one is cut, as a zip does."""
    n = F.least(F.size(labels), F.size(values))
    pairs = F.arrays_zip(F.slice(labels, F.lit(1), n).alias(label), F.slice(values, F.lit(1), n).alias(value))
    return df.select(F.explode(pairs).alias("p")).select(f"p.{label}", f"p.{value}")


def corr_axes(corr: DataFrame) -> DataFrame:
    """Sorted distinct names of both axes."""
    names = corr.select(F.col("variable_x").alias("variable")).union(corr.select("variable_y"))
    return names.distinct().orderBy("variable")


def corr_matrix(corr: DataFrame) -> DataFrame:
    """Long triples to one row: columns and a square symmetric matrix, gaps 1.0.

    The result itself is one row of (number of columns)^2 cells, so is the
    aggregation state; it does not grow with the data profiled.
    """
    cell = F.struct(F.struct("variable_x", "variable_y").alias("k"), F.col("correlation").alias("v"))
    one = corr.groupBy("variable_x", "variable_y").agg(F.max("correlation").alias("correlation")).agg(
        F.map_from_entries(F.collect_list(cell)).alias("m"),
        F.array_sort(F.array_union(F.collect_set("variable_x"), F.collect_set("variable_y"))).alias("columns"),
    )

    def at(x: Column, y: Column) -> Column:
        def look(a: Column, b: Column) -> Column:
            return F.try_element_at("m", F.struct(a.alias("variable_x"), b.alias("variable_y")))

        return F.coalesce(look(x, y), look(y, x), F.lit(1.0))

    matrix = F.transform("columns", lambda x: F.transform("columns", lambda y: at(x, y)))
    return one.select("columns", matrix.alias("matrix"))


def matrix_cells(matrix: DataFrame) -> DataFrame:
    """The square form back to rows (i, j, variable_x, variable_y, correlation)."""
    return (
        matrix.select("columns", F.posexplode("matrix").alias("i", "row"))
        .select("columns", "i", F.posexplode("row").alias("j", "correlation"))
        .select(
            "i", "j", F.col("columns")[F.col("i")].alias("variable_x"),
            F.col("columns")[F.col("j")].alias("variable_y"), "correlation",
        )
    )


def unpivot_stats(wide: DataFrame, cols: Sequence[str], stats: Sequence[str], label: str = "variable") -> DataFrame:
    """One row of `<column>__<stat>` aggregates to one row per column."""
    cells = [
        F.struct(F.lit(c).alias(label), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols
    ]
    return wide.select(F.inline(F.array(*cells)))


def flatten_local(doc: DataFrame, local: str = "local", profiles: Sequence[str] = ("high_risk", "low_risk")) -> DataFrame:
    """Nested local profiles to one row per factor, in order from 1."""
    both = F.array(*[
        F.struct(F.lit(p).alias("perfil_tipo"), F.col(f"{local}.{p}").alias("d")) for p in profiles
    ])
    return (
        doc.select(F.inline(both))
        .select("perfil_tipo", "d.probability", F.posexplode("d.factors").alias("pos", "f"))
        .select(
            "perfil_tipo",
            F.col("probability").alias("probability_pct"),
            F.col("f.feature").alias("feature_name"),
            F.col("f.value").cast("string").alias("feature_value"),
            F.col("f.shap").alias("shap_impact"),
            (F.col("pos") + 1).cast("long").alias("orden"),
        )
    )


def keyed_map(df: DataFrame, key: str, cols: Sequence[str], out: str = "doc") -> DataFrame:
    """Report rows to one {key: struct} map."""
    entry = F.struct(F.col(key).alias("k"), F.struct(*cols).alias("v"))
    return df.agg(F.map_from_entries(_by_key(F.collect_list(entry))).alias(out))


def _by_key(items: Column) -> Column:
    """Sort {k, v} structs by k alone; v may hold maps, which have no order."""
    return F.array_sort(items, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))


def listed(df: DataFrame, cols: Sequence[str], out: str = "doc", order: Sequence[Column | str] = ()) -> DataFrame:
    """Report rows to one array of structs, sorted by `order`."""
    value = F.struct(*cols).alias("v")
    if not order:
        return df.agg(F.collect_list(value).alias(out))
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    items = F.collect_list(F.struct(F.struct(*keys).alias("k"), value))
    return df.agg(F.transform(_by_key(items), lambda s: s["v"]).alias(out))


def report_document(spark, sections: Mapping[str, DataFrame], out: str = "document") -> DataFrame:
    """One-row, one-column sections to one nested JSON document; NULL fields stay visible."""
    parts = []
    for name, frame in sections.items():
        if len(frame.columns) != 1:
            frame = frame.select(F.struct(*frame.columns).alias(name))
        parts.append(frame.scalar().alias(name))
    doc = spark.range(1).select(*parts)
    return doc.select(F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias(out))


def as_percent(df: DataFrame, names: Mapping[str, str] = AS_PERCENT, keep: Sequence[str] = ()) -> DataFrame:
    """Fractions to percentages with 2 digits, under their table names."""
    return df.select(*keep, *[F.round(F.col(a) * 100, 2).alias(b) for a, b in names.items()])


def scale_column(df: DataFrame, col: str) -> DataFrame:
    """If any value exceeds 1 the whole column is percentages: divide by 100; 3 digits."""
    # the KPI history is a few rows, so a window over all of them plans its input once
    any_percent = F.coalesce(F.max(col).over(Window.partitionBy()) > 1.0, F.lit(False))
    return df.withColumn(col, F.round(F.when(any_percent, F.col(col) / 100.0).otherwise(F.col(col)), 3))


def with_default(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """The frame, or `defaults` when it has no rows."""
    rows = df.limit(1).agg(F.count(F.lit(1))).scalar()
    return df.unionByName(defaults.where(rows == 0))
