"""Data profiling: one pass per table, then a reshape of one row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions.scalars import label_nan
from creditspark.functions.selection import quantiles
from creditspark.functions.semantics import percent_of, sql_text

# --- fixed values -----------------------------------------------------------
SOLVENT, DEFAULTED = "Solvente (Clase 0)", "Impago/Default (Clase 1)"
# -----------------------------------------------------------------------------


def dimensions(raw: DataFrame, sample: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows of raw, rows of the sample, columns of raw, rows of clean."""

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    spark = raw.sparkSession
    return spark.range(1).select(
        rows(raw).alias("total_rows_raw_est"),
        rows(sample).alias("sample_rows"),
        F.lit(len(raw.columns)).cast("long").alias("total_columns"),
        rows(clean).alias("filtered_rows"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    cols = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.expr(f"count_if(`{c}` IS NULL) AS n{i}") for i, c in enumerate(cols)],
    )
    cells = ", ".join(f"struct({sql_text(c)} AS campo, n{i} AS nulos)" for i, c in enumerate(cols))
    return wide.selectExpr("__rows", f"inline(array({cells}))").select(
        "campo", "nulos", percent_of(F.col("nulos"), F.col("__rows")).alias("porcentaje")
    )


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """label, count, percentage of all rows; NULL reads 'nan'."""
    counts = df.groupBy(label_nan(c).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return _with_share(counts)


def _with_share(counts: DataFrame, groups: int = 1) -> DataFrame:
    """Share of the total; `groups` columns were counted over the same rows."""
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("percentage", percent_of(F.col("count") * groups, total))


def target_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """Two rows, also when a class is absent."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(target) == 0).alias("n0"),
        F.count_if(F.col(target) == 1).alias("n1"),
    )
    cells = ", ".join(
        f"struct({sql_text(label)} AS label, {n} AS count)" for label, n in ((SOLVENT, "n0"), (DEFAULTED, "n1"))
    )
    return wide.selectExpr("rows", f"inline(array({cells}))").select(
        "label", "count", percent_of(F.col("count"), F.col("rows")).alias("percentage")
    )


def describe(
    df: DataFrame, cols: Sequence[str], approximate: bool = False
) -> DataFrame:
    """count, mean, std, min, median, max per present column; undefined reads 0.

    The median is exact at any size (see `quantiles`); `approximate=True` takes
    `percentile_approx` and saves the extra passes. The columns are read once.
    """
    cols = [c for c in cols if c in df.columns]
    narrow = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    mid = "percentile_approx({x}, 0.5D, 10000)" if approximate else "CAST(NULL AS DOUBLE)"
    each = (
        "struct(count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, "
        + mid + " AS median, max({x}) AS max) AS `{c}`"
    )
    # one row per profiled column is all that reaches the driver
    stats = narrow.agg(*[F.expr(each.format(c=c, x=f"`{c}`")) for c in cols]).first().asDict()
    medians = {c: stats[c]["median"] if approximate else None for c in cols}
    if not approximate:
        medians = {c: v[0] for c, v in quantiles(narrow, cols, [0.5]).items()}
    narrow.unpersist()

    def shown(v) -> float:
        return 0.0 if v is None or v != v else float(v)

    long = [
        (c, s["count"], shown(s["mean"]), shown(s["std"]), shown(s["min"]), shown(medians[c]), shown(s["max"]))
        for c, s in ((c, stats[c]) for c in cols)
    ]
    schema = "variable string, count bigint, mean double, std double, min double, median double, max double"
    return df.sparkSession.createDataFrame(long, schema).select(
        "variable", "count", *[F.round(m, 2).alias(m) for m in ("mean", "std", "min", "median", "max")]
    )


def categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """value_counts of several columns in one pass."""
    cols = [c for c in cols if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), label_nan(c).alias("label")) for c in cols])
    counts = (
        df.select(F.inline(pairs))
        .groupBy("variable", "label")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _with_share(counts, groups=len(cols))


class Moments:
    """Rows, means, extremes and co-moments of several columns; two of them merge into that of all their rows.

    Co-moments are sums of products of deviations from the own mean, so large means cost no digits.
    """

    def __init__(self, columns: int):
        self.n, self.mean, self.co = 0.0, np.zeros(columns), np.zeros((columns, columns))
        self.low, self.high = np.full(columns, np.inf), np.full(columns, -np.inf)

    @staticmethod
    def of(x: np.ndarray) -> "Moments":
        m = Moments(x.shape[1])
        if len(x):
            m.n, m.mean, m.low, m.high = float(len(x)), x.mean(axis=0), x.min(axis=0), x.max(axis=0)
            m.co = (x - m.mean).T @ (x - m.mean)
        return m

    def add(self, other: "Moments") -> None:
        if not other.n:
            return
        n, apart = self.n + other.n, other.mean - self.mean
        self.co = self.co + other.co + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.low, self.high = n, np.minimum(self.low, other.low), np.maximum(self.high, other.high)

    def bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.low, self.high, self.co.ravel()]).tobytes()

    @staticmethod
    def read(blob: bytes, columns: int) -> "Moments":
        v, m = np.frombuffer(blob), Moments(columns)
        m.n, m.mean, m.low, m.high = float(v[0]), *v[1 : 1 + 3 * columns].reshape(3, columns)
        m.co = v[1 + 3 * columns :].reshape(columns, columns)
        return m


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Of the rows without a NULL or NaN in any of the columns, in one pass.

    Each task sends one short row; these are merged in parallel by the number of their task, and what is left
    in one last step, so neither the driver nor a task ever sees a row for each task of a large table.
    """
    k, schema = len(cols), "part int, state binary"

    def sent(state: Moments) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([state.bytes()], pa.binary())], names=["part", "state"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(k)
        with np.errstate(invalid="ignore"):  # infinities have no deviation
            for b in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.float64)
                state.add(Moments.of(x[~np.isnan(x).any(axis=1)]))
        if state.n:
            yield sent(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(k)
        with np.errstate(invalid="ignore"):
            for b in batches:
                for blob in b.column(1).to_pylist():
                    state.add(Moments.read(blob, k))
        if state.n:
            yield sent(state)

    own = df.select(*[F.col(f"`{c}`").cast("double") for c in cols]).mapInArrow(collect, schema)
    row = own.repartition("part").mapInArrow(merge, schema).coalesce(1).sortWithinPartitions("part").mapInArrow(merge, schema).first()
    return Moments.read(row["state"], k) if row else Moments(k)


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation as (variable_x, variable_y, correlation), 3 digits, from one pass over the rows.

    Rows with a NULL in any column go first. A constant column correlates 0
    with everything, itself included; no rows left gives all zeros.
    """
    cols = [c for c in cols if c in df.columns]
    m = moments(df, cols) if cols else Moments(0)
    varies = m.low < m.high
    spread = np.sqrt(np.diagonal(m.co))

    def cell(i: int, j: int) -> float:
        v = 1.0 if i == j else m.co[i, j] / spread[i] / spread[j] if varies[i] and varies[j] and spread[i] and spread[j] else 0.0
        return float(v) if varies[i] and varies[j] and np.isfinite(v) and np.isfinite(spread[i]) else 0.0

    triples = [(a, b, cell(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    long = df.sparkSession.createDataFrame(triples, "variable_x string, variable_y string, correlation double")
    return long.withColumn("correlation", F.round("correlation", 3) + F.lit(0.0))


def imbalance(df: DataFrame, target: str = "target") -> DataFrame:
    """negatives / positives."""
    neg, pos = F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)
    return df.agg(neg.alias("negatives"), pos.alias("positives"), F.try_divide(neg, pos).alias("ratio"))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
