"""Sorts, limits and winners. Winners are aggregates, so no group is sorted whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.functions.scalars import model_family

# --- fixed values -----------------------------------------------------------
TIE = 1e-5
TOP_FEATURES, TOP_FACTORS = 12, 6
HISTORY_ROWS, HISTORY_MIN = 7, 2
# -----------------------------------------------------------------------------
RUN_METRICS = ("f1", "roc_auc", "accuracy", "recall", "precision")


def head(df: DataFrame, n: int, order: Sequence[str | Column] = ()) -> DataFrame:
    """First n rows; give an order for a repeatable answer."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def latest(df: DataFrame, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), *tie).limit(1)


def history(
    df: DataFrame, ts: str, n: int = HISTORY_ROWS, newest: bool = False, at_least: int = HISTORY_MIN,
    tie: Sequence[str] = (),
) -> DataFrame:
    """The n oldest rows (or newest), no rows when there are fewer than `at_least`."""
    picked = df.orderBy(F.col(ts).desc() if newest else F.col(ts).asc(), *tie).limit(n)
    # a count over at most n rows, so the input is planned once
    counted = picked.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy()))
    return counted.where(F.col("__rows") >= at_least).drop("__rows")


def top_n(df: DataFrame, by: Column | str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    c = F.col(by) if isinstance(by, str) else by
    return df.orderBy(c.desc(), *tie).limit(n)


def top_per(df: DataFrame, group: Sequence[str], by: Column, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The n highest rows per group, with their position from 1.

    `row_number() <= n` keeps only n rows per group on the map side before the
    shuffle (window group limit), so a hot group stays small.
    """
    w = Window.partitionBy(*group).orderBy(by.desc(), *tie)
    return df.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= n)


def _first(df: DataFrame, order: Column, group: Sequence[Column | str] = ()) -> DataFrame:
    names = df.columns
    picked = F.min_by(F.struct(*names), order).alias("w")
    return df.groupBy(*group).agg(picked).where("w is not null").select("w.*")


def _highest(metric: str, name: str) -> Column:
    """Order with the highest metric first; an unknown metric loses to every known one."""
    return F.struct(F.col(metric).isNull(), -F.col(metric), F.col(name))


def best_run(runs: DataFrame, f1: str = "f1", name: str = "run_name") -> DataFrame:
    """Run with the highest F1; equal F1 goes by name."""
    return _first(runs, _highest(f1, name))


def best_per_family(runs: DataFrame, f1: str = "f1", name: str = "run_name") -> DataFrame:
    """Best run of each booster family, metrics at 3 digits."""
    best = _first(runs, _highest(f1, name), [model_family(name)])
    shown = [c for c in ("f1", "roc_auc", "accuracy", "recall") if c in best.columns]
    return best.select(model_family(name).alias("name"), *[F.round(c, 3).alias(c) for c in shown])


def champion(
    runs: DataFrame, f1: str = "f1", auc: str = "roc_auc", name: str = "name", tol: float = TIE
) -> DataFrame:
    """Highest F1; among F1 within `tol` of it the highest AUC, then the name. Runs without an F1 cannot win."""
    top = runs.agg(F.max(f1)).scalar()
    near = runs.where(F.col(f1) > top - F.lit(tol))
    return _first(near, _highest(auc, name))


def champion_in_order(
    runs: DataFrame, order: str, f1: str = "f1", auc: str = "roc_auc", name: str = "name", tol: float = TIE
) -> DataFrame:
    """The running choice over the candidates of one training, in training order.

    A later run wins with a higher F1, or with an F1 closer than `tol` and a
    higher AUC; an unknown F1 or AUC is below every known one. The answer depends on
    the order, so the log of the training, a few numbers per run, is folded as one array.
    """
    names = runs.columns
    item = F.struct(F.col(order).alias("o"), F.struct(*names).alias("run"))
    by_order = F.array_sort(
        F.collect_list(item), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    )
    log = runs.groupBy().agg(by_order.alias("log"))

    def step(best: Column, cur: Column) -> Column:
        run = cur["run"]
        above = lambda c: (run[c] > best[c]) | (run[c].isNotNull() & best[c].isNull())
        better = above(f1)
        tie = (F.abs(run[f1] - best[f1]) < tol) & above(auc)
        return F.when(better | tie, run).otherwise(best)

    return (
        log.where(F.size("log") > 0)
        .select(F.reduce(F.slice("log", F.lit(2), F.size("log")), F.col("log")[0]["run"], step).alias("w"))
        .select("w.*")
    )


def extremes(scored: DataFrame, prob: str = "prob", key: str = "loan_id") -> DataFrame:
    """The loans with the highest and the lowest probability; smallest key on ties. Unknown probabilities are neither."""
    row = F.struct(*scored.columns)
    picked = scored.where(F.col(prob).isNotNull()).agg(
        F.min_by(row, F.struct(-F.col(prob), F.col(key))).alias("high_risk"),
        F.min_by(row, F.struct(F.col(prob), F.col(key))).alias("low_risk"),
    )
    both = F.array(*[
        F.struct(F.lit(p).alias("perfil_tipo"), F.col(p).alias("w")) for p in ("high_risk", "low_risk")
    ])
    return picked.select(F.inline(both)).where("w is not null").select("perfil_tipo", "w.*")
