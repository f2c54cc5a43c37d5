"""Reproducible samples and splits.

Every exact operator turns into a predicate on a row's own columns: the cut
is found once with small histograms (`first_k`, `class_cuts`), then the two sides are plain
filters. `key` must identify a row; copies that share a key stay together. A class
column may have any number of values; see `with_place` for more than 64.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.classes import PLACE, class_cuts, even_parts, largest_remainders, train_share, with_place
from creditspark.functions.hashing import bernoulli, order_text
from creditspark.functions.selection import SMALL, first_k, hash_levels, round_half_even

SEED = 42
BUCKET_ROWS = 1_000_000

Key = str | Sequence[str]


def scan_sample(df: DataFrame, fraction: float, key: Key, seed: int | str = SEED) -> DataFrame:
    """Each row with probability `fraction`, decided by its key: same rows on every run."""
    return df if fraction >= 1 else df.where(bernoulli(key, fraction, seed))


def sample_exact(
    df: DataFrame, fraction: float, key: Key, seed: int | str = SEED, small: int = SMALL
) -> DataFrame:
    """round(fraction * rows) rows in hash order; the whole frame from fraction 1 on."""
    if fraction >= 1:
        return df
    text = order_text(key, seed)
    frame = df.withColumn("__t", text)
    k, rows, last = first_k(frame, ["__t"], hash_levels("__t"), lambda n: round_half_even(fraction * n), small)
    return df.where(F.lit(k >= rows) if last is None else text <= F.lit(last[0]))


def sample_n(df: DataFrame, n: int, key: Key, seed: int | str = SEED) -> DataFrame:
    """At most n rows in hash order (a top-k, no full sort)."""
    return df.orderBy(order_text(key, seed)).limit(n)


def with_train(
    df: DataFrame, y: str, test_fraction: float, key: Key, seed: int | str = SEED, out: str = "train", small: int = SMALL,
) -> DataFrame:
    """Column `out`: true for training rows; class shares are exact to one row."""
    text = order_text(key, seed)
    cuts = class_cuts(df, y, text, largest_remainders(train_share(test_fraction)), small)
    return with_place(df, y, text, cuts).withColumn(out, F.col(PLACE) == 0).drop(PLACE)


def stratified_split(
    df: DataFrame, y: str, test_fraction: float, key: Key, seed: int | str = SEED, small: int = SMALL
) -> tuple[DataFrame, DataFrame]:
    parted = with_train(df, y, test_fraction, key, seed, "__train", small)
    return parted.where("__train").drop("__train"), parted.where("not __train").drop("__train")


def with_split(
    df: DataFrame, y: str, key: Key, test_fraction: float = 0.2, calib_fraction: float = 0.2,
    seed: int | str = SEED, small: int = SMALL, fit: DataFrame | None = None,
) -> DataFrame:
    """Column `split`: 'base', 'calib' (both from the training part) or 'test'.

    `fit` may hold the same rows with no more columns than the key and the class, which is cheaper to read.
    """
    fit = df if fit is None else fit
    text, inner_text = order_text(key, seed), order_text(key, f"{seed}-calib")
    cuts = class_cuts(fit, y, text, largest_remainders(train_share(test_fraction)), small)
    train = with_place(fit, y, text, cuts).where(F.col(PLACE) == 0).drop(PLACE)
    inner_cuts = class_cuts(train, y, inner_text, largest_remainders(train_share(calib_fraction)), small)
    outer = with_place(df, y, text, cuts).withColumnRenamed(PLACE, "__outer")
    split = F.when(F.col("__outer") > 0, "test").when(F.col(PLACE) == 0, "base").otherwise("calib")
    return with_place(outer, y, inner_text, inner_cuts).withColumn("split", split).drop("__outer", PLACE)


def _order_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds in time order, for a date or a timestamp with or without zone."""
    kind = df.schema[ts].dataType
    c = F.col(ts)
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        c = c.cast("timestamp")
    return F.unix_micros(c)


def chrono_predicate(
    df: DataFrame, ts: str, fraction: float, key: Key, seed: int | str = SEED, small: int = SMALL
) -> Column:
    """True for the first int(fraction * rows) rows by time; NULL times last."""
    return chrono_cut(df, ts, fraction, key, seed, small)[0]


def chrono_cut(
    df: DataFrame, ts: str, fraction: float, key: Key, seed: int | str = SEED, small: int = SMALL
) -> tuple[Column, int]:
    """The predicate of `chrono_predicate`, and the number of rows it is true for.

    Equal times are ordered by the hash of the key, so that even a third of all
    rows on one instant splits into buckets.
    """
    us = F.col("__us")
    frame = df.withColumn("__us", _order_micros(df, ts)).withColumn("__t", order_text(key, seed))
    # twelve bits of the microseconds at a time: at most 4,096 buckets inside a bucket, whatever the dates
    levels = [F.shiftright(us, bits) for bits in (52, 40, 28, 16, 4)] + [us, *hash_levels("__t")]
    k, rows, values = first_k(frame, ["__us", "__t"], levels, lambda n: int(fraction * n), small)
    if values is None:
        return F.lit(k >= rows), k
    at, text_cut = values
    micros, text = _order_micros(df, ts), order_text(key, seed)
    if at is None:
        return micros.isNotNull() | (text <= F.lit(text_cut)), k
    tie = (micros == F.lit(at)) & (text <= F.lit(text_cut))
    return micros.isNotNull() & ((micros < F.lit(at)) | tie), k


def chrono_split(
    df: DataFrame, ts: str, fraction: float, key: Key, seed: int | str = SEED, small: int = SMALL
) -> tuple[DataFrame, DataFrame]:
    """(baseline, recent)."""
    first = chrono_predicate(df, ts, fraction, key, seed, small)
    return df.where(first), df.where(~first)


def kfold(
    df: DataFrame, y: str, folds: int, key: Key, seed: int | str = SEED, fold_col: str = "fold", small: int = SMALL
) -> DataFrame:
    """Fold number: which n-th part of its class a row belongs to, in hash order.

    All cuts of all classes are found in one walk and tested row by row. Fold sizes of a class differ by one row at most, and copies
    of a key share a fold.
    """
    text = order_text(key, seed)
    placed = with_place(df, y, text, class_cuts(df, y, text, even_parts(folds), small))
    return placed.withColumn(fold_col, F.col(PLACE)).drop(PLACE)
