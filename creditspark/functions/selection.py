"""Exact order statistics that never sort a whole table in one task.

`first_k` finds where the first k rows of an order end. It counts rows per
coarse bucket of the order, walks into the bucket that holds the k-th row,
counts finer buckets there, and ranks rows only once few distinct ones are
left. What reaches the driver is a small histogram per level; the answer is
a plain predicate, so the split itself needs no join, window or shuffle.

`quantiles` counts values in equal bins and closes in on the bins that hold the
wanted ranks, in the same way for every size. Tasks count whole Arrow batches, with one
binary search for each column and value over all the bins that are still open.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 100_000        # rows that one task may rank
BINS = 65_536          # counts that one pass over a frame may bring to the driver


def hash_levels(text: str, depth: int = 6, width: int = 3) -> list[Column]:
    """Prefixes of a hexadecimal text: 16**width buckets, each level refines the last."""
    return [F.substring(F.col(text), 1, width * (i + 1)) for i in range(depth)]


def _null_last(value):
    return (value is None, value)


def _same(column: Column, value) -> Column:
    return column.isNull() if value is None else column == F.lit(value)


class _Walk:
    """How far the search has come."""

    def __init__(self, k: int):
        self.path: list = []
        self.skip = 0      # rows of earlier buckets
        self.size = 0      # rows of the bucket reached
        self.k = k

    def enter(self, histogram):
        passed = self.skip
        for value, n in sorted(histogram, key=lambda h: _null_last(h[0])):
            if passed + n >= self.k:
                self.path.append(value)
                self.skip, self.size = passed, n
                return
            passed += n
        raise ValueError("the rows changed between two passes over the same frame")


def first_k(
    df: DataFrame, order: Sequence[str], levels: Sequence[Column], k_of: Callable[[int], int], small: int = SMALL
) -> tuple[int, int, tuple | None]:
    """Where the first k rows of an order end: (k, rows, order values of the k-th row).

    `order` names the columns of a total order (NULLs last), `levels` are
    ever finer monotone buckets of it, `k_of` maps the number of rows to k.
    No values stand for the trivial cuts k <= 0 and k >= rows.
    """
    base = df.select(*order)

    def histogram(frame: DataFrame, level: Column) -> list[tuple]:
        return [tuple(r) for r in frame.groupBy(level.alias("__b")).agg(F.count(F.lit(1)).alias("n")).collect()]

    first = histogram(base, levels[0])
    rows = sum(n for _, n in first)
    walk = _Walk(k_of(rows))
    if not 0 < walk.k < rows:
        return walk.k, rows, None
    walk.enter(first)

    def reached() -> Column:
        cond = F.lit(True)
        for level, value in zip(levels, walk.path):
            cond = cond & _same(level, value)
        return cond

    while len(walk.path) < len(levels) and walk.size > small:
        walk.enter(histogram(base.where(reached()), levels[len(walk.path)]))

    # copies of a row collapse before the ranking, so the window holds at most
    # the few distinct rows of one fine bucket
    distinct = base.where(reached()).groupBy(*order).agg(F.count(F.lit(1)).alias("__n"))
    keys = [F.col(o).asc_nulls_last() for o in order]
    upto = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    need = F.lit(walk.k - walk.skip)
    hit = (
        distinct.withColumn("__upto", F.sum("__n").over(upto))
        .where((F.col("__upto") >= need) & (F.col("__upto") - F.col("__n") < need))
        .select(*order)
        .first()
    )
    return walk.k, rows, tuple(hit)


def round_half_even(x: float) -> int:
    return int(round(x))


# --- quantiles ---------------------------------------------------------------


@dataclass(frozen=True)
class _Span:
    """Closed interval between two values of a column that holds a wanted rank."""

    column: str
    low: float
    high: float
    offset: int    # rows below low


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int = BINS
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of several columns, NULLs skipped.

    One way for every size: values are counted in equal bins between the extremes of a column,
    then in the bin that holds a wanted rank between its own extremes, and so
    on until a bin holds one value. A pass counts all columns and ranks at
    once and brings at most `bins` counts to the driver for all of them together (16 for each at
    least); no sketch is merged and no row ranked. A hot value is found when it is alone in
    its bin. Infinities lie at the ends.
    """
    cols = list(cols)
    if not cols:
        return {}
    base = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in cols])
    if df.is_cached:  # the caller keeps these columns already
        return _quantiles(base, cols, probs, bins)
    base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles(base, cols, probs, bins)
    finally:
        base.unpersist()


def _quantiles(base: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int) -> dict[str, list[float | None]]:
    def facts(c: str) -> Column:
        x = F.col(c)
        finite = F.when(F.abs(x) < float("inf"), x)
        return F.struct(
            F.count(x).alias("n"), F.count_if(x == float("-inf")).alias("below"), F.count_if(x == float("inf")).alias("above"),
            F.min(finite).alias("low"), F.max(finite).alias("high"),
        ).alias(c)

    row = base.agg(*[facts(c) for c in cols]).first()
    places = {c: [p * (row[c]["n"] - 1) for p in probs] for c in cols if row[c]["n"]}
    values: dict = {c: {} for c in places}
    spans: dict = {}
    for c, xs in places.items():
        f = row[c]
        for r in {r for x in xs for r in (math.floor(x), math.ceil(x))}:
            if r < f["below"] or r >= f["n"] - f["above"]:
                values[c][r] = float("-inf") if r < f["below"] else float("inf")
            else:
                spans.setdefault(_Span(c, f["low"], f["high"], f["below"]), []).append(r)
    while spans:
        for span in [s for s in spans if s.low == s.high]:
            values[span.column].update((r, span.low) for r in spans.pop(span))
        counts = _count_bins(base, list(spans), max(16, bins // len(spans))) if spans else {}
        closer: dict = {}
        for i, (span, ranks) in enumerate(spans.items()):
            passed, at = span.offset, 0
            ranks = sorted(ranks)
            for _, n, low, high in sorted(counts[i]):
                while at < len(ranks) and ranks[at] < passed + n:
                    closer.setdefault(_Span(span.column, low, high, passed), []).append(ranks[at])
                    at += 1
                passed += n
        spans = closer
    return {c: [_interpolate(values[c], x) for x in places[c]] if c in places else [None] * len(probs) for c in cols}


class _Counts:
    """What one task counts of a column: bins of all its open spans, side by side."""

    def __init__(self, spans: Sequence[tuple[float, float, int]], bins: int):
        self.low, self.high = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
        self.half, self.span, self.bins = self.high / 2 - self.low / 2, np.array([s[2] for s in spans], np.int32), bins
        self.n = np.zeros(len(spans) * (bins + 2), np.int64)
        self.least, self.most = np.full(len(self.n), np.inf), np.full(len(self.n), -np.inf)

    def add(self, x: np.ndarray) -> None:
        """The spans of a column do not overlap, so one binary search over their lower bounds finds a value's own."""
        at = np.searchsorted(self.low, x, side="right") - 1
        inside = (at >= 0) & (x <= self.high[at])
        x, at = x[inside], at[inside]
        low, half = self.low[at], self.half[at]
        place = np.minimum(self.bins - 1, np.floor((x / 2 - low / 2) / np.where(half > 0, half, 1) * self.bins)).astype(np.int64)
        # the extremes are bins of their own, so that every pass parts them; halves keep the width finite
        place = np.where(x == low, -1, np.where(x == self.high[at], self.bins, place))
        flat = at * (self.bins + 2) + place + 1
        self.n += np.bincount(flat, minlength=len(self.n))
        np.minimum.at(self.least, flat, x)
        np.maximum.at(self.most, flat, x)

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.n)
        return pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (self.span[some // (self.bins + 2)], (some % (self.bins + 2) - 1).astype(np.int32), self.n[some], self.least[some], self.most[some])],
            names=["i", "b", "n", "low", "high"],
        )


def _count_bins(base: DataFrame, spans: Sequence[_Span], bins: int) -> dict[int, list[tuple]]:
    """(bin, rows, smallest, largest) of every span: counted in each task, column by column, and added up."""
    of_column: dict[str, list[tuple[float, float, int]]] = {}
    for i, s in enumerate(spans):
        of_column.setdefault(s.column, []).append((s.low, s.high, i))
    bounds = [sorted(own) for own in of_column.values()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [_Counts(own, bins) for own in bounds]
        for b in batches:
            for column, known in zip(counts, b.columns, strict=True):
                column.add(known.drop_null().to_numpy())
        for column in counts:
            yield column.rows()

    rows = (
        base.select(*[f"`{c}`" for c in of_column])
        .mapInArrow(count, "i int, b int, n long, low double, high double")
        .groupBy("i", "b")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .toArrow()
    )
    out: dict = {}
    for i, *bin_ in zip(*(rows.column(c).to_pylist() for c in ("i", "b", "n", "low", "high")), strict=True):
        out.setdefault(i, []).append(tuple(bin_))
    return out


def _interpolate(values: Mapping[int, float], place: float) -> float:
    low, high = math.floor(place), math.ceil(place)
    a, b = values[low], values[high]
    return a if a == b else (high - place) * a + (place - low) * b
