"""Whitening of embeddings from exact integer scatter: bit planes packed across rows, counted by AND and popcount."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.text import materialise

COMPONENTS = 32
#: Eigenvalues up to this share of the largest are beyond double precision: rank that the table does not have.
NO_VARIANCE = 1e-10
#: Sums travel in two parts, so that none is too long for a decimal.
PART = 1 << 60
LARGEST = 2**63 - 1


def usable_rows(df: DataFrame, key: str, vector: str, scale: int, offset: int) -> DataFrame:
    """(key, x) of the rows that take part; x is floor(scale * c) + offset."""
    kind = dict(df.dtypes)[key]
    scaled = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: c * F.lit(float(scale)))
    own = df.select(F.col(f"`{key}`").alias("key"), scaled.alias("c"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0**62))
    own = own.where(F.col("c").isNotNull() & (F.size("c") > 0) & ~F.exists("c", bad))
    rows = materialise(own.select("key", F.transform("c", lambda c: F.floor(c) + F.lit(offset)).alias("x")), "lattice")
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], f"key {kind}, x array<bigint>")
    return rows.where(F.size("x") == lengths["dims"])


def lattice(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums over rows and sums of products of all pairs of dimensions, as Python integers.

    Every dimension is shifted by its minimum; each bit of it is one plane whose rows are packed
    into 64-bit words. The popcount of two planes' AND, weighed by both places, is their
    share of the sum of products.
    """
    n, dims = x.shape
    low = x.min(axis=0)
    y = (x - low).astype(np.uint64)
    places = [int(top).bit_length() for top in y.max(axis=0)]
    owner = np.repeat(np.arange(dims), places)
    bit = np.concatenate([np.arange(b) for b in places]).astype(np.uint64) if len(owner) else np.empty(0, np.uint64)
    bits = np.zeros((len(owner), -(-n // 64) * 64), np.uint8)
    bits[:, :n] = (y[:, owner] >> bit & np.uint64(1)).T
    planes = np.packbits(bits, axis=1).view(np.uint64)
    counts = np.zeros((len(owner), len(owner)), np.int64)
    for p in range(len(planes)):
        counts[p, p:] = counts[p:, p] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    small = 2 * max(places) + n.bit_length() < 62
    weights = np.zeros((len(owner), dims), np.int64 if small else object)
    weights[np.arange(len(owner)), owner] = [1 << int(b) for b in bit]
    products = (weights.T @ counts.astype(weights.dtype) @ weights).astype(object)
    sums = (np.diagonal(counts).astype(weights.dtype) @ weights).astype(object)
    low = low.astype(object)
    return sums + n * low, products + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def moments(rows: DataFrame) -> tuple[int, list[int], np.ndarray] | None:
    """Rows, their sums, and n times the scatter less the product of sums: n^2 times the covariance, an integer."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = lattice(b.column(0))
                sums, products = scatter(x)
                n, first, second = n + len(x), first + sums, second + products
        if n:
            dims = len(first)
            a, b = np.triu_indices(dims)
            # row -1 holds the sums, its entry -1 the number of rows
            at = [(-1, -1, n), *((-1, i, int(first[i])) for i in range(dims)), *((i, j, int(second[i, j])) for i, j in zip(a.tolist(), b.tolist(), strict=True))]
            whole, rest = zip(*(divmod(v, PART) for *_, v in at), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, *_ in at], pa.int32()), pa.array([j for _, j, _ in at], pa.int32()), pa.array(whole, pa.decimal128(38, 0)), pa.array(rest, pa.decimal128(38, 0))],
                names=["i", "j", "whole", "rest"],
            )

    parts = rows.select("x").mapInArrow(count, "i int, j int, whole decimal(38,0), rest decimal(38,0)")
    # one row for each pair of dimensions
    total = {(r["i"], r["j"]): int(r["whole"]) * PART + int(r["rest"]) for r in parts.groupBy("i", "j").agg(F.sum("whole").alias("whole"), F.sum("rest").alias("rest")).collect()}
    if not total:
        return None
    n = total[-1, -1]
    dims = sum(1 for i, _ in total if i < 0) - 1
    sums = [total[-1, j] for j in range(dims)]
    centred = np.array([[n * total[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)], dtype=object)
    return n, sums, centred


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares of integers; none where it does not fit a long."""
    if d.dtype != object and (np.abs(d.astype(np.float64)) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in d.astype(object).tolist())
    return [v if v <= LARGEST else None for v in exact]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000, components: int = COMPONENTS) -> DataFrame:
    """(vec_id under its own name, component, n, deviation, whitened, explained, identity_error) of every row and component.

    Entries become x = floor(scale * c) + offset. All rows that take part are fitted: sums S and products are
    exact integers, centred as integers before the eigenvectors of the covariance (divisor n) are
    taken. `component` counts from 1 by falling eigenvalue e; `whitened` is (x - S/n) on the component over
    sqrt(e), its largest weight made positive; `explained` is e over the trace; `deviation` is the sum over
    dimensions of (n*x - S)^2, null where it exceeds a long; `identity_error` is measured from the
    whitened rows: the largest entry of their covariance less the identity.

    Left out are rows whose vector is null or empty, or holds entries that are null, not finite, or 2^62 and more once
    scaled, and rows of another length than most rows have (of equally frequent lengths the longer one stays).
    Components of no variance (up to 1e-10 of the largest) are not returned, so a table of one row, or of copies of one,
    gives no rows, nor does an empty table. Equal eigenvalues share a space without
    an order in it. Null and repeated identifiers take part as rows of their own; other columns are not read.

    The driver holds one matrix of dimensions by dimensions; tasks send one row for each pair of dimensions.
    """
    kind = dict(df.dtypes)[key]
    rows = usable_rows(df, key, vector, scale, offset)
    result = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = moments(rows)
    none = df.sparkSession.createDataFrame([], result)
    if fit is None:
        return none
    n, sums, centred = fit
    variance = np.array([[int(v) / (n * n) for v in row] for row in centred])
    values, axes = np.linalg.eigh(variance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    kept = (values > NO_VARIANCE * max(values[0], 0)) & (values > 0)
    values, axes = values[kept], axes[:, kept]
    if not len(values):
        return none
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    project, explained = axes / np.sqrt(values), (values / np.trace(variance)).tolist()
    largest = np.iinfo(np.int64).max

    def centre(x: np.ndarray) -> np.ndarray:
        if n * max(int(x.max()), -int(x.min())) + max(map(abs, sums)) > largest:
            return x.astype(object) * n - np.array(sums, dtype=object)
        return x * n - np.array(sums, np.int64)

    def whitened(d: np.ndarray) -> np.ndarray:
        return (d / n).astype(np.float64) @ project

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        a, b = np.triu_indices(k)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = whitened(centre(lattice(batch.column(0))))
                first, second = first + w.sum(axis=0), second + w.T @ w
        i, j = np.concatenate([np.full(k, -1), a]), np.concatenate([np.arange(k), b])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([first, second[a, b]]))], names=["i", "j", "total"])

    measured = rows.select("x").mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = {(r["i"], r["j"]): r["total"] / n for r in measured}
    error = max(abs(v - total[-1, i] * total[-1, j] - (i == j)) for (i, j), v in total.items() if i >= 0)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            d = centre(lattice(batch.column(1)))
            size = len(d)
            at = np.repeat(np.arange(size), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), pa.array(np.full(size * k, n), pa.int64()),
                pa.array(deviations(d), pa.int64()).take(pa.array(at)), pa.array(whitened(d).ravel()), pa.array(explained * size), pa.array(np.full(size * k, error)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("key", "x").mapInArrow(answer, result)
