import math

import numpy as np
import pytest

from creditspark.llm.whitening import scatter, whiten

SCHEMA = "vec_id long, embedding array<double>, component string"


def plain(rows, dims, top):
    """By covariance of integers and eigh, without bit planes."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    v = (d.T @ d / n**3).astype(float)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    return n, [int(r @ r) for r in d], (d / n).astype(float) @ axes / np.sqrt(values), values / np.trace(v)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("dims,top", [(5, 32), (40, 32)])
def test_equals_plain_whitening(spark, dims, top):
    rng = np.random.default_rng(dims)
    rows = [(i, (rng.normal(size=dims) * np.linspace(0.2, 2, dims)).tolist()) for i in range(300)]
    n, deviation, want, explained = plain(rows, dims, top)
    got = whiten(table(spark, rows).repartition(5)).collect()
    k = min(dims, top)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    signs = {}
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-8
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        w = want[r.vec_id, r.component - 1]
        sign = signs.setdefault(r.component, 1 if w * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(sign * w, abs=1e-6)


@pytest.mark.parametrize("span", [1, 3, 2**20, 2**61])
def test_scatter_is_exact(span):
    rng = np.random.default_rng(1)
    x = rng.integers(-span + 1, span, size=(130, 4))
    x[:, 2] = 7  # a dimension without variance has no planes
    sums, products = scatter(x)
    y = x.astype(object)
    assert sums.tolist() == y.sum(axis=0).tolist()
    assert (products == y.T @ y).all()


def test_odd_rows_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [math.sin(i), math.cos(3 * i), i / 7]) for i in range(1, 30)] + [(5, [0.1, 0.2, 0.3]), (None, [0.1, -0.2, 0.3])]
    bad = [(40, None), (41, []), (42, [1.0, None, 2.0]), (43, [nan, 0.0, 0.0]), (44, [inf, 0.0, 0.0]), (45, [1.0, 2.0]), (46, [1e300, 0.0, 0.0])]
    got = whiten(table(spark, good + bad)).collect()
    want = whiten(table(spark, good)).collect()
    assert len(got) == 3 * len(good)
    facts = lambda rows: sorted((r.vec_id or 0, r.component, r.n, r.deviation, round(abs(r.whitened), 6)) for r in rows)
    assert facts(got) == facts(want) and {r.n for r in got} == {len(good)}
    assert sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 5 for r in got) == 6


def test_missing_rank_and_empty_tables(spark):
    line = [(i, [i / 3, 2 * i / 3 - 0.0, 1.0]) for i in range(64)]
    assert {r.component for r in whiten(table(spark, [(i, [v[0], v[0], 1.0]) for i, v in line])).collect()} == {1}
    assert whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    empty = whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null(spark):
    rows = whiten(table(spark, [(i, [1e9 * i, -1e9 * i * i]) for i in range(8)])).collect()
    assert {r.deviation for r in rows} == {None} and max(r.identity_error for r in rows) < 1e-6
