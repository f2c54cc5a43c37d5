import math
import random

import numpy as np
import pytest

from creditspark.llm import graph, vectors as vectors_module
from creditspark.llm.vectors import near_vectors


def plain(rows, cosine=0.9):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if ok(a) and ok(b) and len(a) == len(b):
                a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    first = {}
    for i in range(n):
        if rows[i][0] is not None:
            first[find(i)] = min(first.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], first.get(find(i))) for i in range(n)), key=repr)


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = near_vectors(df, **how).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == plain(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(int(i), (centres[i % 6] + spread * rng.normal(size=dims)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("dims,spread", [(3, 0.5), (16, 0.3)])
def test_equals_brute_force(spark, dims, spread):
    check(spark, vectors(dims, 240, dims, spread), cell=20, block=16)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]),
        (9, [2.0, 0.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [1.0, 0.0, 0.0]), (13, [1.0]), (14, [-1.0]), (15, [3.0]),
        (7, [1.0, 0.0]), (None, [1.0, 1.01]), (16, [0.0, 0.0]), (None, [0.0, -5.0]),
    ]
    check(spark, rows)
    check(spark, rows, cell=3, block=2)


def test_a_crowd_of_copies_and_near_copies(spark):
    random.seed(3)
    base = [random.gauss(0, 1) for _ in range(8)]
    rows = [(i, [x + random.gauss(0, 0.02) for x in base]) for i in range(60)] + [(100 + i, base) for i in range(40)]
    check(spark, rows + vectors(1, 40, 8, 2.0)[:0], cell=30, block=16)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(ValueError):
        near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), cosine=0)


def test_lengths_without_a_pivot_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "FEWEST", 1)
    monkeypatch.setattr(vectors_module, "MEETS", 50)
    rows = vectors(4, 90, 3, 0.4) + [(1000 + i, v) for i, v in vectors(5, 90, 5, 0.3)]
    check(spark, rows, cell=10**6, block=16)
    monkeypatch.setattr(vectors_module, "BLOCK", 16 * 24)
    check(spark, rows, cell=10**6)


@pytest.mark.parametrize("hot", [1, 4, 10**6])
def test_every_root_is_named_whatever_its_size(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT", hot)
    rows = [(f"r{i % 7 if i % 2 else 0}", i, 100 - i) for i in range(60)]
    got = graph.named(spark.createDataFrame(rows, "root string, node long, first long")).collect()
    least = {}
    for root, _, first in rows:
        least[root] = min(first, least.get(root, first))
    assert sorted((r.root, r.node, r.first, r.component_id) for r in got) == sorted((*r, least[r[0]]) for r in rows)
    none = graph.named(spark.createDataFrame([], "root string, node long, first long"))
    assert none.collect() == []
