import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import negatives
from creditspark.llm.negatives import Lists, hard_negatives


def plain(rows, every, k, m, low=30, high=90):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) and abs(256 * x) < 2.0**63 for x in v)
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and ok(v)]
    out = []
    for i, lab, a in rows:
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, v, strict=True)), j, other) for j, other, v in rows if j != i and len(v) == len(a)]
        for p, j, _ in sorted((s for s in scored if s[2] == lab), key=lambda s: s[:2])[:k]:
            inside = sorted((s, n) for s, n, other in scored if other != lab and low * -p <= 100 * -s <= high * -p)
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(inside[:m])]
    return sorted(out)


def check(spark, rows, every=5, k=3, m=4):
    df = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], "vec_id long, label int, embedding array<double>, anchor string")
    got = hard_negatives(df, F.col("vec_id") % every == 0, positives=k, negatives=m)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == plain(rows, every, k, m)
    return found


@pytest.mark.parametrize("dims", [2, 12])
def test_equals_brute_force_over_several_blocks(spark, monkeypatch, dims):
    monkeypatch.setattr(negatives, "SMALLEST", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = np.random.default_rng(dims)
    rows = [(i, int(rng.integers(3)), rng.normal(size=dims).tolist()) for i in rng.permutation(120).tolist()]
    assert check(spark, rows)


def test_ties_copies_and_a_label_of_a_third(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SMALLEST", 8)
    rows = [(i, 1 if i % 3 else 2, [1.0, 0.5]) for i in range(30)] + [(30 + i, 3, [0.5, 0.5]) for i in range(12)] + [(50, 1, [0.0, 0.0]), (51, 1, [-1.0, 0.0])]
    assert check(spark, rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (5, 1, [0.0, 0.0]), (10, 2, [-1.0, 0.1]), (1, 1, [1.0, 1.5]), (2, 2, [0.5, 0.5]), (3, 2, None), (4, None, [1.0, 1.0]),
        (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (None, 2, [0.5, 0.5]), (9, 2, [0.6, 0.5]), (9, 2, [0.6, 0.5]), (11, 1, [1.0]), (15, 1, [2.0]),
        (12, 2, [1.0]), (20, 1, []), (13, 1, []), (14, 2, []), (16, 2, [1e300, 0.0]), (25, 1, [3e5, -2e6]), (17, 1, [4e5, -2e6]), (18, 2, [1e5, -1e6]),
    ]
    assert check(spark, rows)
    assert check(spark, [], 5) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**22
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 2.0]), (2, 2, [big / 2, 3.0]), (3, 2, [big / 2, 5.0]), (4, 2, [big / 2, 4.0])]
    assert check(spark, rows)


def test_reading_stops_early():
    """A few large products lie at the head of the lists, so most rows are never read."""
    random.seed(1)
    x = np.array([[random.randint(0, 9), random.randint(0, 9)] for _ in range(4000)] + [[900, 900], [800, 950], [700, 600]], np.int64)

    class Watched(Lists):
        def numbers(self, a):
            x_, lists, a = super().numbers(a)
            rows = self.scored = []

            class Rows:
                dtype = x_.dtype

                def __getitem__(self, at):
                    rows.extend(at.tolist())
                    return x_[at]

            return Rows(), lists, a

    lists = Watched(x)
    (at, scores), = lists.top(np.array([3, 2]), np.ones(len(x), bool), [-(2**63)], [2**63 - 1], 3)
    assert at.tolist() == [4000, 4001, 4002] and scores.tolist() == [4500, 4300, 3300]
    assert len(lists.scored) < 200
