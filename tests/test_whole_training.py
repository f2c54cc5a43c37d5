"""The registered training queries do their whole job; models grown alone equal those grown in passes."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from __spark_entry__ import oracle_sql
from creditspark.operators import attribute as A
from creditspark.operators import boosting as B
from creditspark.operators import train as T
from creditspark.plans import jobs as J
from creditspark.plans import q_model
from creditspark.plans.catalog import QUERIES

PARAMS = {
    "symmetric": {"iterations": 3, "depth": 4, "learning_rate": 0.3, "l2_leaf_reg": 2, "subsample": 0.7},
    "by leaf": {"n_estimators": 3, "num_leaves": 9, "max_depth": -1, "learning_rate": 0.3, "min_child_samples": 7, "reg_alpha": 0.4, "reg_lambda": 0.5, "colsample_bytree": 0.7},
    "by level": {"n_estimators": 3, "max_depth": 5, "learning_rate": 0.2, "min_child_weight": 2, "gamma": 0.1, "reg_lambda": 1.5, "subsample": 0.8},
}


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.stack([rng.normal(size=n), rng.integers(0, 2, n), rng.exponential(size=n), rng.integers(0, 5, n)], axis=1)
    y = (x[:, 0] + 0.6 * x[:, 1] - 0.5 * x[:, 2] + rng.normal(size=n) > 0).astype(int)
    rows = [(i, *map(float, r), int(t), 2.5 if t else 1.0, i % 3) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "loan_id long, a double, b double, c double, k double, target int, w double, fold int")
    return VectorAssembler(inputCols=["a", "b", "c", "k"], outputCol="features").transform(df).repartition(3, "loan_id").cache()


class Asked(Exception):
    pass


def asked(monkeypatch, module, name):
    """The call that a query makes, and nothing after it."""
    def stop(*args, **named):
        raise Asked(args, named)

    monkeypatch.setattr(module, name, stop)


@pytest.mark.parametrize("name", ["train_candidates", "run_log"])
def test_candidates_train_with_their_own_parameters(spark, sf_dir, monkeypatch, name):
    asked(monkeypatch, T, "train_candidates")
    monkeypatch.setattr(q_model, "signal", lambda spark, d: None)
    with pytest.raises(Asked) as call:
        QUERIES[name](spark, sf_dir)
    args, named = call.value.args
    assert len(args) == 4 and not named    # so the candidates are T.CANDIDATES


def test_the_report_trains_with_the_candidates_own_parameters(spark, sf_dir, monkeypatch):
    asked(monkeypatch, J, "train")
    with pytest.raises(Asked) as call:
        QUERIES["train_and_report"](spark, sf_dir)
    args, named = call.value.args
    assert len(args) == 4 and not named


def test_the_search_draws_from_the_whole_grid(spark, sf_dir, monkeypatch):
    asked(monkeypatch, T, "random_search")
    monkeypatch.setattr(q_model, "_ready", lambda spark, d: spark.createDataFrame([(1, 1, "base")], "loan_id long, target int, split string"))
    with pytest.raises(Asked) as call:
        QUERIES["random_search"](spark, sf_dir)
    args, named = call.value.args
    assert args[1] == {**T.XGBOOST_GRID, "weight_factor": T.WEIGHT_FACTORS} and len(args) == 4 and not named
    draws = T._draws(args[1], T.SEARCH_DRAWS, T.SEED)
    made = [args[0](d) for d in draws]
    assert {m.spec.rounds for m in made} == {300, 500, 800} and {m.weight for m in made} == {T.weight_column(f) for f in T.WEIGHT_FACTORS}


def test_the_log_expects_the_best_known_parameters():
    sql = oracle_sql()["run_log"]
    for i, c in enumerate(T.CANDIDATES):
        assert all(f"({i}, '{c.name}', '{k}', '{v}')" in sql for k, v in c.params.items())


@pytest.mark.parametrize("kind", PARAMS)
@pytest.mark.parametrize("change", [{}, {"FLAT_CELLS": 0}, {"KEPT_BYTES": 1}])
def test_a_model_grown_alone_equals_one_grown_in_passes(spark, loans, monkeypatch, kind, change):
    spec = B.Spec.of(PARAMS[kind])
    for name, value in change.items():
        monkeypatch.setattr(B, name, value)
    alone = B.Boosting(loans, [spec], "features", "target", ["w"], "loan_id", "fold", [1])
    monkeypatch.setattr(B, "APART_BYTES", 0)
    passes = B.Boosting(loans, [spec], "features", "target", ["w"], "loan_id", "fold", [1])
    assert alone.counts and passes.counts is None
    assert alone.held_out_counts() == [{c: v for c, v in r.items() if c != "m"} for r in passes.held_out_counts()]
    for a, b in zip(alone.models[0].trees, passes.models[0].trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist() and a.left.tolist() == b.left.tolist()
        assert a.value == pytest.approx(b.value, abs=1e-12) and a.sums == pytest.approx(b.sums, abs=1e-9)


def test_a_search_at_any_size_keeps_no_trees(spark, loans, monkeypatch):
    boosters = [B.Booster(p, "target", "features", "w", key="loan_id") for p in PARAMS.values()]
    want = B.fold_scores(loans, boosters, "loan_id", "fold", 3)
    monkeypatch.setattr(B, "APART_BYTES", 0)
    assert B.fold_scores(loans, boosters, "loan_id", "fold", 3) == pytest.approx(want, abs=1e-12)
    spec = B.Spec.of(PARAMS["by level"])
    grown = B.Boosting(loans, [spec], "features", "target", ["w"], "loan_id", keep=False)
    assert len(grown.models[0].trees) == spec.rounds and grown.models[0].trees[0] is None


def test_records_and_row_groups_are_bounded(spark, loans, monkeypatch):
    monkeypatch.setattr(B, "RECORD_BYTES", 4000)
    spec = B.Spec.of(PARAMS["by level"])
    grown = B.Boosting(loans, [spec], "features", "target", ["w"], "loan_id")
    sizes = [len(r["y"]) for r in B.records(iter(grown.rows.toArrow().to_batches()))]
    assert sum(sizes) == loans.count() and max(sizes) <= 4000 // (4 + 8 * 5) and min(sizes) > 0
    assert len(sizes) <= sum(sizes) / max(sizes) + loans.rdd.getNumPartitions()
    many = spark.range(300).selectExpr("repeat('x', 100000) || id AS y")
    grown.written(many)
    [path] = {p.rsplit("/", 1)[0] for p in spark.read.parquet(grown.paths[1 - grown.turn]).inputFiles()}
    import pyarrow.parquet as pq
    from pathlib import Path

    groups = [pq.ParquetFile(f).metadata for f in Path(path.removeprefix("file://")).glob("*.parquet")]
    assert max(m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)) < 3 * B.PARQUET["parquet.block.size"]


def test_attribution_by_kinds_of_rows_equals_that_of_each_row():
    rng = np.random.default_rng(1)
    test = lambda left, v: (left, False, (v,))
    trees = []
    for _ in range(3):   # two levels on features 0 and 2, the second cut twice
        a, b, c = rng.normal(size=3)
        trees.append([(rng.normal(), [(0, s, (test(p, a),)), (2, t, (test(q, b), test(r, c)))]) for p, q, r, s, t in (
            (True, True, True, 0.3, 0.2), (True, True, False, 0.3, 0.5), (True, False, False, 0.3, 0.3), (False, True, True, 0.7, 0.6), (False, False, False, 0.7, 0.4))])
    trees.append([(0.5, [])])
    x = rng.normal(size=(200, 4))
    base, phi = A.attribution(x, trees)
    want_base, want = A.path_attribution(x, [leaf for leaves in trees for leaf in leaves])
    assert base == pytest.approx(want_base) and np.abs(phi - want).max() < 1e-12
