"""Preprocessing, calibration, training and attribution."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditspark.operators import attribute as A
from creditspark.operators import boosting as B
from creditspark.operators import features as M
from creditspark.operators import split as S
from creditspark.operators import train as T
from creditspark.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(7)
    n = 800
    x, z = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    y = (x + 0.5 * z + rng.normal(size=n) > 1.8).astype(int)
    cat = rng.choice(["p", "q", "r"], n)
    rows = [
        (i, None if i % 11 == 0 else float(x[i]), float(z[i]), 3.0, None, None if i % 13 == 0 else str(cat[i]), int(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "loan_id long, x double, z double, k double, empty double, cat string, target int").cache()


def test_preprocessing_rules(spark, loans):
    base = loans.where("loan_id < 600")
    model = Pipeline(stages=[M.MedianImputer(["x", "z", "k", "empty"]), M.PopulationScaler()]).fit(base)
    out = model.transform(loans)
    assert "imp_empty" not in out.columns and "imp_missing_z" not in out.columns and "imp_missing_x" in out.columns
    xs = np.array([r["x"] for r in base.collect() if r["x"] is not None])
    first = out.where("loan_id = 0").first()
    assert first["imp_x"] == pytest.approx(np.median(xs)) and first["imp_missing_x"] == 1.0
    stats = out.where("loan_id < 600").agg(F.avg("std_x"), F.stddev_pop("std_x"), F.max(F.abs("std_k"))).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1) and stats[2] == 0.0


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert M.modes_of(df, ["c"]) == {"c": "a"}
    assert [r[0] for r in M.ModeImputer(["c"]).fit(df).transform(df).select("cat_c").collect()][-1] == "a"


def test_one_hot_unknown_is_all_zeros(spark):
    seen = spark.createDataFrame([("a", "x'y")], "c string, d string")
    new = spark.createDataFrame([("a", "x'y"), ("zzz", "x'y")], "c string, d string")
    model = Pipeline(stages=[M.ModeImputer(["c", "d"]), *M.one_hot(["c", "d"])]).fit(seen)
    rows = M.one_hot_columns(model.transform(new), model).collect()
    assert [tuple(r) for r in rows] == [(1, 1), (0, 1)]


def test_feature_names_match_the_vector(spark, loans):
    model = M.feature_pipeline(["x", "z"], ["cat"]).fit(loans)
    names = M.feature_names(model)
    assert names == ["x", "z", "missingindicator_x", "cat_p", "cat_q", "cat_r"]
    assert len(model.transform(loans).first()["features"]) == len(names)


def test_platt_equals_a_direct_newton_fit(spark):
    rng = np.random.default_rng(2)
    s = rng.random(500)
    y = (rng.random(500) < s * 0.6).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, target int")
    df = VectorAssembler(inputCols=["s"], outputCol=T.SCORE).transform(df)
    model = T.platt(df)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    x = np.stack([s, np.ones_like(s)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - t))
    assert model.coefficients[0] == pytest.approx(w[0], abs=1e-5)
    assert model.intercept == pytest.approx(w[1], abs=1e-5)


def small_trees(loans):
    model = M.feature_pipeline(["x", "z"], ["cat"]).fit(loans)
    ready = T.class_weights(model.transform(loans), 2.0)
    params = {"iterations": 3, "depth": 3, "learning_rate": 0.5}
    return model, ready, T.boosted_trees(params, "target", "features", T.weight_column(1.0)).fit(ready)


def test_tree_attribution_sums_to_the_margin_and_is_shapley(spark, loans):
    model, ready, trees = small_trees(loans)
    contrib = A.tree_contributions(ready, trees, scratch_path(spark, "trees"), M.feature_names(model))
    total = F.reduce("factors", F.lit(0.0), lambda a, f: a + f["contribution"])
    margin = trees.transform(ready).select("loan_id", vector_to_array("rawPrediction")[1].alias("margin"))
    both = contrib.withColumn("total", F.col("base") + total).join(margin, "loan_id")
    assert both.where(F.abs(F.col("total") - F.col("margin")) > 1e-9).count() == 0
    assert both.count() == loans.count()

    # brute force over all feature subsets on a few rows
    leaves = A.leaf_paths(A.tree_nodes(spark, trees, scratch_path(spark, "trees")).collect())
    x = np.array([r["features"].toArray() for r in ready.orderBy("loan_id").limit(5).collect()])
    _, phi = A.path_attribution(x, leaves)

    def value(row, known):
        out = 0.0
        for v, steps in leaves:
            for f, share, tests in steps:
                v *= float(A._meets(row[f:f + 1], tests)[0]) if f in known else share
            out += v
        return out

    m = x.shape[1]
    for row, got in zip(x, phi):
        for j in range(m):
            others = [i for i in range(m) if i != j]
            want = sum(
                math.factorial(len(s)) * math.factorial(m - 1 - len(s)) / math.factorial(m)
                * (value(row, {*s, j}) - value(row, set(s)))
                for k in range(m) for s in itertools.combinations(others, k)
            )
            assert got[j] == pytest.approx(want, abs=1e-10)


def subset_value(leaves, row, known):
    """What the trees say when only some features are known: leaves weighed by cover along the others."""
    out = 0.0
    for v, steps in leaves:
        for f, share, tests in steps:
            v *= float(A._meets(row[f:f + 1], tests)[0]) if f in known else share
        out += v
    return out


def test_eight_hundred_trees_are_explained_block_by_block(spark):
    from creditspark.operators import boosting as B

    rng = np.random.default_rng(4)
    cuts = [np.sort(rng.normal(size=5)) for _ in range(4)]
    trees = []
    for _ in range(800):  # three splits on two levels, any features
        h = rng.random(4) + 0.1
        sums = np.array([[h.sum(), 9, 1.0], [h[0] + h[1], 5, 1.0], [h[2] + h[3], 4, 1.0], *[[v, 2, 0.0] for v in h]])
        trees.append(B.Tree(
            np.array([*rng.integers(0, 4, 3), -1, -1, -1, -1]), np.array([*rng.integers(0, 5, 3), 0, 0, 0, 0]),
            np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), rng.normal(size=7) / 50, sums,
        ))
    model = B.spark_model(spark, trees, 0.3, cuts, "target", "features")
    x = rng.normal(size=(6, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "loan_id long, a double, b double, c double, d double")
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    nodes = A.tree_nodes(spark, model, scratch_path(spark, "trees"))
    assert nodes.count() == 5601 and len(A.tree_blocks(nodes, 2000)) == 3 and A.tree_blocks(nodes, 10**6) == [(0, 800)] and len(A.tree_blocks(nodes, 1)) == 801
    leaves = A.leaf_paths(nodes.collect())
    got = A.tree_contributions(df, model, scratch_path(spark, "trees"), ["a", "b", "c", "d"], block_nodes=2000).orderBy("loan_id").collect()
    for row, r in zip(x, got, strict=True):
        assert r.base == pytest.approx(subset_value(leaves, row, set()))
        for j, f in enumerate(r.factors):
            others = [i for i in range(4) if i != j]
            want = sum(
                math.factorial(len(s)) * math.factorial(3 - len(s)) / math.factorial(4) * (subset_value(leaves, row, {*s, j}) - subset_value(leaves, row, set(s)))
                for k in range(4) for s in itertools.combinations(others, k)
            )
            assert f["contribution"] == pytest.approx(want, abs=1e-10)


def test_nodes_that_no_row_reaches_are_attributed(spark):
    """A symmetric tree cuts every node of a level, empty ones too: node 1 has no cover, and a row goes there."""
    sums = np.array([[4.0, 9, 1.0], [0.0, 0, 1.0], [4.0, 9, 1.0], [0.0, 0, 0.0], [0.0, 0, 0.0], [1.0, 4, 0.0], [3.0, 5, 0.0]])
    tree = B.Tree(
        np.array([0, 1, 1, -1, -1, -1, -1]), np.zeros(7, int), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]),
        np.array([0.0, 0.0, 0.0, 0.25, -0.5, 0.75, -1.0]), sums,
    )
    model = B.spark_model(spark, [tree], 0.3, [np.zeros(1), np.zeros(1)], "target", "features")
    x = np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, -1.0], [1.0, 1.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "loan_id long, a double, b double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    leaves = A.leaf_paths(A.tree_nodes(spark, model, scratch_path(spark, "trees")).collect())
    margins = {r.loan_id: r.m for r in model.transform(df).select("loan_id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    for r in A.tree_contributions(df, model, scratch_path(spark, "trees"), ["a", "b"]).collect():
        got, row = [f["contribution"] for f in r.factors], x[r.loan_id]
        assert r.base + sum(got) == pytest.approx(margins[r.loan_id], abs=1e-12)
        say = {k: subset_value(leaves, row, set(k)) for k in ((), (0,), (1,), (0, 1))}
        assert got[0] == pytest.approx((say[0,] - say[()] + say[0, 1] - say[1,]) / 2, abs=1e-12)


def test_linear_attribution_sums_to_the_score(spark, loans):
    contrib = A.linear_contributions(loans, {"x": 2.0, "z": -1.0}, {"x": 0.5, "z": 9.0})
    long = A.long_form(contrib).groupBy("loan_id").agg(F.sum("contribution").alias("s")).join(loans, "loan_id")
    want = 2 * (F.coalesce("x", F.lit(0.5)) - 0.5) - (F.col("z") - 9)
    assert long.where(F.abs(F.col("s") - want) > 1e-12).count() == 0
    top = A.top_factors(contrib, 1).where("loan_id = 0").first()
    assert (top["orden"], top["feature"]) == (1, "z")


def test_linear_model_attribution_sums_to_its_margin(spark, loans):
    model = M.feature_pipeline(["x", "z"], ["cat"]).fit(loans)
    ready = T.class_weights(model.transform(loans), 2.0)
    fitted = T.logistic({"iterations": 20}, "target", "features", T.weight_column(1.0)).fit(ready)
    contrib = A.model_contributions(ready, fitted, "unused", M.feature_names(model))
    total = F.col("base") + F.reduce("factors", F.lit(0.0), lambda a, f: a + f["contribution"])
    margin = fitted.transform(ready).select("loan_id", vector_to_array("rawPrediction")[1].alias("margin"))
    assert contrib.join(margin, "loan_id").where(F.abs(total - F.col("margin")) > 1e-9).count() == 0
    assert {f["feature"] for f in contrib.first()["factors"]} == set(M.feature_names(model))


def test_too_many_categories_are_refused(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="not a category"):
        M.modes_of(df, ["c"], most=49)


def test_training_calibration_and_saving(spark, loans):
    from creditspark.sources import sinks as OUT

    rows = S.with_split(loans, "target", "loan_id")
    quick = [
        T.Candidate("CatBoost", {"iterations": 3, "depth": 3, "learning_rate": 0.3}),
        T.Candidate("logistic", {"iterations": 20}, make=T.logistic),
    ]
    done = T.train_candidates(rows, ["x", "z", "absent"], ["cat"], "loan_id", quick)
    log = T.run_log(spark, done)
    assert [r["name"] for r in log.collect()] == ["CatBoost", "logistic"]
    assert log.first()["params"]["decision_threshold"] == f"{done[0].threshold:.2f}"
    assert all(t.metrics["roc_auc"] > 0.6 for t in done)
    path = scratch_path(spark, "model")
    OUT.save_model(done[0].model, done[0].threshold, path, "CatBoost")
    model, threshold, name = OUT.load_model(spark, path)
    a = T.score(done[0].model, loans, done[0].threshold).select("loan_id", "prob", "decision")
    b = T.score(model, loans, threshold).select("loan_id", "prob", "decision")
    assert name == "CatBoost" and a.exceptAll(b).count() == 0


def test_random_search_finds_the_better_point(spark, loans):
    model = M.feature_pipeline(["x", "z"], []).fit(loans)
    rows = T.class_weights(model.transform(loans), 2.0)
    grid = {"reg": [0.0, 1000.0], "iterations": [20]}
    best, fitted, table = T.random_search(
        lambda p: T.logistic(p, "target", "features", T.weight_column(1.0)), grid, rows, "loan_id", n=20, folds=2
    )
    assert best["reg"] == 0.0 and table.count() == 2 and fitted.coefficients.size == 3


def test_booster_parameter_names():
    p = T.boosted_trees(T.LIGHTGBM_BEST, "y", "f", "w")
    assert (p.getMaxIter(), p.getMaxDepth(), p.getMinInstancesPerNode()) == (800, 5, 50)
    assert T.boosted_trees(T.CATBOOST_BEST, "y", "f", "w").getMaxDepth() == 8
    assert T.boosted_trees(T.XGBOOST_BEST, "y", "f", "w").getFeatureSubsetStrategy() == "0.8"
    assert len(T._draws(T.XGBOOST_GRID, 20, 42)) == 20


def test_factors_do_not_travel_to_the_margins(spark, sf_dir):
    """tree_contributions joins sums with margins; the factors of a loan stay where they were found."""
    from creditspark.plans.catalog import QUERIES

    plan = QUERIES["tree_contributions"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):].splitlines()[1]
    assert "Project" in join and "total" in join and "phi" not in join.split("total")[-1]
