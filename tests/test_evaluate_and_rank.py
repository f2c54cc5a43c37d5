"""Evaluation against brute force and Spark's own evaluator; winners and orders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from creditspark.operators import evaluate as E
from creditspark.operators import rank as R


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    n = 3000
    target = (rng.random(n) < 0.25).astype(int)
    prob = np.clip(0.2 + 0.1 * target + 0.1 * rng.normal(size=n), 0, 1)
    prob[::3] = 0.21            # a third of all rows on one score
    prob[1::50] = 0.05          # scores on thresholds
    return pd.DataFrame({"m": np.where(np.arange(n) % 2, "a", "b"), "target": target, "prob": prob})


def f1_at(pdf, t):
    said = pdf.prob >= t
    tp = int((said & (pdf.target == 1)).sum())
    return 2 * tp / max(1, int(said.sum()) + int((pdf.target == 1).sum()))


def test_sweep_equals_brute_force(spark, scores):
    got = {r["m"]: r for r in E.threshold_sweep(spark.createDataFrame(scores), ["m"]).collect()}
    grid = [(5 + i) / 100 for i in range(91)]
    for m, part in scores.groupby("m"):
        f1 = [f1_at(part, t) for t in grid]
        assert got[m]["best_f1"] == max(f1)
        assert got[m]["best_threshold"] == grid[int(np.argmax(f1))]


def test_sweep_without_positives(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.1)], "target int, prob double")
    assert tuple(E.threshold_sweep(df).first()) == (0.5, 0.0)


def test_thresholds_reached_on_every_boundary(spark):
    grid = [(5 + i) / 100 for i in range(91)]
    probs = [0.0, 1.0, 0.04999, *grid, *np.nextafter(grid, 0), *np.nextafter(grid, 1)]
    df = spark.createDataFrame([(float(p),) for p in probs], "prob double")
    for r in df.select("prob", E.thresholds_reached(F.col("prob")).alias("n")).collect():
        assert r["n"] == sum(t <= r["prob"] for t in grid)


def test_auc_equals_sparks_evaluator(spark, scores):
    df = spark.createDataFrame(scores)
    judge = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="target", numBins=0)
    want = judge.evaluate(df.withColumn("prob", F.col("prob").cast("double")).withColumn("target", F.col("target").cast("double")))
    assert E.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_auc_symmetry_and_missing_class(spark, scores):
    df = spark.createDataFrame(scores)
    a = E.roc_auc(df).first()[0]
    b = E.roc_auc(df.withColumn("prob", 1 - F.col("prob"))).first()[0]
    assert a + b == pytest.approx(1.0, abs=1e-9)
    assert E.roc_auc(df.where("target = 1")).first()[0] is None
    assert E.with_gini(E.roc_auc(df)).first()["gini"] == pytest.approx(2 * a - 1)


def test_auc_of_scores_inside_one_fine_bucket_and_out_of_range(spark):
    rows = [(1, 0.5 + 3e-12), (0, 0.5 + 2e-12), (1, 0.5 + 1e-12), (0, 0.5), (1, 7.0), (0, -7.0)]
    df = spark.createDataFrame(rows, "target int, prob double")
    pairs = [(p > n) + 0.5 * (p == n) for t, p in rows if t for u, n in rows if not u]
    assert E.roc_auc(df).first()[0] == pytest.approx(sum(pairs) / 9)


def test_auc_over_all_kinds_of_doubles(spark):
    rng = np.random.default_rng(5)
    s = np.concatenate([
        [np.inf, -np.inf, 0.0, -0.0, 5e-324, -5e-324, 1e-310, 2e-310, 1.7e308, -1.7e308, 1.0, np.nextafter(1, 0), np.nextafter(1, 2)],
        2.0 ** rng.integers(-1074, 1023, 200), rng.normal(size=200), 1e-20 * (1 + 1e-15 * rng.integers(0, 40, 200)), 0.5 + 2.0**-52 * rng.integers(0, 300, 300),
    ])
    y = rng.integers(0, 2, len(s))
    got = E.roc_auc(spark.createDataFrame(pd.DataFrame({"target": y, "prob": s}))).first()[0]
    high, low = s[y == 1][:, None], s[y == 0][None, :]
    assert got == pytest.approx(((high > low) + 0.5 * (high == low)).mean(), abs=1e-12)


def test_auc_levels_rise_with_the_score_and_spread_a_crowd(spark):
    df = spark.range(400_000).select((F.lit(0.3) + F.col("id") * 2.0**-50).alias("s"))   # one bucket of width 2**-24
    levels = df.select("s", *[c.alias(n) for n, c in zip(E.LEVELS, E.score_levels(F.col("s")), strict=True)])
    assert levels.groupBy(*E.LEVELS).count().agg(F.max("count")).first()[0] <= 2**18
    pdf = levels.orderBy("s").toPandas()
    assert pdf.s.is_unique and pdf[E.LEVELS].apply(tuple, axis=1).is_monotonic_increasing


def test_compare_keeps_a_null_group(spark):
    rows = [(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.2), ("a", 0, 0.6)]
    df = spark.createDataFrame(rows, "g string, target int, prob double")
    got = {r["g"]: (r["f1"], r["roc_auc"]) for r in E.compare(df, ["g"]).collect()}
    assert got == {None: (1.0, 1.0), "a": (0.0, 0.0)}


def test_metrics_undefined_is_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "target int, prob double")
    r = E.classification_metrics(df, 0.5).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_losses(spark):
    df = spark.createDataFrame([(100.0, 0.2, "A"), (None, 0.5, "A")], "importe_solicitado double, prob double, g string")
    r = E.portfolio_loss(E.expected_loss(df), ["g"]).first()
    assert (r["loans"], r["ead"]) == (2, 75.0) and r["expected_loss"] == pytest.approx(75 * 0.2 * 0.45)
    assert tuple(E.avoided_loss(df, F.lit(0.5)).first()) == (100.0, 50.0)


RUNS = "run_name string, f1 double, roc_auc double, accuracy double, recall double"


def test_best_runs(spark):
    runs = spark.createDataFrame([
        ("catboost-1", 0.4, 0.7, 0.6, 0.5), ("xgboost-2", 0.41, 0.6, 0.6, 0.5), ("catboost-2", 0.4, 0.9, 0.6, 0.5),
        ("other", 0.1, 0.5, 0.5, 0.123456),
    ], RUNS)
    assert R.best_run(runs).first()["run_name"] == "xgboost-2"
    best = {r["name"]: (r["f1"], r["roc_auc"], r["recall"]) for r in R.best_per_family(runs).collect()}
    assert best == {"CatBoost": (0.4, 0.7, 0.5), "XGBoost": (0.41, 0.6, 0.5), "LightGBM": (0.1, 0.5, 0.123)}
    assert R.best_run(runs.limit(0)).count() == 0


def test_champion_ties(spark):
    def pick(rows, f):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, name string, f1 double, roc_auc double")
        return f(df).first()["name"]

    near = [("a", 0.4, 0.6), ("b", 0.399995, 0.7), ("c", 0.3, 0.9)]
    assert pick(near, R.champion) == "b"
    in_order = lambda df: R.champion_in_order(df, "position")
    assert pick(near, in_order) == "b"
    # a higher F1 within the tolerance wins at once when it comes later
    assert pick([("b", 0.399995, 0.7), ("a", 0.4, 0.6)], in_order) == "a"
    assert pick([("a", 0.4, 0.6), ("b", 0.399995, 0.7)], in_order) == "b"


def test_history_latest_and_top(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "t int, v double")
    assert [r["t"] for r in R.history(df, "t").collect()] == list(range(7))
    assert [r["t"] for r in R.history(df, "t", newest=True).collect()] == [9, 8, 7, 6, 5, 4, 3]
    assert R.history(df.limit(1), "t").count() == 0
    assert R.latest(df, "t").first()["t"] == 9
    assert [r["t"] for r in R.top_n(df, "v", 2).collect()] == [9, 8]
    top = R.top_per(df.withColumn("g", F.col("t") % 2), ["g"], F.col("v"), 2)
    assert sorted((r["g"], r["t"], r["orden"]) for r in top.collect()) == [(0, 6, 2), (0, 8, 1), (1, 7, 2), (1, 9, 1)]


def test_top_per_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    plan = R.top_per(df, ["g"], F.col("id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_extremes_break_ties_by_key(spark):
    df = spark.createDataFrame([(2, 0.9), (1, 0.9), (4, 0.1), (3, 0.1)], "loan_id long, prob double")
    assert {r["perfil_tipo"]: r["loan_id"] for r in R.extremes(df).collect()} == {"high_risk": 1, "low_risk": 3}


def test_unknown_scores_count_nowhere(spark):
    rows = [(1, 0.9, 1), (2, 0.8, 1), (3, 0.2, 0), (4, 0.1, 0), (5, None, 0), (6, 0.95, None)]
    df = spark.createDataFrame(rows, "loan_id long, prob double, target int")
    assert E.roc_auc(df).first().roc_auc == 1.0
    best = E.threshold_sweep(df).first()
    assert best.best_f1 == 1.0
    m = E.classification_metrics(df, 0.5).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 0, 0, 2)
    assert {r.loan_id for r in R.extremes(df.where("target is not null")).collect()} == {1, 4}
    assert tuple(E.left_out(df).first()) == (6, 2)


def test_margins_outside_the_unit_interval(spark):
    import itertools

    rows = [(s, t) for s, t in itertools.product([-50.0, -3.5, -0.1, 0.0, 0.5, 1.0, 1.5, 40.0], [0, 1]) if (s > 0) == bool(t) or s in (0.5, -3.5)]
    df = spark.createDataFrame(rows, "prob double, target int")
    pairs = [(p > n) + 0.5 * (p == n) for p, a in rows if a for n, b in rows if not b]
    assert E.roc_auc(df).first().roc_auc == sum(pairs) / len(pairs)


def test_unknown_metrics_lose(spark):
    runs = spark.createDataFrame([("a", None, 0.9), ("b", 0.5, None), ("c", 0.5, 0.6)], "name string, f1 double, roc_auc double")
    named = runs.withColumnRenamed("name", "run_name")
    assert R.best_run(named).first().run_name == "b"
    assert R.champion(runs).first()["name"] == "c"
    ordered = runs.withColumn("position", F.ascii("name"))
    assert R.champion_in_order(ordered, "position").first()["name"] == "c"


def test_the_tied_pair_depends_on_the_order_alone(spark):
    runs = spark.createDataFrame([(0, "a", 0.5, 0.9), (1, "b", 0.500008, 0.6)], "position int, name string, f1 double, roc_auc double")
    assert R.champion_in_order(runs, "position").first()["name"] == "b"
    assert R.champion(runs).first()["name"] == "a"
