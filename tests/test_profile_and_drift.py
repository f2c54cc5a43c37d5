"""Profiling and drift on edge cases and against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.operators import drift as D
from creditspark.operators import profile as P


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_null_profile_and_empty_frame(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert rows(P.null_profile(df), "campo", "nulos", "porcentaje") == [("a", 1, 33.33), ("b", 2, 66.67)]
    assert rows(P.null_profile(df.limit(0)), "campo", "nulos", "porcentaje") == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_value_counts_share_of_all_rows(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "s string")
    assert sorted(rows(P.value_counts(df, "s"), "label", "count", "percentage")) == [
        ("nan", 1, 25.0), ("x", 2, 50.0), ("y", 1, 25.0)]
    both = P.categorical(df.withColumn("t", F.lit("c")), ["s", "t", "missing"])
    assert ("t", "c", 4, 100.0) in rows(both, "variable", "label", "count", "percentage")


def test_target_distribution_has_two_rows_always(spark):
    df = spark.createDataFrame([(1,), (1,)], "target int")
    assert rows(P.target_distribution(df), "count", "percentage") == [(0, 0.0), (2, 100.0)]
    assert rows(P.target_distribution(df.limit(0)), "count", "percentage") == [(0, 0.0), (0, 0.0)]


def test_describe(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None), (None, 5.0, None)], "a double, k double, z double")
    got = {r["variable"]: tuple(r)[1:] for r in P.describe(df, ["a", "k", "z", "absent"]).collect()}
    assert got == {
        "a": (3, 2.33, 1.53, 1.0, 2.0, 4.0), "k": (4, 5.0, 0.0, 5.0, 5.0, 5.0), "z": (0, 0.0, 0.0, 0.0, 0.0, 0.0),
    }
    assert P.describe(df, ["a"], approximate=True).first()["median"] == 2.0


def test_std_of_one_row_reads_zero(spark):
    assert P.describe(spark.createDataFrame([(3.0,)], "a double"), ["a"]).first()["std"] == 0.0


def test_correlation_with_a_constant_and_gaps(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=200)})
    pdf["b"] = pdf.a * 2 + rng.normal(size=200)
    pdf["k"] = 7.0
    pdf.loc[3, "b"] = None
    df = spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    got = {(r["variable_x"], r["variable_y"]): r["correlation"] for r in P.correlation(df, ["a", "b", "k"]).collect()}
    want = np.corrcoef(*pdf.dropna()[["a", "b"]].to_numpy().T)[0, 1]
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(want, abs=6e-4)
    assert got[("a", "a")] == 1.0 and got[("k", "k")] == 0.0 and got[("a", "k")] == 0.0


def test_correlation_of_no_rows_is_zero(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert {r["correlation"] for r in P.correlation(df, ["a", "b"]).collect()} == {0.0}


def test_correlation_takes_one_pass_and_large_means_cost_no_digits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 4)) + np.array([1e9, -1e9, 1e12, 0.0])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).repartition(13)
    m = P.moments(df, list("abcd"))
    assert m.n == 3000 and np.allclose(m.mean, x.mean(axis=0), rtol=1e-14) and (m.low == x.min(axis=0)).all() and (m.high == x.max(axis=0)).all()
    want = np.corrcoef(x.T)
    got = {(r.variable_x, r.variable_y): r.correlation for r in P.correlation(df, list("abcd")).collect()}
    assert all(got[a, b] == pytest.approx(want[i, j], abs=6e-4) for i, a in enumerate("abcd") for j, b in enumerate("abcd"))
    spark.sparkContext.setJobGroup("moments", "moments")
    P.moments(spark.range(100, numPartitions=5).withColumn("y", F.col("id") % 7), ["id", "y"])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup("moments") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    tasks = [i.numCompletedTasks for i in map(spark.sparkContext.statusTracker().getStageInfo, stages) if i]
    assert tasks.count(5) == 1  # the stage that reads the rows ran once


def test_correlation_of_infinities_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0), (2.0, 5.0)], "a double, b double")
    got = {(r.variable_x, r.variable_y): r.correlation for r in P.correlation(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): 0.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 1.0}


def numpy_psi(base, recent, buckets=10):
    base, recent = base[~np.isnan(base)], recent[~np.isnan(recent)]
    if not len(base) or not len(recent):
        return 0.0
    edges = np.unique(np.percentile(base, np.linspace(0, 100, buckets + 1)))
    if len(edges) < 2:
        return 0.0
    e, a = (np.histogram(v, bins=edges)[0] / len(v) for v in (base, recent))
    e, a = np.where(e == 0, 1e-4, e), np.where(a == 0, 1e-4, a)
    return float(np.sum((a - e) * np.log(a / e)))


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n = 2500
    side = np.arange(n) < 2000
    pdf = pd.DataFrame({
        "side": side,
        "same": rng.normal(size=n),
        "shifted": np.where(side, rng.normal(size=n), rng.normal(2, 1, size=n)),
        "constant": 1.0,
        "few": rng.integers(0, 3, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 0.0, rng.random(n)),
        "gappy": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)),
        "gone": np.where(side, rng.random(n), np.nan),
    })
    cols = [c for c in pdf.columns if c != "side"]
    df = spark.createDataFrame(pdf)
    df = df.select("side", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    got = {r[0]: r[1] for r in D.psi(df, F.col("side"), cols).collect()}
    for c in cols:
        assert got[c] == pytest.approx(numpy_psi(pdf[c][side].to_numpy(), pdf[c][~side].to_numpy()), abs=1e-9), c


def test_psi_of_a_population_with_itself(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"))
    both = df.withColumn("side", F.lit(True)).union(df.withColumn("side", F.lit(False)))
    assert D.psi(both, F.col("side"), ["x"]).first()["psi_value"] == pytest.approx(0.0, abs=1e-12)


def test_breaches(spark):
    psi = spark.createDataFrame([("a", 0.25), ("b", 0.2499)], "feature_name string, psi_value double")
    assert rows(D.breaches(psi), "feature_name") == [("a",)]
    assert rows(D.drift_flag(psi), "breached", "drift_detected") == [(1, True)]
    assert rows(D.drift_flag(psi.limit(0)), "breached", "drift_detected") == [(0, False)]
    assert D.max_psi(psi.limit(0)).first()[0] == 0.0
