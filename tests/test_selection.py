"""Cuts, splits and quantiles against brute force, with hot values and tiny limits."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditspark.functions.classes import class_cuts, even_parts, largest_remainders, with_place
from creditspark.functions.hashing import order_text
from creditspark.functions.selection import quantiles
from creditspark.operators import split as S

PROBS = [0.0, 0.1, 0.34, 0.5, 0.9, 0.99995, 1.0]


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(1)
    n = 6000
    return pd.DataFrame({
        "normal": np.where(np.arange(n) % 7 == 0, np.nan, rng.normal(size=n)),
        "hot": np.where(rng.random(n) < 0.34, 5.0, rng.exponential(10, n)),
        "few": np.round(rng.random(n) * 3),
        "nearly_constant": np.where(rng.random(n) < 0.999, 1.0, rng.random(n)),
    })


@pytest.mark.parametrize("bins", [65_536, 100, 2])
def test_quantiles_equal_numpy(spark, numbers, bins):
    df = spark.createDataFrame(numbers)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])
    got = quantiles(df, list(numbers.columns), PROBS, bins)
    for c in numbers.columns:
        assert np.allclose(got[c], np.percentile(numbers[c].dropna(), [100 * p for p in PROBS]), rtol=1e-12)


def test_quantiles_of_extreme_values(spark):
    inf = float("inf")
    values = [-inf, -1.7e308, -1.0, -1e-300, 0.0, 1e-300, 1.0, 1.7e308, inf, inf, inf]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    probs = [i / 10 for i in range(11)]
    assert quantiles(df, ["a"], probs) == {"a": values}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.0]}
    assert quantiles(df, [], [0.5]) == {}


def order(key, salt):
    return hashlib.md5(f"{key}:{salt}".encode()).hexdigest() + f":{key}"


@pytest.mark.parametrize("small", [100_000, 50, 1])
def test_exact_sample(spark, small):
    want = sorted(range(3001), key=lambda k: order(k, 42))[:300]
    got = S.sample_exact(spark.range(3001), 0.1, "id", small=small)
    assert sorted(r[0] for r in got.collect()) == sorted(want)


def test_sample_edges(spark):
    assert S.sample_exact(spark.range(5), 1.0, "id").count() == 5
    assert S.sample_exact(spark.range(5), 0.0, "id").count() == 0
    assert S.sample_exact(spark.range(0), 0.5, "id").count() == 0
    assert S.sample_n(spark.range(10), 3, "id").count() == 3


def labelled(spark, n=5000):
    return spark.range(n).withColumn("y", F.when(F.col("id") % 5 == 0, 1).when(F.col("id") % 997 == 1, None).otherwise(0))


@pytest.mark.parametrize("small", [100_000, 1])
def test_stratified_split_is_complete_disjoint_and_balanced(spark, small):
    df = labelled(spark)
    train, test = S.stratified_split(df, "y", 0.2, "id", small=small)
    a, b = ({r["id"] for r in x.collect()} for x in (train, test))
    assert not a & b and len(a | b) == 5000 and len(b) == 1000
    shares = {r["y"]: r["n"] for r in test.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for r in df.groupBy("y").agg(F.count("*").alias("n")).collect():
        assert abs(shares.get(r["y"], 0) - 0.2 * r["n"]) <= 1


def test_three_way_split(spark):
    got = {r["split"]: r["n"] for r in S.with_split(labelled(spark), "y", "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"base": 3200, "calib": 800, "test": 1000}


@pytest.mark.parametrize("small", [100_000, 7])
def test_chrono_split_with_a_third_on_one_instant_and_nulls(spark, small):
    n = 3000
    df = spark.range(n).withColumn(
        "ts",
        F.when(F.col("id") % 3 == 0, F.lit("2020-05-05 10:00:00").cast("timestamp"))
        .when(F.col("id") % 10 == 1, F.lit(None).cast("timestamp"))
        .otherwise(F.timestamp_micros(F.lit(1_500_000_000_000_000) + F.col("id") * 86_400_000_123)),
    )
    rows = df.select("id", F.unix_micros("ts").alias("us")).collect()
    ranked = sorted(rows, key=lambda r: (r["us"] is None, r["us"] or 0, order(r["id"], 42)))
    for fraction in (0.3, 0.8, 0.97):
        base, recent = S.chrono_split(df, "ts", fraction, "id", small=small)
        k = int(fraction * n)
        assert {r["id"] for r in base.collect()} == {r["id"] for r in ranked[:k]}
        assert recent.count() == n - k


def test_folds_are_even_and_whatever_the_bucket(spark):
    df = labelled(spark, 3000)
    a = {r["id"]: r["fold"] for r in S.kfold(df, "y", 3, "id").collect()}
    b = {r["id"]: r["fold"] for r in S.kfold(df, "y", 3, "id", small=1).collect()}
    assert a == b and len(a) == 3000
    for r in S.kfold(df, "y", 3, "id").groupBy("y").pivot("fold", [0, 1, 2]).count().collect():
        sizes = [r[str(i)] or 0 for i in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_copies_of_a_key_stay_together(spark):
    df = spark.range(900).withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    got = S.sample_exact(df, 0.5, "k", small=1)
    assert got.where("k = -1").count() in (0, 300)


def test_copies_of_a_key_share_a_fold(spark):
    df = spark.range(900).select((F.col("id") % 100).alias("k"), F.lit(1).alias("y"))
    assert S.kfold(df, "y", 3, "k", small=1).groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def shared(spark, counts, total, small=100_000, inline=1_000):
    sizes = spark.createDataFrame(list(counts.items()), "__c int, rows long")
    return {r["__c"]: r["k"] for r in largest_remainders(lambda n: total, small, inline)(sizes).collect()}


@pytest.mark.parametrize("inline", [1_000, 0])
def test_largest_remainders(spark, inline):
    assert shared(spark, {0: 7, 1: 3}, 8, inline=inline) == {0: 6, 1: 2}
    assert shared(spark, {0: 1, 1: 1, 2: 1}, 2, inline=inline) == {0: 1, 1: 1, 2: 0}
    assert shared(spark, {}, 0, inline=inline) == {}
    big = {0: 3_000_000_000_000, 1: 1_000_000_000_001, None: 7}
    exact = {c: 3_200_000_000_006 * n // 4_000_000_000_008 for c, n in big.items()}
    got = shared(spark, big, 3_200_000_000_006, inline=inline)
    assert sum(got.values()) == 3_200_000_000_006 and all(0 <= got[c] - exact[c] <= 1 for c in big)


def test_quotas_agree_between_driver_and_frames(spark):
    many = {i: 1 + i % 3 for i in range(40)}
    assert shared(spark, many, 33) == shared(spark, many, 33, inline=0) == shared(spark, many, 33, small=1, inline=0)


@pytest.mark.parametrize("small, inline", [(100_000, 1_000), (100_000, 3), (1, 3), (1, 1_000)])
def test_many_classes_with_a_hot_one_against_brute_force(spark, small, inline):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 90).alias("y"))
    text = order_text("id", 42)
    cuts = class_cuts(df, "y", text, even_parts(4), small)
    got = {r["id"]: r["__place"] for r in with_place(df, "y", text, cuts, inline).collect()}
    classes: dict = {}
    for r in df.collect():
        classes.setdefault(r["y"], []).append(r["id"])
    for ids in classes.values():
        ranked = sorted(ids, key=lambda i: order(i, 42))
        for place, i in enumerate(ranked):
            assert got[i] == sum(place >= len(ids) * part // 4 for part in range(1, 4))
    assert len(got) == 2000


def test_more_classes_than_a_driver_should_hold(spark):
    """Thousands of classes of text, a third of the rows in one of them; no class is refused, every row is placed."""
    df = spark.range(15_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5_000)).alias("y"))
    train, test = S.stratified_split(df, "y", 0.25, "id")
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert train.count() == 11_250 and test.count() == 3_750 and abs(sizes["hot"] - 3_750) <= 1
    folds = S.kfold(df, "y", 2, "id").groupBy("y").agg(F.count_if(F.col("fold") == 0).alias("a"), F.count_if(F.col("fold") == 1).alias("b"))
    assert folds.where("abs(a - b) > 1").count() == 0


def test_folds_of_an_empty_frame(spark):
    df = spark.range(0).withColumn("y", F.lit(1))
    assert S.kfold(df, "y", 3, "id").collect() == []
    train, test = S.stratified_split(df, "y", 0.2, "id")
    assert train.count() == test.count() == 0
