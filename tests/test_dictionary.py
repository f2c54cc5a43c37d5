"""Category codes against sorted values, one-hot slots against Spark's own encoder."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditspark.operators import dictionary as D
from creditspark.operators import features as M


def wide(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    c = np.array([f"v{x}" for x in rng.integers(0, 900, n)], dtype=object)
    c[: n // 3] = "hot"
    c[-5:] = None
    return pd.DataFrame({"id": np.arange(n), "c": c, "d": rng.choice(["a", "b", "it's"], n)})


@pytest.mark.parametrize("part, small", [(100, 10), (10**6, 10**4)])
def test_codes_are_the_order_of_the_values(spark, part, small):
    pdf = wide()
    df = spark.createDataFrame(pdf)
    table = D.category_dictionary(df, ["c", "d"], part)
    order = {c: sorted(pdf[c].dropna().unique()) for c in ("c", "d")}
    for c in ("c", "d"):
        rows = table.where(F.col("variable") == c).orderBy("code").collect()
        assert [r["value"] for r in rows] == order[c] and [r["code"] for r in rows] == list(range(len(order[c])))
        assert {r["value"]: r["n"] for r in rows} == pdf[c].value_counts().to_dict()
    new = df.union(spark.createDataFrame([(-1, "unseen", "a"), (-2, None, None)], "id long, c string, d string"))
    got = {r["id"]: (r["idx_c"], r["idx_d"]) for r in D.encode(new, table, ["c", "d"], small=small).collect()}
    code = {c: {v: i for i, v in enumerate(order[c])} for c in order}
    assert got == {**{r.id: (code["c"].get(r.c), code["d"].get(r.d)) for r in pdf.itertuples()}, -1: (None, 0), -2: (None, None)}


def test_vectors_equal_sparks_one_hot_and_fit(spark):
    df = spark.createDataFrame(wide().fillna("none")).withColumn("y", (F.col("c") == "hot").cast("int"))
    model = Pipeline(stages=[M.ModeImputer(["c", "d"]), *M.one_hot(["c", "d"])]).fit(df)
    want = {r["id"]: [*r["a"], *r["b"]] for r in model.transform(df).select("id", vector_to_array("oh_c").alias("a"), vector_to_array("oh_d").alias("b")).collect()}
    table = D.category_dictionary(df, ["c", "d"])
    known = D.sizes(table, ["c", "d"])
    ready = D.as_vectors(D.encode(df, table, ["c", "d"], small=10), known)
    assert {r["id"]: list(r["f"]) for r in ready.select("id", vector_to_array("features").alias("f")).collect()} == want
    fit = LogisticRegression(labelCol="y", maxIter=20).fit(ready)
    assert fit.numFeatures == sum(known.values()) and fit.summary.accuracy > 0.99


def test_empty_and_unknown(spark):
    none = spark.createDataFrame([], "c string, n long")
    table = D.category_dictionary(none, ["c", "n"])
    assert table.count() == 0 and D.sizes(table, ["c", "n"]) == {"c": 0, "n": 0}
    rows = D.encode(spark.createDataFrame([("x", 3)], "c string, n long"), table, ["c", "n"])
    assert rows.select("c", "n", "idx_c", "idx_n", D.slots({"c": 0, "n": 0}).alias("s")).first() == ("x", 3, None, None, [])
    numbers = D.category_dictionary(spark.range(3).withColumnRenamed("id", "n"), ["n"])
    assert D.encode(rows.select("n").union(spark.createDataFrame([(1,)], "n long")), numbers, ["n"]).orderBy("n").collect() == [(1, 1), (3, None)]


def test_a_million_values_without_labels_on_the_driver(spark):
    df = spark.range(1_000_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("c"), "id")
    table = D.category_dictionary(df, ["c"])
    wrong = D.encode(df, table, ["c"]).where("idx_c IS NULL OR idx_c <> id").count()
    assert wrong == 0 and D.sizes(table, ["c"]) == {"c": 1_000_000}
    assert M.ModeImputer(["c"]).fit(df).transform(df.limit(1)).count() == 1
