"""Additive attributions of a score to features, as batch jobs over all loans.

An attribution is one array per loan of (feature, value, contribution), so
per-loan rankings need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.functions.scalars import effect_label
from creditspark.functions.semantics import sql_double, sql_text
from creditspark.operators.rank import TOP_FACTORS, TOP_FEATURES, extremes, top_n
from creditspark.sources.scratch import scratch_path

FEW_TESTS = 12
BLOCK_NODES = 500_000  # tree nodes that the driver holds and broadcasts at a time (a single tree may be larger)


def linear_contributions(
    df: DataFrame, coef: Mapping[str, float], mean: Mapping[str, float], keep: Sequence[str] = ("loan_id",)
) -> DataFrame:
    """coef * (x - mean) per feature: exact for a linear score; NULL counts as the mean."""
    cells = []
    for c, b in coef.items():
        x, m = f"CAST(`{c}` AS DOUBLE)", sql_double(mean[c])
        cells.append(
            f"struct({sql_text(c)} AS feature, {x} AS value, {sql_double(b)} * (coalesce({x}, {m}) - {m}) AS contribution)"
        )
    return df.select(*keep, F.expr(f"array({', '.join(cells)})").alias("factors"))


# --- trees ---------------------------------------------------------------------


def tree_nodes(spark: SparkSession, model, path: str) -> DataFrame:
    """Nodes of a tree ensemble as rows, read from its saved form at `path`."""
    model.write().overwrite().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "about", "tree_weight").drop("about")
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").join(weights, "treeID").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"),
        n["impurityStats"][0].alias("cover"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), n["split"]["numCategories"].alias("categories"),
        n["split"]["leftCategoriesOrThreshold"].alias("test"), "tree_weight",
    )


def leaf_paths(rows: Sequence) -> list[tuple[float, list]]:
    """(weighted leaf value, [(feature, share, tests)]) per leaf of all trees, see `tree_leaves`."""
    return [leaf for leaves in tree_leaves(rows) for leaf in leaves]


def tree_leaves(rows: Sequence) -> list[list[tuple[float, list]]]:
    """(weighted leaf value, [(feature, share, tests)]) per leaf of each tree.

    `share` is the product of cover fractions along the feature's splits, `tests`
    the conditions a value must meet to follow the path. The children of a node without cover,
    as symmetric trees have where a leaf is cut that no row reaches, take half of it each.
    """
    trees: dict = {}
    for r in rows:
        trees.setdefault(r["tree"], {})[r["id"]] = r
    out = []
    for nodes in trees.values():
        leaves = []
        out.append(leaves)
        stack = [(nodes[0], {})]
        while stack:
            node, path = stack.pop()
            if node["left"] < 0:
                steps = [(f, share, tests) for f, (share, tests) in path.items()]
                leaves.append((node["prediction"] * node["tree_weight"], steps))
                continue
            for child, goes_left in ((nodes[node["left"]], True), (nodes[node["right"]], False)):
                share, tests = path.get(node["feature"], (1.0, ()))
                test = (goes_left, node["categories"] >= 0, tuple(node["test"]))
                part = child["cover"] / node["cover"] if node["cover"] else 0.5
                step = (share * part, (*tests, test))
                stack.append((child, {**path, node["feature"]: step}))
    return out


def _meets(x: np.ndarray, tests) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for goes_left, categorical, values in tests:
        left = np.isin(x, values) if categorical else x <= values[0]
        ok &= left if goes_left else ~left
    return ok


def path_attribution(x: np.ndarray, leaves) -> tuple[float, np.ndarray]:
    """Base value and path-dependent Shapley values of a batch of rows.

    On one leaf the value of a feature set is a product: 0/1 for features that are
    known, the cover share for the others. The Shapley value of a product game is
    the integral over t in [0, 1] of the product of (1-t)*share + t*met over the
    other features, a polynomial that Gauss-Legendre nodes integrate exactly.
    """
    # features side by side: one feature of all rows is read at a time
    x = np.ascontiguousarray(x.T)
    base, phi = 0.0, np.zeros_like(x, dtype=float)
    for value, steps in leaves:
        base += value * float(np.prod([share for _, share, _ in steps]))
        if not steps:
            continue
        share = np.array([[s] for _, s, _ in steps])
        met = np.stack([_meets(x[f], tests) for f, _, tests in steps]).astype(float)
        nodes, weights = np.polynomial.legendre.leggauss((len(steps) + 1) // 2)
        integral = np.zeros_like(met)
        for t, w in zip((nodes + 1) / 2, weights / 2):
            factor = (1 - t) * share + t * met
            # products of the factors before and after each one, as a factor may be 0
            others = np.full_like(met, w)
            others[1:] *= np.cumprod(factor[:-1], axis=0)
            others[:-1] *= np.cumprod(factor[:0:-1], axis=0)[::-1]
            integral += others
        for j, (f, _, _) in enumerate(steps):
            phi[f] += value * (met[j] - share[j]) * integral[j]
    return base, phi.T


def attribution(x: np.ndarray, trees) -> tuple[float, np.ndarray]:
    """Base value and Shapley values of a batch of rows, tree by tree.

    Rows that meet the same tests of a tree share its values, so a tree of few tests, as symmetric ones
    are, looks at one row of each kind.
    """
    base, phi = 0.0, np.zeros(x.shape, dtype=float)
    for leaves in trees:
        tests = {(f, categorical, values) for _, steps in leaves for f, _, own in steps for _, categorical, values in own}
        if len(tests) > FEW_TESTS:
            b, p = path_attribution(x, leaves)
        else:
            kind = np.zeros(len(x), np.int64)
            for i, (f, categorical, values) in enumerate(sorted(tests)):
                kind |= _meets(x[:, f], [(True, categorical, values)]).astype(np.int64) << i
            _, first, again = np.unique(kind, return_index=True, return_inverse=True)
            used = sorted({f for f, _, _ in tests})
            b, p = tree_attribution(x[np.ix_(first, used)], [(v, [(used.index(f), s, own) for f, s, own in steps]) for v, steps in leaves])
            phi[:, used] += p[again]
            base += b
            continue
        base += b
        phi += p
    return base, phi


def tree_attribution(x: np.ndarray, leaves) -> tuple[float, np.ndarray]:
    """What `path_attribution` gives, for all leaves of a tree at once; a feature that a path does not ask for changes nothing."""
    n, d, known = len(x), x.shape[1], {}
    value, share, met = np.array([v for v, _ in leaves]), np.ones((len(leaves), 1, d)), np.ones((len(leaves), n, d))
    for i, (_, steps) in enumerate(leaves):
        for f, s, tests in steps:
            if (f, tests) not in known:
                known[f, tests] = _meets(x[:, f], tests)
            share[i, 0, f], met[i, :, f] = s, known[f, tests]
    integral = np.zeros_like(met)
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2) if d else ((), ())
    for t, w in zip(((1 + v) / 2 for v in nodes), (v / 2 for v in weights), strict=True):
        factor = (1 - t) * share + t * met
        others = np.full_like(met, w)
        others[..., 1:] *= np.cumprod(factor[..., :-1], axis=-1)
        others[..., :-1] *= np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
        integral += others
    phi = np.einsum("l,lnf,lnf->nf", value, met - share, integral)
    return float(value @ share.prod(axis=-1)[:, 0]), phi


def tree_blocks(nodes: DataFrame, block_nodes: int) -> list[tuple[int, int]]:
    """Neighbouring trees put together while they have at most `block_nodes` nodes: first and last tree of each block."""
    sizes = nodes.groupBy("tree").count().orderBy("tree").collect()
    blocks: list[tuple[int, int]] = []
    held = 0
    for tree, n in sizes:
        if blocks and held + n <= block_nodes:
            blocks[-1] = (blocks[-1][0], tree)
        else:
            blocks.append((tree, tree))
            held = 0
        held += n
    return blocks


def tree_contributions(
    df: DataFrame, model, path: str, names: Sequence[str], key: str = "loan_id", features: str = "features",
    block_nodes: int = BLOCK_NODES,
) -> DataFrame:
    """Attribution of a boosted-tree margin: key, base, factors.

    The trees go to the executors block by block, so that a model of any size is explained: loans
    pass a block in Arrow batches, which adds its share to their base value and contributions, and
    are written between two blocks. Shares add up, as a margin is a sum over trees.
    """
    spark = df.sparkSession
    nodes = tree_nodes(spark, model, path)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, vector_to_array(features).alias("x"))
    blocks = tree_blocks(nodes, block_nodes)
    for i, (first, last) in enumerate(blocks):
        shared = spark.sparkContext.broadcast(tree_leaves(nodes.where(F.col("tree").between(first, last)).collect()))

        def explain(batches, shared=shared):
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    base, phi = attribution(x, shared.value)
                    base = np.full(len(x), base)
                    if "phi" in b.schema.names:
                        base += b.column("base").to_numpy()
                        phi = phi + b.column("phi").flatten().to_numpy(zero_copy_only=False).reshape(phi.shape)
                    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(phi).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([b.column(key), pa.array(base), b.column("x"), lists], names=[key, "base", "x", "phi"])

        rows = rows.mapInArrow(explain, f"{key} {kind}, base double, x array<double>, phi array<double>")
        if i + 1 < len(blocks):
            so_far = scratch_path(spark, "explained")
            rows.write.parquet(so_far)
            rows = spark.read.schema(rows.schema).parquet(so_far)
    labels = F.expr(f"array({', '.join(map(sql_text, names))})")
    zipped = F.arrays_zip(labels.alias("feature"), F.col("x").alias("value"), F.col("phi").alias("contribution"))
    return rows.select(key, "base", zipped.alias("factors"))


def model_contributions(
    df: DataFrame, classifier, path: str, names: Sequence[str], key: str = "loan_id", features: str = "features"
) -> DataFrame:
    """Attribution of a fitted classifier's margin: exact for linear models, path-dependent for trees."""
    if not hasattr(classifier, "coefficients"):
        return tree_contributions(df, classifier, path, names, key, features)
    mean = df.agg(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray()
    coef = classifier.coefficients.toArray()

    def numbers(values) -> str:
        return "array(" + ", ".join(map(sql_double, values)) + ")"

    base = float(classifier.intercept + coef @ mean)
    zipped = f"arrays_zip(array({', '.join(map(sql_text, names))}), x, {numbers(coef)}, {numbers(mean)})"
    one = "struct(z['0'] AS feature, z['x'] AS value, z['2'] * (z['x'] - z['3']) AS contribution)"
    return df.select(key, F.lit(base).alias("base"), vector_to_array(features).alias("x")).select(
        key, "base", F.expr(f"transform({zipped}, z -> {one})").alias("factors")
    )


# --- reports on attributions ----------------------------------------------------


def long_form(contrib: DataFrame, keep: Sequence[str] = ("loan_id",)) -> DataFrame:
    return contrib.select(*keep, F.inline("factors"))


def global_importance(contrib: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return (
        contrib.select(F.inline("factors"))
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("importance"))
    )


def top_features(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    return top_n(importance, "importance", n, ["feature"]).select("feature", F.round("importance", 4).alias("importance"))


def strongest(factors: Column | str = "factors", n: int = TOP_FACTORS) -> Column:
    """The n factors with the largest absolute contribution, as an array."""
    ranked = F.array_sort(F.transform(
        factors,
        lambda f: F.struct(
            (-F.abs(f["contribution"])).alias("o"), f["feature"].alias("feature"), f["value"].alias("value"),
            f["contribution"].alias("contribution"),
        ),
    ))
    return F.transform(
        F.slice(ranked, 1, n),
        lambda f: F.struct(
            f["feature"].alias("feature"), F.round(f["value"], 4).alias("value"),
            F.round(f["contribution"], 4).alias("shap"), effect_label(f["contribution"]).alias("effect"),
        ),
    )


def top_factors(contrib: DataFrame, n: int = TOP_FACTORS, keep: Sequence[str] = ("loan_id",)) -> DataFrame:
    """The n strongest factors of each loan, with their order from 1; no shuffle."""
    return contrib.select(*keep, F.posexplode(strongest("factors", n)).alias("pos", "f")).select(
        *keep, (F.col("pos") + 1).cast("long").alias("orden"), "f.*"
    )


def local_document(
    contrib: DataFrame, scored: DataFrame, raw: DataFrame, key: str = "loan_id", prob: str = "prob",
) -> DataFrame:
    """One row {high_risk, low_risk}: label, probability, factors and raw features, NULLs kept."""
    pair = extremes(scored.select(key, prob), prob, key)
    label = F.when(F.col("perfil_tipo") == "high_risk", "Alto Riesgo").otherwise("Bajo Riesgo")
    raw_cols = [c for c in raw.columns if c != key]
    # two loans: both joins look them up by a two-row broadcast
    explained = F.broadcast(pair).join(contrib.select(key, "factors"), key)
    rows = (
        F.broadcast(explained.withColumn("factors", strongest()))
        .join(raw.select(key, F.struct(*raw_cols).alias("raw_features")), key)
        .select(
            "perfil_tipo",
            F.struct(
                label.alias("risk_label"), F.round(F.col(prob) * 100, 2).alias("probability"),
                "factors", "raw_features",
            ).alias("d"),
        )
    )
    picked = [F.any_value(F.when(F.col("perfil_tipo") == p, F.col("d")), True).alias(p) for p in ("high_risk", "low_risk")]
    return rows.agg(*picked)


def attribution_document(importance: DataFrame, local: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """One row: `global` (array of feature, importance) and `local` (the two profiles)."""
    top = top_features(importance, n)
    item = F.struct((-F.col("importance")).alias("o"), "feature", "importance")
    ranked = top.agg(F.array_sort(F.collect_list(item)).alias("g")).select(
        F.transform("g", lambda s: F.struct(s["feature"].alias("feature"), s["importance"].alias("importance"))).alias("g")
    )
    return local.select(ranked.scalar().alias("global"), F.struct("high_risk", "low_risk").alias("local"))
