"""Model evaluation over any number of scored rows, for many models in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.functions.semantics import as_column, safe_ratio

# --- fixed values -----------------------------------------------------------
THRESHOLDS = 91            # 0.05, 0.06 .. 0.95
FALLBACK_THRESHOLD = 0.5
EAD_SHARE, LGD = 0.75, 0.45
# -----------------------------------------------------------------------------
DIGIT = 18                 # bits of a score that one level of the AUC settles


def judged(scored: DataFrame, prob: str = "prob", target: str = "target") -> DataFrame:
    """Rows that a metric can judge: score and target are known. Every metric below starts from these alone."""
    return scored.where(F.col(prob).isNotNull() & F.col(target).isNotNull())


def left_out(scored: DataFrame, by: Sequence[str] = (), prob: str = "prob", target: str = "target") -> DataFrame:
    """Rows per group, and how many of them the metrics leave out."""
    unknown = F.col(prob).isNull() | F.col(target).isNull()
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("filas"), F.count_if(unknown).alias("sin_juzgar"))


def threshold_at(i: Column) -> Column:
    return (i + 5) / F.lit(100.0)


def thresholds_reached(prob: Column) -> Column:
    """How many of the 91 thresholds are <= prob, without testing them all."""
    guess = F.floor(prob * 100).cast("int") - 5
    at = F.greatest(F.lit(-1), F.least(F.lit(THRESHOLDS - 1), guess))
    up = (at < THRESHOLDS - 1) & (threshold_at(at + 1) <= prob)
    down = (at >= 0) & (threshold_at(at) > prob)
    return F.when(up, at + 1).when(down, at - 1).otherwise(at) + 1


def threshold_table(
    scored: DataFrame, by: Sequence[str] = (), prob: str = "prob", target: str = "target"
) -> DataFrame:
    """F1 at every threshold: one count per reached threshold, then sums over 92 cells."""
    by = list(by)
    cells = judged(scored, prob, target).groupBy(*by, thresholds_reached(F.col(prob)).alias("__b")).agg(
        F.count_if(F.col(target) == 1).alias("__pos"), F.count_if(F.col(target) == 0).alias("__neg")
    )
    zero = F.expr("struct(0L AS __pos, 0L AS __neg)")
    filled = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("__b", F.struct("__pos", "__neg")))).alias("__cells")
    ).select(
        *by,
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.lit(THRESHOLDS)), lambda i: F.coalesce(F.try_element_at("__cells", i), zero)
        )).alias("__b", "__cell"),
    )
    above = Window.partitionBy(*by).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*by)
    tp, predicted = F.col("__tp"), F.col("__tp") + F.col("__fp")
    return (
        filled.select(
            *by, "__b",
            F.sum("__cell.__pos").over(above).alias("__tp"),
            F.sum("__cell.__neg").over(above).alias("__fp"),
            F.sum("__cell.__pos").over(everything).alias("__positives"),
        )
        .where("__b > 0")
        .select(
            *by,
            threshold_at(F.col("__b") - 1).alias("threshold"),
            safe_ratio(2 * tp, predicted + F.col("__positives")).alias("f1"),
        )
    )


def threshold_sweep(
    scored: DataFrame, by: Sequence[str] = (), prob: str = "prob", target: str = "target"
) -> DataFrame:
    """The lowest threshold with the highest F1; 0.5 when every F1 is 0."""
    table = threshold_table(scored, by, prob, target)
    best = F.max_by(F.col("threshold"), F.struct(F.col("f1"), -F.col("threshold")))
    return table.groupBy(*by).agg(
        F.when(F.max("f1") > 0, best).otherwise(F.lit(FALLBACK_THRESHOLD)).alias("best_threshold"),
        F.max("f1").alias("best_f1"),
    )


def classification_metrics(
    scored: DataFrame, threshold: Column | str | float, by: Sequence[str] = (),
    prob: str = "prob", target: str = "target",
) -> DataFrame:
    """accuracy, precision, recall, f1 of `prob >= threshold`; undefined is 0."""
    cut = F.lit(threshold) if isinstance(threshold, (int, float)) else as_column(threshold)
    said, is_pos = F.col(prob) >= cut, F.col(target) == 1
    counts = judged(scored, prob, target).groupBy(*by).agg(
        F.count_if(said & is_pos).alias("tp"),
        F.count_if(said & ~is_pos).alias("fp"),
        F.count_if(~said & is_pos).alias("fn"),
        F.count_if(~said & ~is_pos).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


LEVELS = ["__power", "__high", "__low"]


def score_levels(s: Column) -> list[Column]:
    """Three ever finer buckets of a double, each rising with it inside the one before.

    The signed power of two, the mantissa's first 18 bits and its next 18. At most about 2**18
    values share a bucket one level up, and as many doubles share the last.
    """
    size = F.abs(s)
    # subnormal numbers are scaled first, as 2**-power would be infinite
    shift = F.when(size < 2.0**-900, F.lit(600)).otherwise(F.lit(0))
    scaled = s * F.pow(F.lit(2.0), shift.cast("double"))
    power = F.floor(F.log2(F.abs(scaled))).cast("int")
    rank = power - shift + 2000
    odd = F.isnan(s) | (size == float("inf")) | (s == 0)
    sign = F.when(F.isnan(s), 9999).when(s == float("inf"), 9998).when(s == float("-inf"), -9998).when(s == 0, 0)
    mantissa = F.when(odd, F.lit(0.0)).otherwise(scaled * F.pow(F.lit(2.0), -power.cast("double")))
    digits = [F.floor(mantissa * 2.0 ** (DIGIT * k)).cast("long") for k in (1, 2)]
    return [F.when(odd, sign).otherwise(F.when(s > 0, rank).otherwise(-rank)).cast("int"), *digits]


def roc_auc(
    scored: DataFrame, by: Sequence[str] = (), prob: str = "prob", target: str = "target"
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    AUC is the share of (positive, negative) pairs in the right order. Rows
    collapse to counts per distinct score. A pair is then settled at the first
    level where its scores differ: powers of two, two digits of the mantissa, or
    the scores themselves (`score_levels`). Each level is a running sum over groups
    of at most some 2**18 rows, however many scores lie close together, and the four
    partial pair counts simply add up. Scores may lie outside [0, 1], margins for
    instance; infinities are ordinary scores, and NaN is the highest.
    """
    by = list(by)
    scores = (
        judged(scored, prob, target).groupBy(*by, F.col(prob).cast("double").alias("__s"))
        .agg(F.count_if(F.col(target) == 1).alias("__pos"), F.count_if(F.col(target) == 0).alias("__neg"))
    )
    scores = scores.select("*", *[c.alias(n) for n, c in zip(LEVELS, score_levels(F.col("__s")), strict=True)])
    sums = [F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg")]
    levels = [scores]
    for k in range(len(LEVELS), 0, -1):
        levels.append(levels[-1].groupBy(*by, *LEVELS[:k]).agg(*sums))

    def pairs(level: DataFrame, group: list[str], order: str, ties: bool) -> DataFrame:
        before = Window.partitionBy(*by, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("__neg").over(before), F.lit(0)) * 2
        won = below + F.col("__neg") if ties else below
        # decimal keeps the pair count exact beyond 2**63
        product = F.col("__pos").cast("decimal(18,0)") * F.col("__won").cast("decimal(19,0)")
        totals = [(F.sum(c) if ties else F.lit(0).cast("long")).alias(c) for c in ("__pos", "__neg")]
        return level.withColumn("__won", won).groupBy(*by).agg(F.sum(product).alias("__won"), *totals)

    parts = pairs(scores, LEVELS, "__s", ties=True)
    for k, level in zip(range(len(LEVELS) - 1, -1, -1), levels[1:], strict=True):
        parts = parts.unionByName(pairs(level, LEVELS[:k], LEVELS[k], ties=False))
    both = F.sum("__pos").cast("double") * F.sum("__neg").cast("double") * 2
    return parts.groupBy(*by).agg(F.try_divide(F.sum("__won").cast("double"), both).alias("roc_auc"))


def with_gini(df: DataFrame, auc: str = "roc_auc") -> DataFrame:
    return df.withColumn("gini", F.col(auc) * 2 - 1)


def compare(
    scored: DataFrame, by: Sequence[str], threshold: Column | str | float = FALLBACK_THRESHOLD,
    prob: str = "prob", target: str = "target",
) -> DataFrame:
    """All metrics per model (or per any grouping)."""
    metrics = classification_metrics(scored, threshold, by, prob, target).drop("tp", "fp", "fn", "tn")
    names = [c for c in metrics.columns if c not in by]
    # one row per group from either side; grouping keeps a NULL group, a join would not
    both = metrics.unionByName(roc_auc(scored, by, prob, target), allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(c).alias(c) for c in (*names, "roc_auc")])


def total_exposure(df: DataFrame, amount: str = "importe_solicitado") -> DataFrame:
    return df.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_risk"))


def avoided_loss(df: DataFrame, recall: Column, amount: str = "importe_solicitado") -> DataFrame:
    """Exposure and the part a champion with this recall would have caught."""
    return total_exposure(df, amount).withColumn("avoided_loss", F.col("total_risk") * recall)


def expected_loss(
    df: DataFrame, balance: str = "importe_solicitado", pd: str = "prob", ead: float = EAD_SHARE, lgd: float = LGD
) -> DataFrame:
    """EL = EAD x PD x LGD per loan."""
    exposure = F.coalesce(F.col(balance), F.lit(0.0)) * F.lit(ead)
    return df.withColumns({"ead": exposure, "expected_loss": exposure * F.col(pd) * F.lit(lgd)})


def portfolio_loss(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return losses.groupBy(*by).agg(
        F.count(F.lit(1)).alias("loans"),
        F.sum("ead").alias("ead"),
        F.sum("expected_loss").alias("expected_loss"),
    )


def score(scored: DataFrame, threshold: float | Column, prob: str = "prob") -> DataFrame:
    """Decision column: 1 where the probability reaches the threshold."""
    cut = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return scored.withColumn("decision", (F.col(prob) >= cut).cast("int"))
