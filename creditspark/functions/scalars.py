"""Scalar rules of the credit domain, as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.functions.semantics import as_column, ieee_div, or_default, sql_double, sql_text

# --- fixed values -----------------------------------------------------------
SENIORITY = {
    "< 1 year": 0.5, "1 year": 1.0, "2 years": 2.0, "3 years": 3.0, "4 years": 4.0, "5 years": 5.0,
    "6 years": 6.0, "7 years": 7.0, "8 years": 8.0, "9 years": 9.0, "10+ years": 10.0,
}
GRADE = {"A": 1.0, "B": 2.0, "C": 3.0, "D": 4.0, "E": 5.0, "F": 6.0, "G": 7.0}
DEFAULT_TERM_MONTHS = 36.0
DEFAULT_RATE = 12.0
RISK_UP, RISK_DOWN = "Incrementa riesgo", "Reduce riesgo"
# -----------------------------------------------------------------------------


def term_months(c: Column | str) -> Column:
    """First run of digits as a double; 36 when there is none."""
    digits = F.regexp_substr(as_column(c).cast("string"), F.lit("[0-9]+"))
    return F.coalesce(digits.cast("double"), F.lit(DEFAULT_TERM_MONTHS))


def map_ordinal(c: Column | str, mapping: Mapping[str, float], default: float) -> Column:
    """Label to number through a literal map; unknown and NULL give `default`."""
    pairs = ", ".join(f"{sql_text(k)}, {sql_double(v)}" for k, v in mapping.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), as_column(c)), F.lit(float(default)))


def est_installment(amount: Column, rate: Column, term: Column) -> Column:
    return ieee_div(amount * (F.lit(1.0) + rate / F.lit(100.0)), term)


def burden_ratio(installment: Column, income: Column) -> Column:
    """Yearly installments over income + 1, with `income` already defaulted."""
    return ieee_div(installment * F.lit(12.0), income + F.lit(1.0))


def residual_income(installment: Column, income: Column) -> Column:
    return income - installment * F.lit(12.0)


def overdebt_alert(revolving: Column, inquiries: Column) -> Column:
    return revolving / F.lit(100.0) * inquiries


def parse_issue_date(c: Column | str) -> Column:
    """Text to timestamp; unreadable text gives NULL (count them, see `unparsed`)."""
    return F.try_to_timestamp(as_column(c).cast("string"))


def unparsed(raw: Column | str) -> Column:
    """Number of non-null texts that `parse_issue_date` cannot read."""
    raw = as_column(raw)
    return F.count_if(raw.isNotNull() & parse_issue_date(raw).isNull())


def label_nan(c: Column | str) -> Column:
    """Display label: NULL reads 'nan'."""
    return or_default(as_column(c).cast("string"), "nan")


def to_percent(c: Column | str) -> Column:
    """A fraction (<= 1) becomes a percentage; a percentage stays."""
    c = as_column(c)
    return F.when(c <= 1.0, c * 100).otherwise(c)


def to_fraction(c: Column | str) -> Column:
    """A percentage (> 1) becomes a fraction; a fraction stays."""
    c = as_column(c)
    return F.when(c > 1.0, c / 100.0).otherwise(c)


def label_time(c: Column | str) -> Column:
    return F.date_format(as_column(c), "dd/MM HH:mm")


def model_family(c: Column | str) -> Column:
    """Booster family from a run name."""
    name = F.lower(as_column(c))
    return (
        F.when(name.contains("catboost"), "CatBoost")
        .when(name.contains("xgboost"), "XGBoost")
        .otherwise("LightGBM")
    )


def effect_label(c: Column | str) -> Column:
    return F.when(as_column(c) > 0, RISK_UP).otherwise(RISK_DOWN)


def find_metric_col(df: DataFrame, patterns: Sequence[str]) -> str:
    """First column whose lower-cased name contains one of the patterns."""
    for name in df.columns:
        if any(p in name.lower() for p in patterns):
            return name
    raise KeyError(f"no column matches any of {list(patterns)}; have {df.columns}")


# --- fixed values: what to look for per metric ------------------------------
METRIC_PATTERNS = {
    "f1": ("f1",),
    "roc_auc": ("roc", "auc"),
    "accuracy": ("accuracy",),
    "recall": ("recall",),
    "precision": ("precision",),
}
# -----------------------------------------------------------------------------


def standard_metrics(df: DataFrame, keep: Sequence[str] = ("run_name",)) -> DataFrame:
    """Rename a tracker's metric columns to the five standard names."""
    found = {m: find_metric_col(df, p) for m, p in METRIC_PATTERNS.items()}
    return df.select(*keep, *[F.col(c).cast("double").alias(m) for m, c in found.items()])
