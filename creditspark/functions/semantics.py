"""Numeric and null rules that differ between Spark and IEEE/NaN-based tools.

Decided once here, used by every operator:

* a missing number is NULL; NaN becomes NULL when data enters;
* division follows IEEE (x/0 is infinite, 0/0 undefined, hence NULL);
* text becomes a number only when the whole text is a number;
* rounding is half-up on the decimal representation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java parses "12.5d" and "0x1p3" as doubles; this pattern keeps those out.
NUMBER_PATTERN = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?))$"


def sql_double(x: float) -> str:
    """A double literal in SQL text.

    Long literal lists are written as SQL text: one parse instead of a call to
    the JVM per literal.
    """
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NULL instead of NaN; infinities stay."""
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def frame_nan_to_null(df: DataFrame) -> DataFrame:
    """Apply `nan_to_null` to every float column of a frame."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[nan_to_null(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def or_default(c: Column | str, value) -> Column:
    return F.coalesce(as_column(c), F.lit(value))


def ieee_div(a: Column, b: Column) -> Column:
    """a/b where b = 0 gives a signed infinity, and 0/0 gives NULL (NaN is missing)."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a != 0, F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def log1p_np(c: Column | str) -> Column:
    """log(1+x): -inf at -1, NULL below, missing x counts as 0."""
    x = or_default(c, 0.0).cast("double")
    return F.when(x == -1, F.lit(float("-inf"))).otherwise(F.log1p(x))


def text_to_number(c: Column | str) -> Column:
    """Double when the trimmed text is a plain number or an infinity, else NULL."""
    t = F.trim(as_column(c))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def clean_percent(c: Column | str) -> Column:
    """'12.5%' to 12.5; anything that is not a number to NULL."""
    return text_to_number(F.replace(as_column(c).cast("string"), F.lit("%"), F.lit("")))


def round_k(c: Column | str, k: int) -> Column:
    return F.round(as_column(c), k)


def percent_of(part: Column, whole: Column) -> Column:
    """100*part/whole rounded to 2 digits; 0 when the whole is 0."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2), F.lit(0.0))


def safe_ratio(a: Column, b: Column) -> Column:
    """a/b as double, 0 when undefined (the convention for precision, recall and F1)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def evaluate_once(df: DataFrame, exprs) -> DataFrame:
    """Select that the optimizer does not merge into what follows.

    Filters move below a projection and copy its expressions; over many derived
    columns the copies outgrow generated code. They cannot move below a generator.
    """
    return df.select(F.inline(F.array(F.struct(*exprs))))
