"""Cuts of a hash order inside every class of a column, for any number of classes.

One walk finds all cuts of all classes: rows are counted by class and bucket, a
running sum inside each class finds the bucket a cut falls in, and rows of these
buckets alone are counted in finer buckets, until the buckets reached are small
enough to be counted by the order value itself. Counts, cuts and quotas stay
DataFrames joined by class. The driver sees results of at most 20,000 rows,
and the cuts of the 64 largest classes, which become a predicate; rows of any further class, each
smaller than these, are joined by class and first digit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.selection import SMALL, first_k, hash_levels
from creditspark.sources.scratch import scratch_path

INLINE = 64           # classes whose cuts are part of a predicate; each further one is smaller than all of them
LOCAL = 20_000        # rows of an intermediate result that travel by the driver
WHOLE = "decimal(19,0)"    # the product of two counts goes beyond a long
BEFORE, BEYOND = "", "~"    # below and above every hexadecimal text
PLACE, TEXT = "__place", "__t"


def even_parts(parts: int) -> Callable[[DataFrame], DataFrame]:
    """Quotas (class, rows, cut, k) that divide every class into equal parts."""
    def quotas(sizes: DataFrame) -> DataFrame:
        cuts = F.array(*[F.struct(F.lit(i).alias("cut"), F.expr(f"rows * {i}L div {parts}").alias("k")) for i in range(1, parts)])
        return sizes.select("__c", "rows", F.inline(cuts))

    return quotas


def largest_remainder(counts: Sequence[int], names: Sequence[tuple], total: int) -> list[int]:
    """Share `total` among counts in proportion, whole rows only; what is left goes to the largest remainders."""
    n = max(1, sum(counts))
    shares = [total * c // n for c in counts]
    by_rest = sorted(range(len(counts)), key=lambda i: (-(total * counts[i] % n), names[i]))
    for i in by_rest[:total - sum(shares)]:
        shares[i] += 1
    return shares


def largest_remainders(share: Callable[[int], int], small: int = SMALL, inline: int = INLINE) -> Callable[[DataFrame], DataFrame]:
    """Quotas that share `share(rows)` rows among the classes in proportion, whole rows only.

    What rounding down leaves goes to the largest remainders, on ties to the
    class whose text is smallest. For up to `inline` classes the driver reckons; beyond, `first_k`
    finds that cut of the classes. Both give the same quotas.
    """
    def quotas(sizes: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("__c").cast("string"), F.lit("None"))
        few = sizes.select("__c", "rows", text.alias("__name"), F.col("__c").isNull().alias("__unknown")).limit(inline + 1).toArrow()
        if few.num_rows <= inline:
            counts, names = few["rows"].to_pylist(), list(zip(few["__name"].to_pylist(), few["__unknown"].to_pylist()))
            shares = pa.array(largest_remainder(counts, names, share(sum(counts))), pa.int64())
            out = few.drop(["__name", "__unknown"]).append_column("cut", pa.array([1] * len(counts), pa.int32())).append_column("k", shares)
            schema = T.StructType([*sizes.select("__c", "rows").schema.fields, T.StructField("cut", T.IntegerType()), T.StructField("k", T.LongType())])
            return sizes.sparkSession.createDataFrame(out, schema)
        total = sizes.agg(F.sum("rows")).first()[0] or 0
        if total == 0:
            return sizes.select("__c", "rows", F.lit(1).alias("cut"), F.col("rows").alias("k"))
        wanted = share(total)
        whole = f"CAST({total} AS {WHOLE})"
        shares = sizes.withColumn("__product", F.expr(f"CAST(rows AS {WHOLE}) * CAST({wanted} AS {WHOLE})")).withColumn("k", F.expr(f"__product div {whole}"))
        ranked = shares.select(
            "__c", "rows", "k", F.expr(f"CAST(CAST(k AS {WHOLE}) * {whole} - __product AS LONG)").alias("__rest"),
            text.alias("__name"), F.col("__c").isNull().alias("__unknown"),
        )
        left = wanted - (ranked.agg(F.sum("k")).first()[0] or 0)
        rest, name = F.col("__rest"), F.col("__name")
        levels = [F.shiftright(rest, bits) for bits in (52, 40, 28, 16, 4)] + [rest, *[F.substring(name, 1, i) for i in range(1, 33)], name]
        k, rows, last = first_k(ranked, ["__rest", "__name", "__unknown"], levels, lambda _: left, small)
        if last is None:
            one_more = F.lit(k >= rows > 0)
        else:
            one_more = F.struct("__rest", "__name", "__unknown") <= F.struct(F.lit(last[0]).cast("long"), F.lit(last[1]), F.lit(last[2]))
        return ranked.select("__c", "rows", F.lit(1).alias("cut"), (F.col("k") + one_more.cast("long")).alias("k"))

    return quotas


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _settled(frame: DataFrame) -> DataFrame:
    """The rows themselves where they are few, else a table written with them: no plan grows from step to step."""
    spark = frame.sparkSession
    rows = frame.limit(LOCAL + 1).toArrow()
    if rows.num_rows <= LOCAL:
        return spark.createDataFrame(rows, frame.schema)
    path = scratch_path(spark, "cuts")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _enter(histogram: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each open cut moves to the bucket it falls in. Both sides know the bucket before as `__p`."""
    before = Window.partitionBy("__c", "__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    upto = histogram.withColumn("__upto", F.sum("n").over(before)).withColumnsRenamed({"__c": "__hc", "__p": "__hp"})
    falls = (F.col("__upto") >= F.col("need")) & (F.col("__upto") - F.col("n") < F.col("need"))
    return upto.join(cuts, _same("__hc", "__c") & (F.col("__hp") == F.col("__p")) & falls).select(
        "__c", "rows", "cut", (F.col("need") - F.col("__upto") + F.col("n")).alias("need"), F.col("__b").alias("__p"), F.col("n").alias("size"),
    )


def class_cuts(
    df: DataFrame, by: str, text: Column, quotas: Callable[[DataFrame], DataFrame], small: int = SMALL
) -> DataFrame:
    """(class, rows, texts): the k-th text of a class in order, for every cut asked for.

    `text` begins with hexadecimal digits that spread evenly. A cut before the first or from the
    last row on is a text below or above all others. NULL is a class. An empty frame has no cuts.
    """
    base = df.select(F.col(by).alias("__c"), text.alias(TEXT))
    levels = hash_levels(TEXT)

    def counted(cuts: DataFrame, parent: Column, bucket: Column) -> DataFrame:
        """Rows of the buckets reached, by finer bucket. Copies of a text collapse in the tasks that read them."""
        reached = cuts.select(F.col("__c").alias("__hc"), F.col("__p").alias("__hp")).distinct()
        rows = base.withColumn("__p", parent)
        inside = rows.join(reached, _same("__c", "__hc") & (F.col("__p") == F.col("__hp")), "leftsemi")
        return inside.groupBy("__c", "__p", bucket.alias("__b")).agg(F.count(F.lit(1)).alias("n"))

    first = base.groupBy("__c", F.lit(BEFORE).alias("__p"), levels[0].alias("__b")).agg(F.count(F.lit(1)).alias("n"))
    first.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        asked = quotas(_settled(first.groupBy("__c").agg(F.sum("n").alias("rows"))))
        whole = (F.col("k") <= 0) | (F.col("k") >= F.col("rows"))
        trivial = asked.where(whole).select("__c", "rows", "cut", F.when(F.col("k") <= 0, BEFORE).otherwise(BEYOND).alias(TEXT))
        start = asked.where(~whole).select("__c", "rows", "cut", F.col("k").alias("need"), F.lit(BEFORE).alias("__p"))
        cuts, used = _settled(_enter(first, start)), 1
    finally:
        first.unpersist()
    while used < len(levels) and not cuts.where(F.col("size") > small).isEmpty():
        cuts = _settled(_enter(counted(cuts, levels[used - 1], levels[used]), cuts))
        used += 1
    last = _enter(counted(cuts, levels[used - 1], F.col(TEXT)), cuts)
    found = trivial.unionByName(last.select("__c", "rows", "cut", F.col("__p").alias(TEXT)))
    return _settled(found.groupBy("__c").agg(F.first("rows").alias("rows"), F.sort_array(F.collect_list(TEXT)).alias("__cuts")))


def with_place(df: DataFrame, by: str, text: Column, cuts: DataFrame, inline: int = INLINE) -> DataFrame:
    """Adds `__place`: how many of the cuts of its class a row lies behind, 0 before the first.

    Rows of the `inline` largest classes pass a predicate on their own columns, without join, window or
    shuffle. Where there are more classes, rows of the others are joined with their cuts.
    """
    largest = cuts.limit(inline + 1).collect()
    more = len(largest) > inline
    if more:
        largest = cuts.orderBy(F.desc("rows"), F.asc_nulls_last("__c")).limit(inline).collect()

    def behind(texts: Sequence[str]) -> Column:
        # no test is needed where nothing or everything lies behind
        tests = [F.when(text > F.lit(v), 1).otherwise(0) for v in texts if v not in (BEFORE, BEYOND)]
        return sum(tests, F.lit(sum(v == BEFORE for v in texts)))

    place = F.when(F.lit(False), 0)
    for r in largest:
        same = F.col(by).isNull() if r["__c"] is None else F.col(by) == F.lit(r["__c"])
        place = place.when(same, behind(r["__cuts"]))
    place = place.otherwise(0)
    if not more:
        return df.withColumn(PLACE, place)
    values = [r["__c"] for r in largest if r["__c"] is not None]
    known = F.coalesce(F.col(by).isin(values), F.lit(len(values) < len(largest)))
    hot = df.where(known).withColumn(PLACE, place)
    # the first digit of the text salts the join, so that no class lands in one task
    own = cuts.select(F.col("__c").alias("__hc"), "__cuts", F.explode(F.array(*[F.lit(d) for d in "0123456789abcdef"])).alias("__digit"))
    joined = _same(by, "__hc") & (F.substring(TEXT, 1, 1) == F.col("__digit"))
    rest = df.where(~known).withColumn(TEXT, text).join(own, joined, "left")
    behind_own = F.greatest(F.lit(0), F.size(F.filter("__cuts", lambda v: F.col(TEXT) > v)))
    return hot.unionByName(rest.select(*df.columns, behind_own.alias(PLACE)))


def train_share(test_fraction: float) -> Callable[[int], int]:
    """Rows left for training when ceil(fraction * rows) are held out."""
    return lambda total: total - math.ceil(total * test_fraction)
