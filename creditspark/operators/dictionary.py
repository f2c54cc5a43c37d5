"""Category codes for columns of any number of values.

The dictionary is a table (variable, value, n, code): nothing in it reaches the driver but one row per column.
Codes follow the order of the values and are numbered from range partitions: each task numbers its own sorted
values, and small totals say where a partition begins. Rows take their codes by joins; frequent values, of which there
are few, are broadcast, so that no hot value gathers its rows in one task. One-hot rows are sparse
slots, and become Spark ML vectors without Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.sources.scratch import scratch_path

PART = 500_000      # values that one task numbers
SMALL = 10_000      # values of a column whose dictionary is broadcast whole
SHARE = 1_000       # a value in more than one of so many rows is frequent: there are fewer than this
BUCKETS = 1 << 20   # spread of the rows that need no join
CODE = "idx_"


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def category_dictionary(df: DataFrame, cols: Sequence[str], part: int = PART) -> DataFrame:
    """(variable, value, n, code) of every value of `cols`, as text, seen in `df`.

    Codes run from 0 in the order of the values, in each column anew. NULL is no value. An empty
    frame has an empty dictionary. Values are counted in the tasks that read them and meet once.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    counts = _written(
        df.select(F.inline(pairs)).where("value is not null").groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")), "values"
    )
    parts = max(1, -(-counts.count() // part))
    ordered = counts.repartitionByRange(parts, "variable", "value").sortWithinPartitions("variable", "value")
    # the identifier's lower bits are the row's place in its partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = _written(ordered.select("*", F.spark_partition_id().alias("part"), place.alias("at")), "numbered")
    before = Window.partitionBy("variable").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("variable", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")).select(
        "variable", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return _written(
        numbered.join(starts, ["variable", "part"]).select("variable", "value", "n", (F.col("at") + F.col("shift")).alias("code")), "dictionary"
    )


def sizes(dictionary: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Values of each column; 0 for a column without any."""
    found = {r["variable"]: r["size"] for r in dictionary.groupBy("variable").agg(F.count(F.lit(1)).alias("size")).collect()}
    return {c: found.get(c, 0) for c in cols}


def encode(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], prefix: str = CODE, small: int = SMALL) -> DataFrame:
    """`df` with idx_<c>: the code of its value; NULL where it is NULL or not in the dictionary.

    A column of few values is looked up in a broadcast of at most `small` rows. Of a larger one only the frequent
    values are, and the other rows meet the dictionary by value; rows that are settled already
    spread over all tasks instead of meeting under NULL. Columns of `df` keep their names and order.
    """
    known = sizes(dictionary, cols)
    out = df
    for i, c in enumerate(cols):
        own = dictionary.where(F.col("variable") == c).select(F.col("value").alias("__v"), F.col("code").alias("__code"), "n")
        value = F.col(f"`{c}`").cast("string")
        if known[c] <= small:
            out = out.join(F.broadcast(own.drop("n")), value == F.col("__v"), "left").withColumnRenamed("__code", prefix + c).drop("__v")
            continue
        rows = own.agg(F.sum("n")).first()[0]
        hot = own.where(F.col("n") * SHARE > rows).select(F.col("__v").alias("__hot"), F.col("__code").alias("__hot_code"))
        cold = own.where(F.col("n") * SHARE <= rows).select("__v", "__code", F.pmod(F.xxhash64("__v"), F.lit(BUCKETS)).alias("__vb"))
        out = out.join(F.broadcast(hot), value == F.col("__hot"), "left")
        open_ = value.isNotNull() & F.col("__hot_code").isNull()
        spread = -1 - F.pmod(F.xxhash64(F.spark_partition_id(), F.lit(i)), F.lit(BUCKETS))
        out = out.withColumns({"__key": F.when(open_, value), "__kb": F.when(open_, F.pmod(F.xxhash64(value), F.lit(BUCKETS))).otherwise(spread)})
        out = out.join(cold, (F.col("__kb") == F.col("__vb")) & (F.col("__key") == F.col("__v")), "left")
        out = out.withColumn(prefix + c, F.coalesce("__hot_code", "__code")).drop("__hot", "__hot_code", "__key", "__kb", "__v", "__vb", "__code")
    return out


def slots(known: Mapping[str, int], prefix: str = CODE) -> Column:
    """The one-hot slots of an encoded row that hold 1, ascending: columns follow one another in the order of `known`.

    An unknown or missing value has none, so it is all zeros.
    """
    begins, at = {}, 0
    for c, n in known.items():
        begins[c], at = at, at + n
    places = [F.col(f"`{prefix}{c}`").cast("int") + F.lit(b) for c, b in begins.items()]
    return F.array_compact(F.array(*places)) if places else F.array().cast("array<int>")


def as_vectors(df: DataFrame, known: Mapping[str, int], out: str = "features", prefix: str = CODE) -> DataFrame:
    """An encoded frame, written once, with a sparse vector of all one-hot slots.

    The vector's own storage form is written and read back under its type, so no row passes through
    Python and no slot needs a name on the driver.
    """
    at = slots(known, prefix)
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(sum(known.values())).alias("size"),
        at.alias("indices"), F.transform(at, lambda _: F.lit(1.0)).alias("values"),
    )
    path = scratch_path(df.sparkSession, "vectors")
    rest = df.drop(out)
    rest.withColumn(out, vector).write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([*rest.schema.fields, T.StructField(out, VectorUDT())])).parquet(path)
