"""Exact duplicates by a content sort, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm.text import materialise

#: Leading characters that order the texts; their hash orders texts that begin alike.
LEADING = 32
#: A text is hot, and dealt to several runs, if it has more rows than RUN and than the share 1/HOT of the table. So at most
#: HOT texts are hot, they make at most 2 * HOT runs, and tables of these may be broadcast.
RUN, HOT = 1_000, 10_000
#: What names a run of equal neighbours.
OF_RUN = ["__lead", "__hash", "__salt", "__turn"]


def as_is(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def numbered(df: DataFrame, place: Sequence[str], text: str, then: Sequence[Column], name: str) -> DataFrame:
    """Rows that share a place are sorted by their whole text; each is compared in full with the one before, and runs of equals are numbered."""
    beside = Window.partitionBy(*place).orderBy(text, *then)
    begins = F.coalesce(F.lag(text).over(beside) != F.col(text), F.lit(True))
    return df.withColumn("__begins", begins).withColumn(
        name, F.sum(F.col("__begins").cast("int")).over(beside.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__begins")


def content_sort(
    docs: DataFrame, key: str, text: str, normalise: Callable[[Column], Column], keep: str, run: int, digest: Callable[[str], Column],
) -> DataFrame:
    """`docs` with __id, __text, the run of equal texts that a row is in, whether it is the run's last, and whether its text is hot."""
    n = docs.count()
    most = max(run, -(-n // HOT))
    placed = docs.select("*", normalise(F.col(f"`{text}`")).alias("__text"), F.col(f"`{key}`").alias("__id"))
    placed = placed.select("*", F.substring("__text", 1, LEADING).alias("__lead"), digest("__text").alias("__hash"))
    hot = placed.groupBy("__hash").agg(F.count("*").alias("__rows")).where(F.col("__rows") > most)
    # at most HOT rows
    placed = placed.join(F.broadcast(hot), "__hash", "left").select(
        *placed.columns, F.col("__rows").isNotNull().alias("__hot"),
        F.coalesce(F.pmod(F.xxhash64("__id"), F.ceil(F.col("__rows") / most)), F.lit(0)).cast("int").alias("__salt"),
    ).repartitionByRange("__lead", "__hash", "__salt")
    best_last = F.col("__id").asc_nulls_first() if keep == "largest" else F.col("__id").desc_nulls_first()
    place = ["__lead", "__hash", "__salt"]
    runs = numbered(placed, place, "__text", [best_last], "__turn")
    beside = Window.partitionBy(*place).orderBy("__text", best_last)
    return runs.withColumn("__ends", F.coalesce(F.lead("__turn").over(beside) != F.col("__turn"), F.lit(True)))


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] = as_is,
    keep: str = "smallest", run: int = RUN, columns: Sequence[str] | None = None, digest: Callable[[str], Column] = F.xxhash64,
) -> DataFrame:
    """Every row (all its columns, or those named) with `keep_id`, `group_size`, `kept` and `text_sha256`, copies of a text forming a group.

    Rows are range-partitioned by splitters that Spark samples from (first characters,
    hash) and sorted externally by these and the whole normalised text, which
    places equal texts side by side. Each row is compared in full with its neighbour, and a run of
    equals is a group. Only a text with more rows than `run` (and than a ten-thousandth of the table) is
    dealt to several runs, by the hash of the key; one row of each of these runs carries the text on,
    and these few are sorted and compared in full again. Hashes only place texts; they decide nothing.

    `keep` says whether the "smallest" or the "largest" identifier stays. Null texts
    count as empty; a null identifier stays only if the group has no other. Of rows
    that share text and identifier one stays. An empty table gives an empty one;
    columns of the input named like a result are replaced, and those that begin with two underscores are free to use.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    made = ("keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in columns or docs.columns if c not in made]
    # own columns travel as one, so that their names meet none of those made here
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__own"), F.col(f"`{text}`").alias("__raw"), F.col(f"`{key}`").alias("__key"))
    sorted_ = content_sort(packed, "__key", "__raw", normalise, keep, run, digest)
    rows = materialise(sorted_.select(
        "__own", "__id", *OF_RUN, "__ends", "__hot", F.sha2("__text", 256).alias("text_sha256"),
        F.when(F.col("__hot") & F.col("__ends"), F.col("__text")).alias("__rep"),
    ), "content-sort")
    runs = rows.groupBy(*OF_RUN).agg(F.count("*").alias("__n"), F.max_by("__id", "__ends").alias("__best"), F.any_value("__hot").alias("__hot"))
    met = numbered(rows.where("__rep IS NOT NULL").select(*OF_RUN, "__rep"), ["__lead", "__hash"], "__rep", [], "__class").select(*OF_RUN, "__class")
    hot = runs.where("__hot").join(met, OF_RUN)
    same = Window.partitionBy("__lead", "__hash", "__class")
    best_first = F.col("__best").desc_nulls_last() if keep == "largest" else F.col("__best").asc_nulls_last()
    ranked = same.orderBy(best_first, "__salt", "__turn")
    # at most 2 * HOT rows
    settled = F.broadcast(hot.select(
        *OF_RUN, F.first("__best").over(ranked).alias("__first"), F.sum("__n").over(same).alias("__size"), (F.row_number().over(ranked) == 1).alias("__wins"),
    ))
    groups = runs.drop("__hot").join(settled, OF_RUN, "left").select(
        *OF_RUN, F.when(F.col("__size").isNull(), F.col("__best")).otherwise(F.col("__first")).alias("keep_id"),
        F.coalesce("__size", "__n").alias("group_size"), F.coalesce("__wins", F.lit(True)).alias("__wins"),
    )
    return rows.join(groups, OF_RUN).select(
        *[F.col("__own").getField(c).alias(c) for c in names], "keep_id", "group_size", (F.col("__ends") & F.col("__wins")).alias("kept"), "text_sha256",
    )
