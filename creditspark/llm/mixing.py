"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm.text import materialise, n_words

#: Units that are paired one after another in one row of the tree; so many residuals of a level meet in the next.
CHUNK = 64
UNIT = "struct<id:string,size:double,p:double>"
#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """Rows (source, source_size) with `target`: `share` times all sizes, dealt by weight.

    Weights go to the sources by code point, null last, and repeat. No target
    exceeds `most` times its source's size; what is above is dealt again by weight,
    which settles at one level: a source gets its weight times the level, or its
    maximum if that is less. The table has one row for each source. Sources of size
    zero have target zero.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy("__need", "__place")
    at = F.pmod(F.col("__place") - 1, F.lit(len(weights)))
    ranked = sizes.select("source", "source_size", F.row_number().over(in_order).alias("__place"))
    weighed = ranked.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    weighed = weighed.withColumn("__most", F.lit(float(most)) * F.col("source_size"))
    weighed = weighed.withColumn("__need", F.col("__most") / F.col("__weight"))
    below = by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = by_need.rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = weighed.withColumn("__all", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn(
        "__held", F.sum("__most").over(below) + F.col("__need") * F.coalesce(F.sum("__weight").over(above), F.lit(0.0)),
    )
    # sources that fill up before the level is reached; the others share the rest
    full = filled.withColumn("__full", F.col("__held") <= F.col("__all"))
    rest = F.col("__all") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__most"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("__full"), F.col("__weight"))).over(everything)
    level = F.when(F.col("__full"), F.col("__most")).otherwise(F.col("__weight") * rest / open_weight)
    return full.select("source", "source_size", F.least(F.col("__most"), level).alias("target"))


def coin(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def pair_up(units: Column, seed: int) -> Column:
    """Pair units in order: the residual of the pairs so far meets the next unit.

    Mass moves between the two, one way or the other, until one copy probability is
    0 or 1; the sum of size times probability stays, and the chance of the way
    makes every probability right on average. Gives the residual and what was decided.
    """
    start = F.struct(
        units[0].alias("left"), F.array().cast("array<struct<id:string,up:boolean>>").alias("done"),
    )

    def meet(state: Column, unit: Column) -> Column:
        p, q, u, v = state["left"]["p"], unit["p"], state["left"]["size"], unit["size"]
        up, down = F.least(1 - p, q * v / u), F.least(p, (1 - q) * v / u)
        rises = coin(F.lit(seed), state["left"]["id"], unit["id"]) * (up + down) < down
        # the first unit is decided if its own limit is the nearer one, else the second
        first_done = F.when(rises, 1 - p <= q * v / u).otherwise(p <= (1 - q) * v / u)
        first_p = F.when(rises, p + q * v / u).otherwise(p - (1 - q) * v / u)
        second_p = F.when(rises, q - (1 - p) * u / v).otherwise(q + p * u / v)
        keeps = lambda unit_, p_: F.struct(unit_["id"].alias("id"), unit_["size"].alias("size"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p_)).alias("p"))
        said = lambda unit_, up_: F.array(F.struct(unit_["id"].alias("id"), up_.alias("up")))
        return F.struct(
            F.when(first_done, keeps(unit, second_p)).otherwise(keeps(state["left"], first_p)).alias("left"),
            F.concat(state["done"], F.when(first_done, said(state["left"], rises)).otherwise(said(unit, ~rises))).alias("done"),
        )

    return F.aggregate(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0))), start, meet)


def rounded(units: DataFrame, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(source, id, up) for units (source, id, size, p) with 0 < p < 1 and size > 0.

    A reduction tree: units are dealt by hash into chunks of about `chunk`, each is
    paired up in one row, and the residual of every chunk goes on to the next level,
    until a source has one left, which a coin decides. A source of any size has
    as many chunks as it needs, so none fills a task.
    """
    spark = units.sparkSession
    level, decided = materialise(units.select("source", F.struct("id", "size", "p").alias("unit")), "units"), None
    for depth in range(64):
        counts = level.groupBy("source").count()
        most = counts.agg(F.max("count")).first()[0]
        if not most:
            break
        # the chunks of a source: a hash of the unit, spread over as many as its count needs
        sized = level.join(counts.select(F.col("source").alias("__s"), "count"), F.col("source").eqNullSafe(F.col("__s"))).select(
            "source", "unit", F.pmod(F.xxhash64(F.lit(seed + depth), "unit.id"), F.ceil(F.col("count") / chunk)).alias("chunk"),
        )
        paired = sized.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("unit")).alias("units")).select(
            "source", pair_up(F.col("units"), seed + depth).alias("state"),
        )
        paired = materialise(paired, "pairs")
        done = paired.select("source", F.inline("state.done"))
        decided = done if decided is None else decided.union(done)
        level = paired.select("source", F.col("state.left").alias("unit"))
        if most <= chunk:  # every source has one residual left
            last = level.select("source", F.col("unit.id").alias("id"), (coin(F.lit(seed), F.lit("last"), "unit.id") < F.col("unit.p")).alias("up"))
            return decided.union(last)
    return spark.createDataFrame([], "source string, id string, up boolean")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7,
    key: str = "doc_id", source: str = "source", text: str = "text", chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id under its own name, source, size, source_size, target, copies, taken) of every row.

    The size of a document is its number of words. A source's target over its size
    is the number of copies each of its documents should have: the whole part is
    given to all, the fraction is rounded to 0 or 1 by pivotal dependent rounding,
    which keeps the source's words at its target to within one document. `taken` is
    copies times size.

    Null and empty texts have size 0, take nothing and have the whole copies alone.
    A null source is a source of its own, the last. Rows that share identifier,
    source and size, null identifiers too, are one unit and get the same copies. The
    result depends on nothing but the rows, so reruns agree. An empty table gives an
    empty one; other columns are not carried.
    """
    sized = materialise(docs.select(
        F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").cast("string").alias("source"), n_words(F.col(f"`{text}`")).alias("size"),
    ), "sizes")
    unit = sized.groupBy("__key", "source", "size").agg(F.count("*").alias("__rows"))
    totals = unit.groupBy("source").agg(F.sum(F.col("size") * F.col("__rows")).alias("source_size"))
    targets = materialise(source_targets(totals, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same_source = F.col("source").eqNullSafe(F.col("__source"))
    rated = unit.join(targets.withColumnRenamed("source", "__source"), same_source).select(
        "__key", "source", "size", "__rows", "source_size", "target", F.floor(rate).alias("__whole"), (rate - F.floor(rate)).alias("__p"),
        F.concat_ws(":", F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.col("size").cast("string")).alias("__unit"),
    )
    fractional = rated.where("size > 0 and __p > 0").select(
        "source", F.col("__unit").alias("id"), (F.col("size") * F.col("__rows")).cast("double").alias("size"), F.col("__p").alias("p"),
    )
    ups = rounded(fractional, seed, chunk).where("up").select(F.col("source").alias("__up_source"), F.col("id").alias("__up"))
    chosen = rated.join(ups, (F.col("__unit") == F.col("__up")) & F.col("source").eqNullSafe(F.col("__up_source")), "left")
    copies = (F.col("__whole") + F.col("__up").isNotNull().cast("long")).cast("long")
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows")))).select(
        F.col("__key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix itself: every row of `docs`, with all its columns, as often as the mix takes it.

    Rows meet their copies by identifier, source and size; see `mix` for ties, nulls
    and empty texts. Rows without words are left out unless every row of their source is given whole.
    """
    taken = mix(docs, key=key, source=source, text=text, **how).where("copies > 0").groupBy(key, "source", "size").agg(
        F.max("copies").alias("__copies"),
    ).toDF("__key", "__source", "__size", "__copies")
    own = docs.withColumn("__words", n_words(F.col(f"`{text}`")))
    meets = (
        F.col(f"`{key}`").eqNullSafe(F.col("__key")) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    return own.join(taken, meets).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
