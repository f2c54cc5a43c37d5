"""Near-duplicate vectors by an exact metric range join over the cells of pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.graph import components, named
from creditspark.llm.simhash import forest
from creditspark.llm.text import materialise

COSINE = 0.9
#: Vectors for each pivot, the fewest pivots and the most; the last bounds what the driver holds and broadcasts.
CELL, FEWEST, PIVOTS = 16_384, 8, 1024
#: Bytes of a cell that one task holds, and rows that it meets in all.
BLOCK, MEETS = 1 << 23, 1_000_000
#: Rows compared at once; pairs checked at once; slack of the single-precision screen and of angles.
STEP, PAIRS, SLACK, ANGLE_SLACK = 512, 100_000, 1e-4, 1e-6


def usable(v: Column) -> Column:
    """A vector with a direction: not null, no null or non-finite component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled first so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def packed(df: DataFrame) -> DataFrame:
    """(node, size, vec) with the vector's doubles as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.asarray(v.values, dtype=np.float64).tobytes() for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], names=["node", "size", "vec"])

    return df.mapInArrow(pack, "node string, size long, vec binary")


def placed(nodes: DataFrame, pivots: dict[int, np.ndarray], first: dict[int, int], angle: float) -> DataFrame:
    """Every vector with its cell and the cells that must see it.

    A vector's cell is that of its nearest pivot. A partner within `angle` that lives in
    cell j is nearer to pivot j than to the vector's own pivot p, so by the triangle
    inequality d(vector, j) <= d(vector, p) + 2 * angle: the vector goes to these cells.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(2).to_pylist()
            home, seen_by = [0] * len(blobs), [[]] * len(blobs)
            for n in {len(v) for v in blobs}:
                at = [i for i, v in enumerate(blobs) if len(v) == n]
                if n not in pivots:  # no pivot of this length: a cell for the length alone
                    for i in at:
                        home[i] = -n
                    continue
                d = angles(unit_rows([blobs[i] for i in at]), pivots[n])
                own = d.argmin(axis=1)
                near = d <= d[np.arange(len(at)), own][:, None] + 2 * angle + ANGLE_SLACK
                near[np.arange(len(at)), own] = False
                for k, i in enumerate(at):
                    home[i] = first[n] + int(own[k])
                    seen_by[i] = (first[n] + np.flatnonzero(near[k])).tolist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(home, pa.int32()), pa.array(seen_by, pa.list_(pa.int32()))], names=["node", "size", "vec", "home", "seen_by"],
            )

    return nodes.mapInArrow(place, "node string, size long, vec binary, home int, seen_by array<int>")


class Cell:
    """The rows of one block of a cell, and what the rows that came by are to them."""

    def __init__(self, nodes: list[str], blobs: list[bytes], cosine: float):
        self.nodes, self.cosine, self.x = nodes, cosine, unit_rows(blobs)
        self.x32, self.links, self.label = self.x.astype(np.float32), np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        self.outer: list[tuple[str, int]] = []

    def meet(self, nodes: list[str], sizes: np.ndarray, blobs: list[bytes]) -> None:
        for at in range(0, len(nodes), STEP):
            y = unit_rows(blobs[at : at + STEP])
            screened = self.x32 @ y.astype(np.float32).T >= self.cosine - SLACK
            if np.count_nonzero(screened) > PAIRS:
                i, j = np.nonzero(self.x @ y.T >= self.cosine)
            else:
                i, j = np.nonzero(screened)
                true = np.einsum("ij,ij->i", self.x[i], y[j]) >= self.cosine
                i, j = i[true], j[true]
            other = np.array([self.nodes[a] != nodes[at + b] for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool)
            i, j = i[other], j[other]
            if not len(i):
                continue
            np.add.at(self.links, i, sizes[at + j])
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            begins = np.concatenate([[True], j[1:] != j[:-1]])
            anchor = i[begins][np.cumsum(begins) - 1]
            links = np.unique(np.stack([self.label[i], self.label[anchor]]), axis=1)
            self.label = forest(len(self.nodes), *links)[self.label]
            self.outer += [(nodes[at + b], a) for a, b in zip(i[begins].tolist(), j[begins].tolist(), strict=True)]

    def rows(self) -> pa.RecordBatch:
        """(node, links, other): links found of each row, and links that join all that is linked here."""
        found = np.flatnonzero(self.links)
        node, links, other = [self.nodes[i] for i in found], self.links[found].tolist(), [self.nodes[self.label[i]] for i in found]
        node += [n for n, _ in self.outer]
        links += [0] * len(self.outer)
        other += [self.nodes[i] for _, i in self.outer]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(links, pa.int64()), pa.array(other, pa.string())], names=["node", "links", "other"])


def range_join(nodes: DataFrame, cosine: float, cell: int, block: int | None) -> DataFrame:
    """Rows (node, links, other) whose sums and links hold all pairs of `nodes` (node, size, vec) at `cosine` or more."""
    spark = nodes.sparkSession
    n = nodes.count()
    sample = nodes.orderBy("node").limit(min(PIVOTS, max(FEWEST, -(-n // cell)))).select("vec").collect()
    by_length: dict[int, list[bytes]] = {}
    for (v,) in sample:
        by_length.setdefault(len(v), []).append(bytes(v))
    pivots, first, at = {}, {}, 0
    for length, blobs in by_length.items():
        pivots[length], first[length] = unit_rows(blobs), at
        at += len(blobs)
    home = materialise(placed(nodes, pivots, first, math.acos(cosine)), "cells")
    at_home = {r[0]: r[1] for r in home.where("home >= 0").groupBy("home").count().collect()}
    visits = {r[0]: r[1] for r in home.select(F.explode("seen_by").alias("c")).groupBy("c").count().collect()}
    holds = lambda length: block or max(1, BLOCK // length)
    length_of = {first[length] + i: length for length in first for i in range(len(by_length[length]))}
    # lengths without a pivot have a cell each; only those beyond one block or part are told apart
    large = F.col("count") > F.least(F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / -F.col("home"))) if block is None else F.lit(block), F.lit(MEETS))
    alone = {r[0]: r[1] for r in home.where("home < 0").groupBy("home").count().where(large).collect()}
    count = lambda rows, size: max(1, -(-rows // size))
    table = lambda of: (F.array(*[F.lit(of(c, at_home.get(c, 0), length_of[c])) for c in range(at)] or [F.lit(1)]),
                        F.create_map(*[F.lit(x) for c, n_ in alone.items() for x in (c, of(c, n_, -c))]) if alone else None)
    blocks = table(lambda c, rows, length: count(rows, holds(length)))
    met = table(lambda c, rows, length: count(rows + visits.get(c, 0), MEETS))

    def pick(found: tuple, c: Column) -> Column:
        other = F.lit(1) if found[1] is None else F.coalesce(F.try_element_at(found[1], c), F.lit(1))
        return F.when(c >= 0, F.get(found[0], c)).otherwise(other)

    upto = lambda n_: F.explode(F.sequence(F.lit(0), n_ - 1))
    deal = lambda n_, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n_).cast("int")
    own = home.select("node", "size", "vec", F.col("home").alias("cell")).select(
        "cell", deal(pick(blocks, F.col("cell")), 1).alias("block"), upto(pick(met, F.col("cell"))).alias("part"), F.lit(0).alias("role"), "node", "size", "vec",
    )
    guests = home.select("node", "size", "vec", F.explode(F.concat(F.array("home"), "seen_by")).alias("cell")).select(
        "cell", upto(pick(blocks, F.col("cell"))).alias("block"), deal(pick(met, F.col("cell")), 2).alias("part"), F.lit(1).alias("role"), "node", "size", "vec",
    )
    key = ("cell", "block", "part")
    dealt = own.union(guests).repartition(*key).sortWithinPartitions(*key, "role")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes_, blobs, cell_ = None, [], [], None
        for b in batches:
            cols = b.to_pydict()
            keys = list(zip(cols["cell"], cols["block"], cols["part"], cols["role"], strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                *of, role = keys[a]
                if of != held:
                    if cell_ is not None:
                        yield cell_.rows()
                    held, nodes_, blobs, cell_ = of, [], [], None
                if role == 0:
                    nodes_ += cols["node"][a:z]
                    blobs += cols["vec"][a:z]
                elif nodes_:
                    cell_ = cell_ or Cell(nodes_, blobs, cosine)
                    cell_.meet(cols["node"][a:z], np.array(cols["size"][a:z]), cols["vec"][a:z])
        if cell_ is not None:
            yield cell_.rows()

    return dealt.mapInArrow(join, "node string, links long, other string")


def near_vectors(
    df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", cell: int = CELL, block: int | None = None,
) -> DataFrame:
    """(vec_id under its own name, n_links, component_id, kept) of every row.

    Rows are linked if the cosine of their vectors, in double precision, is `cosine`
    or more. `n_links` counts the other rows linked directly, `component_id` is the
    smallest identifier that links reach, and `kept` marks the row that bears it.

    Equal vectors are one node with a size. Pivots split the nodes into cells by angle, which
    is a metric; `placed` says which cells see a node. Blocks of a cell, of `block` rows
    or of 8 MB, are streamed past by the rows that may reach them, so neither a cell nor a crowd of near
    copies is gathered, and no pairs are written: a block returns counts and a forest. The join is exact. Where
    vectors have no near neighbours to speak of (random directions in many
    dimensions), the bound prunes little, and every row meets every cell.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, their own copies included, and stay. Vectors of different length are not
    linked. Rows of a null identifier are linked like others; a component of nulls alone
    has a null id. Rows that share an identifier share its fate. An empty table gives
    an empty one; other columns are not carried.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine: above 0, at most 1")
    own = df.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    own = own.withColumn("__ok", usable(F.col("__v")))
    # zeros of either sign are the same component
    plain = F.transform("__v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    good = own.where("__ok").select("__id", plain.alias("__v")).select("__id", "__v", F.sha2(F.col("__v").cast("string"), 256).alias("node"))
    classes = good.groupBy("node").agg(F.count("*").alias("size"), F.min("__id").alias("first"), F.any_value("__v").alias("__v"))
    nodes = materialise(packed(classes.select("node", "size", "__v")), "vectors")
    found = materialise(range_join(nodes, cosine, cell, block), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    firsts = good.groupBy("node").agg(F.count("*").alias("size"), F.min("__id").alias("first"))
    rooted = firsts.join(reached, "node", "left").join(links, "node", "left").select(
        "node", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    rooted = materialise(rooted, "rooted")
    of = named(rooted).select("node", "n_links", "component_id")
    linked = good.select("__id", "node").join(of, "node").select("__id", "n_links", "component_id")
    alone = own.where(~F.col("__ok")).select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    return linked.union(alone).select(
        F.col("__id").alias(key), "n_links", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
