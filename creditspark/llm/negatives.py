"""Hard negatives by Fagin's threshold algorithm over blocks of per-dimension sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditspark.llm.text import materialise, shuffle_partitions

#: Rows of a block at least and at most; anchors that meet a block in one task.
SMALLEST, LARGEST, ANCHORS = 1024, 65_536, 8192
#: Entries of every list that the first round reads; each later round doubles the depth.
DEPTH = 16
LOWEST, HIGHEST = -(2**63), 2**63 - 1


class Lists:
    """The candidates of a block, sorted once for each dimension; row order is the order of ties."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.dims) = x, x.shape
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(x.T, self.order, axis=1)
        self.reach = max(1, int(x.max(initial=0)), -int(x.min(initial=0))) * max(1, self.dims)
        self.kept: dict[type, tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates, sorted lists and anchor in the narrowest numbers that keep every sum of products exact."""
        bound = self.reach * max(1, int(a.max(initial=0)), -int(a.min(initial=0)))
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        if kind not in self.kept:
            self.kept[kind] = self.x.astype(kind), self.sorted.astype(kind)
        return *self.kept[kind], a.astype(kind)

    def top(self, a: np.ndarray, allowed: np.ndarray, lows: list[int], highs: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores its first k allowed rows: positions and scores, higher scores and earlier rows first.

        Every list is read from the end where the anchor's sign puts the larger products;
        a row met for the first time is scored whole. No row still unmet can score
        above the threshold, the sum of the products at the lists' present depth, so reading stops
        once that is strictly below the k-th score of every window, or below the window
        where it holds fewer rows.
        """
        x, lists, a = self.numbers(a)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        met = np.zeros(self.n, dtype=bool)
        at = np.empty(0, np.int64)
        scores = np.empty(0, np.int64 if x.dtype != object else object)
        depth, last = 0, 0 if len(up) + len(down) else self.n
        while depth < self.n:
            begin, depth = depth, last or min(self.n, max(DEPTH, 2 * depth))
            read = np.zeros(self.n, dtype=bool)
            if last:  # an anchor of zeros has no order to go by
                read[:] = True
            read[self.order[up, self.n - depth : self.n - begin]] = True
            read[self.order[down, begin:depth]] = True
            new = np.flatnonzero(read & ~met & allowed)
            met |= read
            at = np.concatenate([at, new])
            scores = np.concatenate([scores, (x[new] @ a).astype(scores.dtype)])
            threshold = a[up] @ lists[up, self.n - depth] + a[down] @ lists[down, depth - 1]
            if met.all() or all(threshold < self.level(scores, low, high, k) for low, high in zip(lows, highs, strict=True)):
                break
        return [self.first(at, scores, low, high, k) for low, high in zip(lows, highs, strict=True)]

    @staticmethod
    def level(scores: np.ndarray, low: int, high: int, k: int) -> int:
        inside = scores[(scores >= low) & (scores <= high)]
        return low if len(inside) < k else np.partition(inside, len(inside) - k)[len(inside) - k]

    def first(self, at: np.ndarray, scores: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        inside = (scores >= max(low, self.level(scores, low, high, k))) & (scores <= high)
        at, scores = at[inside], scores[inside]
        best = np.lexsort((at, -scores))[:k]
        return at[best], scores[best]


def table_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def best_in_windows(rows: DataFrame, anchors: DataFrame, same: bool, k: int, blocks: int, parts: int) -> DataFrame:
    """(anchor, window, key, score): the first k rows of every window of every anchor.

    `rows` have (key, label, vec), `anchors` (anchor, key, label, vec, lows, highs). Only rows
    of the anchor's own label count if `same`, else only rows of other labels; never those of the
    anchor's key. Blocks hold rows by the hash of their key, and anchors stream past them, so no label and no
    crowd of copies is gathered; a block gives k rows a window, and these are ranked again.
    """
    kinds = dict(rows.dtypes)
    by_hash = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("vec").alias("length")
    none = F.lit(None).cast("array<long>")
    held = rows.select(
        length, by_hash(blocks, 1).alias("block"), every(parts).alias("part"), F.lit(None).cast("long").alias("anchor"),
        "key", "label", "vec", none.alias("lows"), none.alias("highs"),
    )
    met = anchors.select(
        length, every(blocks).alias("block"), by_hash(parts, 2).alias("part"), "anchor", "key", "label", "vec", "lows", "highs",
    )
    where = ("length", "block", "part")
    # nulls sort first: a block's rows, in the order of ties, come before the anchors that meet them
    dealt = held.union(met).repartition(*where).sortWithinPartitions(*where, "anchor", "key")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pieces, lists, keys, labels = None, [], None, None, None
        for b in batches:
            cut = list(zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).is_null().to_pylist(), strict=True))
            ends = [i for i in range(len(cut)) if i == 0 or cut[i] != cut[i - 1]] + [len(cut)]
            for begin, end in zip(ends, ends[1:], strict=False):
                *block, is_row = cut[begin]
                some = b.slice(begin, end - begin)
                if block != of:
                    of, pieces, lists = block, [], None
                if is_row:
                    pieces.append(some)
                    continue
                if not pieces:
                    continue
                if lists is None:
                    whole = pa.Table.from_batches(pieces).combine_chunks()
                    lists = Lists(np.concatenate([table_of(p.column("vec")) for p in pieces]))
                    keys, labels = (whole.column(c).combine_chunks() for c in ("key", "label"))
                found = []
                for i, a in enumerate(table_of(some.column("vec"))):
                    alike = pc.equal(labels, some.column("label")[i]).to_numpy(zero_copy_only=False)
                    other = pc.not_equal(keys, some.column("key")[i]).to_numpy(zero_copy_only=False)
                    windows = lists.top(a, other & (alike if same else ~alike), *(some.column(c)[i].as_py() for c in ("lows", "highs")), k)
                    found += [(some.column("anchor")[i].as_py(), w, at, scores) for w, (at, scores) in enumerate(windows) if len(at)]
                if found:
                    sizes = [len(at) for *_, at, _ in found]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat([f[0] for f in found], sizes), pa.int64()), pa.array(np.repeat([f[1] for f in found], sizes), pa.int32()),
                        keys.take(pa.array(np.concatenate([f[2] for f in found]))),
                        pa.array([min(max(int(s), LOWEST), HIGHEST) for f in found for s in f[3]], pa.int64()),
                    ], names=["anchor", "window", "key", "score"])

    found = dealt.mapInArrow(search, f"anchor long, window int, key {kinds['key']}, score long")
    ranked = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Components become floor(scale * x); a score is the integer inner product with the
    anchor, higher ones first, ties by smaller key. An anchor's positives are its first `positives`
    other rows of the same label; the negatives of a pair are the first `negatives` rows of other labels with
    `low` % <= negative score / positive score <= `high` %, in products of integers (so none below a
    positive score of 0). Fewer are returned where there are fewer.

    Rows with a null key, label or vector, or a component that is null, not finite or beyond a long once
    scaled, take no part. Vectors of different length do not meet; empty ones score 0. Rows that share a key
    are rows of their own as candidates and as anchors, except that none is a candidate of an anchor of its key.
    Sums of products are exact; those beyond a long count and are returned as its nearest end.
    A label or vector that a third of all rows share changes nothing: blocks go by the hash of the key.
    An empty table gives an empty one; other columns are not read.
    """
    x = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    out_of_reach = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(scale))) >= F.lit(2.0**63))
    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), x.alias("vec"), is_anchor.alias("is_anchor"), F.col(f"`{vector}`").cast("array<double>").alias("raw"))
    usable = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & ~F.exists("raw", out_of_reach)
    rows = materialise(own.where(usable).select("key", "label", "vec", "is_anchor"), "candidates")
    n = rows.count()
    anchors = materialise(rows.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "key", "label", "vec"), "anchors")
    size = min(LARGEST, max(SMALLEST, -(-n // shuffle_partitions(df))))
    blocks, parts = max(1, -(-n // size)), max(1, -(-anchors.count() // ANCHORS))
    rows = rows.select("key", "label", "vec")
    whole = anchors.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))})
    best = best_in_windows(rows, whole, True, positives, blocks, parts)
    exact = F.col("score").cast("decimal(19,0)")
    best = best.select(
        "anchor", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"), "rank",
        F.ceil(exact * low / 100).cast("long").alias("low"), F.floor(exact * high / 100).cast("long").alias("high"),
    )
    best = materialise(best, "positives")
    # windows of one anchor, at most `positives`, in the order of their ranks
    spans = best.where("low <= high").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    windows = anchors.join(spans, "anchor").select(
        "anchor", "key", "label", "vec", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"),
    )
    mined = best_in_windows(rows, windows, False, negatives, blocks, parts)
    named = spans.join(anchors.select("anchor", F.col("key").alias("anchor_id")), "anchor").select(
        "anchor", "anchor_id", F.posexplode(F.col("w.rank")).alias("window", "at"),
    ).join(best.select("anchor", F.col("rank").alias("at"), "positive_id", "positive_score"), ["anchor", "at"])
    return mined.join(named, ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def hard_negatives_sql() -> str:
    """The registered query in SQL: all scores, then ranks."""
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
