"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.text import ROWS, materialise

TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Buckets that single tokens and neighbouring pairs are hashed into, and what each holds before counting.
BUCKETS, PRIOR = 1 << 17, 0.5
#: Labelled rows that define the target at most; chosen by the hash of their identifier.
FIT_ROWS = 200_000
#: Share of the good documents left out of the target that may fall below the level.
SPARE = 0.005
REMEMBERED = 200_000
#: Pairs of tokens are hashed by an odd multiple of the first and a rotation.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SELECT_BINS = 4096


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def buckets_of(text: str | None, known: TokenHashes, buckets: int) -> np.ndarray:
    """Buckets of all tokens (runs of word characters, runs of signs; case counts) and of all neighbouring pairs."""
    tokens = TOKENS.findall(text) if text else []
    h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    pairs = h[:-1] * MULTIPLIER ^ (h[1:] >> np.uint64(31) | h[1:] << np.uint64(33))
    mixed = np.concatenate([h, pairs])
    return ((mixed ^ mixed >> np.uint64(29)) * MULTIPLIER >> np.uint64(32)).astype(np.int64) % buckets


def log_ratios(docs: DataFrame, buckets: int) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) from `docs` (text, target): all rows are raw text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, wanted = TokenHashes(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                found = [buckets_of(text.as_py(), known, buckets) for text in some.column(0)]
                good = [f for f, target in zip(found, some.column(1).to_pylist(), strict=True) if target]
                raw += np.bincount(np.concatenate(found), minlength=buckets)
                wanted += np.bincount(np.concatenate([np.empty(0, np.int64), *good]), minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(wanted[some])], names=["bucket", "raw", "target"])

    counts = docs.select("text", "target").mapInArrow(count, "bucket int, raw long, target long")
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(buckets, PRIOR), np.full(buckets, PRIOR)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    if not len(sums) or not sums["target"].sum():
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(key: Column, seed: int) -> Column:
    """A standard Gumbel number that depends on the key alone."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column of finite doubles; None if k < 1.

    Values are counted in 4,096 equal bins between the extremes, then in the bin
    that holds the k-th, between its own extremes, and so on: each pass brings
    at most 4,096 counts to the driver.
    """
    if k < 1:
        return None
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k:
        return low
    while low < high:
        width = (high - low) / SELECT_BINS
        place = F.least(F.lit(SELECT_BINS - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width))) if width > 0 else F.when(F.col(column) > low, 1).otherwise(0)
        bins = df.where(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"),
        ).collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if k <= b["n"]:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return low


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep_share: float | None = None, spare: float = SPARE,
    seed: int = 11, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every row (all its columns, or those named) with `log_ratio`, `n_grams`, `gumbel_key` and `kept`.

    The target is the text of documents labelled good (`labels`: doc_id, quality 1,
    toxic 0), the raw text that of all documents. Both are bags of tokens and token pairs hashed into
    `buckets`; `log_ratio` is the sum over a text's n-grams of their log importance.
    With a Gumbel number added, the k largest keys are a sample without replacement
    in proportion to importance.

    k is `keep_share` of all rows, or else it is learned: a fifth of the good documents is
    left out of the target, and k is the number of rows whose ratio reaches the level
    that all but the share `spare` of these reach. Without such documents all rows stay.

    Labels are read for at most `fit_rows` good documents, the smallest by hash; counts
    and scores cover all rows. Null and empty texts have no n-grams and ratio 0. The number
    depends on the identifier, so repeated rows share their fate, and rows that tie
    with the last one kept are kept too. Null labels and labels of unknown documents
    count for nothing. Without a target all ratios are 0. An empty table gives an
    empty one; columns named like a result are replaced.
    """
    made = ("log_ratio", "n_grams", "gumbel_key", "kept", "__scored", "__id")
    own = [F.col(f"`{c}`") for c in columns or docs.columns if c not in made]
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__good")).distinct()
    good = materialise(good.orderBy(F.xxhash64("__good"), "__good").limit(fit_rows), "good")
    aside = F.pmod(F.xxhash64("__good", F.lit(seed)), F.lit(5)) == 0
    # at most fit_rows numbers, so they may be broadcast
    marked = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(good.where(~aside)), F.col("__key") == F.col("__good"), "left",
    )
    ratios = docs.sparkSession.sparkContext.broadcast(
        log_ratios(marked.select("text", F.col("__good").isNotNull().alias("target")), buckets).astype(np.float64),
    )

    @F.arrow_udf("struct<log_ratio:double,n_grams:long>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, table = TokenHashes(), ratios.value
        for b in batches:
            sums, sizes = [], []
            for t in b:
                found = buckets_of(t.as_py(), known, buckets)
                sums.append(float(table[found].sum()))
                sizes.append(len(found))
            yield pa.StructArray.from_arrays([pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], names=["log_ratio", "n_grams"])

    noise = gumbel(F.coalesce(F.col("__id").cast("string"), F.lit("")), seed)
    rows = docs.select(*own, F.col(f"`{key}`").alias("__id"), scored(F.col(f"`{text}`")).alias("__scored")).select(
        *own, "__id", F.col("__scored.log_ratio").alias("log_ratio"), F.col("__scored.n_grams").alias("n_grams"),
    )
    rows = materialise(rows.withColumn("gumbel_key", F.col("log_ratio") + noise), "importance")
    if keep_share is not None:
        k = round(keep_share * rows.count())
    else:
        known_good = rows.join(F.broadcast(good.where(aside)), F.col("__id") == F.col("__good")).select("log_ratio")
        n = known_good.count()
        level = kth_largest(known_good, "log_ratio", n - int(spare * n))
        k = rows.count() if level is None else rows.where(F.col("log_ratio") >= F.lit(level)).count()
    cut = kth_largest(rows, "gumbel_key", k)
    return rows.drop("__id").withColumn("kept", F.lit(False) if cut is None else F.col("gumbel_key") >= F.lit(cut))
