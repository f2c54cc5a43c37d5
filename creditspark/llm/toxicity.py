"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.text import materialise

WORDS = re.compile(r"\w+")
#: Hashes that a worker remembers.
REMEMBERED = 200_000
#: Documents that one learner sees, in passes over them; a feature counts from so many of them on.
SHARD, PASSES, SEEN_IN = 8192, 4, 3
#: Learning rate, its smoothing, and the penalties of size and of squares.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
#: Weights that one learner may hand on at most: the largest ones. Bounds what is broadcast.
WEIGHTS = 1 << 19
LEVEL = 0.3
#: Kinds of features are told apart by odd multipliers of the first word's hash.
PAIR, SKIP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: Key of the intercept.
ALWAYS = 0
#: Buckets of the table that passes by most features without a search.
SCREEN_BITS = 22


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def features(text: str | None, known: WordHashes) -> np.ndarray:
    """64-bit hashes of a text's words in lower case, of neighbours, and of words with one word between them; repeats included."""
    found = WORDS.findall(text.lower()) if text else []
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    joined = lambda a, b, kind: (mixed := a * kind ^ (b >> np.uint64(31) | b << np.uint64(33))) ^ mixed >> np.uint64(29)
    return np.concatenate([h, joined(h[:-1], h[1:], PAIR) * MIX, joined(h[:-2], h[2:], SKIP) * MIX])


def logistic(s: float) -> float:
    return 1 / (1 + math.exp(-s)) if s >= 0 else math.exp(s) / (1 + math.exp(s))


class Ftrl:
    """FTRL-proximal with a learning rate for each coordinate; coordinate 0 is the intercept, without penalties."""

    def __init__(self, size: int, intercept: float, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n, self.intercept = np.zeros(size), np.zeros(size), intercept
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z[0] = -intercept * beta / alpha

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha
        own = at == 0
        l1, l2 = np.where(own, 0.0, self.l1), np.where(own, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / (rate + l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = logistic(float(w.sum())) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def learned(docs: list[np.ndarray], labels: list[int], intercept: float, passes: int, seen_in: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights) of the intercept and of all weights other than 0, from documents given as their distinct features, passed over in their order."""
    keys, count = np.unique(np.concatenate([np.empty(0, np.uint64), *docs]), return_counts=True)
    keys = np.concatenate([np.array([ALWAYS], np.uint64), keys[(count >= seen_in) & (keys != ALWAYS)]])
    rows = []
    for doc in docs:
        at = np.searchsorted(keys, doc)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == doc) & (doc != ALWAYS)]
        rows.append(np.concatenate([[0], at]))
    model = Ftrl(len(keys), intercept)
    for _ in range(passes):
        for at, label in zip(rows, labels, strict=True):
            model.learn(at, label)
    w = model.weights(np.arange(len(keys)))
    some = np.flatnonzero((w != 0) | (keys == ALWAYS))
    if len(some) > WEIGHTS:
        some = np.sort(some[np.argsort(-np.abs(w[some]), kind="stable")[:WEIGHTS]])
    return keys[some], w[some]


def train(examples: DataFrame, shard: int = SHARD, passes: int = PASSES, seen_in: int = SEEN_IN, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(keys, weights, intercept) from `examples` (key, text, toxic).

    Examples are dealt by the hash of their key into shards of about `shard` documents. Each shard has a
    learner of its own, which passes over its documents in the order of another hash; then weights are
    averaged, and those stay that at least half of the learners have. So the model holds at most twice the weights of one
    learner, however many examples there are, and none of them are left out.
    """
    found = examples.agg(F.count("*"), F.sum("toxic")).first()
    n, positive = found[0], float(found[1] or 0)
    share = (positive + 0.1) / (n + 1)  # nothing learned: 0.1
    intercept = math.log(share / (1 - share))
    if not n:
        return np.empty(0, np.uint64), np.empty(0), intercept
    shards = max(1, -(-n // shard))
    named = F.coalesce(F.col("key").cast("string"), F.lit(""))
    dealt = examples.select(F.pmod(F.xxhash64(named, F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(named, F.lit(seed + 1)).alias("turn"), "text", "toxic")
    # more partitions than shards, so that few of them meet in one; equal turns are told apart by the row itself
    dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions("shard", "turn", "toxic", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, docs, labels, known = None, [], [], WordHashes()

        def result() -> pa.RecordBatch:
            keys, w = learned(docs, labels, intercept, passes, seen_in)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(w)], names=["key", "weight"])

        for b in batches:
            for s, text, label in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if s != of:
                    if docs:
                        yield result()
                    of, docs, labels = s, [], []
                docs.append(np.unique(features(text.as_py(), known)))
                labels.append(label)
        if docs:
            yield result()

    weights = dealt.mapInArrow(learn, "key long, weight double")
    # shards that hashing left empty have no learner, and each learner gives one intercept
    learners = F.max(F.when(F.col("key") == ALWAYS, F.col("votes")))
    mean = weights.groupBy("key").agg(F.count("*").alias("votes"), F.sum("weight").alias("total"))
    mean = materialise(mean, "weights")
    known = mean.agg(learners).first()[0] or shards
    kept = mean.where(F.col("votes") * 2 >= known).select("key", (F.col("total") / known).alias("weight")).orderBy("key").collect()
    keys = np.array([r["key"] for r in kept], np.int64).view(np.uint64)
    w = np.array([r["weight"] for r in kept], np.float64)
    base = float(w[keys == ALWAYS].sum())
    order = np.argsort(keys[keys != ALWAYS])
    return keys[keys != ALWAYS][order], w[keys != ALWAYS][order], base


def toxicity(
    docs: DataFrame, labels: DataFrame, teaches: Column, key: str = "doc_id", text: str = "text", toxic: str = "toxic", level: float = LEVEL,
    shard: int = SHARD, passes: int = PASSES, seen_in: int = SEEN_IN,
) -> DataFrame:
    """(doc_id under its own name, score, predicted) of every row of `docs`.

    The features of a text are its distinct words in lower case, pairs of neighbours, and pairs with one word between,
    all of the whole text, hashed to 64 bits. The score is the logistic sum of their weights and an intercept;
    `predicted` is 1 from `level` on. Labels (`labels`: the same key, and `toxic` 0 or 1) teach where `teaches`,
    a condition on `docs`, holds; identifiers only join and deal them.

    Null and empty texts have the intercept's score. Null labels, labels other than 0 and 1, labels
    of unknown documents and null identifiers teach nothing; a document labelled both ways teaches both, a
    repeated row teaches again, a repeated label does not. Without labels all scores are 0.1, which no text changes. An empty table gives
    an empty one; other columns are not carried, whatever their names.
    """
    marks = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{toxic}`").cast("int").alias("__toxic")).where("__key IS NOT NULL AND __toxic IN (0, 1)").distinct()
    own = docs.where(teaches).select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    # labels grow with the documents, so neither side is broadcast, at any size
    examples = own.join(marks.hint("merge"), F.col("__id") == F.col("__key")).select(F.col("__id").alias("key"), F.col("__text").alias("text"), F.col("__toxic").alias("toxic"))
    examples = materialise(examples, "examples")
    keys, weights, intercept = train(examples, shard, passes, seen_in)
    screen = np.zeros(1 << SCREEN_BITS, dtype=bool)
    place = np.uint64(64 - SCREEN_BITS)
    screen[keys >> place] = True
    model = docs.sparkSession.sparkContext.broadcast((keys, weights, np.packbits(screen), intercept))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, weights, packed, intercept = model.value
        table, known = np.unpackbits(packed).view(bool), WordHashes()
        for b in batches:
            out = []
            for t in b:
                h = features(t.as_py(), known)
                h = np.unique(h[table[h >> place]])
                at = np.searchsorted(keys, h)
                at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h)] if len(keys) else at[:0]
                out.append(logistic(intercept + float(weights[at].sum())))
            yield pa.array(out, pa.float64())

    scored = docs.select(F.col(f"`{key}`"), score(F.col(f"`{text}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= level).cast("int"))


