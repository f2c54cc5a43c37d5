"""Near duplicates by SimHash fingerprints and an inverted index over their bytes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.graph import components
from creditspark.llm.text import map_batches, materialise, words

BYTES = 8
#: Hashes of a text whose bits are counted at once.
AT_ONCE = 1 << 16
#: Postings up to this size are compared pair by pair in one small matrix.
SMALL = 64


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> bytes:
    """Eight bytes: a bit is 1 if it is set in over half the hashes of the text's word shingles.

    Shingles are joined by a space and hashed by XXH64; repeated ones count each
    time. A text with fewer words is one shingle; one without words is zero.
    """
    found = words(text, lower=True)
    if not found:
        return bytes(BYTES)
    joined, k = b" ".join(found), min(shingle, len(found))
    ends = [e + i for i, e in enumerate(accumulate(map(len, found)))]
    starts = [0, *(e + 1 for e in ends)]
    digest, n, ones = xxhash.xxh64_intdigest, len(found) - k + 1, np.zeros(8 * BYTES, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        to = min(n, at + AT_ONCE)
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at:to], ends[at + k - 1 : to + k - 1], strict=True)]
        raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def with_fingerprint(docs: DataFrame, shingle: int, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Every row with its fingerprint as 16 lowercase hexadecimal digits; null counts as a text without words."""
    @F.arrow_udf("string")
    def marks(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle).hex() for t in batch], type=pa.string())

    return docs.withColumn(name, marks(F.col(f"`{text}`")))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n items' component, given links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if np.array_equal(label, before):
            return label


def linked(values: np.ndarray, free: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sorted distinct fingerprints at `distance` bits or fewer; they differ in the bits of `free` alone."""
    if len(values) <= SMALL:
        a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values) <= distance, 1))
        return a, b
    left, right = [], []
    for k in range(1, distance + 1):
        for flips in combinations(free, k):
            partner = values ^ np.bitwise_or.reduce(np.array(flips, dtype=np.uint64))
            at = np.minimum(np.searchsorted(values, partner), len(values) - 1)
            hit = np.flatnonzero(values[at] == partner)
            left.append(hit)
            right.append(at[hit])
    return np.concatenate(left), np.concatenate(right)


def near_links(marks: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints `fingerprint` at `distance` bits or fewer.

    A pair that differs in d bits shares at least 8 - d of its 8 positional bytes.
    Posting lists of single bytes would each hold 1/256 of the table, so the index
    has a posting for every set of 8 - d positions with their bytes: a pair meets in
    one exactly if its tally of shared bytes reaches the minimum. Members of
    a posting differ in d bytes only, which bounds it at 256 ** d distinct
    fingerprints. The verified pairs of a posting are given as a forest, a link for
    each member at most, so a crowded posting does not grow with its square.
    """
    shared = list(combinations(range(BYTES), BYTES - distance))
    keys = [
        F.struct(F.lit(i).alias("positions"), F.concat(*[F.substring("fingerprint", 2 * p + 1, 2) for p in chosen]).alias("bytes"))
        for i, chosen in enumerate(shared)
    ]
    postings = marks.select("fingerprint", F.inline(F.array(*keys))).groupBy("positions", "bytes").agg(
        F.collect_list("fingerprint").alias("members"),
    ).where(F.size("members") > 1).select("positions", "members")
    bits = [
        np.array([1 << (8 * (BYTES - 1 - p) + i) for p in range(BYTES) if p not in chosen for i in range(8)], dtype=np.uint64)
        for chosen in shared
    ]

    def links(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = [], []
        for positions, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.unique(np.array([int(m, 16) for m in members], dtype=np.uint64))
            a, b = linked(values, bits[positions], distance)
            if len(a):
                root = forest(len(values), a, b)
                at = np.flatnonzero(root != np.arange(len(values)))
                left += [f"{v:016x}" for v in values[at].tolist()]
                right += [f"{v:016x}" for v in values[root[at]].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])

    return map_batches(postings, links, "a string, b string")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text", columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every row (its identifier, or the columns named) with `fingerprint`, `component_id` and `kept`.

    Fingerprints at `distance` bits or fewer are linked, and a component holds all that
    links reach; its id is the smallest identifier in it, and the row that bears
    it is kept. Texts without words (null, empty, blank) have fingerprint zero and are
    linked like any other. Rows of equal fingerprint are one node, so copies cost one row
    each. A component of null identifiers alone has a null id. Of rows that share
    an identifier the one with the smallest hash of its text is kept; rows equal in
    both share their fate. An empty table gives an empty one; columns named like
    a result are replaced.
    """
    made = ("fingerprint", "component_id", "kept")
    id_ = F.col(f"`{key}`")
    order = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text")).alias("__order")
    marked = with_fingerprint(docs.select(order, F.col(f"`{text}`").alias("__text")), shingle, "__text")
    marked = materialise(marked.select("__order", "fingerprint"), "fingerprints")
    nodes = marked.groupBy("fingerprint").agg(F.min("__order").alias("__first"))
    reached = components(near_links(nodes.select("fingerprint"), distance)).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(reached, "fingerprint", "left").select("fingerprint", "__first", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("__first").alias("__best"))
    of = materialise(rooted.select("fingerprint", "root").join(named, "root").select("fingerprint", "__best"), "components")
    judged = marked.join(of, "fingerprint").select(
        "__order", "fingerprint", F.col("__best.id").alias("component_id"), F.col("__order").eqNullSafe(F.col("__best")).alias("kept"),
    )
    if columns is None:
        return judged.select(F.col("__order.id").alias(key), "fingerprint", "component_id", "kept")
    # texts and other columns are not carried along: rows meet their judgement at the end
    judged = judged.distinct().select(F.col("__order.id").alias("__id"), F.col("__order.text").alias("__mark"), "fingerprint", "component_id", "kept")
    own = [F.col(f"`{c}`") for c in columns if c not in made]
    rows = docs.select(*own, id_.alias("__own_id"), F.xxhash64(F.col(f"`{text}`")).alias("__own_mark"))
    meets = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_mark") == F.col("__mark"))
    return rows.join(judged, meets).select(*own, "fingerprint", "component_id", "kept")
