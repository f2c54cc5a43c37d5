"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.llm.text import map_batches, shuffle_partitions, words
from creditspark.operators.dictionary import category_dictionary, encode

WIDTH = 13
#: Base of the polynomial, modulo 2**64 (any odd number does: the word hashes are random already).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows that a task holds before it sends them; word hashes that it remembers.
HELD, REMEMBERED = 1_000_000, 200_000
#: Decided windows that travel in one row.
DECIDED = 1 << 17
#: Bytes of text whose windows share a bucket.
BUCKET_BYTES = 16_000_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(found: list[bytes], width: int, known: WordHashes) -> np.ndarray:
    """The hash of the window that starts at each word: the sum of word hashes times falling powers of the base."""
    n = len(found) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    out = h[:n].copy()
    for j in range(1, width):
        out *= BASE
        out += h[j : n + j]
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours begin, and how many there are."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


#: What a task sends to a bucket: documents, how many windows each, and the windows' hashes.
SENT = "bucket int, docs binary, counts binary, hashes binary"


def sent(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each (bucket, document of every hash, hashes); equal neighbouring documents are run-lengthed."""
    columns = [], [], [], []
    for bucket, docs, hashes in rows:
        starts, counts = runs(docs)
        parts = bucket, docs[starts].tobytes(), counts.astype(np.uint32).tobytes(), hashes.tobytes()
        for column, part in zip(columns, parts, strict=True):
            column.append(part)
    kinds = pa.int32(), pa.binary(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["bucket", "docs", "counts", "hashes"])


def to_buckets(texts: list[tuple[int, np.ndarray]], buckets: int, turn: int = 0) -> pa.RecordBatch:
    """Of every hash held, the smallest document goes to the hash's bucket.

    The others are decided: the hash must go from them, which buckets below zero
    pass on. A passage that stands in a third of all documents so leaves a task once.
    Decided windows need not meet, so they are dealt to those buckets in turn, from
    `turn` on, whatever stands in them.
    """
    texts.sort(key=lambda x: x[0])
    hashes = np.concatenate([h for _, h in texts])
    docs = np.repeat(np.array([d for d, _ in texts], dtype=np.int64), [len(h) for _, h in texts])
    order = np.argsort(hashes, kind="stable")
    starts, counts = runs(hashes[order])
    later = order[docs[order] > np.repeat(docs[order[starts]], counts)]
    first = np.sort(order[starts])
    bucket = ((hashes[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    at, sizes = runs(bucket[by_bucket])
    rows = [(int(bucket[by_bucket[a]]), docs[some], hashes[some]) for a, n in zip(at.tolist(), sizes.tolist(), strict=True) if len(some := first[by_bucket[a : a + n]])]
    if len(later):
        gone = np.unique(np.stack([docs[later], hashes[later].view(np.int64)]), axis=1)
        for k, at_ in enumerate(range(0, gone.shape[1], DECIDED)):
            part = gone[:, at_ : at_ + DECIDED]
            rows.append((-1 - (turn + k) % buckets, part[0], part[1].view(np.uint64)))
    return sent(rows)


def repeated_hashes(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Rows (doc, hash): windows of a document that also start in a document with a smaller identifier.

    Input: (doc, text), identifiers not null.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, texts = WordHashes(), 0, []
        # tasks begin at places of their own and go on where their last chunk ended
        turn = xxhash.xxh3_64_intdigest(b"%d" % TaskContext.get().partitionId()) % buckets
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                h = window_hashes(words(text.as_py()), width, known)
                if len(h):
                    texts.append((doc.as_py(), h))
                    held += len(h)
                if held >= HELD:
                    yield to_buckets(texts, buckets, turn)
                    turn += -(-held // DECIDED)
                    held, texts = 0, []
        if texts:
            yield to_buckets(texts, buckets, turn)

    def meet(group: pa.Table) -> pa.Table:
        blobs = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), dtype=kind)
        hashes, docs = blobs("hashes", np.int64), np.repeat(blobs("docs", np.int64), blobs("counts", np.uint32))
        if group.column("bucket")[0].as_py() >= 0:
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            starts, counts = runs(hashes)
            later = docs > np.repeat(np.minimum.reduceat(docs, starts), counts)
            hashes, docs = hashes[later], docs[later]
        return pa.table({"doc": docs, "hash": hashes})

    # as many tasks as buckets, so that a task's share does not grow with the text
    return docs.mapInArrow(scan, SENT).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "doc long, hash long")


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Windows at `starts` (ascending) as maximal intervals [from, to) of words; neighbours that touch are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + width).tolist(), strict=True))


def remove_repeats(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id under its own name, n_words, n_removed, spans, kept_text) of every row.

    A word goes if a window of `width` words that covers it also starts, word for
    word, in a document with a smaller identifier. `spans` are the maximal intervals
    [start, end) of words that go; `kept_text` has the others, joined by one space.
    Windows are judged on the input.

    A window is known by a 64-bit hash. Tasks send each of their hashes once, with its smallest
    document, in compact blocks, to buckets whose number grows with the text,
    and a bucket names the documents that have a smaller one before them. Two
    different windows in a table of n fall together with a chance of n * n / 2 ** 65.

    Null, empty and short texts lose nothing. Rows with a null identifier neither
    lose words nor take any; rows that share an identifier do not take each other's.
    Repeated rows give repeated results, an empty table an empty one; other columns
    are not carried. Identifiers that are no integers keep their type, and the smaller is
    the one whose text comes first.
    """
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    if isinstance(texts.schema["id"].dataType, T.IntegralType):
        texts = texts.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("doc"), "text")
    else:
        texts = encode(texts, category_dictionary(texts, ["id"]), ["id"]).select("id", F.col("idx_id").alias("doc"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs), -(-size // BUCKET_BYTES))
    known_texts = texts.where("doc is not null and text is not null").select("doc", "text")
    repeats = repeated_hashes(known_texts, width, buckets).groupBy(F.col("doc").alias("of")).agg(F.collect_set("hash").alias("hashes"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [], [], [], []
        known = WordHashes()
        for text_, hashes in zip(batch.column(1), batch.column(2), strict=True):
            found, spans = words(text_.as_py()), []
            if hashes.is_valid and len(found) >= width:
                gone = hashes.values.to_numpy().view(np.uint64)
                spans = intervals(np.flatnonzero(np.isin(window_hashes(found, width, known), gone)), width)
            kept, at = [], 0
            for a, b in spans:
                kept += found[at:a]
                at = b
            kept += found[at:]
            parts = len(found), len(found) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode("utf-8", "surrogatepass")
            for column, part in zip(out, parts, strict=True):
                column.append(part)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = pa.int64(), pa.int64(), span, pa.string()
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["id", "n_words", "n_removed", "spans", "kept_text"])

    joined = texts.join(repeats, F.col("doc") == F.col("of"), "left").select("id", "text", "hashes")
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
    return map_batches(joined, cut, schema).withColumnRenamed("id", key)


def repeats_sql(width: int = WIDTH) -> str:
    """Digests of the same removal over `documents` in SQL."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {width - 1})) AS i FROM w WHERE len(ws) >= {width}),
wins AS (SELECT doc_id, i, array_to_string(ws[i : i + {width - 1}], ' ') AS g FROM starts),
firsts AS (SELECT g, min(doc_id) AS first FROM wins GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM wins JOIN firsts USING (g), range({width}) r(j) WHERE first < doc_id),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
