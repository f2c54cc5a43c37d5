"""Shared text rules and helpers of the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.sources.scratch import scratch_path

#: A word is a run of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes: ASCII letters to lower case; any blank to a space.
#: Rows that a Python worker takes and gives at a time.
ROWS = 1_000
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
BLANKS_TO_SPACE = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8 bytes. `bytes.split` cuts at exactly the six blanks."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER_BYTES) if lower else raw).split()


def word_strings(text: str | None) -> list[str]:
    return re.findall(WORD, text) if text else []


def held_out(key: Column, divisor: int, remainder: int = 2) -> Column:
    """Rows whose crc32 of the key as text leaves the remainder; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(divisor)) == remainder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a function to the rows, `ROWS` of them at a time; rows are independent of one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                out = f(b.slice(at, ROWS))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
