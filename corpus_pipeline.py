"""From raw documents to token ids: quality, exact and near duplicates, source mix, byte-pair encoding.

Rows that share a doc_id, or have none, are documents of their own wherever their texts differ; columns of documents
beyond the known ones pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm.bpe import encode_and_decode
from creditspark.llm.exact import exact_duplicates
from creditspark.llm.mixing import mixed
from creditspark.llm.quality import resample
from creditspark.llm.simhash import near_duplicates
from creditspark.llm.text import materialise

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: The columns that operators go by. All others travel as one, so that their names meet none of an operator's own.
KNOWN = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c not in KNOWN]
    return docs.select(*[c for c in KNOWN if c in docs.columns], *([F.struct(*others).alias("others")] if others else []))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in KNOWN else F.col("others").getField(c).alias(c) for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample takes; what counts as good is learned from the labels.

    Rows without words compete with ratio 0; without labels everything stays.
    """
    return unpacked(resample(packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept"), docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest identifier; null texts count as empty."""
    return unpacked(exact_duplicates(packed(docs), keep="largest").where("kept"), docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest identifier; texts without words are one group."""
    rows = packed(docs)
    return unpacked(near_duplicates(rows, shingle=3, distance=2, columns=rows.columns).where("kept"), docs.columns)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once or twice."""
    return unpacked(mixed(packed(docs)), docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they stand for; null and empty texts have none."""
    coded = encode_and_decode(docs, TOKENIZER, ["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", in_proportion),
    ("bpe", as_tokens),
]
#: Hashed fingerprints, random rounding and byte-pair merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
