"""Readers. Missing numbers become NULL here and nowhere else."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditspark.functions.semantics import frame_nan_to_null
from creditspark.sources.schema import LOAN_SCHEMA


CSV = {"sep": ";", "header": True, "encoding": "UTF-8"}
BROKEN = "linea_rota"


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line that is not blank of every file that has one.

    One job, a task for each file, which stops reading after that line. Files are neither
    cut nor put together here, whatever the session's settings: these hold in a session of their own.
    """
    own = spark.newSession()
    for setting, value in {"files.maxPartitionBytes": 2**62, "files.openCostInBytes": 2**62, "files.minPartitionNum": 1, "execution.arrow.maxRecordsPerBatch": 16}.items():
        own.conf.set(f"spark.sql.{setting}", str(value))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, line in enumerate(b.column(1)):
                if line.as_py().strip():
                    yield b.slice(i, 1)
                    return

    return own.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("header")).mapInArrow(first, "file string, header string")


def read_loans_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, keep_broken: bool = False
) -> DataFrame:
    """Semicolon-separated loans with a header in every file.

    The columns are found by each file's own header, in any order: one job finds all headers, files that
    share one are read together, and the groups are joined by name. A known column missing
    from all files is left out rather than filled; files without a line add nothing. With `keep_broken`, a line that
    does not fit its header or types stands in the column `linea_rota` (NULL for sound lines).
    """
    known = {f.name: f.dataType for f in (schema or LOAN_SCHEMA)}
    # as many names as Spark's own file index holds, for the readers below
    by_header = file_headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(by_header.collect()):
        # Spark names the columns, by the one line alone
        names = spark.read.csv(spark.sparkContext.parallelize([r["header"]], 1), inferSchema=False, **CSV).columns
        groups.setdefault(tuple(names), []).extend(unquote(f) for f in r["files"])
    # a line is looked at as a whole, whatever columns a query wants
    whole = {"columnPruning": False} if keep_broken else {}
    parts = []
    for header, files in groups.items():
        broken = [T.StructField(BROKEN, T.StringType())] if keep_broken else []
        ordered = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header] + broken)
        reader = spark.read.options(**whole)
        parts.append(reader.csv(files, schema=ordered, mode="PERMISSIVE", enforceSchema=True, columnNameOfCorruptRecord=BROKEN, **CSV))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(BROKEN, T.StringType())] if keep_broken else list(schema or LOAN_SCHEMA)))
    return frame_nan_to_null(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def broken_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Lines of the files, and how many of them are broken."""
    rows = read_loans_csv(spark, path, schema, keep_broken=True)
    some = F.col(next((c for c in rows.columns if c != BROKEN), BROKEN))
    # Spark refuses to read the column of broken lines alone
    return rows.agg((F.count(some) + F.count_if(some.isNull())).alias("lineas"), F.count_if(F.col(BROKEN).isNotNull()).alias("rotas"))


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a Parquet path when the name holds a slash."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_doc(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document (one object, any layout) under a fixed schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


def run_rows(doc: DataFrame) -> DataFrame:
    """Rows of a run log document: one per run, metrics as columns."""
    runs = doc.select("champion_name", F.posexplode("runs").alias("position", "r"))
    return runs.select("champion_name", "position", "r.name", "r.params", "r.metrics.*")
