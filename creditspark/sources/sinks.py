"""Writers: tables, governance tables, JSON documents, models."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence
from itertools import pairwise

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.operators.reshape import with_default
from creditspark.sources.schema import GOVERNANCE_TABLES, required_columns, table_ddl

STAGING = "__next"
DECISION = "name string, decision_threshold double"


def ensure_db(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{at}")


def ensure_tables(spark: SparkSession, db: str, tables: Sequence[str] = tuple(GOVERNANCE_TABLES)) -> None:
    """Create the governance tables that do not exist yet."""
    ensure_db(spark, db)
    for t in tables:
        spark.sql(table_ddl(t, f"{db}.{t}"))


def with_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail the write on a NULL in a required column.

    Parquet tables accept NULL in NOT NULL columns, so the check rides in the
    projection of the write itself and costs no extra pass.
    """
    def checked(c: str):
        stop = F.raise_error(F.lit(f"NULL in required column {c}"))
        return F.when(F.col(c).isNull(), stop.cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    return df.select(*[checked(c) if c in required else F.col(c) for c in df.columns])


def _home(spark: SparkSession, name: str) -> tuple[str, str]:
    """Where the folders of a table lie, and what their names begin with."""
    db, _, short = name.rpartition(".")
    home = spark.catalog.getDatabase(db or spark.catalog.currentDatabase()).locationUri
    return home.rstrip("/"), f"{short}__v_"


def _new_version(spark: SparkSession, name: str) -> str:
    """A folder of its own for the next rows of a table, beside the earlier ones."""
    home, begin = _home(spark, name)
    return f"{home}/{begin}{uuid.uuid4().hex[:12]}"


def _versions(spark: SparkSession, name: str) -> list[tuple[float, str]]:
    """(seconds of the last write, folder) of a table, oldest first. Files tell the time, as folders of object stores have none."""
    home, begin = _home(spark, name)
    root = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    for folder in files.listStatus(root) if files.exists(root) else []:
        if folder.isDirectory() and re.fullmatch(re.escape(begin) + "[0-9a-f]{12}", folder.getPath().getName(), re.IGNORECASE):
            times = [f.getModificationTime() for f in files.listStatus(folder.getPath())] or [folder.getModificationTime()]
            found.append((max(times) / 1000, folder.getPath().toString()))
    return sorted(found)


def remove_versions(spark: SparkSession, name: str, hours: float = 24.0) -> list[str]:
    """Remove folders that a table has left more than `hours` ago; returns them.

    A folder counts as left when the next one was written, however old its own rows are, so a reader has
    `hours` to end. The folder in use stays, and so does the newest, which may be a write under way. A
    table that does not exist keeps all its folders. Files are listed by the session's JVM, which a remote
    client does not have.
    """
    if not spark.catalog.tableExists(name):
        return []
    where = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    used = where["data_type"].rstrip("/").rpartition("/")[2]
    before, gone = time.time() - hours * 3600, []
    for (_, path), (left, _) in pairwise(_versions(spark, name)):
        if left < before and path.rpartition("/")[2] != used:
            old = spark._jvm.org.apache.hadoop.fs.Path(path)
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
            gone.append(path)
    return gone


def _point(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)


def write_replace(df: DataFrame, name: str) -> DataFrame:
    """Replace a whole table: write the new rows to a folder of their own, then point the table there.

    The frame may read the table it replaces, and a failed write changes nothing. Readers always
    find a table; one under way goes on with the rows it began with, whose folder
    (`<table>__v_..`) stays until `remove_versions`. Only a change of columns drops
    and creates the table.
    """
    spark, path = df.sparkSession, _new_version(df.sparkSession, name)
    df.write.parquet(path)
    columns = [(f.name, f.dataType) for f in df.schema]
    if spark.catalog.tableExists(name) and [(f.name, f.dataType) for f in spark.table(name).schema] == columns:
        _point(spark, name, path)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=path, source="parquet", schema=df.schema)
    return spark.table(name)


def write_all(frames: Mapping[str, DataFrame], db: str) -> dict[str, DataFrame]:
    """Replace several tables. Cache or write a shared parent first."""
    return {t: write_replace(df, f"{db}.{t}") for t, df in frames.items()}


def _insert(df: DataFrame, table: str, into: str) -> None:
    wanted = [c for c, _, _ in GOVERNANCE_TABLES[table] if c in df.columns]
    checked = with_required(df.select(*wanted), required_columns(table))
    view = f"__rows_{table}_{uuid.uuid4().hex[:12]}"
    checked.createOrReplaceTempView(view)
    columns = ", ".join(f"`{c}`" for c in wanted)
    # columns left out get their default, the load time
    df.sparkSession.sql(f"INSERT INTO {into} ({columns}) SELECT {columns} FROM {view}")
    df.sparkSession.catalog.dropTempView(view)


def append_rows(df: DataFrame, db: str, table: str) -> None:
    """Append to a governance table; the load time fills itself."""
    _insert(df, table, f"{db}.{table}")


def delete_reload(df: DataFrame, db: str, table: str) -> None:
    """Empty a governance table and load it again, as one change of its folder."""
    spark, name = df.sparkSession, f"{db}.{table}"
    ensure_tables(spark, db, [table])
    path, staging = _new_version(spark, name), f"{name}{STAGING}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"{table_ddl(table, staging)} LOCATION '{path}'")
    try:
        _insert(df, table, staging)
        _point(spark, name, path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {staging}")  # its rows stay: they lie at a place of their own


def append(df: DataFrame, name: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(name)


def table_or(spark: SparkSession, name: str, defaults: DataFrame) -> DataFrame:
    """The table, or `defaults` when it is missing or empty."""
    if not spark.catalog.tableExists(name):
        return defaults
    return with_default(spark.table(name).select(*defaults.columns), defaults)


def write_doc(df: DataFrame, path: str) -> None:
    """One-row, one-column JSON text to a folder."""
    df.select(F.col(df.columns[0]).alias("value")).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, threshold: float, path: str, name: str = "", spark: SparkSession | None = None) -> None:
    """A fitted pipeline with the decision threshold that belongs to it."""
    model.write().overwrite().save(f"{path}/model")
    spark = spark or SparkSession.active()
    row = spark.createDataFrame([(name, float(threshold))], DECISION)
    row.write.mode("overwrite").json(f"{path}/decision")


def model_saved(spark: SparkSession, path: str) -> bool:
    """Whether `save_model` has left a model with its threshold at the path."""
    try:
        return bool(path) and spark.read.json(f"{path}/decision", schema=DECISION).limit(1).count() == 1
    except AnalysisException:
        return False


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, float, str]:
    decision = spark.read.json(f"{path}/decision", schema=DECISION).first()
    return PipelineModel.load(f"{path}/model"), decision["decision_threshold"], decision["name"]
