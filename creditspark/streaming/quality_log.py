"""Quality results that arrive as JSON files, appended to the log table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.sources.schema import QUALITY_PAYLOAD_SCHEMA


def log_rows(payloads: DataFrame) -> DataFrame:
    """Project, bucket and results as JSON text, with the arrival time."""
    text = F.coalesce(F.to_json("results", {"ignoreNullFields": "false"}), F.lit("{}"))
    return payloads.select(
        "gcp_project", "gcs_bucket", text.alias("results"), F.current_timestamp().alias("fecha_registro")
    )


def quality_log_stream(
    spark: SparkSession, in_dir: str, table: str, checkpoint: str, files_per_batch: int = 10_000
) -> None:
    """Append every file not seen before, then stop.

    The checkpoint remembers files, so running it again adds nothing; two
    results with the same content in two files are two rows.
    """
    payloads = (
        spark.readStream.schema(QUALITY_PAYLOAD_SCHEMA)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(in_dir)
    )
    query = (
        log_rows(payloads)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .toTable(table, format="parquet")
    )
    query.awaitTermination()
