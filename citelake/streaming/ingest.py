"""Resumable ingestion of raw records: a file stream, replays dropped by watermark, the latest payload of a key kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from citelake.operators.ingest import latest

SCHEMA = "source string, external_id string, payload string, fetched_at timestamp"


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def fresh(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Repeated deliveries of a record go; state older than the delay is dropped."""
    return records.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["source", "external_id", "payload"])


def start(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its own folder: a replayed batch overwrites itself, so restarts are idempotent."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, ["source", "external_id"], "fetched_at").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The latest payload of every key over all batches."""
    return latest(spark.read.schema(SCHEMA).option("basePath", target).parquet(f"{target}/batch=*"), ["source", "external_id"], "fetched_at")
