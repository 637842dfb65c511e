"""Streaming extension: files arriving in a folder become boxes, page by page.

One file is one document, so per-page operators stay stateless; operators that need all
pages of a document run inside a micro-batch, which holds whole files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.pdfxml import parse_boxes


def stream_documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (doc_id, xml), a row per file."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"))


def stream_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of box rows."""
    return parse_boxes(stream_documents(spark, folder))


def run_documents(documents: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Apply a whole-document plan to each micro-batch; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
