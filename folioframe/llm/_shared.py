"""Session helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.sources.staging import Scratch, bounded_batches, shared_dir
from folioframe.sources.staging import staged as stored

__all__ = ["Scratch", "bounded_batches", "shared_dir", "stored", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; the operators read it in Arrow batches of bounded size."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
