"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text leaves 1 on division by 3."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def first_by_hash(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, ...), those of least hash: a sample that any rerun repeats."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of usable training labels: known, not held out, one per document (ties: the largest)."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
    rows = rows.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))
