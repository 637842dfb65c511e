"""Sinks: tables as CSV, page grids as JSON, documents as XML files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators.grid import document_json


def union_tables(*tables: DataFrame) -> DataFrame:
    """All rows of tables whose columns differ; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header; every field quoted, since cells may hold line ends."""
    table.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def write_grids(grid: DataFrame, path: str) -> None:
    """One JSON line per document: page number to rows of [[left, top], [right, bottom]]."""
    document_json(grid).select("grids").write.mode("overwrite").text(path)


def write_xml(docs: DataFrame, path: str) -> None:
    """(doc_id, xml) as text files in a folder for each document."""
    docs.write.mode("overwrite").partitionBy("doc_id").text(path)
