"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``, extra ones too, whatever their names.

In every stage null and empty texts are documents without words: they are never rejected for their
text, repeated, near a copy or contaminated, and encode to no tokens. Rows without an id are documents
named by their text, rows equal in id and text come out alike, of ties the smallest id counts as first,
and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from folioframe.llm._shared import table
from folioframe.llm.queries import vocabulary
from folioframe.sources.staging import dropped, shared_dir, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier, trained on ``labels``, does not reject; unlabelled documents and those without an id are judged too."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks and runs of lines that an earlier document has; n_chars follows the text, null for a null one."""
    out = line_dedup.dedup_lines(docs, passages=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one of the smallest id."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents no benchmark item leaks into; items without an id count, those without a text do not."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to; a row for each row."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: No SQL: the classifier, the tokenizer and the tiling cannot be expressed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on ``documents``; a stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            dropped(spark, before)
        before = path
    return docs
