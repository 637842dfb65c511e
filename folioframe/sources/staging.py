"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and Python: many long texts or large images do not meet in one batch.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches where the session sets no lower bound itself."""
    if int(spark.conf.get(_BATCH, str((1 << 31) - 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to about as many tasks as a shuffle has; Spark does not put them together again.

    For rows that are costly to work on but short, or long but compress well, like page images: by their bytes Spark
    would give all of them to one or two tasks. Their number is another than a shuffle's, else Spark takes an earlier
    shuffle by the same keys for this one; up to 200 are written to disk without being held in memory.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    usual, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    n = max(min(usual, 200), cores)
    return rows.repartition(n if n != usual else n - 1 if n > cores else n + 1, *keys)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster names in spark.checkpoint.dir.

    The setting is read from the session. Where it is unset, as in tests, the folder lies in the
    session's warehouse, which executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    if base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[5:]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` made."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a new table in the shared folder.

    Plans that use a result several times compute it once, and a lost executor repeats only
    what follows.
    """
    return written(df, shared_dir(df.sparkSession, name))


def arrow_files(uri: str):
    """(file system, path) of a folder for reading and writing bytes in tasks.

    Hadoop's names for S3 are mapped; a scheme that has no file system here fails with its name.
    """
    from pyarrow import ArrowInvalid, fs

    scheme, _, rest = uri.partition("://")
    try:
        return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)
    except ArrowInvalid as e:
        raise ValueError(f"no file system for {scheme}:// paths is available to tasks: {uri}") from e


class Scratch:
    """Tables of one run in a folder of their own, deleted together when what needs them is stored."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.number = spark, shared_dir(spark, name), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        return written(df, f"{self.folder}/{self.number:03d}-{name}")

    def drop(self) -> None:
        dropped(self.spark, self.folder)
