"""Restartable ingestion: each file once, and a re-run adds nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keratoline import schemas
from keratoline.operators.joins import not_in_ledger


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The files done so far; empty before the first run."""
    return spark.read.schema(schemas.LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], schemas.LEDGER)


def batched(files: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(files with `batch`, number of batches): so many batches that each holds about `most` bytes by `length`, files being spread by their path. Of no files there is none."""
    files_n, size = files.agg(F.count(F.lit(1)), F.sum("length")).first()
    n = max(1, -(-size // most)) if files_n else 0
    return files.withColumn("batch", F.pmod(F.xxhash64("path"), F.lit(max(n, 1))).cast("int")), n


def new_commit() -> str:
    return f"c{uuid.uuid4().hex}"


def commit(keys: DataFrame, done: str, name: str | None) -> None:
    """Enters the keys (path) into the ledger, in one file and so all or none. Rows written under this name count from now on."""
    keys.select("path", F.lit(name).cast("string").alias("commit")).coalesce(1).write.mode("append").parquet(done)


def committed(spark: SparkSession, table: str, done: str) -> DataFrame:
    """The rows of a table whose `commit` the ledger holds; what a run wrote before it failed is not among them."""
    names = ledger(spark, done).select("commit").where("commit is not null").distinct()
    return spark.read.parquet(table).join(names, "commit", "left_semi")


def run_once(spark: SparkSession, files: DataFrame, process: Callable[[DataFrame], DataFrame], table: str, done: str, key: str = "path") -> int:
    """Processes the files that the ledger lacks; returns how many. Files without rows are entered too. `key` is what the ledger holds.

    Rows are appended with the batch's files, and readers take each (path,
    event) once, so a crash between the two writes repeats work, not rows.
    """
    new = not_in_ledger(files, ledger(spark, done).select(F.col("path").alias(key)), key).select(*files.columns)
    paths = new.select(F.col(key).alias("path")).distinct().cache()
    n = paths.count()
    if n:
        process(new).write.mode("append").parquet(table)
        paths.write.mode("append").parquet(done)
    paths.unpersist()
    return n


def rows_once(spark: SparkSession, table: str, keys: tuple[str, ...] = ("path", "event")) -> DataFrame:
    """The table's rows, each key once."""
    return spark.read.parquet(table).dropDuplicates(list(keys))


def ingest_stream(spark: SparkSession, root: str, process: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, pattern: str = "*.dcm"):
    """Takes what is new below a folder and stops; the checkpoint is the ledger.

    Each micro-batch overwrites its own partition, so a batch that is run again
    after a crash replaces its rows.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
