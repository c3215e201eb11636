"""Work that can be interrupted: pending rows by anti-join, and idempotent batches, plain or streamed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(df: DataFrame, done: DataFrame, key: str = "original_id") -> DataFrame:
    """Rows of df whose id isn't done, ids compared as text. An anti join: a null done id removes nothing."""
    ids = done.select(F.col(key).cast("string").alias("_done")).distinct()
    return df.join(ids, df[key].cast("string") == F.col("_done"), "left_anti")


def write_batch(df: DataFrame, path: str, batch_id: int | str) -> None:
    """Rows of a batch under their own folder, replaced as a whole: writing a batch again changes nothing."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_batches(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, batches: int, key: str = "original_id") -> None:
    """work over df in `batches` parts by hash of the key; parts that are already written are skipped."""
    spark = df.sparkSession
    for b in range(batches):
        if not exists(spark, f"{path}/batch={b}/_SUCCESS"):
            write_batch(work(df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches)) == b)), path, b)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stream(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """work over the Parquet files that arrive in `source`, once each; stops when all present files are done.

    A batch that a failure interrupts is written again to the same folder, so no row is lost or doubled.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, b: write_batch(work(df), path, b)).start()
