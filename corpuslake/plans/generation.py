"""Model runs end to end: restartable error generation, and correction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.chat import correction_messages, generation_messages, plain_prompt
from corpuslake.functions.text import prediction
from corpuslake.operators.align import error_pairs, failed_raw
from corpuslake.operators.dedup import fresh
from corpuslake.operators.generate import CORRECTION, ERROR_GENERATION, Decoding, Factory, generate
from corpuslake.operators.validate import blank_and_pending
from corpuslake.streaming.resume import exists, pending, write_batch


def generate_errors(rows: DataFrame, factory: Factory, path: str, batches: int = 16, name: str = "generator", keep_failed: bool = False, decoding: Decoding = ERROR_GENERATION) -> int:
    """Error pairs of the rows (original_id, sentence, others) that earlier calls on `path` haven't done; the batches written.

    A batch has its rows by hash of the id. It writes the model's outputs, then the pairs, then the outputs that lack
    some of the six types, and its ids last. A call that breaks off loses its last batch alone: the next call begins with
    a batch of the same number, whose folders it replaces. Rows without a sentence are done at once and have no pairs.
    """
    spark = rows.sparkSession
    number = 0
    while exists(spark, f"{path}/done/batch={number}/_SUCCESS"):
        number += 1
    left = pending(rows, spark.read.parquet(*[f"{path}/done/batch={i}" for i in range(number)])) if number else rows
    blank, todo = blank_and_pending(left, "sentence")
    if left.isEmpty():
        return 0
    parts = [(None, blank)] + [(b, todo.where(F.pmod(F.xxhash64(F.col("original_id").cast("string")), F.lit(batches)) == b)) for b in range(batches)]
    written = 0
    for b, part in parts:
        ids = part
        if b is not None:
            prompt = fresh(part, "prompt")
            asked = part.withColumn(prompt, plain_prompt(generation_messages(F.col("sentence"))))
            write_batch(generate(asked, prompt, factory, "raw_output", decoding.batch).drop(prompt), f"{path}/raw", number)
            ids = spark.read.parquet(f"{path}/raw/batch={number}")
            write_batch(error_pairs(ids, name, keep_failed), f"{path}/pairs", number)
            write_batch(failed_raw(ids), f"{path}/failed", number)
        write_batch(ids.select(F.col("original_id").cast("string").alias("original_id")), f"{path}/done", number)
        number, written = number + 1, written + 1
    return written


def finished(rows: DataFrame, path: str, kind: str = "pairs") -> DataFrame:
    """What the finished batches of generate_errors have written: pairs, failed or raw."""
    spark, found, i = rows.sparkSession, [], 0
    while exists(spark, f"{path}/done/batch={i}/_SUCCESS"):
        if exists(spark, f"{path}/{kind}/batch={i}/_SUCCESS"):
            found.append(f"{path}/{kind}/batch={i}")
        i += 1
    return spark.read.parquet(*found)


def corrected(rows: DataFrame, factory: Factory, column: str = "error_sentence", out: str = "prediction", decoding: Decoding = CORRECTION) -> DataFrame:
    """rows with a model's correction of a column, reduced to the corrected sentence."""
    prompt = fresh(rows, "prompt")
    asked = rows.withColumn(prompt, plain_prompt(correction_messages(F.coalesce(column, F.lit("")))))
    return generate(asked, prompt, factory, out, decoding.batch).withColumn(out, prediction(F.col(out))).drop(prompt)
