"""First-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keep_first(df: DataFrame, keys: list[Column], order: list[str], flag: str | None = None) -> DataFrame:
    """The first row of each key in the given order; with flag, all rows and whether each is the first.

    A window by a hash of the key: without flag, its group limit drops later rows before and after the shuffle,
    so a frequent key costs a row for each input partition.
    """
    key = F.sha2(F.to_json(F.array(*[k.cast("string") for k in keys])), 256) if len(keys) > 1 else F.sha2(keys[0].cast("string"), 256)
    by, rank = fresh(df, "key"), fresh(df, "rank")
    w = Window.partitionBy(by).orderBy(*order)
    ranked = df.withColumn(by, key).withColumn(rank, F.row_number().over(w))
    if flag:
        return ranked.withColumn(flag, F.col(rank) == 1).drop(*{by, rank} - {flag})
    return ranked.where(F.col(rank) == 1).drop(by, rank)


def duplicate_count(df: DataFrame, column: str) -> DataFrame:
    """One row: rows less distinct values (n_duplicates)."""
    each = df.groupBy(column).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
