"""Exact, reproducible splits and samples by hash rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.operators.dedup import fresh


def hash_rank(df: DataFrame, key: Column, salt: str, out: str = "rank") -> DataFrame:
    """df with the 1-based rank of each row in the order of md5(salt:key), then key.

    No global sort: rows are ranked inside each of the 4096 ranges that the digest's first three digits name, and
    the ranges' counts, a table of 4096 rows, give the offsets. The salted digest spreads any key evenly.
    """
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    h, r, i, o = (fresh(df, f"{x}_of_rank") for x in ("digest", "range", "place", "offset"))
    keyed = df.withColumn(h, digest).withColumn(r, F.substring(h, 1, 3))
    before = Window.orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(r).agg(F.count("*").alias(o))
    offsets = counts.select(r, F.coalesce(F.sum(o).over(before), F.lit(0)).alias(o))
    inside = Window.partitionBy(r).orderBy(h, key)
    return keyed.withColumn(i, F.row_number().over(inside)).join(F.broadcast(offsets), r).withColumn(out, F.col(i) + F.col(o)).drop(h, r, i, o)


def shuffled(df: DataFrame, key: Column, salt: str = "42") -> DataFrame:
    """df in a reproducible random order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), key)


def three_way(df: DataFrame, key: Column, salt: str = "42") -> DataFrame:
    """df with split: 40 % rule_input, then two thirds of the rest llm_input and a third mt_input, by exact counts."""
    n = df.count()
    rest = -(-6 * n // 10)
    mt = -(-3333 * rest // 10000)
    rule, llm = n - rest, rest - mt
    r = F.col("rank")
    return hash_rank(df, key, salt).withColumn("split", F.when(r <= rule, "rule_input").when(r <= rule + llm, "llm_input").otherwise("mt_input")).drop("rank")


def dev_test_train(df: DataFrame, key: Column, dev: int, test: int, train: int | None = None, salt: str = "42") -> DataFrame:
    """df with split: the first `dev` rows in random order, then `test`, then the rest (or `train` of it)."""
    n = df.count()
    if dev + test > n:
        raise ValueError(f"dev and test need {dev + test} rows of {n}")
    r = F.col("rank")
    out = hash_rank(df, key, salt).withColumn("split", F.when(r <= dev, "dev").when(r <= dev + test, "test").otherwise("train"))
    if train is not None:
        out = out.where(r <= dev + test + train)
    return out.drop("rank")


def sample_by_group(df: DataFrame, group: str, key: Column, k: int, salt: str = "42") -> DataFrame:
    """Up to k random rows of each group; the group limit keeps a group's rows per partition at k before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), key)
    rank = fresh(df, "rank")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).drop(rank)


def first_groups(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The n groups seen first: group and the least `order`."""
    return df.groupBy(group).agg(F.min(order).alias("first_seen")).orderBy("first_seen", group).limit(n)
