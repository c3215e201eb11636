"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TWO64 = "18446744073709551616"
_FACTOR = "2862933555777941757"


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the bucket of a 64-bit key among shards, and among shards + 1.

    The generator's next state is key * 2862933555777941757 + 1 modulo 2**64, in decimal(38, 0), which holds
    the product. At most `shards` steps; the expression stops changing once the candidate is past the end.
    A null key counts as 0.
    """
    dec = lambda c: c.cast("decimal(38,0)")
    two64, factor = F.lit(_TWO64).cast("decimal(20,0)"), F.lit(_FACTOR).cast("decimal(19,0)")
    k = F.coalesce(key.cast("long"), F.lit(0))
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), dec(F.when(k < 0, dec(k) + two64).otherwise(dec(k))).alias("k"))

    def step(s: Column, _: Column) -> Column:
        nxt = (s["k"].cast("decimal(20,0)") * factor + F.lit(1)).cast("decimal(38,0)") % two64
        return F.when(s["j"] >= shards, s).otherwise(
            F.get(F.transform(F.array(dec(nxt)), lambda n: F.struct(
                s["j"].alias("b"),
                F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.floor(n / F.lit("8589934592").cast("decimal(10,0)")).cast("long") + 1).cast("double"))).cast("long").alias("j"),
                n.alias("k"),
            )), F.lit(0))
        )

    last = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return F.get(F.transform(F.array(last), lambda s: F.struct(s["b"].cast("int").alias("shard"), F.when(s["j"] == shards, F.lit(shards)).otherwise(s["b"]).cast("int").alias("grown"))), F.lit(0))


def shard(docs: DataFrame, shards: int = 24, spread: int | None = None) -> DataFrame:
    """Place each document by its doc_id: size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32: of the UTF-8 bytes (null: 0); slot: gapless from 0 in each shard;
    grown_shard: the shard if one is appended. Null doc_ids count as 0; repeated rows get a slot each; other
    columns are ignored; an empty table gives no rows.

    A shard grows with the data, so slots aren't numbered in one task: rows are numbered inside
    (shard, part), and the parts' row counts (shards * spread rows, a fixed number) give the offsets.
    """
    spread = spread or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump(F.col("doc_id"), shards).alias("at"),
        F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("part"),
    ).select("doc_id", "size", "text_crc32", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"), "part")
    ids = docs.select(jump(F.col("doc_id"), shards)["shard"].alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("part"))
    counts = ids.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )
