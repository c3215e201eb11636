"""Reports over attempted and accepted sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L
from corpuslake.functions.text import block_chars


def reject_breakdown(attempts: DataFrame) -> DataFrame:
    """A row for each reason, zeros too: reason, n, percent of all attempts, unit, and HIGH where two reasons exceed 5000.

    attempts: one row for each attempt, with reject_reason (null: accepted).
    """
    return breakdown(attempts.groupBy("reject_reason").agg(F.count("*").alias("n")))


def breakdown(counts: DataFrame) -> DataFrame:
    """reject_breakdown from counts (reject_reason, n), which are read once."""
    spark = counts.sparkSession
    reasons = spark.createDataFrame([(i, r, "article" if r == "empty_text" else "sentence") for i, r in enumerate(L.REJECT_REASONS)], "ord int, reason string, unit string")
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
    rows = reasons.join(counts, reasons.reason == counts.reject_reason, "left")
    n = F.coalesce("n", F.lit(0))
    high = F.when(F.col("reason").isin("mojibake", "no_urdu_chars") & (n > 5000), "HIGH").otherwise("")
    return rows.select("ord", "reason", "unit", n.alias("n"), F.coalesce(F.try_divide(100.0 * n, F.col("total")), F.lit(0.0)).alias("percent"), high.alias("flag"))


def length_stats(df: DataFrame, column: str = "word_count") -> DataFrame:
    """One row: count, least, greatest, mean, median (mean of the middle two) and upper median of a length.

    Lengths are counted before they are ordered, so the order is over the distinct lengths alone.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    low, high = at(F.floor((F.col("total") - 1) / 2)), at(F.floor(F.col("total") / 2))
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("v").alias("min_words"), F.max("v").alias("max_words"),
        F.try_divide(F.sum(F.col("v") * F.col("n")).cast("double"), F.sum("n").cast("double")).alias("mean_words"), ((low + high) / F.lit(2.0)).alias("median_words"), high.alias("upper_median"),
    )


def quality_checks(df: DataFrame) -> DataFrame:
    """The seven checks of accepted sentences as check, passed, detail.

    One pass: counts by sentence and, beside them, by category, which are few rows. All other sums are over the sentences.
    """
    c = F.col
    is_sentence = F.grouping("sentence") == 0
    each = df.groupingSets([["sentence"], ["category"]], "sentence", "category").agg(
        is_sentence.alias("by_sentence"), F.count("*").alias("c"), F.sum("word_count").alias("words"), F.count("word_count").alias("counted"), F.max("word_count").alias("longest")
    )
    over = lambda cond, n: F.coalesce(F.sum(F.when(c("by_sentence") & cond, n)), F.lit(0))
    every = F.lit(True)
    one = each.agg(
        over(every, c("c")).alias("n"), over(c("sentence").isNull(), c("c")).alias("nulls"), over(block_chars(c("sentence")) < 5, c("c")).alias("few"), over(every, c("c") - 1).alias("dup"),
        F.try_divide(over(every, c("words")).cast("double"), over(every, c("counted"))).alias("mean"), F.max("longest").alias("longest"), over(c("sentence").rlike("[طظغ]{3,}"), c("c")).alias("moji"),
        F.count_if(~c("by_sentence") & c("category").isNotNull()).alias("cats"),
    )
    ok = lambda name, cond, detail: F.struct(F.lit(name).alias("check"), F.coalesce(cond, F.lit(False)).alias("passed"), F.coalesce(detail.cast("double"), F.lit(0.0)).alias("detail"))
    checks = F.array(
        ok("not_empty", c("n") > 0, c("n")), ok("no_nulls", c("nulls") == 0, c("nulls")), ok("in_script", c("few") == 0, c("few")), ok("no_duplicates", c("dup") == 0, c("dup")),
        ok("length_in_range", (c("mean") > 4) & (c("mean") < 31) & (c("longest") <= 30), c("longest")), ok("no_mojibake", c("moji") == 0, c("moji")), ok("several_categories", c("cats") > 1, c("cats")),
    )
    return one.select(F.explode(checks).alias("x")).select("x.*")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count, percent of all and bar length (half of the percent, cut) of each value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    percent = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", percent).withColumn("bar", F.floor(F.col("percent") / 2).cast("int"))


def top_values(df: DataFrame, column: str, order: str, k: int = 20) -> DataFrame:
    """The k most frequent values; ties go to the one seen first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen", "value").limit(k)


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def texts_longer_than(df: DataFrame, column: Column, n: int = 20) -> DataFrame:
    return df.agg(F.count_if(F.length(F.trim(column)) > n).alias("n_long"))
