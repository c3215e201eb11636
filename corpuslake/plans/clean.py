"""Corpus cleaning from articles to sentences, and the plans around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import clean, is_blank, token_count
from corpuslake.operators.dedup import keep_first
from corpuslake.operators.segment import sentences
from corpuslake.operators.validate import reject_reason


def attempts(articles: DataFrame) -> DataFrame:
    """One row for each blank article (reason empty_text) and each sentence: ord, pos, sentence, category, source, headline,
    reject_reason, word_count. Repeats of an accepted sentence have the reason duplicate; the first by (ord, pos) stays.

    articles: ord, text, category, source, headline. The text and the headline are cleaned once for each article, before
    its sentences are laid out; sentences of over 30 tokens are rejected, not cut. One shuffle, by sentence hash.
    """
    judged = judgements(articles)
    good = keep_first(judged.where("reject_reason IS NULL"), [F.col("sentence")], ["ord", "pos"], flag="first")
    good = good.withColumn("reject_reason", F.when(~F.col("first"), F.lit("duplicate"))).drop("first")
    out = judged.where("reject_reason IS NOT NULL").unionByName(good)
    return out.select("ord", F.coalesce("pos", F.lit(-1)).alias("pos"), "sentence", "category", "source", "headline", "reject_reason", token_count(F.col("sentence")).alias("word_count"))


def judgements(articles: DataFrame) -> DataFrame:
    """attempts without the search for repeats: an accepted sentence has no reason."""
    blank = is_blank(F.col("text"))
    base = articles.select("ord", blank.alias("blank"), "category", "source", clean(F.col("headline")).alias("headline"), F.when(~blank, sentences(clean(F.col("text")))).alias("parts"))
    laid = base.select("ord", "blank", "category", "source", "headline", F.posexplode_outer("parts").alias("pos", "sentence")).where("blank OR sentence IS NOT NULL")
    return laid.withColumn("reject_reason", F.when(F.col("blank"), "empty_text").otherwise(reject_reason(F.col("sentence"))))


def reason_counts(articles: DataFrame) -> DataFrame:
    """reject_reason and n, as grouping attempts gives them, in one pass: duplicates are accepted less distinct sentences.

    Partial counts by sentence hash, so a frequent sentence costs a row for each input partition.
    """
    accepted = F.col("reject_reason").isNull()
    each = judgements(articles).groupBy("reject_reason", F.when(accepted, F.sha2("sentence", 256)).alias("h")).agg(F.count("*").alias("c"))
    sums = each.groupBy("reject_reason").agg(F.sum("c").alias("all"), F.count("*").alias("distinct"))
    split = F.when(accepted, F.array(F.struct(F.lit(None).cast("string").alias("r"), F.col("distinct").alias("n")), F.struct(F.lit("duplicate").alias("r"), (F.col("all") - F.col("distinct")).alias("n"))))
    return sums.select(F.explode(F.coalesce(split, F.array(F.struct(F.col("reject_reason").alias("r"), F.col("all").alias("n"))))).alias("x")).select(F.col("x.r").alias("reject_reason"), "x.n")


def clean_sentences(articles: DataFrame) -> DataFrame:
    """The accepted sentences alone: later repeats are dropped before and after the shuffle by the window's group limit.

    Blank articles give no sentences. The outer explode keeps the optimizer from filtering by the number of sentences
    below it, where the whole cleaning would be computed once more, in the tasks of the scan.
    """
    base = articles.select("ord", "category", "source", clean(F.col("headline")).alias("headline"), sentences(clean(F.col("text"))).alias("parts"))
    laid = base.select("ord", "category", "source", "headline", F.posexplode_outer("parts").alias("pos", "sentence"))
    good = laid.where(F.col("sentence").isNotNull() & reject_reason(F.col("sentence")).isNull())
    return keep_first(good, [F.col("sentence")], ["ord", "pos"]).select("ord", "pos", "sentence", "category", "source", "headline", token_count(F.col("sentence")).alias("word_count"))
