"""The statistics report of a cleaned corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators import reports, split
from corpuslake.plans.clean import clean_sentences, reason_counts
from corpuslake.sources.writers import text_report


def stats_report(articles: DataFrame, title: str = "CLEAN CORPUS - STATISTICS REPORT", good: DataFrame | None = None) -> str:
    """Totals, rejections, categories, sources, lengths, and three random sentences of each of the first ten categories.

    good: the accepted sentences, where they have been written; else they are computed for each section.
    """
    good = clean_sentences(articles) if good is None else good
    totals = good.agg(F.count("*").alias("sentences"), F.count_distinct("category").alias("categories"), F.count_distinct("source").alias("sources")).join(F.broadcast(articles.agg(F.count("*").alias("articles"))))
    first = split.first_groups(good, "category", "ord", 10).select("category")
    sample = split.sample_by_group(good.join(F.broadcast(first), "category"), "category", F.col("sentence"), 3)
    share = lambda df: df.orderBy(F.desc("n"), "value").select("value", "n", F.round("percent", 1).alias("percent"), F.repeat(F.lit("#"), F.col("bar")).alias("bar"))
    sections = {
        "Totals (articles, sentences, categories, sources)": totals.select("articles", "sentences", "categories", "sources"),
        "Rejections": reports.breakdown(reason_counts(articles)).orderBy("ord").select("reason", "n", F.round("percent", 1).alias("percent"), "flag"),
        "Categories": share(reports.distribution(good, "category")),
        "Sources": share(reports.distribution(good, "source")).limit(20),
        "Lengths (n, least, greatest, mean, median)": reports.length_stats(good).select("n", "min_words", "max_words", F.round("mean_words", 1), F.round("median_words", 1)),
        "Random sentences": sample.orderBy("category", "sentence").select("category", "sentence"),
    }
    return text_report(title, sections)
