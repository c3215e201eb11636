"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._base import lower_ascii, words_col

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    """the of and to in a is that for it as was with be by on not he his are this from at or an have
    le la les de des du et en un une que qui dans pour pas sur au avec est par il elle ce
    der die das und zu den von mit ist ein eine auf für nicht im dem sich als auch es
    el los las y del se por con una su para al lo como más o pero sus""".split()
)

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; the measure is an SQL expression over the measures' columns."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The threshold table. Ratios are over words or lines and are compared as doubles.
RULES = (
    Rule("length", "n_words", 20, 10_000_000),
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / n_words", high=0.1),
    Rule("bang_ratio", "n_bangs / n_words", high=0.3),
    Rule("shout_ratio", "n_upper / n_letters", high=0.5),
    Rule("stop_word_ratio", "n_stop_words / n_words", low=0.05),
    Rule("word_variety", "n_distinct_words / root_words", low=2.5),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", high=0.5),
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, k: int = 8) -> Column:
    """How many words lie in a window of k words that occurs twice or more in the text.

    Windows are compared by 64-bit hash. Texts whose windows all differ stop after one hash set; else the
    sorted (hash, position) pairs give the repeated positions, and each covers k words less its overlap
    with the next.
    """

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(k), F.get(at, i + 1) - p)).otherwise(k))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeats(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def positions(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        return let(let(pairs, positions), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats(h)))

    return let(words, lambda w: F.when(F.size(w) <= k, F.lit(0)).otherwise(windows(w))).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text with the measures as columns; other columns are dropped. A null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda regex: F.regexp_count(body, F.lit(regex)).cast("long")
    stop = lambda w: lower_ascii(F.rtrim(w, F.lit(",.;:!?"))).isin(*STOP_WORDS)
    parts = docs.select(
        "doc_id",
        let(words_col(body), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            F.size(F.filter(w, stop)).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        )).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        count(f"[{SYMBOLS}]").alias("n_symbols"),
        count("!").alias("n_bangs"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"\p{L}").alias("n_letters"),
    )
    return parts.select("doc_id", "w.*", "l.*", "n_symbols", "n_bangs", "n_upper", "n_letters", F.sqrt("w.n_words").alias("root_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds; a ratio over nothing passes."""
    out = F.lit(True)
    for r in rules:
        if "/" in r.measure:
            over, under = (F.col(x.strip()) for x in r.measure.split("/"))
            value = F.when(under == 0, F.lit(None)).otherwise(over.cast("double") / under)
        else:
            value = F.col(r.measure).cast("double")
        ok = F.lit(True)
        if r.low != float("-inf"):
            ok = ok & (value >= r.low)
        if r.high != float("inf"):
            ok = ok & (value <= r.high)
        out = out & F.coalesce(ok, F.lit(True))
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """One row for each document: its measures, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: false if
    base_failed, else the verdict of the table. Null and empty texts have no words and fail; repeated rows
    each get a row; other columns, whatever their names, are ignored; an empty table gives none. One
    projection: no shuffle, no user function.
    """
    m = measures(docs, text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names.

    Null, empty and blank texts have no words, fail the base rule and go, also where doc_id is null; repeated rows are
    judged alike; texts of any length are judged whole; an empty table gives an empty one.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = quality_columns(inner, "row.text", rules)
    return judged.where("kept").select("row.*")


def quality_columns(df: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """df (one column, row) with kept beside it."""
    m = measures(df.select(F.col("row").alias("doc_id"), F.col(text).alias("text")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.select(F.col("doc_id").alias("row"), (~failed & verdict(rules)).alias("kept"))
