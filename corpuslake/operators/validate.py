"""Sentence and row filters with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.text import ascii_letters, block_chars, let, letters, strip, tokens


def occurs(words: Column, least: Column) -> Column:
    """Whether an element occurs `least` times or more. Sorted, such an element stands at two places that far apart."""
    by_order = lambda x: F.exists(F.sequence(F.lit(0), F.size(x["w"]) - x["k"]), lambda i: F.get(x["w"], i) == F.get(x["w"], i + x["k"] - 1))
    # with so many different elements none can occur so often
    return F.when(F.size(words) - F.size(F.array_distinct(words)) + 1 < least, False).otherwise(let(F.struct(F.sort_array(words).alias("w"), least.alias("k")), by_order))


def reject_reason(sentence: Column) -> Column:
    """The first rule that a sentence breaks, or null."""

    def of(w: Column) -> Column:
        long = F.greatest(F.length(sentence), F.lit(1)).cast("double")
        return (
            F.when(F.size(w) < 5, "too_short")
            .when(F.size(w) > 30, "too_long")
            .when(sentence.rlike("[A-Za-z]") & (ascii_letters(sentence) / long > 0.20), "latin_heavy")
            .when(~sentence.rlike(r"\A(?:[^؀-ۿ]*+[؀-ۿ]){10}"), "no_urdu_chars")
            .when(sentence.rlike("[طظغ]{3,}"), "mojibake")
            .when(letters(sentence) / long < 0.50, "mostly_symbols")
            .when(occurs(w, F.floor(F.size(w) * 7 / 20).cast("int") + 1), "repetitive")  # over 0.35 of the words
        )

    return let(tokens(sentence), of)


def in_script(text: Column) -> Column:
    """A text of five characters or more, half of them in the Arabic block."""
    t = strip(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 5) & (block_chars(t) * 2 >= F.length(t))


def not_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (strip(F.col(column)) != ""))


def accepted_pairs(df: DataFrame) -> DataFrame:
    """Pairs whose corruption exists, differs and has two tokens or more."""
    bad, good = F.col("incorrect_sentence"), F.col("correct_sentence")
    return df.where(bad.isNotNull() & (bad != good) & (F.size(tokens(bad)) >= 2))


def accepted_eval(df: DataFrame) -> DataFrame:
    """Evaluation rows with two texts that differ."""
    bad, good = F.col("error_sentence"), F.col("correct_sentence")
    return df.where((bad != "") & (good != "") & (bad != good))


def require_script(df: DataFrame, column: str, least: int = 10) -> None:
    """Raise if the first text that isn't blank has fewer characters of the block."""
    row = not_blank(df, column).select(block_chars(F.col(column)).alias("n")).limit(1).collect()
    if not row or row[0]["n"] < least:
        raise ValueError(f"column {column!r} holds no text in the expected script")


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("no rows are left")


def blank_and_pending(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows without text, which count as done, and the rows to work on."""
    blank = F.col(column).isNull() | (strip(F.col(column)) == "")
    return df.where(blank), df.where(~blank)
