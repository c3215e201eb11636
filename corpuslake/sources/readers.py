"""Readers: CSV with encoding checks, JSON lines, done ids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L
from corpuslake.functions.chat import pair_of_line
from corpuslake.functions.text import block_chars, strip
from corpuslake.operators.dedup import fresh, keep_first

#: Names as the CSV reader takes them; utf-8 covers files with a byte order mark too. The reader doesn't take code page
#: 1256, whose bytes are read one to one and then mapped.
ENCODINGS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1256": "ISO-8859-1", "latin1": "ISO-8859-1"}
_HIGH = bytes(range(128, 256))


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without leading byte order marks and other characters that aren't of a word."""
    return df.toDF(*[re.sub(r"^[﻿\W]+", "", c) for c in df.columns])


def resolve(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of names that is a column, exactly, else in any case."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((n for n in names if n in df.columns), None) or next((lower[n.lower()] for n in names if n.lower() in lower), None)


def sniff_text_column(df: DataFrame) -> str | None:
    """The first column whose first row holds a letter of the script."""
    row = df.limit(1).collect()
    return next((c for c in df.columns if row and any(x in L.SNIFFED_LETTERS for x in str(row[0][c]))), None)


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """All columns as text; quotes as in RFC 4180, line breaks inside them included."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=ENCODINGS.get(encoding, encoding), inferSchema=False)
    if encoding == "cp1256":
        high = str.maketrans(_HIGH.decode("latin1"), _HIGH.decode("cp1256"))
        df = df.select(*[F.translate(F.col(f"`{c}`"), _HIGH.decode("latin1"), _HIGH.decode("cp1256")).alias(c.translate(high)) for c in df.columns])
    return clean_header(df)


def read_news_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8-sig", "utf-8", "cp1256"), least: int = 20) -> tuple[DataFrame, str]:
    """The frame and the first encoding in which the first three rows hold over `least` characters of the block; else ValueError."""
    for name in encodings:
        try:
            df = read_csv(spark, path, name)
            n = df.limit(3).select(F.sum(sum((F.coalesce(block_chars(F.col(f"`{c}`")), F.lit(0)) for c in df.columns), F.lit(0))).alias("n")).first()["n"]
        except Exception as e:  # an encoding that the runtime doesn't know or can't apply
            if "encoding" not in str(e).lower() and "charset" not in str(e).lower():
                raise
            continue
        if n and n > least:
            return df, name
    raise ValueError(f"none of {', '.join(encodings)} gives text in the expected script: {path}")


def read_csv_auto(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """All columns as text, null as the empty text, in the first encoding without replacement characters anywhere; the search ends at the first one."""
    for name in ("utf-8-sig", "utf-8", "cp1256", "latin1"):
        df = read_csv(spark, path, name)
        bad = [F.contains(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit("�")) for c in df.columns]
        if bad and df.where(F.greatest(*bad) if len(bad) > 1 else bad[0]).isEmpty():
            break
    df = df.na.fill("")
    return df.limit(nrows) if nrows is not None else df


def with_ordinal(df: DataFrame, out: str = "ord") -> DataFrame:
    """df with the rows' places in the file, from 0. For files without an id; a source with one should use that.

    A row's place is its place in its partition and the sizes of the partitions before, a table of one row each. df is
    read twice and must give the same partitions both times, as scans of files do.
    """
    at = fresh(df, "place")
    placed = df.withColumn(at, F.monotonically_increasing_id())  # the partition from bit 33 on
    part = F.shiftright(at, 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    sizes = sizes.toDF(fresh(df, "part"), fresh(df, "offset"))
    joined = placed.join(F.broadcast(sizes), part == sizes[sizes.columns[0]])
    return joined.withColumn(out, F.col(at).bitwiseAND((1 << 33) - 1) + sizes[sizes.columns[1]]).drop(at, *sizes.columns)


def row_range(df: DataFrame, start: int = 0, end: int = -1, ordinal: str = "ord") -> DataFrame:
    """Rows from start up to end, if that is positive."""
    out = df.where(F.col(ordinal) >= start)
    return out.where(F.col(ordinal) < end) if end > 0 else out


def news_articles(df: DataFrame) -> DataFrame:
    """text, category, source and headline by known column names; ValueError without a text column."""
    text = resolve(df, L.TEXT_NAMES)
    if text is None:
        raise ValueError(f"no text column among {df.columns}")
    optional = lambda names, default: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) if (c := resolve(df, names)) else F.lit(default)
    keep = [c for c in ("ord",) if c in df.columns]
    return df.select(*keep, F.col(f"`{text}`").alias("text"), optional(L.CATEGORY_NAMES, "Unknown").alias("category"), optional(L.SOURCE_NAMES, "").alias("source"), optional(L.HEADLINE_NAMES, "").alias("headline"))


def eval_rows(lines: DataFrame, start: int = 0, limit: int = -1) -> DataFrame:
    """sample_id, error_sentence, correct_sentence from JSON lines (line_id, value).

    Lines before `start`, blank lines and lines that can't be read are skipped; of the acceptable rows the first
    `limit` stay, before repeated pairs go (the first stays).
    """
    rows = lines.where(F.col("line_id") >= start).select("line_id", pair_of_line(F.col("value")).alias("p")).select(F.col("line_id").alias("sample_id"), "p.*")
    rows = rows.where("error_sentence <> '' AND correct_sentence <> '' AND error_sentence <> correct_sentence")
    if limit >= 0:
        rows = rows.orderBy("sample_id").limit(limit)
    return keep_first(rows, [F.col("error_sentence"), F.col("correct_sentence")], ["sample_id"])


def read_chat_jsonl(spark: SparkSession, path: str, start: int = 0, limit: int = -1) -> DataFrame:
    """eval_rows of a file; ValueError if none is left."""
    out = eval_rows(with_ordinal(spark.read.text(path), "line_id"), start, limit)
    if out.isEmpty():
        raise ValueError(f"no usable rows: {path}")
    return out


def read_done_ids(spark: SparkSession, done_path: str | None, output_path: str | None = None, scan_output: bool = True) -> DataFrame:
    """Distinct ids of a text file (blank lines skipped) and of earlier output; what isn't there counts as empty."""
    out = spark.createDataFrame([], "original_id string")
    for path, ids in ((done_path, lambda p: spark.read.text(p).select(strip(F.col("value")).alias("original_id"))), (output_path if scan_output else None, lambda p: read_csv(spark, p).select("original_id"))):
        if path:
            try:
                out = out.unionByName(ids(path))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
    return out.where("original_id IS NOT NULL AND original_id <> ''").distinct()


def chat_lines(conversations: DataFrame) -> DataFrame:
    """line_id and a JSON line for each conversation (conv_id, turn, role, text), messages in the order of turns."""
    w = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return conversations.groupBy("conv_id").agg(w.alias("m")).select(F.col("conv_id").alias("line_id"), F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("value"))


