"""Writers: CSV, text, JSON records and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def append_csv(df: DataFrame, path: str) -> None:
    """Rows join an earlier output; each part file has a header."""
    write_csv(df, path, "append")


def export_csv(df: DataFrame, path: str) -> None:
    """One local file with a byte order mark, row by row from the driver; for reports and hand-overs, not for corpora."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The text column `value`, lines as they are."""
    df.select("value").write.mode(mode).text(path)


def append_ids(ids: DataFrame, path: str, column: str = "original_id") -> None:
    write_lines(ids.select(F.col(column).cast("string").alias("value")), path, "append")


def append_records(df: DataFrame, path: str) -> None:
    """Each row as a JSON line."""
    write_lines(df.select(F.to_json(F.struct("*")).alias("value")), path, "append")


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """Lines by split, one folder for each."""
    df.select("value", column).write.mode("overwrite").partitionBy(column).text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row frame as a JSON file, indented, not escaped to ASCII."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(df.first().asDict(), f, ensure_ascii=False, indent=2)


def text_report(title: str, sections: dict[str, DataFrame]) -> str:
    """Small report frames as text; they have a row for each reason, category or check."""
    lines = ["=" * 60, f"  {title}", "=" * 60]
    for name, df in sections.items():
        lines.append(f"\n-- {name}")
        lines += ["  " + "  ".join(str(v) for v in row) for row in df.collect()]
    return "\n".join(lines) + "\n"


def review_text(sample: DataFrame, totals: DataFrame) -> str:
    """Sampled sentences by category for reading; a category named nan is left out."""
    total = {r["value"]: r["n"] for r in totals.collect()}
    groups: dict[str, list[str]] = {}
    for r in sample.orderBy("category").collect():
        groups.setdefault(str(r["category"]), []).append(f"  [{r['word_count']}w]  {r['sentence']}")
    out = []
    for name, rows in groups.items():
        if name.lower() != "nan":
            out += ["=" * 50, f"CATEGORY: {name}  (total: {total.get(name, 0):,} sentences)", "=" * 50, *rows]
    return "\n".join(out) + "\n"
