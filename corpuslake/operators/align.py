"""Error items in a model's free text: JSON recovery, normalisation and alignment with the expected types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L
from corpuslake.functions.text import let, strip, truncate, without_thoughts

_STRICT = {"allowSingleQuotes": "false"}
_ITEM = "struct<error_type:string,error_sentence:string,changed_part:string>"
SUCCESS = ("success", "success_order_aligned")


def _raw_items(t: Column) -> Column:
    """Raw JSON of the items in a JSON text: those of an object's `errors`, or of an array; null if it doesn't parse."""
    none = F.array().cast("array<string>")
    # as the only element of an array, so that nothing may follow the value
    alone = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", _STRICT)

    def of(x: Column) -> Column:
        listed = F.from_json(F.get(x, F.lit(0)), "errors string", _STRICT)["errors"]
        whole = F.from_json(F.get(x, F.lit(0)), "array<string>", _STRICT)
        return F.when(F.size(x) == 1, F.when(t.startswith("{") & t.endswith("}"), F.coalesce(F.from_json(listed, "array<string>", _STRICT), none)).when(t.startswith("[") & t.endswith("]"), whole))

    return let(alone, of)


def extract_items(raw: Column) -> Column:
    """array<struct<error_type, error_sentence, changed_part>> of a model's output; empty if nothing can be read.

    Tried in order: the whole text, its first brace to its last, its first bracket to its last. Objects give three
    stripped fields, strings a sentence alone; other items go. A null field gives the empty text.
    """
    def of(t: Column) -> Column:
        braces, brackets = F.regexp_extract(t, r"(?s)\{.*\}", 0), F.regexp_extract(t, r"(?s)\[.*\]", 0)
        items = F.coalesce(_raw_items(t), F.when(braces != "", _raw_items(braces)), F.when(brackets != "", _raw_items(brackets)), F.array().cast("array<string>"))

        def item(x: Column) -> Column:
            o = F.from_json(x, _ITEM, _STRICT)
            text = lambda f: strip(F.coalesce(o[f], F.lit("")))
            plain = F.when(x.rlike(r"^\s*\{"), None).otherwise(strip(x))
            return F.when(x.rlike(r"(?s)^\s*\{.*\}\s*$"), F.struct(*[text(f).alias(f) for f in ("error_type", "error_sentence", "changed_part")])).when(
                plain.isNotNull() & ~x.rlike(r"^\s*(?:-?[0-9.]+|true|false|null|\[.*)\s*$"), F.struct(F.lit("").alias("error_type"), plain.alias("error_sentence"), F.lit("").alias("changed_part"))
            )

        return F.filter(F.transform(items, item), lambda x: x.isNotNull())

    return let(without_thoughts(F.coalesce(raw, F.lit(""))), of)


def align_items(items: Column, original: Column) -> Column:
    """The six expected types in order, each with its item: the first of that type, else the next leftover by order.

    parse_status: success, failed_empty_or_same (its item is blank or the original; leftovers aren't tried),
    success_order_aligned, failed_missing.
    """
    types = [t for t, *_ in L.ERROR_TYPES]

    def of(x: Column) -> Column:
        kinds = F.transform(x["i"], lambda i: i["error_type"])
        places = F.transform(F.array(*map(F.lit, types)), lambda t: F.array_position(kinds, t).cast("int"))

        def done(p: Column) -> Column:
            def final(y: Column) -> Column:
                def one(t: Column, j: Column) -> Column:
                    place = F.get(y["p"], j)
                    missing_before = F.size(F.filter(y["p"], lambda q, i: (q == 0) & (i < j)))
                    item = F.when(place > 0, F.get(y["i"], place - 1)).otherwise(F.get(y["rest"], missing_before))
                    good = F.coalesce((item["error_sentence"] != "") & (item["error_sentence"] != original), F.lit(False))
                    status = F.when(place > 0, F.when(good, "success").otherwise("failed_empty_or_same")).otherwise(F.when(good, "success_order_aligned").otherwise("failed_missing"))
                    return F.struct(t.alias("error_type"), F.when(good, item["error_sentence"]).otherwise("").alias("error_sentence"), F.coalesce(item["changed_part"], F.lit("")).alias("changed_part"), status.alias("parse_status"))
                return F.transform(F.array(*map(F.lit, types)), one)

            rest = F.filter(x["i"], lambda _, i: ~F.array_contains(p, i + 1))
            return let(F.struct(x["i"].alias("i"), p.alias("p"), rest.alias("rest")), final)

        return let(places, done)

    return let(F.struct(items.alias("i")), of)


def error_pairs(df: DataFrame, generator: str = "generator", keep_failed: bool = False) -> DataFrame:
    """Rows of aligned errors from original_id, sentence and raw_output; other columns pass through as orig_<name>."""
    meta = F.create_map(*[x for t, cat, zh, _ in L.ERROR_TYPES for x in (F.lit(t), F.struct(F.lit(cat).alias("category"), F.lit(zh).alias("zh")))])
    others = [F.col(f"`{c}`").alias(f"orig_{c}") for c in df.columns if c not in ("original_id", "raw_output")]
    rows = df.select("original_id", F.col("sentence").alias("original_sentence"), *others, F.explode(align_items(extract_items(F.col("raw_output")), F.col("sentence"))).alias("e"))
    out = rows.select(
        "original_id", "original_sentence", "e.error_sentence", meta[F.col("e.error_type")]["category"].alias("error_category"), "e.error_type",
        meta[F.col("e.error_type")]["zh"].alias("error_type_zh"), "e.changed_part", "e.parse_status", F.lit(generator).alias("generator"), *[f"orig_{c}" for c in df.columns if c not in ("original_id", "raw_output")],
    )
    return out if keep_failed else out.where(F.col("parse_status").isin(*SUCCESS))


def success_counts(df: DataFrame) -> DataFrame:
    """original_id and success_count."""
    aligned = align_items(extract_items(F.col("raw_output")), F.col("sentence"))
    return df.select("original_id", F.size(F.filter(aligned, lambda x: x["parse_status"].isin(*SUCCESS))).alias("success_count"))


def failed_raw(df: DataFrame) -> DataFrame:
    """Rows of which not all six types succeeded, with the first 3000 characters of the output."""
    aligned = align_items(extract_items(F.col("raw_output")), F.col("sentence"))
    n = F.size(F.filter(aligned, lambda x: x["parse_status"].isin(*SUCCESS)))
    return df.select("original_id", F.col("sentence").alias("original_sentence"), n.alias("success_count"), truncate(F.col("raw_output")).alias("raw_output")).where(F.col("success_count") < len(L.ERROR_TYPES))
