"""The queries opN_<name> of the driver contract and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm._base import table


def op4_jump_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.shard import shard

    return shard(table(spark, sf_dir, "documents"), 24)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.quality import quality

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_distinct_words", "n_stop_words", "n_lines", "n_bangs", "n_upper", "n_letters")
    return quality(table(spark, sf_dir, "documents")).select(*columns)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpuslake.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpuslake.llm.pieces import encode_pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).drop("text")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpuslake.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op4_jump_shard, op5_quality_rules, op7_token_counts, op8_minhash_near_dedup, op10_sentencepiece, op9_benchmark_decontamination, op6_license_scan, op3_html_extraction, op1_lm_score, op2_substring_dedup)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality_sql() -> str:
    """The measures in SQL, and the threshold table turned into one condition."""
    from corpuslake.llm.quality import RULES, STOP_WORDS, SYMBOLS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    count = lambda regex: f"len(regexp_extract_all(coalesce(text, ''), '{regex}'))::bigint"  # noqa: E731
    tests = []
    for r in RULES:
        over, _, under = (x.strip() for x in r.measure.partition("/"))
        value = f"{over}::double / nullif({under}, 0)" if under else f"{over}::double"
        tests += [f"coalesce({value} >= {r.low!r}, true)"] * (r.low != float("-inf")) + [f"coalesce({value} <= {r.high!r}, true)"] * (r.high != float("inf"))
    return rf"""with d as (select doc_id, text, {_WORDS} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) as l from documents),
 g as (select doc_id, i, array_to_string(w[i:i + 7], chr(31)) as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 8)),
 r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
 c as (select doc_id, count(distinct i + k)::bigint as n from r, range(8) t(k) group by doc_id),
 m as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, {count(f"[{SYMBOLS}]")} as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, len(list_distinct(w))::bigint as n_distinct_words, len(list_filter(w, lambda x: {_LOWER.format("rtrim(x, ',.;:!?')")} in ({stop})))::bigint as n_stop_words, len(l)::bigint as n_lines,
  {count("!")} as n_bangs, {count(chr(92) + "p{Lu}")} as n_upper, {count(chr(92) + "p{L}")} as n_letters, sqrt(len(w)) as root_words from d left join c using (doc_id)),
 f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
 select * exclude (root_words), not base_failed and {" and ".join(tests)} as kept from f"""


_NEAR_SQL = rf"""with recursive d as (select doc_id, list_transform({_WORDS}, lambda w: {_LOWER.format("w")}) as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, chr(31))] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(31))) end) as g from d where len(w) > 0),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
 both_ways as (select a, b from e union all select b, a from e),
 reach(id, other) as (select doc_id, doc_id from documents union select reach.id, both_ways.b from reach join both_ways on both_ways.a = reach.other)
 select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept from d left join n using (doc_id) join (select id as doc_id, min(other) as component_id from reach group by id) c using (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op5_quality_rules": _quality_sql(), "op8_minhash_near_dedup": _NEAR_SQL}
