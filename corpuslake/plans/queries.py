"""The reference operators' queries over the driver's tables, with SQL for each that SQL can express.

The tables hold no text in the Arabic script, so a transliterated view of documents stands in for it: frequent
words become words of the rules' lists, other letters are mapped one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions import chat
from corpuslake.functions import lexicon as L
from corpuslake.functions import metrics as M
from corpuslake.functions import rng
from corpuslake.functions import text as T
from corpuslake.functions.chat import MESSAGES, chat_json, generation_messages, merged_user_text, plain_prompt
from corpuslake.operators import align, corrupt, reports, segment, split, validate
from corpuslake.operators.dedup import duplicate_count, keep_first
from corpuslake.operators.generate import back_translate
from corpuslake.plans import clean
from corpuslake.plans.generation import corrected
from corpuslake.sources.readers import chat_lines, eval_rows, row_range
from corpuslake.streaming.resume import pending

# The transliteration.
WORDS = {"the": "کے", "of": "کی", "and": "اور", "to": "کو", "in": "میں", "is": "ہے", "was": "رہا", "that": "کرتا"}
LETTERS = ("abcdefghijklmnopqrstuvwxyz.?", "ابپتیثجچہخدکذرونمشسٹطظعگفق۔؟")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small files scan as one partition; the regex chains that follow are worth a shuffle of the rows to all cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def transliterated(c: Column) -> Column:
    """Words are what stands between single spaces: with each space doubled, replacements of neighbours don't meet."""
    doubled = F.concat(F.lit(" "), F.replace(F.lower(c), F.lit(" "), F.lit("  ")), F.lit(" "))
    words = reduce(lambda t, kv: F.replace(t, F.lit(f" {kv[0]} "), F.lit(f" {kv[1]} ")), WORDS.items(), doubled)
    inside = T.let(words, lambda t: F.substr(t, F.lit(2), F.length(t) - 2))
    return F.translate(F.replace(inside, F.lit("  "), F.lit(" ")), *LETTERS)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: text, category (lang), source, and the first line of the text as headline."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    t = docs.select(F.col("doc_id").alias("ord"), transliterated(F.col("text")).alias("text"), F.col("lang").alias("category"), "source")
    return t.withColumn("headline", F.substring_index("text", "\n", 1))


# --- SQL parts -------------------------------------------------------------------------------------------------

S = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NS = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLOCK = "[؀-ۿ]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, regex: str, new: str) -> str:
    return f"regexp_replace({x}, {q(regex)}, {q(new)}, 'g')"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(S + '+')}), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    return sub(x, f"^{S}+|{S}+$", "")


SQL_WORDS = "case w " + " ".join(f"when '{k}' then '{v}'" for k, v in WORDS.items()) + " else w end"
SQL_TR = f"select doc_id, lang, source, translate(array_to_string(list_transform(string_split(lower(text), ' '), lambda w: {SQL_WORDS}), ' '), '{LETTERS[0]}', '{LETTERS[1]}') as t from documents"


def sql_boilerplate(x: str) -> str:
    return reduce(lambda t, p: f"replace({t}, '{p}', ' ')", L.BOILERPLATE, x)


def sql_letters(x: str) -> str:
    return f"translate({x}, '{L.LETTERS_FROM + L.DELETED}', '{L.LETTERS_TO}')"


def sql_fusions(x: str) -> str:
    return reduce(lambda t, e: sub(t, f"({e})({BLOCK})", r"\1 \2"), L.FUSION_ENDINGS, x)


# RE2 has ASCII word boundaries alone, so numbers are taken with the characters beside them, in two passes
SQL_NOISE = (
    (f"https?://{NS}+", ""), (rf"www\.{NS}+", ""), (rf"{NS}+@{NS}+\.{NS}+", ""), ("<[^>]+>", ""), ("&[a-zA-Z]+;", ""), *[(r"(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])[0-9۰-۹٠-٩]+($|[^\p{L}\p{M}\p{Nd}\p{Pc}])", r"\1\2")] * 2,
    ("۔{2,}", "۔"), ("؟{2,}", "؟"), ("!{2,}", "!"), ("-{3,}", " "), (f"{S}+", " "),
)


def sql_noise(x: str) -> str:
    return f"trim({reduce(lambda t, p: sub(t, *p), SQL_NOISE, x)})"


def sql_clean(x: str) -> str:
    return f"case when {x} is null or {sql_strip(x)} = '' or lower({sql_strip(x)}) = 'nan' then '' else {sql_noise(sql_fusions(sql_letters(sql_boilerplate(x))))} end"


def sql_verbs(x: str) -> str:
    """Marks after verb endings. The pattern takes the next character, so a second pass finds what stood right behind."""
    for p in L.VERB_ENDINGS:
        for _ in range(2):
            x = f"regexp_replace({x}, {q(f'({p})({S}+{BLOCK})')}, '\\1' || chr(1) || '\\2', 'g')"
    return x


def sql_parts(x: str, sep: str) -> str:
    return f"list_filter(list_transform({sep}, lambda s: {sql_strip('s')}), lambda s: s <> '')".replace("{x}", x)


SQL_SEGMENT = f"""
split1 as (select k, {sql_parts('', "string_split_regex(body, '[۔؟!।]+')")} as p from bodies),
verbs as (select k, p[1] as one, {sql_verbs('p[1]')} as marked from split1 where len(p) = 1 and len({sql_tokens('p[1]')}) > 40),
parts as (select split1.k, case when verbs.k is null then split1.p else {sql_parts('', 'string_split(marked, chr(1))')} end as p from split1 left join verbs on verbs.k = split1.k),
laid as (select k, unnest(range(len(p))) as pos, unnest(p) as sentence from parts)"""

W = sql_tokens("sentence")
SQL_REASON = f"""case when len(w) < 5 then 'too_short' when len(w) > 30 then 'too_long'
 when len(regexp_extract_all(sentence, '[A-Za-z]')) / length(sentence)::double > 0.20 then 'latin_heavy'
 when len(regexp_extract_all(sentence, '{BLOCK}')) < 10 then 'no_urdu_chars'
 when regexp_matches(sentence, '[طظغ]{{3,}}') then 'mojibake'
 when len(regexp_extract_all(sentence, '\\p{{L}}')) / length(sentence)::double < 0.50 then 'mostly_symbols'
 when list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) / len(w)::double > 0.35 then 'repetitive' end"""

SQL_ATTEMPTS = f"""tr as materialized ({SQL_TR}),
cleaned as materialized (select doc_id as k, lang as category, source, {sql_clean("string_split(t, chr(10))[1]")} as headline, {sql_clean('t')} as body from tr where t is not null and {sql_strip('t')} <> ''),
bodies as (select k, body from cleaned), {SQL_SEGMENT},
judged as materialized (select k as ord, pos, sentence, {SQL_REASON} as reason, len(w) as word_count from (select *, {W} as w from laid)),
ranked as materialized (select *, case when reason is null then row_number() over (partition by reason is null, sentence order by ord, pos) end as rn from judged),
good as materialized (select ord, pos, sentence, category, source, headline, word_count from ranked join cleaned on k = ord where reason is null and rn = 1)"""

GOOD = f"with {SQL_ATTEMPTS}"


# --- text functions ----------------------------------------------------------------------------------------------


@query(f"with tr as ({SQL_TR}) select doc_id, {sql_letters('t')} as t from tr")
def unicode_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.normalize_letters(F.col("text")).alias("t"))


_PHRASED = f"replace(replace(t, 'اور', '{L.BOILERPLATE[0]}'), 'میں', '{L.BOILERPLATE[5]}')"


@query(f"with tr as ({SQL_TR}) select doc_id, {sql_boilerplate(_PHRASED)} as t from tr")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit("اور"), F.lit(L.BOILERPLATE[0])), F.lit("میں"), F.lit(L.BOILERPLATE[5]))
    return articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.remove_boilerplate(t).alias("t"))


@query(f"with tr as ({SQL_TR}) select doc_id, {sql_fusions('t')} as t from tr")
def fusion_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.split_fusions(F.col("text")).alias("t"))


@query(f"select page_id, {sql_noise('html')} as t from pages")
def html_noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.remove_noise(F.col("html")).alias("t"))


@query(f"with tr as ({SQL_TR}) select doc_id, {sql_clean('t')} as t from tr")
def full_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.clean(F.col("text")).alias("t"))


@query(f"""with tr as ({SQL_TR}) select doc_id, len(regexp_extract_all(t, '{BLOCK}'))::bigint as n_block, len(regexp_extract_all(t, '[A-Za-z]'))::bigint as n_ascii,
 len(regexp_extract_all(t, '\\p{{L}}'))::bigint as n_letters, len({sql_tokens('t')})::bigint as n_tokens, sha256(t) as fingerprint, substr(t, 1, 3000) as head from tr""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return articles(spark, sf_dir).select(
        F.col("ord").alias("doc_id"), T.block_chars(t).cast("long").alias("n_block"), T.ascii_letters(t).cast("long").alias("n_ascii"), T.letters(t).cast("long").alias("n_letters"),
        T.token_count(t).cast("long").alias("n_tokens"), T.fingerprint(t).alias("fingerprint"), T.truncate(t).alias("head"),
    )


@query(f"""with tr as ({SQL_TR}) select doc_id from tr where length({sql_strip('t')}) >= 5 and 2 * len(regexp_extract_all({sql_strip('t')}, '{BLOCK}')) >= length({sql_strip('t')})""")
def script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where(validate.in_script(F.col("text"))).select(F.col("ord").alias("doc_id"))


# --- sentences ---------------------------------------------------------------------------------------------------

_COLLAPSED = f"trim({sub('t', S + '+', ' ')})"


@query(f"with tr as ({SQL_TR}), bodies as (select doc_id as k, {_COLLAPSED} as body from tr), {SQL_SEGMENT} select k as doc_id, pos::integer as pos, sentence from laid")
def sentence_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim(T.collapse(F.col("text")))
    return articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.posexplode(segment.sentences(t)).alias("pos", "sentence"))


_PLAIN = f"trim({sub(sub('t', '[۔؟!।]+', ' '), S + '+', ' ')})"


@query(f"""with tr as ({SQL_TR}), b as (select doc_id, {_PLAIN} as body from tr), m as (select doc_id, case when len({sql_tokens('body')}) > 40 then {sql_parts('', f"string_split({sql_verbs('body')}, chr(1))")} else [body] end as p from b)
 select doc_id, unnest(range(len(p)))::integer as pos, unnest(p) as part from m""")
def verb_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim(T.collapse(F.regexp_replace("text", "[۔؟!।]+", " ")))
    one = articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), t.alias("body"))
    return one.select("doc_id", F.posexplode(segment.split_on_verbs(F.col("body"))).alias("pos", "part"))


@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim(T.collapse(F.col("text")))
    long = articles(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.explode(segment.sentences(t)).alias("sentence")).where(T.token_count(F.col("sentence")) > 30)
    return long.select("doc_id", F.posexplode(segment.chunks(F.col("sentence"))).alias("pos", "chunk"))


@query(f"{GOOD} select ord, pos::integer as pos, sentence, category, source, headline, word_count::integer as word_count from good")
def clean_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_sentences(articles(spark, sf_dir))


_REASONS = ", ".join(f"({i}, '{r}', '{'article' if r == 'empty_text' else 'sentence'}')" for i, r in enumerate(L.REJECT_REASONS))


@query(f"""{GOOD}, reasons(ord, reason, unit) as (values {_REASONS}),
 every as (select coalesce(reason, case when rn > 1 then 'duplicate' end) as why from ranked union all select 'empty_text' from tr where t is null or {sql_strip('t')} = ''),
 counts as (select why, count(*) as n from every group by why)
 select reasons.ord::integer as ord, reason, unit, coalesce(n, 0)::bigint as n, round(100.0 * coalesce(n, 0) / (select sum(n) from counts), 6)::double as percent,
 case when reason in ('mojibake', 'no_urdu_chars') and coalesce(n, 0) > 5000 then 'HIGH' else '' end as flag from reasons left join counts on why = reason""")
def reject_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.breakdown(clean.reason_counts(articles(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


@query(f"""{GOOD} select count(*)::bigint as n, min(word_count)::integer as min_words, max(word_count)::integer as max_words, round(avg(word_count), 6)::double as mean_words, median(word_count)::double as median_words,
 list_sort(list(word_count))[(count(*) // 2 + 1)::integer]::integer as upper_median from good""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.length_stats(clean.clean_sentences(articles(spark, sf_dir))).withColumn("mean_words", F.round("mean_words", 6))


@query(f"""{GOOD}, a as (select count(*) as n, sum((sentence is null)::int) as nulls, sum((len(regexp_extract_all(sentence, '{BLOCK}')) < 5)::int) as few, count(*) - count(distinct sentence) as dup,
 avg(word_count) as mean, max(word_count) as longest, sum(regexp_matches(sentence, '[طظغ]{{3,}}')::int) as moji, count(distinct category) as cats from good)
 select 'not_empty' as "check", n > 0 as passed, n::double as detail from a union all select 'no_nulls', nulls = 0, nulls::double from a union all select 'in_script', few = 0, few::double from a
 union all select 'no_duplicates', dup = 0, dup::double from a union all select 'length_in_range', mean > 4 and mean < 31 and longest <= 30, longest::double from a
 union all select 'no_mojibake', moji = 0, moji::double from a union all select 'several_categories', cats > 1, cats::double from a""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_checks(clean.clean_sentences(articles(spark, sf_dir)))


# --- reports over documents --------------------------------------------------------------------------------------


@query("select lang as value, count(*)::bigint as n, round(100.0 * count(*) / sum(count(*)) over (), 6)::double as percent, floor(100.0 * count(*) / sum(count(*)) over () / 2)::integer as bar from documents group by lang")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(table(spark, sf_dir, "documents"), "lang").withColumn("percent", F.round("percent", 6))


@query("select source as value, count(*)::bigint as n, min(doc_id) as first_seen from documents group by source order by n desc, first_seen, value limit 20")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_values(table(spark, sf_dir, "documents"), "source", "doc_id", 20)


@query("select count(distinct lang)::bigint as n_lang, count(distinct source)::bigint as n_source from documents")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_counts(table(spark, sf_dir, "documents"), "lang", "source")


@query("select sum((length(trim(text)) > 20)::int)::bigint as n_long from documents")
def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.texts_longer_than(table(spark, sf_dir, "documents"), F.col("text"))


@query("select (count(*) - count(distinct text))::bigint as n_duplicates from documents")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_count(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text")


@query("select doc_id, lang, source from (select *, row_number() over (partition by trim(text) order by doc_id) as rn from documents where text is not null and trim(text) <> '') where rn = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = validate.not_blank(table(spark, sf_dir, "documents"), "text")
    return keep_first(docs, [T.strip(F.col("text"))], ["doc_id"]).select("doc_id", "lang", "source")


@query("select doc_id, lang from (select *, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) as rn from documents) where rn <= 20")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.sample_by_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"), 20)


@query("""with g as (select source, min(doc_id) as first_seen from documents group by source order by first_seen, source limit 10)
 select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('42:' || doc_id), doc_id) as rn from documents join g using (source)) where rn <= 3""")
def first_sources_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    groups = split.first_groups(docs, "source", "doc_id", 10).select("source")
    return split.sample_by_group(docs.join(F.broadcast(groups), "source"), "source", F.col("doc_id"), 3).select("doc_id", "source")


@query("select doc_id from documents where doc_id >= 100 and doc_id < 500")
def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_range(table(spark, sf_dir, "documents").select("doc_id"), 100, 500, "doc_id")


_RANKED = "select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) as r, count(*) over () as n from documents"
_THREE = f"""with ranked as ({_RANKED}), m as (select *, (3333 * rest + 9999) // 10000 as mt from (select doc_id, r, n, (6 * n + 9) // 10 as rest from ranked))
 select doc_id, case when r <= n - rest then 'rule_input' when r <= n - mt then 'llm_input' else 'mt_input' end as split from m"""


@query(_THREE)
def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.three_way(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


@query(f"with x as ({_THREE}) select split, count(*)::bigint as n, round(100.0 * count(*) / sum(count(*)) over (), 6)::double as percent from x group by split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = split.three_way(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")).groupBy("split").agg(F.count("*").alias("n"))
    return sizes.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"with ranked as ({_RANKED}) select doc_id, case when r <= 50 then 'dev' when r <= 100 then 'test' else 'train' end as split from ranked")
def split_dev_test_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.dev_test_train(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 50, 50)


# --- corruption --------------------------------------------------------------------------------------------------


def sql_pick(salt: str, items: str, key: str = "s") -> str:
    return f"{items}[({rng.sql(salt, key)} % len({items}) + 1)::integer]"


def sql_map(m: dict) -> str:
    return "map {" + ", ".join(f"'{k}': [{', '.join(q(x) for x in v)}]" for k, v in m.items()) + "}"


BASE = f"{GOOD}, base as (select sentence as s, {sql_tokens('sentence')} as w from good)"
CONF = "[" + "".join(L.CONFUSABLE) + "]"


def sql_places(keys) -> str:
    return f"list_filter(range(len(w)), lambda i: list_contains([{', '.join(q(k) for k in keys)}], w[(i + 1)::integer]))"


SQL_SPELL = f"""c as (select s, list_filter(w, lambda x: regexp_matches(x, '{CONF}')) as cand from base),
 d as (select s, {sql_pick('spelling_word', 'cand')} as word from c where len(cand) > 0),
 e as (select s, word, list_filter(range(1, length(word) + 1), lambda i: regexp_matches(substr(word, i, 1), '{CONF}')) as places from d),
 f as (select s, word, {sql_pick('spelling_place', 'places')} as p from e),
 g as (select *, ({sql_map(L.CONFUSABLE)})[substr(word, p, 1)] as opts from f),
 spelling as (select s, substr(s, 1, instr(s, word) - 1) || substr(word, 1, p - 1) || {sql_pick('spelling_char', 'opts')} || substr(word, p + 1) || substr(s, instr(s, word) + length(word)) as bad, 'spelling_error' as kind from g)"""
SQL_POST = f"""h as (select s, w, {sql_places(L.POSTPOSITIONS)} as places from base), i as (select s, w, {sql_pick('postposition_place', 'places')} as place from h where len(places) > 0),
 j as (select *, ({sql_map(L.POSTPOSITIONS)})[w[(place + 1)::integer]] as opts from i), k2 as (select s, w, place, {sql_pick('postposition_new', 'opts')} as new from j),
 postposition as (select s, array_to_string(w[1:place::integer] || (case when new = '' then [] else [new] end) || w[(place + 2)::integer:], ' ') as bad, case when new = '' then 'postposition_deletion' else 'postposition_substitution' end as kind from k2)"""
SQL_GENDER = f"""l as (select s, w, {sql_places(L.GENDER)} as places from base), m as (select s, w, {sql_pick('gender_place', 'places')} as place from l where len(places) > 0),
 gender as (select s, array_to_string(w[1:place::integer] || ({sql_map({k: (v,) for k, v in L.GENDER.items()})})[w[(place + 1)::integer]] || w[(place + 2)::integer:], ' ') as bad, 'gender_agreement' as kind from m)"""
SQL_INSERT = f"""insertion as (select s, array_to_string(w[1:place::integer] || [word] || w[(place + 1)::integer:], ' ') as bad, 'word_insertion' as kind
 from (select s, w, {rng.sql('insertion_place', 's')} % (len(w) + 1) as place, {sql_pick('insertion_word', '[' + ', '.join(q(x) for x in L.INSERTED) + ']')} as word from base))"""
SQL_DELETE = f"""deletion as (select s, array_to_string(w[1:place::integer] || w[(place + 2)::integer:], ' ') as bad, 'word_deletion' as kind from (select s, w, {rng.sql('deletion_place', 's')} % len(w) as place from base where len(w) > 3))"""


def _corrupted(name: str, part: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = clean.clean_sentences(articles(spark, sf_dir)).select(F.col("sentence").alias("s"))
        made = corrupt.made_once(s, corrupt.FUNCTIONS[name](F.col("s")), "s")
        return made.select("s", F.col("incorrect_sentence").alias("bad"), F.col("error_type").alias("kind"))

    run.__name__ = f"rule_{name}"
    query(f"{BASE}, {part} select s, bad, kind from {name}")(run)


for _name, _part in (("spelling", SQL_SPELL), ("postposition", SQL_POST), ("gender", SQL_GENDER), ("insertion", SQL_INSERT), ("deletion", SQL_DELETE)):
    _corrupted(_name, _part)

_SHARES, _total = [], 0.0
for _n, _share in L.CORRUPTION_SHARES[:-1]:
    _total += _share
    _SHARES.append(f"when u < {round(_total, 9)} then '{_n}'")
SQL_PAIRS = f"""{BASE}, {SQL_SPELL}, {SQL_POST}, {SQL_GENDER}, {SQL_INSERT}, {SQL_DELETE},
 chosen as (select s, case {' '.join(_SHARES)} else '{L.CORRUPTION_SHARES[-1][0]}' end as name from (select s, {rng.sql('choice', 's')} / 4294967296.0::double as u from base)),
 made as ({' union all '.join(f"select '{n}' as name, s, bad, kind from {n}" for n, _ in L.CORRUPTION_SHARES)}),
 pairs as (select bad as incorrect_sentence, chosen.s as correct_sentence, kind as error_type from chosen join made on made.s = chosen.s and made.name = chosen.name where bad <> chosen.s and len({sql_tokens('bad')}) >= 2)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrupt.rule_pairs(clean.clean_sentences(articles(spark, sf_dir)))


@query(f"{SQL_PAIRS} select * from pairs")
def rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"{SQL_PAIRS} select error_type, count(*)::bigint as n from pairs group by error_type")
def error_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrupt.error_type_counts(_pairs(spark, sf_dir))


@query(f"""{SQL_PAIRS} select incorrect_sentence, correct_sentence, error_type, 'rules' as method from pairs union all
 select 'en:' || sentence || ' <en>', sentence, 'translation', 'translation' from good""")
def unify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule pairs and back-translated pairs in one format; the stub translators mark what they have done.

    Both take the sentence alone, so that they read one exchange of sentences and cleaning runs once.
    """
    good = clean.clean_sentences(articles(spark, sf_dir)).select("sentence")
    translated = back_translate(good, lambda: lambda texts: [f"en:{t}" for t in texts], lambda: lambda texts: [f"{t} <en>" for t in texts])
    return corrupt.unify_pairs(rules=corrupt.rule_pairs(good), translation=translated)


# --- resume, JSON, chat ------------------------------------------------------------------------------------------


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


def _model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of many shapes made from user turns: clean and fenced objects, prose around arrays, strings, wrong types, broken JSON."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("original_id"), F.col("text").alias("sentence"))
    item = lambda t, i: F.struct(F.lit(t).alias("error_type"), F.concat("sentence", F.lit(f" {i}")).alias("error_sentence"), F.lit(str(i)).alias("changed_part"))
    types = [t for t, *_ in L.ERROR_TYPES]
    whole = F.to_json(F.struct(F.array(*[item(t, i) for i, t in enumerate(types)]).alias("errors")))
    some = F.to_json(F.array(item(types[3], 3), item("other", 9), item(types[0], 0)))
    shape = F.col("original_id") % 6
    raw = F.when(shape == 0, whole).when(shape == 1, F.concat(F.lit("<think>so { it is</think>```json\n"), whole, F.lit("\n```"))).when(shape == 2, some).when(shape == 3, F.concat(F.lit("Here: "), some, F.lit(" done")))
    raw = raw.when(shape == 4, F.to_json(F.struct(F.array("sentence", F.concat("sentence", F.lit("!"))).alias("errors")))).otherwise(F.substring(whole, 1, 60))
    return turns.withColumn("raw_output", raw)


@query()
def llm_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.error_pairs(_model_outputs(spark, sf_dir), "stub", keep_failed=True)


@query("""select parse_status, sum(n)::bigint as n from (select (conv_id * 1000 + turn) % 6 as shape, count(*) as n from conversations where role = 'user' group by 1) join
 (values (0, 'success', 6), (1, 'success', 6), (2, 'success', 2), (2, 'success_order_aligned', 1), (2, 'failed_missing', 3), (3, 'success', 2), (3, 'success_order_aligned', 1), (3, 'failed_missing', 3),
  (4, 'failed_missing', 5), (4, 'success_order_aligned', 1), (5, 'failed_missing', 6)) t(shape, parse_status, k) using (shape), unnest(range(k)) group by parse_status""")
def llm_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.error_pairs(_model_outputs(spark, sf_dir), "stub", keep_failed=True).groupBy("parse_status").agg(F.count("*").alias("n"))


@query("""select conv_id * 1000 + turn as original_id, case (conv_id * 1000 + turn) % 6 when 0 then 6 when 1 then 6 when 2 then 3 when 3 then 3 when 4 then 1 else 0 end::integer as success_count from conversations where role = 'user'""")
def llm_success_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.success_counts(_model_outputs(spark, sf_dir))


@query()
def llm_failed_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.failed_raw(_model_outputs(spark, sf_dir))


_USER = f"{q(chat.GENERATION_HEAD)} || text || {q(chat.generation_tail())}"


@query(f"""select item_id, to_json([{{'role': 'system', 'content': {q(chat.GENERATION_SYSTEM)}}}, {{'role': 'user', 'content': {_USER}}}])::varchar as messages,
 trim({q(chat.GENERATION_SYSTEM)}) || chr(10) || chr(10) || trim({_USER}) as merged, trim({q(chat.GENERATION_SYSTEM)}) || chr(10) || chr(10) || trim({_USER}) || chr(10) || chr(10) || 'Corrected sentence:' as plain from benchmark""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = generation_messages(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.to_json(m).alias("messages"), merged_user_text(m).alias("merged"), plain_prompt(m).alias("plain"))


_NORM = f"trim({sub('x', S + '+', ' ')})"


def sql_norm(x: str) -> str:
    return _NORM.replace("(x,", f"(translate({x}, chr(65279) || chr(8204) || chr(8205), ''),")


def sql_last_line(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: {sql_strip('s')}), lambda s: s <> '')"
    return f"coalesce({lines}[-1], {x})"


@query(f"""with l as (select conv_id, arg_max(text, turn) filter (role = 'user') as u, arg_max(text, turn) filter (role = 'assistant') as a from conversations group by conv_id),
 p as (select conv_id as sample_id, {sql_norm(sql_last_line("coalesce(u, '')"))} as error_sentence, {sql_norm("coalesce(a, '')")} as correct_sentence from l)
 select sample_id, error_sentence, correct_sentence from (select *, row_number() over (partition by error_sentence, correct_sentence order by sample_id) as rn from p where error_sentence <> '' and correct_sentence <> '' and error_sentence <> correct_sentence) where rn = 1""")
def chat_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_rows(chat_lines(table(spark, sf_dir, "conversations")))


@query("""select conv_id * 1000 + turn as id, json_extract_string(j, '$.messages[1].content') as prompt, json_extract_string(j, '$.messages[2].content') as answer from (select conv_id, turn,
 to_json({'messages': [{'role': 'system', 'content': 's'}, {'role': 'user', 'content': 'Please correct all the spelling and grammatical errors in the following text:' || chr(10) || text}, {'role': 'assistant', 'content': text || '!'}]}) as j from conversations)""")
def chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("incorrect_sentence"), F.concat("text", F.lit("!")).alias("correct_sentence"))
    m = F.from_json(chat_json(F.col("incorrect_sentence"), F.col("correct_sentence")), MESSAGES)["messages"]
    return turns.select("id", F.get(m, F.lit(1))["content"].alias("prompt"), F.get(m, F.lit(2))["content"].alias("answer"))


@query(f"""select item_id, {sql_norm("text")} as prediction from benchmark""")
def prediction_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in many wrappings, all of which hold the item's text on one line."""
    one = T.collapse(F.col("text"))
    shape = F.col("item_id") % 4
    raw = F.when(shape == 0, F.concat(F.lit("<think>a\nb</think>\n"), one)).when(shape == 1, F.to_json(F.struct(one.alias("answer")))).when(shape == 2, F.concat(F.lit("Corrected sentence: "), one)).otherwise(F.concat(F.lit("```\n\""), one, F.lit("\"\n```")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.prediction(raw).alias("prediction"))


@query(f"""select item_id, {sql_norm("text")} as prediction from benchmark""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction of each item by a stub that answers with the text of its prompt."""

    def stub():
        import json

        return lambda prompts: [json.dumps({"answer": p.split("following text:\n", 1)[1].rsplit("\n\nCorrected sentence:", 1)[0]}) for p in prompts]

    return corrected(table(spark, sf_dir, "benchmark").select("item_id", "text"), stub, "text").select("item_id", "prediction")


# --- evaluation --------------------------------------------------------------------------------------------------


def all_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three successive turns as source, reference and prediction."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    norm = T.normalize_for_scoring
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    turns = turns.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "conv_id")  # of a count that stays: few bytes are much work here
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), norm(F.col("text")).alias("error_sentence"), F.lead("text", 1).over(w).alias("r"), F.lead("text", 2).over(w).alias("p"))
    return rows.where("r IS NOT NULL AND p IS NOT NULL").select("sample_id", "error_sentence", norm(F.col("r")).alias("correct_sentence"), norm(F.col("p")).alias("prediction"))


# DuckDB's levenshtein counts bytes: each row's characters are numbered (there are fewer than 128 different ones in a
# triple of these tables) and written as ASCII characters first
_CODED = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: chr(list_position(chars, c)::integer)), '')"
SQL_TRIPLES = f"""raw as (select conv_id * 1000 + turn as sample_id, text as a, lead(text, 1) over (partition by conv_id order by turn) as b, lead(text, 2) over (partition by conv_id order by turn) as c from conversations),
 triples as (select sample_id, {sql_norm('a')} as error_sentence, {sql_norm('b')} as correct_sentence, {sql_norm('c')} as prediction from raw where b is not null and c is not null),
 coded as (select *, {_CODED('error_sentence')} as xe, {_CODED('correct_sentence')} as xc, {_CODED('prediction')} as xp from (select *, list_distinct(regexp_extract_all(error_sentence || correct_sentence || prediction, '(?s).')) as chars from triples)),
 report as (select 'model' as model, sample_id, error_sentence, correct_sentence, prediction, prediction = correct_sentence as exact_match, levenshtein(xe, xc)::integer as source_ref_edit_distance,
  levenshtein(xp, xc)::integer as pred_ref_edit_distance, levenshtein(xp, xc) < levenshtein(xe, xc) as closer_than_source, prediction = error_sentence as unchanged_from_source from coded)"""


@query(f"with {SQL_TRIPLES} select * from report")
def prediction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prediction_report(all_triples(spark, sf_dir))


def _sql_gleu(n: int) -> str:
    grams = lambda w: f"(case when len({w}) < {n} then [] else list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], chr(31))) end)"
    return f"select sample_id, {n} as n, {grams('p')} as a, {grams('r')} as b from tok"


SQL_GLEU = f"""tok as (select sample_id, {sql_tokens('prediction')} as p, {sql_tokens('correct_sentence')} as r from triples), grams as ({' union all '.join(_sql_gleu(n) for n in range(1, 5))}),
 ca as (select sample_id, n, g, count(*) as c from (select sample_id, n, unnest(a) as g from grams) group by all), cb as (select sample_id, n, g, count(*) as c from (select sample_id, n, unnest(b) as g from grams) group by all),
 ov as (select sample_id, n, sum(least(ca.c, cb.c)) as o from ca join cb using (sample_id, n, g) group by all),
 orders as (select sample_id, n, case when len(a) = 0 and len(b) = 0 then 1.0 when len(a) = 0 or len(b) = 0 then 0.0 else coalesce(o, 0)::double / greatest(len(a), len(b)) end as s from grams left join ov using (sample_id, n)),
 gleu as (select sample_id, case when any_value(len(p)) = 0 and any_value(len(r)) = 0 then 1.0 when any_value(len(p)) = 0 or any_value(len(r)) = 0 then 0.0 else avg(s) end as gleu from orders join tok using (sample_id) group by sample_id)"""


@query(f"""with {SQL_TRIPLES}, {SQL_GLEU} select 'model' as model, count(*)::bigint as num_samples, round(coalesce(avg(gleu) * 100, 0), 4)::double as gleu, round(coalesce(avg(exact_match::int) * 100, 0), 4)::double as exact_match,
 round(coalesce(avg(source_ref_edit_distance), 0), 4)::double as source_ref_edit_distance, round(coalesce(avg(pred_ref_edit_distance), 0), 4)::double as pred_ref_edit_distance,
 round(coalesce(100 * avg((source_ref_edit_distance - pred_ref_edit_distance)::double / source_ref_edit_distance) filter (source_ref_edit_distance > 0), 0), 4)::double as edit_distance_reduction,
 round(coalesce(avg(closer_than_source::int) * 100, 0), 4)::double as closer_rate, round(coalesce(avg(unchanged_from_source::int) * 100, 0), 4)::double as unchanged_rate from report join gleu using (sample_id)""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluate(all_triples(spark, sf_dir))


_PUNCT = r"[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def _sql_chrf(col: str) -> str:
    chars = " union all ".join(f"select sample_id, {n} as n, unnest(case when length(c) < {n} then [] else list_transform(range(1, length(c) - {n} + 2), lambda i: substr(c, i, {n})) end) as gram from side_{col}" for n in range(1, 7))
    words = " union all ".join(f"select sample_id, {6 + n} as n, unnest(case when len(w) < {n} then [] else list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) end) as gram from side_{col}" for n in (1, 2))
    edge = f"case when length(x) = 1 then [x] when regexp_matches(x, '{_PUNCT}$') then [substr(x, 1, length(x) - 1), substr(x, length(x))] when regexp_matches(x, '^{_PUNCT}') then [substr(x, 1, 1), substr(x, 2)] else [x] end"
    return f"side_{col} as (select sample_id, {sub(col, S + '+', '')} as c, flatten(list_transform({sql_tokens(col)}, lambda x: {edge})) as w from triples), grams_{col} as (select sample_id, n, gram, count(*) as k from ({chars} union all {words}) group by all)"


SQL_CHRF = f"""with {SQL_TRIPLES}, {_sql_chrf('prediction')}, {_sql_chrf('correct_sentence')},
 sums as (select n, sum(coalesce(a.k, 0))::bigint as n_pred, sum(coalesce(b.k, 0))::bigint as n_ref, sum(least(coalesce(a.k, 0), coalesce(b.k, 0)))::bigint as n_match from grams_prediction a full join grams_correct_sentence b using (sample_id, n, gram) group by n)"""


@query(f"{SQL_CHRF} select n::integer as n, n_pred, n_ref, n_match from sums")
def chrf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chrf_counts(all_triples(spark, sf_dir))


@query(f"{SQL_CHRF}, a as (select avg(n_match::double / n_pred) as p, avg(n_match::double / n_ref) as r from sums where n_pred > 0 and n_ref > 0) select round(case when p + r > 0 then 100 * 5 * p * r / (4 * p + r) else 0 end, 6)::double as chrf from a")
def chrf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chrf(all_triples(spark, sf_dir)).select(F.round("chrf", 6).alias("chrf"))


@query()
def ter_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ter(all_triples(spark, sf_dir))


@query(f"""with {SQL_TRIPLES} select sample_id, len({sql_tokens('lower(prediction)')})::integer as n_words, len({sql_tokens('lower(correct_sentence)')})::integer as n_ref from triples""")
def ter_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_triples(spark, sf_dir).select("sample_id", F.size(T.tokens(F.lower("prediction"))).alias("n_words"), F.size(T.tokens(F.lower("correct_sentence"))).alias("n_ref"))


@query()
def ter_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_triples(spark, sf_dir).select("sample_id", M.shift_free_edits(F.col("prediction"), F.col("correct_sentence")).alias("edits"))
