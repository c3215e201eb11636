"""Steps whose work once grew too fast or was done more than once."""

import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L
from corpuslake.functions import metrics as M
from corpuslake.functions import text as T
from corpuslake.operators import reports
from corpuslake.operators.validate import occurs
from corpuslake.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plain_grams(text, chars=6, words=2):
    body, parts = "".join(text.split()), []
    punct = set(r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")
    for w in text.split():
        parts += [w] if len(w) == 1 else [w[:-1], w[-1]] if w[-1] in punct else [w[0], w[1:]] if w[0] in punct else [w]
    grams = [Counter(body[i : i + n] for i in range(len(body) - n + 1)) for n in range(1, chars + 1)]
    return grams + [Counter(tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)) for n in range(1, words + 1)]


def test_chrf_counts_of_shared_and_missing_ids(spark):
    rows = [(1, "a b, ab", "ab a. b"), (2, "é😀 x", "x é😀"), (3, "ab", ""), (3, "", "ab"), (3, "b", "b"), (None, "ab c", "ab c"), (None, "q", "q"), (4, None, "z"), (5, "", "")]
    got = {r.n: (r.n_pred, r.n_ref, r.n_match) for r in M.chrf_counts(spark.createDataFrame(rows, "sample_id long, prediction string, correct_sentence string")).collect()}
    sides = {}
    for i, p, r in rows:
        one = sides.setdefault(i, [[Counter() for _ in range(8)] for _ in range(2)])
        for total, text in zip(one, (p, r), strict=True):
            for c, more in zip(total, plain_grams(text or ""), strict=True):
                c.update(more)
    # as in the SQL, whose join finds no partner for a null id
    want = {n + 1: (sum(p[n].total() for p, _ in sides.values()), sum(r[n].total() for _, r in sides.values()), sum((p[n] & r[n]).total() for i, (p, r) in sides.items() if i is not None)) for n in range(8)}
    assert got == {n: x for n, x in want.items() if x[0] + x[1]}


def test_chrf_grams_of_single_rows_do_not_move(spark):
    df = spark.createDataFrame([(i, f"abc {i}" * 20, f"abd {i}" * 20) for i in range(50)], "sample_id long, prediction string, correct_sentence string")
    assert [list(x) for x in M.pair_grams(*zip(*[r[1:] for r in df.collect()], strict=True), most=300)] == [[r.n, r.n_pred, r.n_ref, r.n_match] for r in sorted(M.chrf_counts(df).collect())]


def test_ter_matches_words_once_a_shift(monkeypatch):
    calls = []
    real = M.word_edits
    monkeypatch.setattr(M, "word_edits", lambda a, b: calls.append(1) or real(a, b))
    a = "c d a b e f g h"
    assert M.ter_edits(a, "a b c d e f g h x") == (2, 9) and len(calls) <= 2
    calls.clear()
    # nothing to gain, as all words that both have are matched
    assert M.ter_edits("a b c q", "a b c d e") == (2, 5) and not calls
    for x, y in ((a, "h g f e"), ("", "a"), ("a b a b", "b a b a b"), ("q", "q")):
        assert M._distance(x.split(), y.split()) == real(x.split(), y.split())[0]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def operators_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_fusions_in_two_passes_equal_one_for_each_ending(spark):
    rng = random.Random(3)
    parts = [*L.FUSION_ENDINGS * 2, *set("".join(L.FUSION_ENDINGS)), " ", "۔", "x"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 20))) for _ in range(3000)] + ["کی" * k + "ا" for k in range(6)] + ["کیا" * k + "x" for k in range(6)] + ["کیا" * k + "ب" for k in range(6)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = reduce(lambda t, e: F.regexp_replace(t, f"({e})({T.BLOCK})", "$1 $2"), L.FUSION_ENDINGS, F.col("t"))
    assert df.where(whole != T.split_fusions(F.col("t"))).isEmpty() and plan_of(df.select(T.split_fusions(F.col("t")).alias("x"))).count("regexp_replace") == 2


def test_text_steps_equal_plain_regular_expressions(spark):
    rng = random.Random(4)
    parts = ["http://a.b/c", "https:", "www.", "a@b.c", "@x", "b@c@d.e", "<b>", "<", "&amp;", "&", "12", "۱۲", "x1", "۔۔", "؟؟؟", "!!", "!", "---", "--", "ا", "پاک", "é", "😀", *T.SPACES, "nan"]
    df = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randint(0, 14))),) for _ in range(3000)] + [(None,), ("\nNaN ",), ("nanİ",)], "t string")
    t, ws = F.col("t"), r"(?U)[\s\x1c-\x1f]"
    no = r"(?U)[^\s\x1c-\x1f]+"
    noise = [(r"(?U)https?://" + no[4:], ""), (r"(?U)www\." + no[4:], ""), (no + "@" + no[4:] + r"\." + no[4:], ""), ("<[^>]+>", ""), ("&[a-zA-Z]+;", ""), (r"(?U)\b\d+\b", ""), ("۔{2,}", "۔"), ("؟{2,}", "؟"), ("!{2,}", "!"), ("-{3,}", " "), (ws + "+", " ")]
    bare = F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    same = [
        (T.remove_noise(t), F.trim(reduce(lambda x, p: F.regexp_replace(x, *p), noise, t))), (T.strip(t), bare), (T.collapse(t), F.regexp_replace(t, ws + "+", " ")),
        (T.tokens(t), F.filter(F.split(t, ws + "+"), lambda w: w != "")), (T.is_blank(t), t.isNull() | (bare == "") | (F.lower(bare) == "nan")),
        (T.block_chars(t), F.regexp_count(t, F.lit(T.BLOCK))), (T.letters(t), F.regexp_count(t, F.lit(r"\p{L}"))), (T.ascii_letters(t), F.regexp_count(t, F.lit("[A-Za-z]"))),
    ]
    assert df.select(*[F.count_if(~a.eqNullSafe(b)) for a, b in same]).first() == (0,) * len(same)


def test_repeats_are_found_without_comparing_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choices("abcdef", k=rng.randint(1, 12)), rng.randint(1, 13)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "w array<string>, k int")
    assert [r[0] for r in df.select(occurs(F.col("w"), F.col("k"))).collect()] == [max(Counter(w).values()) >= k for w, k in rows]


@pytest.mark.parametrize("name", ["rule_spelling", "rule_postposition", "rule_gender", "rule_insertion", "rule_deletion", "rule_pairs"])
def test_a_corruption_is_made_once(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    salt = {"rule_spelling": "spelling_word", "rule_pairs": "choice"}.get(name, f"{name[5:]}_place")
    assert plan_of(Q.QUERIES[name](spark, SF)).count(f"md5(cast(concat_ws(:, {salt},") == 1


def test_checks_lay_sentences_out_once(spark):
    assert plan_of(Q.QUERIES["quality_checks"](spark, SF)).count("Generate posexplode") == 1
    df = spark.createDataFrame([("پاکستان", 5, "a"), ("پاکستان", 7, None), (None, 2, "b"), ("ططط پ", 40, "a")], "sentence string, word_count int, category string")
    got = {r.check: (r.passed, r.detail) for r in reports.quality_checks(df).collect()}
    assert got == {"not_empty": (True, 4.0), "no_nulls": (False, 1.0), "in_script": (False, 1.0), "no_duplicates": (False, 1.0), "length_in_range": (False, 40.0), "no_mojibake": (False, 1.0), "several_categories": (True, 2.0)}


def test_unified_pairs_clean_once(spark):
    assert "ReusedExchange" in operators_run(Q.QUERIES["unify_pairs"](spark, SF))
