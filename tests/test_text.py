from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.functions.metrics import gleu, shift_free_edits, ter_edits
from corpuslake.functions.rng import draw
from corpuslake.operators import segment
from corpuslake.operators.validate import in_script, reject_reason


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_fusions(spark):
    assert one(spark, "کیا گیا ہے۔", T.split_fusions) == "کی ا گی ا ہے ۔"
    assert one(spark, "ہےاور", T.split_fusions) == "ہے اور"


def test_letters_and_noise(spark):
    assert one(spark, "آأإٱيكـ‌", T.normalize_letters) == "اااایک"
    assert one(spark, "سال ۲۰۲۴ اور 2024 abc12", T.remove_noise) == "سال اور abc12"
    assert one(spark, "a https://x.y/z b@c.de <b>q</b> &amp; ---- !!!", T.remove_noise) == "a q !"


def test_tokens_split_on_all_white_space(spark):
    assert one(spark, "a b c\x0bd　e\x1cf\x85g", T.tokens) == list("abcdefg")
    assert one(spark, "   ", T.tokens) == [] and one(spark, None, T.tokens) is None


def test_clean_of_nothing(spark):
    for t in (None, "", "  ", "NaN"):
        assert one(spark, t, T.clean) == ""


def test_segmentation_edges(spark):
    assert one(spark, "۔a", segment.sentences) == ["a"]
    assert one(spark, "a۔b۔", segment.sentences) == ["a", "b"]
    assert one(spark, "", segment.sentences) == []
    assert one(spark, "a\nb", segment.sentences) == ["a", "b"]


def test_verb_segmentation_in_order(spark):
    blob = "کیا گیا ہے اور گیا ہے اور وہ " + " ".join(["لفظ"] * 40)
    parts = one(spark, blob, segment.split_on_verbs)
    assert parts[:4] == ["کیا گیا", "ہے", "اور گیا", "ہے"]
    assert one(spark, "کیا گیا ہے اور", segment.split_on_verbs) == ["کیا گیا ہے اور"]


def test_chunks(spark):
    words = [f"w{i}" for i in range(70)]
    got = one(spark, " ".join(words), segment.chunks)
    assert [len(c.split()) for c in got] == [30, 30, 10]
    assert one(spark, "a b", segment.chunks) == ["a b"]
    marked = " ".join([*words[:10], "x۔", *words[10:40]])
    assert one(spark, marked, segment.chunks)[0].endswith("x۔")


def test_reject_reasons(spark):
    w = "پاکستان کرکٹ ٹیم نے میچ جیت لیا"
    cases = {w: None, "ا ب پ ت": "too_short", " ".join(["پاک"] * 31): "too_long", "abcdefgh abcd پاکستان کرکٹ ٹیم نے": "latin_heavy", "ا ب پ ت ٹ ث ج": "no_urdu_chars", "ططط کرکٹ ٹیم نے میچ جیت": "mojibake"}
    cases["ہے ہے ہے کرکٹ ٹیم میچ"] = "repetitive"
    for text, reason in cases.items():
        assert one(spark, text, reject_reason) == reason, text
    assert one(spark, "پاکس abc", in_script) and not one(spark, "abcdef", in_script)


def test_predictions(spark):
    assert one(spark, '<think>x</think>```json\n{"answer": "وہ آیا"}\n```', T.prediction) == "وہ آیا"
    assert one(spark, 'Corrected sentence: "hello\nوہ"', T.prediction) == "وہ"
    assert one(spark, None, T.prediction) == ""


def test_prompt_source(spark):
    assert one(spark, "Fix the Following Text : \n وہ\nآیا", T.source_of_prompt) == "وہ\nآیا"
    assert one(spark, "a\n b \n", T.source_of_prompt) == "b"


def test_metrics(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("", ""), ("a", ""), ("a b", "a c"), ("b c a", "a b c")], "p string, r string")
    assert [round(x[0], 4) for x in df.select(gleu(F.col("p"), F.col("r"))).collect()] == [1.0, 1.0, 0.0, round((0.5 + 0 + 1 + 1) / 4, 4), round((1 + 0.5 + 0 + 1) / 4, 4)]
    assert [x[0] for x in df.select(shift_free_edits(F.col("p"), F.col("r"))).collect()] == [0, 0, 1, 1, 2]
    assert ter_edits("b c a", "a b c") == (1, 3) and ter_edits("a b", "a b") == (0, 2) and ter_edits("", "a b") == (2, 2)
    assert one(spark, "کِا", lambda c: F.levenshtein(c, F.lit("کا"))) == 1


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(50).select(draw("s", F.col("id")).alias("x"))
    assert sorted(r.x for r in df.collect()) == sorted(r.x for r in df.repartition(7).collect())
