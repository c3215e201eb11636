import json

from pyspark.sql import functions as F

from corpuslake.functions.chat import pair_of_line, render, to_chat_json
from corpuslake.functions.lexicon import ERROR_TYPES
from corpuslake.operators import align, corrupt, reports, split
from corpuslake.operators.dedup import keep_first
from corpuslake.operators.generate import generate
from corpuslake.plans import clean
from corpuslake.sources import readers, writers
from corpuslake.streaming import resume

TYPES = [t for t, *_ in ERROR_TYPES]


def aligned(spark, raw, original="orig"):
    df = spark.createDataFrame([(raw,)], "r string")
    return [(x.error_type, x.error_sentence, x.parse_status) for x in df.select(align.align_items(align.extract_items(F.col("r")), F.lit(original)).alias("x")).first().x]


def test_alignment(spark):
    items = [{"error_type": t, "error_sentence": f"s{i}", "changed_part": ""} for i, t in enumerate(TYPES)]
    whole = json.dumps({"errors": items})
    for raw in (whole, f"```json\n{whole}\n```", f"<think>a</think>{whole}", f"text {whole} more", json.dumps(items)):
        assert [x[2] for x in aligned(spark, raw)] == ["success"] * 6
    odd = json.dumps({"errors": [{"error_type": TYPES[0], "error_sentence": "orig"}, {"error_type": "other", "error_sentence": "x"}, "y", 5]})
    assert aligned(spark, odd)[:4] == [(TYPES[0], "", "failed_empty_or_same"), (TYPES[1], "x", "success_order_aligned"), (TYPES[2], "y", "success_order_aligned"), (TYPES[3], "", "failed_missing")]
    for raw in ("{'errors': []}", whole[:40], "", None, f"so: [{json.dumps(items[0])}]"):
        assert {x[2] for x in aligned(spark, raw)} == {"failed_missing"}
    assert aligned(spark, json.dumps({"errors": [{"error_type": TYPES[0], "error_sentence": None}]}))[0][2] == "failed_empty_or_same"


def test_chat_round_trip(spark):
    pairs = spark.createDataFrame([("غلط جملہ", "صحیح جملہ")], "incorrect_sentence string, correct_sentence string")
    p = to_chat_json(pairs).select(pair_of_line(F.col("value")).alias("p")).first().p
    assert tuple(p) == ("غلط جملہ", "صحیح جملہ")
    flat = spark.createDataFrame([('{"source": "", "src": "a", "target": "b"}',), ("[]",), ("{x",)], "value string")
    assert [tuple(r.p) if r.p else None for r in flat.select(pair_of_line(F.col("value")).alias("p")).collect()] == [("a", "b"), None, None]


def test_eval_rows_limit_before_dedup(spark):
    lines = [(i, json.dumps({"error": e, "correct": c})) for i, (e, c) in enumerate([("a", "b"), ("a", "b"), ("c", "d"), ("x", "x")])]
    df = spark.createDataFrame(lines, "line_id long, value string")
    assert readers.eval_rows(df, limit=2).count() == 1 and readers.eval_rows(df).count() == 2 and readers.eval_rows(df, start=1).count() == 2


def test_corruption(spark):
    s = "وہ اسکول کے زمانے میں کرتا تھا"
    df = spark.createDataFrame([(s,), ("ا",), ("",)], "sentence string")
    for name, f in corrupt.FUNCTIONS.items():
        x = df.select(f(F.col("sentence")).alias("x")).collect()
        assert x[0].x.incorrect_sentence != s, name
        if name != "insertion":
            assert x[2].x is None
    assert corrupt.rule_pairs(df, variations=0).count() == 0
    many = spark.range(2000).select(F.concat(F.lit(s + " "), F.col("id").cast("string")).alias("sentence"))
    shares = {r.c: r["count"] / 2000 for r in many.groupBy(corrupt.choice(F.col("sentence")).alias("c")).count().collect()}
    assert abs(shares["spelling"] - 0.35) < 0.05 and abs(shares["deletion"] - 0.05) < 0.02


def test_splits(spark):
    df = spark.range(1000)
    a, b = split.three_way(df, F.col("id")), split.three_way(df.repartition(7), F.col("id"))
    assert {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"rule_input": 400, "llm_input": 400, "mt_input": 200}
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    c = split.dev_test_train(df, F.col("id"), 50, 60)
    assert {r.split: r["count"] for r in c.groupBy("split").count().collect()} == {"dev": 50, "test": 60, "train": 890}
    ranks = sorted(r["rank"] for r in split.hash_rank(df, F.col("id"), "s").collect())
    assert ranks == list(range(1, 1001))


def test_first_wins(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, None), (5, None)], "i int, t string")
    assert sorted(r.i for r in keep_first(df, [F.col("t")], ["i"]).collect()) == [1, 3, 4]


def test_attempts_account_for_all(spark):
    good = "پاکستان کرکٹ ٹیم نے میچ جیت لیا"
    df = spark.createDataFrame([(1, f"{good}۔ چھوٹا جملہ۔", "c", "s", good), (2, good, "c", "s", ""), (3, None, "c", "s", ""), (4, "nan", "c", "s", "")], "ord long, text string, category string, source string, headline string")
    a = clean.attempts(df)
    assert sorted(((r.ord, r.reject_reason or "") for r in a.collect())) == [(1, ""), (1, "too_short"), (2, "duplicate"), (3, "empty_text"), (4, "empty_text")]
    rows = {r.reason: r.n for r in reports.reject_breakdown(a).collect()}
    assert len(rows) == 9 and rows["duplicate"] == 1 and rows["empty_text"] == 2 and rows["too_short"] == 1
    assert clean.clean_sentences(df).count() == 1
    assert reports.quality_checks(clean.clean_sentences(df)).count() == 7


def test_length_stats(spark):
    df = spark.createDataFrame([(i,) for i in (4, 1, 3, 2)], "word_count int")
    r = reports.length_stats(df).first()
    assert (r.n, r.min_words, r.max_words, r.mean_words, r.median_words, r.upper_median) == (4, 1, 4, 2.5, 2.5, 3)


def test_readers(spark, tmp_path):
    text = "پاکستان کرکٹ ٹیم نے میچ جیت لیا"
    (tmp_path / "a.csv").write_text(f'News Text,Category\n"{text}, ""q""\nx",c\n', encoding="utf-8-sig")
    df, enc = readers.read_news_csv(spark, str(tmp_path / "a.csv"))
    assert enc == "utf-8-sig" and df.columns == ["News Text", "Category"] and readers.resolve(df, ("headline", "news text")) == "News Text"
    a = readers.news_articles(df).first()
    assert a.text == f'{text}, "q"\nx' and a.category == "c" and a.source == "" and readers.sniff_text_column(df) == "News Text"
    (tmp_path / "b.csv").write_text("a\nlatin\n")
    try:
        readers.read_news_csv(spark, str(tmp_path / "b.csv"))
        raise AssertionError
    except ValueError:
        pass
    assert readers.read_csv_auto(spark, str(tmp_path / "b.csv")).first().a == "latin"
    writers.append_ids(spark.createDataFrame([("1",), ("2",)], "original_id string"), str(tmp_path / "done"))
    writers.append_ids(spark.createDataFrame([("2",), (" ",)], "original_id string"), str(tmp_path / "done"))
    done = readers.read_done_ids(spark, str(tmp_path / "done"), str(tmp_path / "none"))
    assert sorted(r.original_id for r in done.collect()) == ["1", "2"]
    assert readers.with_ordinal(spark.createDataFrame([("x",), ("y",)], "v string")).orderBy("ord").first().v == "x"


def test_resume(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("original_id"))
    done = spark.createDataFrame([("3",), (None,), ("7",)], "original_id string")
    assert resume.pending(df, done).count() == 18
    calls = []
    work = lambda d: (calls.append(1), d)[1]
    resume.run_batches(df, work, str(tmp_path / "out"), 3)
    resume.run_batches(df, work, str(tmp_path / "out"), 3)
    assert len(calls) == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 20
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        resume.stream(spark, str(tmp_path / "in"), "original_id long", lambda d: d, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20


def test_generators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, p string")
    assert sorted(r.o for r in generate(df, "p", lambda: lambda x: [t + "!" for t in x], "o", 1).collect()) == ["!", "a!"]

    class Strict:
        def apply_chat_template(self, messages, tokenize, add_generation_prompt, **flags):
            if flags or any(m["role"] == "system" for m in messages):
                raise TypeError
            return messages[0]["content"]

    assert render(Strict(), [{"role": "system", "content": "S"}, {"role": "user", "content": "U"}]) == "S\n\nU"
    assert render(None, [{"role": "user", "content": "U"}]) == "U\n\nCorrected sentence:"


def test_ter_queries_take_all_triples(spark):
    from collections import defaultdict

    from corpuslake.functions.metrics import ter_edits
    from corpuslake.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append(r)
    ids = {a.conv_id * 1000 + a.turn for t in turns.values() for a, b, c in zip(t, t[1:], t[2:]) if b.text is not None and c.text is not None}
    rows = {r.sample_id: r for r in Q.all_triples(spark, sf).collect()}
    assert set(rows) == ids and not all("".join(r[1:]).isascii() for r in rows.values())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    bound = {r.sample_id: r.edits for r in Q.ter_bound(spark, sf).collect()}
    assert bound == {i: distance(r.prediction.lower().split(), r.correct_sentence.lower().split()) for i, r in rows.items()}
    pairs = [ter_edits(r.prediction, r.correct_sentence) for r in rows.values()]
    got = Q.ter_score(spark, sf).first()
    assert (got.edits, got.words) == (sum(p[0] for p in pairs), sum(p[1] for p in pairs))
