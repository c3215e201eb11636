"""Plans, whole records, and the helpers that no query calls."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import metrics as M
from corpuslake.functions import text as T
from corpuslake.operators import split, validate
from corpuslake.operators.dedup import keep_first
from corpuslake.plans import clean
from corpuslake.plans import queries as Q
from corpuslake.sources import readers, writers

SF = "/root/testdata/sf0.001"


def below_exchange(df):
    """The optimized plan's lines under the repartition of the rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Repartition") :] if "Repartition" in plan else ""


@pytest.mark.parametrize("name", ["clean_sentences", "length_stats", "rule_pairs", "reject_breakdown"])
def test_cleaning_stands_above_the_exchange(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = below_exchange(Q.QUERIES[name](spark, SF))
    assert plan and "regexp_replace" not in plan


def test_reject_breakdown_reads_once(spark):
    plan = Q.QUERIES["reject_breakdown"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"documents\.parquet|Relation \[", plan)) <= 1 and plan.count("Generate posexplode") == 1


def test_reason_counts_equal_attempts(spark):
    articles = Q.articles(spark, SF)
    want = {r[0]: r[1] for r in clean.attempts(articles).groupBy("reject_reason").count().collect()}
    assert {r.reject_reason: r.n for r in clean.reason_counts(articles).collect() if r.n} == want


def test_gender_rule_has_rows(spark):
    assert Q.QUERIES["rule_gender"](spark, SF).count() > 0


def test_fences_in_any_case(spark):
    df = spark.createDataFrame([('```JSON\n{"answer": "وہ آیا"}\n```',)], "t string")
    assert df.select(T.prediction(F.col("t"))).first()[0] == "وہ آیا" and df.select(T.without_thoughts(F.col("t"))).first()[0] == '{"answer": "وہ آیا"}'


def test_metrics_record(spark):
    df = spark.createDataFrame([(1, "a b", "a c", "a c"), (2, "x y z", "x y", "x z y")], "sample_id long, error_sentence string, correct_sentence string, prediction string")
    r = M.metrics_record(df, "m", "p.csv", "m.json").first().asDict()
    assert next(iter(r)) == "model" and r["predictions_path"] == "p.csv" and r["metrics_path"] == "m.json" and r["num_samples"] == 2 and r["exact_match"] == 50.0
    assert r["ter"] == 25.0 and 0 < r["chrf"] < 100
    none = M.metrics_record(df.limit(0)).first()
    assert none.num_samples == 0 and none.chrf is None and none.ter is None


def test_overlap_of_repeats(spark):
    df = spark.createDataFrame([("a a b b b c", "a b b d a a"), ("a", "a"), ("", "a")], "p string, r string")
    got = [x[0] for x in df.select(M._overlap(M.ngrams(T.tokens(F.col("p")), 1), M.ngrams(T.tokens(F.col("r")), 1))).collect()]
    assert got == [4, 1, 0]


def test_bound_of_many_words(spark):
    words = [f"w{i}" for i in range(9000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:-1] + ["x"]))], "p string, r string")
    assert df.select(M.shift_free_edits(F.col("p"), F.col("r"))).first()[0] == 1


def test_own_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7, 8), (2, "a", 5, 6, 7, 8)], "i int, t string, _key int, _rank int, key int, rank int")
    assert keep_first(df, [F.col("t")], ["i"]).columns == df.columns and keep_first(df, [F.col("t")], ["i"]).first().key == 7
    odd = spark.range(50).withColumn("_h", F.lit(1)).withColumn("_r", F.lit(2)).withColumn("digest_of_rank", F.lit(3))
    assert split.hash_rank(odd, F.col("id"), "s").columns == [*odd.columns, "rank"]
    sample = split.sample_by_group(df, "t", F.col("i"), 1)
    assert sample.columns == df.columns and sample.count() == 1


def test_ordinals_follow_the_file(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}-{i}\n" for i in range(40)))
    df = spark.read.text(str(tmp_path))
    got = {r.ord: r.value for r in readers.with_ordinal(df).collect()}
    assert sorted(got) == list(range(120)) and [got[i] for i in range(120)] == [r.value for r in df.collect()]


def test_encoding_is_judged_by_the_whole_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a\n" + b"plain\n" * 3000 + "سلام".encode("cp1256") + b"\n")
    assert readers.read_csv_auto(spark, str(tmp_path / "a.csv")).where("a = 'سلام'").count() == 1


def test_chat_file(spark, tmp_path):
    lines = [json.dumps({"messages": [{"role": "user", "content": f"Correct the following text: a{i}"}, {"role": "assistant", "content": f"b{i}"}]}) for i in range(5)]
    (tmp_path / "c.jsonl").write_text("\n".join([*lines[:2], "", "{broken", *lines[2:]]))
    rows = readers.read_chat_jsonl(spark, str(tmp_path / "c.jsonl")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.error_sentence, r.correct_sentence) for r in rows] == [(0, "a0", "b0"), (1, "a1", "b1"), (4, "a2", "b2"), (5, "a3", "b3"), (6, "a4", "b4")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", "dev"), (2, "c", "train")], "n int, value string, split string")
    writers.export_csv(df.orderBy("n"), str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfn,value,split")
    writers.append_csv(df, str(tmp_path / "a"))
    writers.append_csv(df, str(tmp_path / "a"))
    assert sorted(r.value for r in readers.read_csv(spark, str(tmp_path / "a")).collect()) == ["a,\"b\""] * 2 + ["c"] * 2
    writers.append_records(df, str(tmp_path / "r"))
    assert sorted(json.loads(r.value)["n"] for r in spark.read.text(str(tmp_path / "r")).collect()) == [1, 2]
    writers.write_splits(df, str(tmp_path / "s"))
    assert {r.split: r.value for r in spark.read.text(str(tmp_path / "s")).collect()} == {"dev": "a,\"b\"", "train": "c"}
    writers.write_metrics(df.where("n = 2"), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["value"] == "c"
    assert "-- rows\n  1  " in writers.text_report("t", {"rows": df.orderBy("n")})
    sample = spark.createDataFrame([("x", 3, "s1"), ("nan", 2, "s2")], "category string, word_count int, sentence string")
    text = writers.review_text(sample, spark.createDataFrame([("x", 1200)], "value string, n long"))
    assert "1,200" in text and "s1" in text and "s2" not in text


def test_guards(spark):
    df = spark.createDataFrame([(None, 1), ("پاکستان کرکٹ ٹیم", 2), (" ", 3)], "t string, n int")
    validate.require_script(df, "t")
    validate.require_rows(df)
    for bad in (lambda: validate.require_script(df.where("n <> 2"), "t"), lambda: validate.require_rows(df.limit(0))):
        with pytest.raises(ValueError):
            bad()
    blank, rest = validate.blank_and_pending(df, "t")
    assert blank.count() == 2 and rest.count() == 1
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("", "b")], "error_sentence string, correct_sentence string")
    assert validate.accepted_eval(pairs).count() == 1


def test_shuffle_is_reproducible(spark):
    df = spark.range(100)
    a, b = [r.id for r in split.shuffled(df, F.col("id")).collect()], [r.id for r in split.shuffled(df.repartition(3), F.col("id")).collect()]
    assert a == b and a != list(range(100)) and sorted(a) == list(range(100))


def test_generation_can_be_interrupted(spark, tmp_path):
    from corpuslake.functions.lexicon import ERROR_TYPES
    from corpuslake.plans.generation import finished, generate_errors

    answer = json.dumps({"errors": [{"error_type": t, "error_sentence": f"s{i}", "changed_part": ""} for i, (t, *_) in enumerate(ERROR_TYPES)]})
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}", "x") for i in range(12)], "original_id long, sentence string, topic string")
    path = str(tmp_path / "run")

    def breaks():
        return lambda prompts: [answer if "t7\n" not in p else 1 / 0 for p in prompts]

    def works():
        return lambda prompts: [answer if "t5\n" not in p else "no" for p in prompts]

    with pytest.raises(Exception):
        generate_errors(rows, breaks, path, batches=4)
    assert generate_errors(rows, works, path, batches=2) > 0 and generate_errors(rows, works, path, batches=2) == 0
    more = rows.unionByName(spark.createDataFrame([(50, "t50", "x")], rows.schema))
    assert generate_errors(more, works, path, batches=1) > 0
    pairs = finished(rows, path)
    assert {r.original_id: r["count"] for r in pairs.groupBy("original_id").count().collect()} == {i: 6 for i in (*range(12), 50) if i not in (3, 5)} | ({} if pairs.where("original_id = 5").isEmpty() else {5: 6})
    assert "orig_topic" in pairs.columns and finished(rows, path, "failed").where("original_id <> 5").isEmpty()
    assert sorted(int(r.original_id) for r in spark.read.parquet(f"{path}/done").collect()) == [*range(12), 50]


def test_stats_report(spark):
    from corpuslake.plans.report import stats_report

    articles = Q.articles(spark, SF)
    good = clean.clean_sentences(articles).cache()
    text = stats_report(articles, "T", good)
    good.unpersist()
    assert all(f"-- {x}" in text for x in ("Totals", "Rejections", "Categories", "Sources", "Lengths", "Random sentences")) and "too_short" in text


def test_chunks_equal_plain_python(spark):
    from corpuslake.functions.lexicon import CHUNK_MARKS
    from corpuslake.operators import segment

    def plain(sentence):
        out, held = [], ""
        for word in sentence.split():
            held = f"{held} {word}".strip()
            if len(held.split()) >= 30:
                mark = next((m for m in CHUNK_MARKS if m in held), None)
                pieces = held.split(mark) if mark else [held, ""]
                out += [p.strip() + (mark or "") for p in pieces[:-1] if p.strip()]
                held = pieces[-1].strip()
        return [c for c in [*out, held] if len(c.split()) >= 5]

    t = F.trim(F.regexp_replace("text", T.WS, " "))
    rows = Q.articles(spark, SF).select("ord", F.posexplode(segment.sentences(t)).alias("pos", "s")).collect()
    want = sorted((r.ord, i, c) for r in rows if len(r.s.split()) > 30 for i, c in enumerate(plain(r.s)))
    got = sorted((r.doc_id, r.pos, r.chunk) for r in Q.QUERIES["sentence_chunks"](spark, SF).collect())
    assert got == want and len(got) > 50


def test_alignment_equals_plain_python(spark):
    from corpuslake.functions.lexicon import ERROR_TYPES

    types = {t: (cat, zh) for t, cat, zh, _ in ERROR_TYPES}

    def items(raw):
        t = re.sub(r"```(?:json|JSON)?", "", re.sub(r"(?s)<think>.*?</think>", "", raw.strip())).strip()
        for part in (t, *(m[0] for p in (r"\{.*\}", r"\[.*\]") if (m := re.search(p, t, re.S)))):
            try:
                x = json.loads(part)
            except ValueError:
                continue
            x = x.get("errors", []) if isinstance(x, dict) else x
            return [(i["error_type"], i["error_sentence"].strip(), i["changed_part"]) if isinstance(i, dict) else ("", i.strip(), "") for i in x]
        return []

    def aligned(raw, sentence):
        left, by, out = [], {}, []
        for i in items(raw):
            if i[0] in types and i[0] not in by:
                by[i[0]] = i
            else:
                left.append(i)
        for t in types:
            i = by.get(t) or (left.pop(0) if left else None)
            good = i is not None and i[1] not in ("", sentence)
            status = ("success" if good else "failed_empty_or_same") if t in by else ("success_order_aligned" if good else "failed_missing")
            out.append((t, i[1] if good else "", i[2] if i else "", status))
        return out

    raw = {r.original_id: r for r in Q._model_outputs(spark, SF).collect()}
    want = sorted((i, r.sentence, x[1], types[x[0]][0], x[0], types[x[0]][1], x[2], x[3]) for i, r in raw.items() for x in aligned(r.raw_output, r.sentence))
    got = sorted((r.original_id, r.original_sentence, r.error_sentence, r.error_category, r.error_type, r.error_type_zh, r.changed_part, r.parse_status) for r in Q.QUERIES["llm_align"](spark, SF).collect())
    assert got == want
    good = {i: sum(x[3].startswith("success") for x in aligned(r.raw_output, r.sentence)) for i, r in raw.items()}
    failed = sorted((r.original_id, r.original_sentence, r.success_count, r.raw_output) for r in Q.QUERIES["llm_failed_raw"](spark, SF).collect())
    assert failed == sorted((i, r.sentence, good[i], r.raw_output[:3000]) for i, r in raw.items() if good[i] < 6)
