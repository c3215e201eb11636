"""The pipeline against each stage's brute-force meaning on the smallest table."""

import corpus_pipeline
from corpuslake.llm import quality, substring_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "piece_encoding"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {r.doc_id: r for r in docs.collect()}
    fine = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    # near copies by brute force
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i in fine if (w := texts[i].text.encode().lower().split()) or True}
    comp = {i: i for i in fine}
    for a in fine:
        for b in fine:
            n = len(sets[a] & sets[b])
            if a < b and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((comp[a], comp[b]))
                comp = {i: x if c == y else c for i, c in comp.items()}
    single = {i for i in fine if comp[i] == i}
    assert set(out) <= single
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i in single if any(b in " ".join(texts[i].text.lower().split()) for b in bench)}
    assert not leaked & set(out)
    # clean documents stay: one that is gone holds a benchmark item or is, edited, a passage of a document before it
    for i in single - set(out) - leaked:
        assert max(len(sets[i] & sets[j]) / len(sets[i]) for j in single if j < i) >= 0.4, i
    assert sum(out[i].text != texts[i].text for i in out) <= 0.1 * len(out)
    assert all(r.round_trip and r.n_pieces == len(r.pieces) for r in out.values())


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_shared_passages_are_cut(spark):
    """After substring dedup no document holds 50 words in a row of an earlier one, and what is cut stood in one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, docs, SF).collect()}
    seen, short, cut = set(), set(), 0
    for d in sorted(before):
        text, now = before[d].text or "", after[d].text if d in after else ""
        if grams(text, 50) & seen:
            assert not grams(now, 50) & seen, d
        if now != text:
            gone = grams(text, 5) - grams(now, 5)
            assert len(text.split()) - len(now.split()) >= 40 and len(gone & short) >= 0.3 * len(gone), d
            cut += 1
            assert d not in after or after[d].n_chars == len(now)
        seen |= grams(text, 50)
        short |= grams(text, 5)
    assert cut >= 20


def test_substring_dedup_moves_no_clean_texts(spark):
    """Where few documents are cut, the others are picked by broadcast ids, also when Spark itself wouldn't broadcast; rows are the same by either path."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", docs["doc_id"] + 1000))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = substring_dedup.drop_repeated_passages(docs)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "LeftOuter" not in plan and "BroadcastHashJoin" in plan
        rows = {r.doc_id: r for r in few.collect()}
        assert rows == {r.doc_id: r for r in substring_dedup.drop_repeated_passages(docs, substring_dedup.Config(broadcast_ids=0)).collect()}
        assert len(rows) < docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
