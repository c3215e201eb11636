"""Brute-force checks of the operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import decontaminate, html_extract, license_scan, lm_score, minhash, pieces, quality, shard, substring_dedup, token_count
from corpuslake.llm._words import Words
from corpuslake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


def low(t):
    return (t or "").encode().lower().split()


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [text_of(rng, rng.randint(30, 120)) for _ in range(40)]
    out = list(base)
    for t in base[:12]:
        w = t.split()
        out.append(t.upper())
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(len(v))] = text_of(rng, 1)
            out.append(" ".join(v))
    out += [None, "", "  \n", "one", "ONE", "one two", "one two", "x" * 5000, text_of(rng, 20000), "é ▁ 中文　 a  b \x00 <s>"]
    return [(i, t, "kept", 5) for i, t in enumerate(out)] + [(0, out[0], "again", 5), (None, "no id at all but some words here", "z", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_words_match_bytes_split():
    rng = random.Random(1)
    texts = [None, "", " a", "b ", text_of(rng, 3000), "A\x0bb\x0cC\td", "é ü", "x"]
    w = Words(pa.array(texts, pa.string()))
    n = 0
    seen = {}
    for i, t in enumerate(texts):
        own = low(t)
        assert w.first[i + 1] - w.first[i] == len(own)
        for j, x in enumerate(own):
            k = w.first[i] + j
            assert bytes(w.raw[w.starts[k] : w.ends[k]]) == x
            assert seen.setdefault(x, w.hashes[k]) == w.hashes[k]
            n += 1
    assert len(set(seen.values())) == len(seen) and n == len(w.hashes)
    assert (w.hash_spans(w.starts, w.ends, 64) == w.hashes).all()


def test_quality(docs, rows, empty):
    got = {(r.doc_id, r.word_chars): r for r in quality.quality(docs).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        m = {j + d for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for d in range(8)}
        r = got[i, sum(map(len, w))]
        assert (r.n_words, r.n_repeat_words, r.n_symbols) == (len(w), len(m), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert r.base_failed == (len(w) < 20 or 100 * len(m) > 30 * len(w))
    assert quality.quality(empty).count() == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    plan = quality.quality(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeats_and_lines(spark):
    w8 = "a b c d e f g h"
    texts = [f"{w8} {w8}", f"{w8} x {w8} y", " ".join(["a"] * 30), "p q\n \np q\nr\np q"]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_repeat_words for i in range(4)] == [16, 16, 30, 0] and got[3].n_dup_lines == 2 and got[3].n_lines == 4


def test_jump_hash(spark, docs, rows, empty):
    def jump(key, n):
        b, j = -1, 0
        key &= (1 << 64) - 1
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    out = shard.shard(docs, 24).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(list)
    for r in out:
        assert r.shard == jump(r.doc_id or 0, 24) and r.grown_shard == jump(r.doc_id or 0, 25)
        sizes[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    by = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == by and shard.shard(empty).count() == 0
    for n in (1, 2, 7, 100):
        keys = spark.createDataFrame([(k,) for k in (0, 1, -1, 2**62, -(2**63), 123456789)], "k long")
        assert all(r.j.shard == jump(r.k, n) and r.j.grown == jump(r.k, n + 1) for r in keys.select("k", shard.jump(F.col("k"), n).alias("j")).collect())


def test_token_counts(docs, rows, empty):
    sp, safe = token_count.load(MODEL)
    assert safe
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, MODEL).collect())
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in rows)
    assert got == want and token_count.count_tokens(empty, MODEL).count() == 0
    odd = ["a  b", " a", "a ", "▁ ▁▁ x ▁y", "a ▁b c", "\n \n", "x" * 300 + " " + "y" * 300]
    c = token_count.Counter(MODEL, keep=3)
    for _ in range(3):
        assert c.count(odd) == [len(sp.encode(t)) for t in odd]


def near(rows, k, percent):
    sets = {i: frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w := low(t)) >= k else frozenset([tuple(w)] if w else []) for i, t, *_ in rows if i is not None}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((comp[a], comp[b]))
                comp = {i: x if c == y else c for i, c in comp.items()}
    return sets, comp


@pytest.mark.parametrize("cfg", [minhash.Config(), minhash.Config(k=5, percent=80), minhash.Config(hot=2, block_docs=3, few_blocks=1, broadcast_ids=0)])
def test_near_duplicates(docs, rows, cfg):
    sets, comp = near(rows, cfg.k, cfg.percent)
    got = minhash.near_duplicates(docs, cfg).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_near_duplicates_of_nothing(empty, docs):
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1


def test_estimate_is_corrected():
    cfg = minhash.Config()
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(2000)]
    a = " ".join(words[:1000])
    b = " ".join(words[200:1200])
    s = minhash.signatures(pa.array([a, b]), cfg)
    blocks = cfg.minima // 64
    p = s["planes"].view(np.uint64).reshape(2, cfg.bits, blocks)
    differ = np.bitwise_or.reduce(p[0] ^ p[1], axis=0)
    est = ((1 - sum(int(x).bit_count() for x in differ) / cfg.minima) - 2.0**-cfg.bits) / (1 - 2.0**-cfg.bits)
    assert abs(est - 798 / 1198) < 0.2 and rng is not None


def test_components_on_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7), (102, 100)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model(docs, rows, empty):
    cfg = lm_score.Config(batch_bytes=40_000, bucket_bytes=30_000, hot=1 / 64)
    got = lm_score.lm_scores(docs.withColumn("score", F.lit(1)), cfg).collect()
    assert len(got) == len(rows)
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows}
    train = [[*low(t), None] for i, t, *_ in rows if not held[i]]
    c = Counter(w for t in train for w in t)
    big = Counter(p for t in train for p in zip(["<s>", *t], t))
    ctx = Counter()
    for (v, _), n in big.items():
        ctx[v] += n
    single = Counter()
    for (v, _), n in big.items():
        single[v] += n == 1
    seen, one = Counter(), Counter()
    for v, n in ctx.items():
        k = int(lm_score.count_class(n - 1))
        seen[k] += n
        one[k] += single[v]
    n_all, types = sum(c.values()), len(c)
    root = lambda w: (c[w] + 0.1) / (n_all + 0.1 * (types + 1))

    def p(v, w):
        if not ctx[v]:
            return root(w)
        k = int(lm_score.count_class(ctx[v]))
        f = min(max((one[k] + 0.5) / (seen[k] + 1), 1e-4), 0.9999)
        return (1 - f) * big[v, w] / ctx[v] + f * root(w)

    by = defaultdict(list)
    for i, t, *_ in rows:
        by[i].append([*low(t), None])
    for r in got:
        w = by[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n_all)
        assert math.isclose(r.base_score, sum(math.log10(root(x)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(v, x)) for v, x in zip(["<s>", *w], w)), rel_tol=1e-9)
    # the weights of a state sum to one over all words and the unknown
    for v in ("<s>", *list(ctx)[:5]):
        assert math.isclose(sum(p(v, w) for w in c) + p(v, "never seen"), 1, rel_tol=1e-9)
    assert lm_score.lm_scores(empty).count() == 0


def test_fenwick_chains_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        a = [(rng.randint(0, 60), rng.randint(0, 60), rng.randint(3, 9)) for _ in range(rng.randint(1, 14))]
        found = substring_dedup.chains(a, 0.3)
        best = [0.0] * len(a)
        for i in sorted(range(len(a)), key=lambda i: a[i]):
            best[i] = a[i][2] + max([0, *(best[j] - 0.3 * (a[i][0] - a[j][0] - a[j][2] + a[i][1] - a[j][1] - a[j][2]) for j in range(len(a)) if a[j][0] + a[j][2] <= a[i][0] and a[j][1] + a[j][2] <= a[i][1])])
        first = found[0]
        score = sum(a[i][2] for i in first) - 0.3 * sum(a[y][0] - a[x][0] - a[x][2] + a[y][1] - a[x][1] - a[x][2] for x, y in zip(first, first[1:]))
        assert math.isclose(score, max(best)) and sorted(i for c in found for i in c) == list(range(len(a)))


def test_substring_dedup(spark, empty):
    rng = random.Random(11)
    passage = text_of(rng, 70).split()
    edited = [*passage[:30], "changed", *passage[31:50], *passage[52:]]
    bodies = [text_of(rng, 80) for _ in range(6)]
    texts = [f"{bodies[0]} {' '.join(passage)}", bodies[1], f"{' '.join(passage).upper()} {bodies[2]}", f"{bodies[3][:200]} {' '.join(edited)} {bodies[3][200:]}", bodies[4], "", None, bodies[1]]
    docs = spark.createDataFrame([(i + 10, t, len(t or "")) for i, t in enumerate(texts)] + [(None, texts[0], 3)], "doc_id long, text string, n_chars long")
    cfg = substring_dedup.Config(batch_bytes=1500, bucket_bytes=1500)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs, cfg).collect()}
    assert set(got) == {12, 13, 17} and {r.source_id for r in got.values()} == {10, 11}
    raw = texts[2].encode()
    assert raw[got[12].start_byte : got[12].end_byte].lower().split() == " ".join(passage).encode().split() and got[12].edits == 0
    raw = texts[3].encode()
    assert raw[got[13].start_byte : got[13].end_byte].split() == " ".join(edited).encode().split() and got[13].edits == 3
    left = {r.doc_id: r for r in substring_dedup.drop_repeated_passages(docs, cfg).collect()}
    assert left[12].text.split() == bodies[2].split() and left[12].n_chars == len(left[12].text)
    assert left[10].text == texts[0] and left[15].text == "" and left[16].text is None and 17 not in left and None in left
    assert substring_dedup.repeated_passages(empty).count() == 0 and substring_dedup.drop_repeated_passages(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination(spark, docs, empty):
    rng = random.Random(13)
    items = [text_of(rng, n).split() for n in (8, 12, 25, 40, 60, 3)]
    bench = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    planted, texts = {}, []
    for i, w in enumerate(items[:5]):
        for k in range(12):
            v = list(w)
            for _ in range(k % (len(w) // 5 + 1)):
                at = rng.randrange(len(v))
                v[at : at + 1] = rng.choice([[], [text_of(rng, 1)], [v[at], text_of(rng, 1)]])
            texts.append(f"{text_of(rng, rng.randint(0, 30))} \"{' '.join(v).upper()}\", {text_of(rng, rng.randint(0, 30))}")
            planted[len(texts) - 1] = (i, edits(w, v))
    texts += [text_of(rng, 300), "", None, " ".join(items[5])]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    for d, (i, e) in planted.items():
        if e <= len(items[i]) // 5:
            assert got[d, i].distance <= e, (d, i, e)
    assert set(got) <= {(d, i) for d, (i, _) in planted.items()} | {(len(texts) - 1, 5)} and got[len(texts) - 1, 5].distance == 0
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    small = decontaminate.Config(block_bytes=300)
    assert decontaminate.contaminated(df, bench, small).count() == len(got)
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_licenses(spark, empty):
    t = license_scan.TEMPLATES
    mit = t["MIT"].split()
    texts = ["words before. " + t["Apache-2.0-notice"] + " and after", "é " + " ".join([*mit[:20], "new", *mit[21:]]), "nothing here of the kind at all", "", None, t["MIT-notice"] + " x " * 50 + t["MIT-notice"].lower()]
    df = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)], "doc_id long, text string, license string")
    got = defaultdict(list)
    for r in license_scan.scan_licenses(df).collect():
        got[r.doc_id].append(r)
    a = [r for r in got[0] if r.license == "Apache-2.0-notice"][0]
    assert texts[0].encode()[a.start_byte : a.end_byte].decode() == t["Apache-2.0-notice"].rstrip(".") and a.coverage == 1
    m = [r for r in got[1] if r.license == "MIT"][0]
    assert m.matched_words >= len(mit) - 3 and not got[2] and not got[3] and not got[4]
    assert len([r for r in got[5] if r.license == "MIT-notice"]) == 2
    assert license_scan.scan_licenses(empty).count() == 0


def test_html(spark):
    tree = html_extract.train()
    truth = [b for b in html_extract.LABELLED if html_extract.classify(tree, b[:-1]) != b[-1]]
    assert len(truth) <= 0.02 * len(html_extract.LABELLED)
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now</div>
      <article><h1>T&eacute;st &amp; more</h1><p>One <b>bold</b><br>line</p><aside>side</aside><p>Two&nbsp;three</p><div class="comments"><p>I like it</p></div></article><footer>&copy; x</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page, 2), (2, None, None, 2), (3, "v", "", 2), (4, "w", "<p", 2), (1, "u", page, 2)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect()))
    want = "Tést & more One bold line Two three"
    assert got[:2] == [(1, want, len(want))] * 2 and got[2] == (2, "", 0) and html_extract.extract(df.limit(0)).count() == 0
    sample = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in sample.join(html_extract.extract(sample).select("page_id", "text"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())


def test_viterbi_equals_brute_force(docs, rows, empty):
    rng = random.Random(17)
    table = [("<unk>", 0.0, "other"), *[(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]]
    table += [(p, -rng.random() * 9 - 1, "normal") for p in ["▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "▁ab", "ca", "é", "▁▁", "cab"]]
    v = pieces.Vocabulary(table)
    score = {p: s for p, s, k in table if k == "normal"}

    def best(t):
        t = "▁" + t.replace(" ", "▁")
        out = [(0.0, [])] + [None] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(e):
                x = score.get(t[s:e], v.unk_score if e - s == 1 and t[s:e] not in score else None)
                if x is not None and out[s] and (out[e] is None or out[s][0] + x > out[e][0] + 1e-12):
                    out[e] = (out[s][0] + x, [*out[s][1], t[s:e]])
        return out[-1][1]

    texts = ["".join(rng.choice("abcab é中") for _ in range(rng.randint(0, 25))) for _ in range(200)]
    ids, at = v.encode(texts)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        want = [x for p in best(t) for x in ([next(i for i, r in enumerate(table) if r[0] == p)] if p in score else [1 + c for c in p.encode()])] if t else []
        assert list(ids[a:b]) == want, t
    raw, ends = v.decode(ids, at)
    assert [raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts
    got = pieces.encode_pieces(docs, MODEL)
    assert got.columns == [*docs.columns, "pieces", "n_pieces", "pieces_crc32", "round_trip"]
    back = pieces.decode_pieces(got, MODEL).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.decoded == (r.text or "").replace("▁", " ") and r.round_trip == ("▁" not in (r.text or "")) and r.n_pieces == len(r.pieces)
    assert pieces.encode_pieces(empty, MODEL).count() == 0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [text_of(rng, 1)], [out[at], text_of(rng, 1)]])
    return out


def test_edited_passages_are_found(spark):
    rng = random.Random(23)
    rows, planted = [], []
    for i in range(120):
        p = text_of(rng, 60).split()
        q = edited(rng, p, (3, 6, 9)[i % 3])
        rows += [(i, f"{text_of(rng, 60)} {' '.join(p)} {text_of(rng, 60)}"), (1000 + i, f"{text_of(rng, 60)} {' '.join(q)} {text_of(rng, 60)}")]
        planted.append((1000 + i, i))
    got = {(r.doc_id, r.source_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= set(planted) and len(got) >= 0.97 * len(planted)


@pytest.mark.parametrize("kind", ["replaced", "inserted", "deleted"])
def test_passages_at_the_limit(spark, kind):
    """Passages of similarity 0.8 itself are found wherever the edits lie: at random, at equal distances, side by side near an end."""
    rng = random.Random(59)
    rows, texts = [], {}
    for words in (40, 45, 60, 100):
        size = words + words // 4 if kind == "deleted" else words
        for i in range(12):
            p = text_of(rng, size).split()
            e = size // 5
            at = [sorted(rng.sample(range(1, size - 1), e)), [1 + int((j + 0.5) * (size - 2) / e) for j in range(e)], [3 + j for j in range(e)]][i % 3]
            q = list(p)
            for j in reversed(at):
                q[j : j + 1] = {"replaced": [text_of(rng, 1)], "inserted": [q[j], text_of(rng, 1)], "deleted": []}[kind]
            d = len(rows) // 2
            rows += [(d, f"{text_of(rng, 50)} {' '.join(p)} {text_of(rng, 50)}"), (1000 + d, f"{text_of(rng, 50)} {' '.join(q)} {text_of(rng, 50)}")]
    texts = dict(rows)
    got = set()
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own, src = texts[r.doc_id][r.start_byte : r.end_byte].split(), texts[r.source_id].split()
        assert len(own) == r.n_words >= 40 and r.similarity >= 0.8 - 1e-9
        last = np.zeros(len(src) + 1, np.int64)  # least edits against any stretch of the source
        for w in own:
            now = np.minimum(last + 1, np.concatenate([[last[0] + 1], last[:-1] + (np.array(src) != w)]))
            last = np.minimum.accumulate(now - np.arange(len(now))) + np.arange(len(now))
        assert last.min() <= r.edits
        got.add((r.doc_id, r.source_id))
    assert got == {(1000 + d, d) for d in range(48)}


@pytest.mark.parametrize("parts", [[(0, 30), (30, 60)], [(0, 38), (22, 60)], [(0, 20), (20, 40), (40, 60)]])
def test_passage_whose_parts_others_hold(spark, parts):
    rng = random.Random(29)
    rows, whole = [], {}
    for i in range(20):
        p = text_of(rng, 60).split()
        for j, (a, b) in enumerate([*parts, (0, 60), (0, 60)]):
            head = text_of(rng, 50)
            rows.append((100 * i + j, f"{head} {' '.join(p[a:b])} {text_of(rng, 50)}"))
            whole[100 * i + j] = (len(head) + 1, len(head) + 1 + len(" ".join(p)))
    spans = defaultdict(set)
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans[r.doc_id] |= set(range(r.start_byte, r.end_byte))
    for i in range(20):
        d = 100 * i + len(parts) + 1
        assert set(range(*whole[d])) <= spans[d]


@pytest.mark.parametrize("kind", ["replaced", "inserted", "deleted"])
def test_decontamination_at_the_limit(spark, kind):
    rng = random.Random(31)
    items, texts = [], []
    for n in (8, 20, 40, 60, 100, 150):
        for _ in range(20):
            words = text_of(rng, n).split()
            items.append(" ".join(words))
            for at in sorted(rng.sample(range(n), n // 5), reverse=True):
                words[at : at + 1] = {"replaced": [text_of(rng, 1)], "inserted": [words[at], text_of(rng, 1)], "deleted": []}[kind]
            texts.append(f"{text_of(rng, 20)} {' '.join(words)} {text_of(rng, 20)}")
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{name} long, text string") for x, name in ((texts, "doc_id"), (items, "item_id")))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got >= {(i, i) for i in range(len(items))}


def test_two_passages_of_one_source():
    rng = random.Random(37)
    p, q = text_of(rng, 45).split(), text_of(rng, 80).split()
    a, b = [*p, *text_of(rng, 60).split(), *q], [*p, *text_of(rng, 60).split(), *q]
    found = substring_dedup.longest(a, b, [(0, 0, 45), (105, 105, 80)], 0.8, 40)
    words = set()
    for x0, x1, *_ in found:
        words |= set(range(x0, x1))
    assert words >= {*range(45), *range(105, 185)}


@pytest.mark.parametrize("letters", [(2, 7), (30, 34), (60, 64), (200, 204)])
def test_passages_of_long_words(spark, letters):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(*letters)))
    rows, whole = [], {}
    for i in range(30):
        p = [word() for _ in range(60)]
        q = list(p)
        for at in rng.sample(range(8, 52), 2):
            q[at] = word()
        for d, body in ((i, p), (1000 + i, q)):
            head = " ".join(word() for _ in range(30))
            rows.append((d, f"{head} {' '.join(body)} {' '.join(word() for _ in range(30))}"))
            whole[d] = (len(head) + 1, len(head) + 1 + len(" ".join(body)))
    got = {(r.doc_id, r.source_id): (r.start_byte, r.end_byte) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1000 + i, i) for i in range(30)} and all(got[d, s] == whole[d] for d, s in got)


def test_passage_tiled_by_earlier_documents(spark):
    rng = random.Random(43)
    rows, whole = [], {}
    for i in range(20):
        p = text_of(rng, 100).split()
        for j, (a, b) in enumerate([*((k, k + 24) for k in range(0, 100, 20)), (0, 100), (0, 100)]):
            head = text_of(rng, 50)
            rows.append((100 * i + j, f"{head} {' '.join(p[a:b])} {text_of(rng, 50)}"))
            whole[100 * i + j] = (len(head) + 1, len(head) + 1 + len(" ".join(p[a:b])))
    got = {(r.doc_id, r.source_id): (r.start_byte, r.end_byte) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(100 * i + 6, 100 * i + 5) for i in range(20)} and all(got[d, s] == whole[d] for d, s in got)


def test_exact_passages_equal_brute_force(spark):
    """Every word of an equal run of 50 words with any earlier document is in a span but for 10 words at the run's ends; spans hold."""
    rng = random.Random(47)
    pool = [text_of(rng, rng.randint(20, 160)).split() for _ in range(25)]
    docs = []
    for d in range(90):
        words = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            words += p[a : rng.randint(a + 1, len(p))] if rng.random() < 0.6 else p
            words += text_of(rng, rng.randint(0, 15)).split()
        docs.append(words)
    spans = defaultdict(list)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    for r in substring_dedup.repeated_passages(df, substring_dedup.Config(batch_bytes=6000, bucket_bytes=9000)).collect():
        text = " ".join(docs[r.doc_id])
        assert zlib.crc32(text[r.start_byte : r.end_byte].encode()) == r.crc32 and r.source_id < r.doc_id
        own = text[r.start_byte : r.end_byte].split()
        src = docs[r.source_id]
        assert len(own) == r.n_words >= 40 and min(edits(own, src[i : i + len(own) + m]) for m in (0, r.edits, -r.edits) for i in range(len(src))) <= 2 * r.edits
        first = len(text[: r.start_byte].split())
        spans[r.doc_id] += range(first, first + len(own))
    k = 50
    for d, words in enumerate(docs):
        for s in range(d):
            held = {tuple(docs[s][i : i + k]) for i in range(len(docs[s]) - k + 1)}
            hits = [i for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in held]
            for i in hits:
                assert set(range(i + 10, i + k - 10)) <= set(spans[d]), (d, s, i)


def test_clashing_names_and_repeated_ids(spark):
    rng = random.Random(53)
    p = text_of(rng, 70)
    other = text_of(rng, 90)
    rows = [(1, f"{other} {p}", "a", 1), (2, f"{p} {text_of(rng, 40)}", "b", 2), (2, text_of(rng, 120), "c", 3), (3, None, "d", 4), (None, p, "e", 5), (4, f"{other} {p}", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _spans long").withColumn("at", F.lit(0)).withColumn("Spans", F.lit(1)).withColumn("gone", F.lit(2))
    bench = spark.createDataFrame([(1, " ".join(other.split()[:30]))], "item_id long, text string")
    cut = substring_dedup.drop_repeated_passages(docs)
    left = {r._id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and set(left) == set("abcde") and left["b"].split() == rows[1][1].split()[70:] and left["c"] == rows[2][1] and left["a"] == rows[0][1]
    near = minhash.drop_near_duplicates(docs)
    assert near.columns == docs.columns and {r._id for r in near.collect()} == set("abcde")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r._id for r in clean.collect()} == set("bcde")


def test_near_copies_of_a_large_group(spark):
    """A group of copies with many edits of their own: buckets are large, and what can't be linked is thinned out first."""
    rng = random.Random(59)
    base = text_of(rng, 120).split()
    rows = [(i, " ".join(edited(rng, base, rng.choice((0, 1, 2, 3, 4, 6, 9, 14)))), "g", 0) for i in range(120)]
    cfg = minhash.Config(hot=4, block_docs=40)
    _, comp = near(rows, cfg.k, cfg.percent)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string, n long"), cfg).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_licenses_equal_brute_force():
    """The whole-text longest common subsequence over every window as long as a template and its band says which licenses a text holds."""
    rng = random.Random(61)
    cfg = license_scan.Config()
    known = license_scan.Templates(license_scan.TEMPLATES, cfg)
    words = {n: known.words[i] for i, n in enumerate(known.names)}
    texts = []
    for n, t in license_scan.TEMPLATES.items():
        for k in (0, 1, 3):
            v = t.split()
            for _ in range(k * len(v) // 40):
                at = rng.randrange(len(v))
                v[at : at + 1] = rng.choice([[], [text_of(rng, 1)], [v[at], text_of(rng, 1)]])
            texts.append(f"{text_of(rng, rng.randint(0, 20))} {' '.join(v)} {text_of(rng, rng.randint(0, 20))}")
    texts += [text_of(rng, 200), ""]
    got = {(t, n) for t, n, *_ in known.scan(pa.array(texts))}

    def lcs(a, b):
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
        return int(row[-1])

    w = decontaminate.trimmed_words(pa.array(texts))
    for t in range(len(texts)):
        own = w.hashes[w.first[t] : w.first[t + 1]]
        for n, template in words.items():
            width = len(template) + min(cfg.band, max(1, len(template) // 2)) // 2
            most = max((lcs(template, own[i : i + width]) for i in range(max(1, len(own) - width + 1))), default=0) if len(own) else 0
            if most >= cfg.coverage * len(template):
                assert (t, n) in got, (t, n)
            elif (t, n) in got:
                assert lcs(template, own) >= cfg.coverage * len(template)


def test_licenses_side_by_side(spark):
    t = license_scan.TEMPLATES["MIT-notice"]
    df = spark.createDataFrame([(1, "\n".join([t] * 9)), (1, "\n".join([t] * 9)), (2, t + " " + t)], "doc_id long, text string")
    got = Counter((r.doc_id, r.license) for r in license_scan.scan_licenses(df).collect())
    assert got[1, "MIT-notice"] == 18 and got[2, "MIT-notice"] == 2


def test_tree_uses_densities_and_cues(spark):
    tree = html_extract.train()
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    long = lambda n: " ".join(["word"] * n)
    links = "".join(f"<li><a href='/{i}'>more on this</a></li>" for i in range(6))
    crafted = [
        f"<article><h1>Head</h1><p>{long(80)}</p><p>{long(60)}</p><ul>{links}</ul></article>",
        f"<article><h2>Teaser</h2><p>{long(18)}</p></article><div><p>{long(90)}</p><p>{long(120)}</p><p>{long(100)}</p></div>",
        f"<div><ul>{links}</ul></div><div><p>{long(90)}</p><p>{long(60)}</p></div>",
        f"<article><div class='header'><p>{long(60)}</p><p>{long(50)}</p></div></article>",
    ]
    main = [html_extract.main_text(p, tree).split() for p in crafted]
    assert [m.count("word") for m in main] == [140, 328, 150, 110] and not any("more" in m for m in main)
    flat = lambda row, at, value: tuple(value if i in at else x for i, x in enumerate(row))
    differ = right = n = 0
    for p in crafted + pages:
        for row in html_extract.features(html_extract.blocks(p)):
            now = html_extract.classify(tree, row)
            differ += html_extract.classify(tree, flat(row, {1, 3, 5}, 0.0)) != now
            right += (html_extract.classify(tree, flat(row, {6, 7, 8}, 0)) == now) * row[0]
            n += row[0]
    assert differ > 0 and right >= 0.8 * n


def test_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "Alpha beta."), (2, "one two three four five"), (3, "solo"), (4, "..."), (5, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha BETA y alpha, beta"), (2, "one two three four"), (3, "Solo; one two three four five"), (4, None), (3, "solo")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.n_windows, r.item_words) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 1, 1, 2, 2), (3, 2, 1, 1, 5), (3, 3, 0, 1, 1), (3, 3, 0, 1, 1), (3, 5, 1, 1, 5)]


def test_language_model_of_many_words(monkeypatch):
    """The two ways to order pairs agree."""
    rng = random.Random(67)
    texts = pa.array([text_of(rng, 300), text_of(rng, 50), ""])
    train = np.array([True, False, True])
    a = lm_score.Pairs(texts, train, 3, {})
    monkeypatch.setattr(lm_score, "WIDE", 0)
    b = lm_score.Pairs(texts, train, 3, {})
    for x in ("v", "low", "count", "bucket", "pi"):
        assert (getattr(a, x) == getattr(b, x)).all()


def test_pipeline_stages_on_odd_rows(spark, rows, empty):
    import corpus_pipeline

    bench = "/root/testdata/sf0.001"
    cases = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (cases, cases.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, bench)
            assert set(docs.columns) <= set(out.columns), name
            out.write.format("noop").mode("overwrite").save()
