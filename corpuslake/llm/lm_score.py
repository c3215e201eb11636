"""Language-model scores of documents: a bigram backoff automaton over all training text, which no machine holds whole.

Documents are dealt into batches by key. A batch sends each of its distinct word pairs once, with its count in
training documents, to the bucket of the pair's first word; a bucket adds up the counts of all batches and
answers each batch in the order of its message. A batch then has the part of the automaton that its documents
can reach: a state for each word, an arc for each pair seen in training, and a failure arc from each state to
the root, which has an arc for every token. Its documents are read from left to right once.

First words that hold a large share of all tokens are spread over as many buckets as their share asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._base import ship, staged
from corpuslake.llm._words import U64, Words, mix, pieces

BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
#: From so many distinct words on, contexts and 40 bits of a successor don't fit one key.
WIDE = 1 << 24
#: Count classes of contexts: 1 to 15 apart, then by powers of two.
CLASSES = 80


@dataclass(frozen=True)
class Config:
    """add: the base's additive constant. batch_bytes, bucket_bytes: text in a batch, and text whose pairs a
    bucket gets; their numbers follow the input. hot: the share of tokens from which a word is spread."""

    add: float = 0.1
    batch_bytes: int = 8 << 20
    bucket_bytes: int = 16 << 20
    hot: float = 1 / 512


def count_class(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, np.int64)
    return np.where(c < 16, c, 12 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64))


class Pairs:
    """Contexts and pairs of a batch. token i follows contexts[vi[i]]; its pair is pi[i]; texts begin at first.

    Pairs are in the order of messages: by bucket, then context, then the 40 bits of the next word that tell the
    successors of a context apart. Documents may come in any order; the pairs' order doesn't depend on it.
    """

    def __init__(self, texts: pa.Array, train: np.ndarray, buckets: int, hot: dict[int, int]):
        w = Words(texts)
        n = np.diff(w.first)
        self.first = np.concatenate([[0], np.cumsum(n + 1)])
        total = int(self.first[-1])
        ctx = np.full(total, BEGIN, U64)
        begins = np.zeros(total, bool)
        begins[self.first[:-1]] = True
        ctx[~begins] = w.hashes
        nxt = np.empty(total, U64)
        nxt[:-1] = ctx[1:]
        nxt[self.first[1:] - 1] = END
        self.ends = self.first[1:] - 1
        self.contexts, self.vi = np.unique(ctx, return_inverse=True)
        spread = np.ones(len(self.contexts), np.int64)
        for h, s in hot.items():
            at = np.searchsorted(self.contexts, U64(h))
            if at < len(self.contexts) and self.contexts[at] == U64(h):
                spread[at] = s
        self.spread = spread
        home = (self.contexts % U64(buckets)).astype(np.int64)
        low = mix(nxt * U64(0xD1342543DE82EF95)) & U64((1 << 40) - 1)
        if len(self.contexts) < WIDE:  # one key that sorts by context, then successor
            uniq, self.pi = np.unique((self.vi.astype(U64) << U64(40)) | low, return_inverse=True)
            v, low = (uniq >> U64(40)).astype(np.int64), uniq & U64((1 << 40) - 1)
        else:  # a very long text can have more words; the same order by two keys
            order = np.lexsort((low, self.vi))
            new = np.ones(total, bool)
            new[1:] = (self.vi[order[1:]] != self.vi[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
            self.pi = np.empty(total, np.int64)
            self.pi[order] = np.cumsum(new) - 1
            v, low = self.vi[order[new]].astype(np.int64), low[order[new]]
        count = np.bincount(self.pi, weights=np.repeat(train, n + 1).astype(np.float64), minlength=len(v)).astype(np.int64)
        bucket = (home[v] + (low % spread[v].astype(U64)).astype(np.int64)) % buckets
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.pi = back[self.pi]
        self.v, self.low, self.count, self.bucket = v[order], low[order], count[order], bucket[order]
        self.buckets = buckets

    def messages(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, its contexts, pairs of each, low words, counts, whether a context is spread)."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(self.bucket)), strict=True):
            v = self.v[a:b]
            new = np.flatnonzero(np.diff(v, prepend=-1))
            yield int(self.bucket[a]), self.contexts[v[new]], np.diff(np.append(new, b - a)), self.low[a:b], self.count[a:b], self.spread[v[new]] > 1


def _five(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _counts(n: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 where one needs them."""
    return n.astype(np.uint64 if n.max(initial=0) >= 1 << 32 else np.uint32).tobytes()


def _answer(rows: list[dict]) -> tuple[list[dict], dict[str, np.ndarray]]:
    """Replies to the messages of one bucket, in their order, and what the bucket adds to the totals."""
    contexts = [np.frombuffer(r["contexts"], U64) for r in rows]
    runs = [np.frombuffer(r["runs"], np.uint32).astype(np.int64) for r in rows]
    all_contexts, where = np.unique(np.concatenate(contexts), return_inverse=True)
    low = np.concatenate([_unfive(r["low"]) for r in rows])
    count = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(np.int64)
    v = np.repeat(where, np.concatenate(runs))
    order = np.lexsort((low, v))
    new = np.ones(len(order), bool)
    new[1:] = (v[order[1:]] != v[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group, weights=count).astype(np.int64)
    of = v[order[new]]
    c = np.bincount(of, weights=total, minlength=len(all_contexts)).astype(np.int64)
    single = np.bincount(of, weights=total == 1, minlength=len(all_contexts)).astype(np.int64)
    hot = np.zeros(len(all_contexts), bool)
    hot[where[np.concatenate([np.frombuffer(r["hot"], np.uint8) for r in rows]).astype(bool)]] = True
    replies, a, p = [], 0, 0
    for r, own in zip(rows, contexts, strict=True):
        m = len(r["counts"]) // 4
        replies.append({"b": r["b"], "bucket": r["bucket"], "pairs": _counts(total[group[p : p + m]]), "c": c[where[a : a + len(own)]].astype(np.uint64).tobytes()})
        a, p = a + len(own), p + m
    return replies, {"context": all_contexts, "c": c, "single": single, "hot": hot}


def _totals(t: dict[str, np.ndarray]) -> list[tuple[str, int, int, int]]:
    """(kind, key, tokens, singles): novelty by the class of the count less one; words; parts of spread words."""
    cold = (t["c"] > 0) & ~t["hot"]
    cls = count_class(t["c"] - 1)
    word = cold & (t["context"] != BEGIN)
    out = [("class", int(k), int(t["c"][m].sum()), int(t["single"][m].sum())) for k in np.unique(cls[cold]) if (m := cold & (cls == k)).any()]
    out.append(("words", 0, int(word.sum()), 0))
    hot = np.flatnonzero(t["hot"])
    return out + [("hot", int(t["context"][i].astype(np.int64)), int(t["c"][i]), int(t["single"][i])) for i in hot]


class Automaton:
    """The states and arcs that the documents of a batch can reach.

    The state after a word is that word; before the first it is BEGIN. arc: log10 weights of pairs seen in
    training, NaN for the others; fail: of the failure arcs to the root; root: of the root's arcs, by context's
    word; end: of the root's arc for the end. A context that training lacks has no arcs and a failure arc of weight 0.
    """

    def __init__(self, pairs: Pairs, pair_counts: np.ndarray, contexts: np.ndarray, end_count: int, tokens: int, types: int, novelty: np.ndarray, add: float):
        below = np.log10(tokens + add * (types + 1)) if tokens + add * (types + 1) > 0 else 0.0
        self.root = np.log10(contexts + add) - below
        self.end = np.log10(end_count + add) - below
        self.known = contexts > 0
        share = np.where(contexts > 0, novelty[np.minimum(count_class(contexts), CLASSES - 1)], 1.0)
        self.fail = np.log10(share)
        self.share, self.contexts, self.pair_counts, self.pairs = share, contexts, pair_counts, pairs

    def traverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base and score of each text, reading from left to right; the state is the word before."""
        p = self.pairs
        state = p.vi
        word = np.append(state[1:], 0)
        root = self.root[word]
        known = self.known[word].copy()
        root[p.ends] = self.end
        known[p.ends] = self.end_known
        seen = self.pair_counts[p.pi]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = self.share[state]
            arc = np.log10((1 - share) * seen / np.maximum(self.contexts[state], 1) + share * 10.0**root)
        step = np.where(seen > 0, arc, self.fail[state] + root)
        at = p.first[:-1]
        if not len(at):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        return np.diff(p.first), np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(root, at), np.add.reduceat(step, at)

    end_known = True


def _profile(source: DataFrame, cfg: Config) -> tuple[int, int, int, dict[int, float]]:
    """Bytes of text, training documents, training tokens, and the words of a share of `hot` or more with that share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                w = Words(part.column("text"))
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                rows = [("bytes", 0, len(w.raw)), ("docs", 0, int((~held).sum())), ("tokens", 0, int((np.diff(w.first) + 1)[~held].sum())), ("all", 0, len(w.hashes) + len(held))]
                # first the words with a share among every eighth, so that few are counted in full
                some, n = np.unique(w.hashes[::8], return_counts=True)
                some = np.sort(some[n >= max(2, cfg.hot * len(w.hashes) / 32)])
                if len(some):
                    at = np.minimum(np.searchsorted(some, w.hashes), len(some) - 1)
                    n = np.bincount(at[some[at] == w.hashes], minlength=len(some))
                    rows += [("word", int(h.astype(np.int64)), int(c)) for h, c in zip(some, n, strict=True) if c >= cfg.hot / 2 * len(w.hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["kind", "key", "n"])

    totals = source.select("held", "text").mapInArrow(run, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    totals = staged(totals, "profile")
    sums = {r["kind"]: r["n"] for r in totals.where("kind <> 'word'").collect()}
    every = max(1, sums.get("all", 0))
    # at most 1 / hot words can have such a share
    words = {r["key"]: r["n"] / every for r in totals.where((F.col("kind") == "word") & (F.col("n") >= cfg.hot * every)).collect()}
    return sums.get("bytes", 0), sums.get("docs", 0), sums.get("tokens", 0), words


def lm_scores(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Training documents are those whose crc32 of the doc_id as text isn't 0 modulo 10. The root is the base:
    (count + add) / (N + add * (V + 1)). A state v has P(w | v) = (1 - f) c(v w) / c(v) + f P(w), where f, the
    weight of its failure arc, is the share of new pairs that leave-one-out finds in contexts of its count class.

    Null texts count as empty: one token, the end. A null doc_id counts as held out. Repeated rows are each
    scored, and each counts in training; other columns are ignored; an empty table gives no rows. Without
    training text all weights come from the additive constant. Memory: a batch or a bucket.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    source = docs.select("doc_id", held.alias("held"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, train_docs, tokens, shares = _profile(source, cfg)
    batches, buckets = max(1, -(-size // cfg.batch_bytes)), max(1, -(-size // cfg.bucket_bytes))
    hot = {int(np.int64(h).view(U64)): max(2, int(np.ceil(s * buckets))) for h, s in shares.items() if buckets > 1 and s * buckets > 0.25}
    dealt = source.withColumn("b", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(batches)).cast("int"))

    def ask(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        b = group.column("b")[0].as_py()
        text = group.column("text").combine_chunks() if isinstance(group.column("text"), pa.ChunkedArray) else group.column("text")
        pairs = Pairs(text, ~group.column("held").to_numpy(zero_copy_only=False).astype(bool), buckets, hot)
        rows = [(b, k, c.tobytes(), r.astype(np.uint32).tobytes(), _five(low), n.astype(np.uint32).tobytes(), h.astype(np.uint8).tobytes()) for k, c, r, low, n, h in pairs.messages()]
        return pa.table([pa.array(x) for x in zip(*rows, strict=True)], names=["b", "bucket", "contexts", "runs", "low", "counts", "hot"]).cast(_ASKED)

    def answer(group: pa.Table) -> pa.Table:
        replies, totals = _answer(group.to_pylist())
        rows = [(r["b"], r["bucket"], r["pairs"], r["c"], None, None, None, None) for r in replies] + [(None, None, None, None, *t) for t in _totals(totals)]
        return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _ANSWERED, strict=True)], schema=_ANSWERED)

    asked = dealt.groupBy("b").applyInArrow(ask, "b int, bucket int, contexts binary, runs binary, low binary, counts binary, hot binary")
    answered = staged(asked.groupBy("bucket").applyInArrow(answer, "b int, bucket int, pairs binary, c binary, kind string, key long, n long, single long"), "lm-replies")
    sums = answered.where("kind IS NOT NULL").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("single").alias("single")).collect()  # classes, and words of a share: bounded
    hot_counts = {int(np.int64(r["key"]).view(U64)): r["n"] for r in sums if r["kind"] == "hot"}
    types = sum(r["n"] for r in sums if r["kind"] == "words") + sum(1 for h, n in hot_counts.items() if n > 0 and h != int(BEGIN)) + (train_docs > 0)
    seen, single = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        if r["kind"] == "class" or (r["kind"] == "hot" and r["n"] > 0):
            k = r["key"] if r["kind"] == "class" else int(count_class(r["n"] - 1))
            seen[k] += r["n"]
            single[k] += r["single"]
    novelty = np.clip((single + 0.5) / (seen + 1.0), 1e-4, 0.9999)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], f.type) for f in out], schema=out)
        left = left.combine_chunks()
        text = left.column("text").combine_chunks() if isinstance(left.column("text"), pa.ChunkedArray) else left.column("text")
        held_out = left.column("held").to_numpy(zero_copy_only=False).astype(bool)
        pairs = Pairs(text, ~held_out, buckets, hot)
        contexts, counts = np.zeros(len(pairs.contexts), np.int64), np.zeros(len(pairs.v), np.int64)
        replies = {r["bucket"]: r for r in right.to_pylist()}
        at = 0
        for bucket, own, _, low, _, _ in pairs.messages():
            r = replies[bucket]
            counts[at : at + len(low)] = np.frombuffer(r["pairs"], U64 if len(r["pairs"]) > 4 * len(low) else np.uint32).astype(np.int64)
            contexts[np.searchsorted(pairs.contexts, own)] = np.frombuffer(r["c"], U64).astype(np.int64)
            at += len(low)
        for h, n in hot_counts.items():
            i = np.searchsorted(pairs.contexts, U64(h))
            if i < len(contexts) and pairs.contexts[i] == U64(h):
                contexts[i] = n
        automaton = Automaton(pairs, counts, contexts, train_docs, tokens, types, novelty, cfg.add)
        automaton.end_known = train_docs > 0
        n_tokens, n_known, base, total = automaton.traverse()
        return pa.table([left.column("doc_id"), pa.array(held_out), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(n_tokens), tokens)), pa.array(base), pa.array(total)], names=out.names).cast(out)

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    out = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    replies = answered.where("b IS NOT NULL").select("b", "bucket", "pairs", "c")
    return dealt.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_ASKED = pa.schema([("b", pa.int32()), ("bucket", pa.int32()), ("contexts", pa.binary()), ("runs", pa.binary()), ("low", pa.binary()), ("counts", pa.binary()), ("hot", pa.binary())])
_ANSWERED = pa.schema([("b", pa.int32()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("c", pa.binary()), ("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("single", pa.int64())])
