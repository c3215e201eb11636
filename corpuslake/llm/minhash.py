"""Near-duplicate documents by b-bit MinHash (Li and Koenig, 2010), confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._base import drop_staged, lower_ascii, ship, staged, without, words_col
from corpuslake.llm._words import U64, Words, mix, pieces
from corpuslake.llm.components import components


@dataclass(frozen=True)
class Config:
    """k: words in a shingle; percent: the least Jaccard similarity; bands * rows minima make the bucket keys.

    At similarity 0.85, a pair shares none of 36 buckets of 7 minima with probability (1 - 0.85**7)**36 = 9e-7,
    at 0.8 (1 - 0.8**7)**36 = 2e-4; a pair at 0.5 meets with 0.25. slack: how far below the limit an estimate may
    fall before a pair is dropped unconfirmed; 0.15 is over six standard deviations of 256 minima. hot: members of
    a bucket from which shingles that no other member of such buckets has are counted. block_shingles, block_docs:
    sets that one task compares with one another at most; few_blocks: from how many such blocks a cluster is dealt
    bucket by bucket. broadcast_ids: up to so many ids (16 bytes each) are broadcast to pick texts.
    """

    k: int = 3
    percent: int = 85
    bands: int = 36
    rows: int = 7
    bits: int = 4
    slack: float = 0.15
    hot: int = 16
    block_shingles: int = 2 << 20
    block_docs: int = 8192
    few_blocks: int = 8
    broadcast_ids: int = 2 << 20

    @property
    def minima(self) -> int:
        return -(-self.bands * self.rows // 64) * 64


_PAD = U64(0x5851F42D4C957F2D)


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and offsets by text; a text of 1 to k - 1 words has one shingle, its whole sequence."""
    hashes, offsets = words.shingles(k)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return hashes, offsets
    values = [mix(np.array([np.bitwise_xor.reduce(mix(words.hashes[words.first[i] : words.first[i + 1]] * U64(3) + np.arange(1, n[i] + 1, dtype=U64))) ^ _PAD], U64))[0] for i in short]
    hashes = np.insert(hashes, offsets[short], np.array(values, U64))
    counts = np.maximum(n - (k - 1), 0)
    counts[short] = 1
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def signatures(part: pa.Array, cfg: Config) -> dict[str, np.ndarray]:
    """Set sizes, content hashes, band keys and packed bit planes of some texts."""
    words = Words(part)
    hashes, offsets = shingle_hashes(words, cfg.k)
    n = len(part)
    of = np.repeat(np.arange(n), np.diff(offsets))
    size = np.zeros(n, np.int64)
    minima = np.zeros((cfg.minima, n), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for i in full:
            hashes[offsets[i] : offsets[i + 1]].sort()
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        new[offsets[full]] = True
        size = np.bincount(of[new], minlength=n).astype(np.int64)
        x = (hashes[new] >> U64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(size[full])])[:-1]
        rng = np.random.Generator(np.random.PCG64(20101))
        a = rng.integers(0, 1 << 32, cfg.minima, np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, cfg.minima, np.uint32)
        y = np.empty_like(x)
        for j in range(cfg.minima):
            np.multiply(x, a[j], out=y)
            y += b[j]
            minima[j, full] = np.minimum.reduceat(y, at)
    keys = np.empty((n, cfg.bands), np.int64)
    for j in range(cfg.bands):
        h = np.full(n, j + 1, U64)
        for r in range(cfg.rows):
            h = mix(h * U64(0xD1342543DE82EF95) + minima[j * cfg.rows + r].astype(U64))
        keys[:, j] = h.view(np.int64)
    blocks = cfg.minima // 64
    planes = np.empty((n, cfg.bits * blocks), np.int64)
    for p in range(cfg.bits):
        low = ((minima >> np.uint32(p)) & np.uint32(1)).astype(np.uint8)
        planes[:, p * blocks : (p + 1) * blocks] = np.packbits(low, axis=0).T.copy().view(np.int64).reshape(n, blocks)
    place = np.arange(len(words.hashes), dtype=np.int64) - np.repeat(words.first[:-1], np.diff(words.first))
    content = np.zeros((2, n), U64)
    has = np.flatnonzero(np.diff(words.first))
    if len(has):
        for c in range(2):
            content[c, has] = np.add.reduceat(mix(words.hashes * U64(2 * c + 3) + place.astype(U64) * U64(0x9E3779B97F4A7C15 + 2 * c)), words.first[has])
    return {"size": size, "content": content, "keys": keys, "planes": planes}


def _signed(docs: DataFrame, cfg: Config) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                s = signatures(part.column("text"), cfg)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1))) for m in (s["keys"], s["planes"])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s["size"]), *[pa.array(c.view(np.int64)) for c in s["content"]], *lists], names=["id", "n_shingles", "c1", "c2", "keys", "planes"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, n_shingles long, c1 long, c2 long, keys array<long>, planes array<long>")


def estimate(a: Column, b: Column, cfg: Config) -> Column:
    """Similarity from packed planes: minima agree where no plane differs; chance agreement of b bits is taken off."""
    blocks = cfg.minima // 64
    differ = F.lit(0)
    for j in range(blocks):
        word = None
        for p in range(cfg.bits):
            x = F.get(a, F.lit(p * blocks + j)).bitwiseXOR(F.get(b, F.lit(p * blocks + j)))
            word = x if word is None else word.bitwiseOR(x)
        differ = differ + F.bit_count(word)
    chance = 2.0**-cfg.bits
    return ((1 - differ / F.lit(float(cfg.minima))) - chance) / (1 - chance)


def shingle_set(text: Column, k: int) -> Column:
    """The distinct shingles of a text as 64-bit hashes, by built-in functions."""
    from corpuslake.llm.quality import let

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.array_distinct(many)

    return let(words_col(lower_ascii(text)), of)


def _sets(texts: DataFrame, ids: DataFrame, cfg: Config) -> DataFrame:
    """id and shingle set of the texts of these ids; the ids are broadcast if they are few, else texts are shuffled."""
    ids = staged(ids, "ids")
    few = F.broadcast(ids) if ids.count() <= cfg.broadcast_ids else ids
    sets = staged(texts.join(few, "id", "left_semi").select("id", shingle_set(F.col("text"), cfg.k).alias("s")), "sets")
    drop_staged(ids)
    return sets


def _possible(cfg: Config, n1: str, s1: str, n2: str, s2: str) -> Column:
    """Whether sets of n1 and n2 elements, of which at most s1 and s2 occur elsewhere, can have the similarity."""
    most = F.least(s1, s2)
    return 100 * most >= cfg.percent * (F.col(n1) + F.col(n2) - most)


def _links(pairs: DataFrame, sets: DataFrame, planes: DataFrame, cfg: Config) -> DataFrame:
    """Those of pairs (a < b) whose full sets have the similarity."""
    pa_, pb = (planes.select(F.col("id").alias(x), F.col("planes").alias(f"p{x}")) for x in "ab")
    likely = pairs.join(pa_, "a").join(pb, "b").where(estimate(F.col("pa"), F.col("pb"), cfg) >= cfg.percent / 100 - cfg.slack).select("a", "b")
    sa, sb = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    sure = likely.join(sb, "b").join(sa, "a").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return staged(sure.where(100 * F.col("both") >= cfg.percent * (F.col("total") - F.col("both"))).select("a", "b"), "links")


class Group:
    """Sets that share buckets, and links enough to connect all of them that are linked.

    A shingle that one set alone has is in no intersection: sets that can't be linked for that are left out, until
    none is left to leave out. Other pairs of different components are compared by their bit planes, and those
    that may have the similarity by their elements.
    """

    def __init__(self, ids: np.ndarray, comps: np.ndarray, side: np.ndarray, planes: np.ndarray, values: np.ndarray, offsets: np.ndarray, cfg: Config):
        self.cfg, self.planes = cfg, planes
        self.ids, self.n = ids, np.diff(offsets)
        _, self.token = np.unique(values, return_inverse=True)
        self.offsets, self.side = offsets, side
        _, self.label = np.unique(comps, return_inverse=True)
        of = np.repeat(np.arange(len(ids)), self.n)
        live = self.n > 0
        while True:
            used = live[of]
            shared = np.bincount(self.token[used], minlength=1)
            s = np.bincount(of[used], weights=shared[self.token[used]] > 1, minlength=len(ids)).astype(np.int64)
            now = live & (100 * s >= cfg.percent * self.n)
            if (now == live).all():
                break
            live = now
        self.live, self.s = np.flatnonzero(live), s

    def links(self) -> list[tuple[int, int]]:
        cfg, out, live = self.cfg, [], self.live
        blocks, chance = cfg.minima // 64, 2.0**-cfg.bits
        p = self.planes[live].reshape(len(live), cfg.bits, blocks)
        n, s, label, side = self.n[live], self.s[live], self.label[live], self.side[live]
        mixed = side.min() != side.max() if len(live) else False
        mark = np.zeros(int(self.token.max(initial=0)) + 1, bool)
        for i in range(len(live) - 1):
            js = np.arange(i + 1, len(live))
            most = np.minimum(s[i], s[js])
            js = js[(label[js] != label[i]) & (100 * most >= cfg.percent * (n[i] + n[js] - most)) & (not mixed or side[js] != side[i])]
            if not len(js):
                continue
            differ = np.bitwise_count(np.bitwise_or.reduce(p[js] ^ p[i], axis=1)).sum(axis=1, dtype=np.int64)
            js = js[(1 - differ / cfg.minima - chance) / (1 - chance) >= cfg.percent / 100 - cfg.slack]
            if not len(js):
                continue
            own = self.token[self.offsets[live[i]] : self.offsets[live[i] + 1]]
            mark[own] = True
            first, size = self.offsets[live[js]], n[js]
            ends = np.cumsum(size)
            at = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))
            both = np.add.reduceat(mark[self.token[at]].astype(np.int64), ends - size)
            mark[own] = False
            for j in js[100 * both >= cfg.percent * (n[i] + size - both)].tolist():
                if label[j] != label[i]:
                    out.append((int(self.ids[live[i]]), int(self.ids[live[j]])))
                    label[label == label[j]] = label[i]
        return out


def _group_links(live: DataFrame, sets: DataFrame, planes: DataFrame, cfg: Config) -> DataFrame:
    """Links between the components of live (bucket, id, comp, n) whose members share a bucket.

    Members go to tasks by cluster, the connected members of live buckets; what a cluster holds is dealt into
    blocks of bounded size, and a task compares two blocks. A cluster of many blocks is dealt by bucket instead.
    """
    hub = live.groupBy("bucket").agg(F.min("id").alias("a"))
    label = staged(components(live.join(hub, "bucket").select("a", F.col("id").alias("b"))), "clusters")
    member = live.select("id", "comp", "n").dropDuplicates(["id"]).join(label.withColumnRenamed("comp", "cluster"), "id")
    blocks = lambda df, key: df.groupBy(key).agg(F.greatest(F.ceil(F.sum("n") / cfg.block_shingles), F.ceil(F.count("*") / cfg.block_docs)).alias("blocks"))
    sizes = staged(blocks(member, "cluster"), "sizes")
    small = member.join(sizes.where(F.col("blocks") <= cfg.few_blocks), "cluster").select(F.lit(0).alias("kind"), F.col("cluster").alias("group"), "id", "comp", "blocks")
    wide = live.join(label.withColumnRenamed("comp", "cluster"), "id").join(sizes.where(F.col("blocks") > cfg.few_blocks), "cluster").select("bucket", "id", "comp", "n")
    by_bucket = wide.join(blocks(wide, "bucket"), "bucket").select(F.lit(1).alias("kind"), F.col("bucket").alias("group"), "id", "comp", "blocks")
    dealt = small.unionByName(by_bucket).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other")
    tasks = dealt.select("kind", "group", "id", "comp", "own", other).select("kind", "group", "id", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        s = group.column("s").combine_chunks()
        s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
        planes = np.array(group.column("planes").to_pylist(), np.int64).view(np.uint64)
        found = Group(*(group.column(c).to_numpy() for c in ("id", "comp", "own")), planes, s.flatten().to_numpy(), np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy())]), cfg).links()
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ends.min(axis=1) if len(ends) else ends[:, 0], "b": ends.max(axis=1) if len(ends) else ends[:, 1]})

    full = tasks.join(planes, "id").join(sets, "id")
    links = staged(full.groupBy("kind", "group", "i", "j").applyInArrow(run, "a long, b long"), "links")
    drop_staged(label, sizes)
    return links


def _thinned(members: DataFrame, sets: DataFrame, cfg: Config) -> DataFrame:
    """members (bucket, id, n, size) with s, the shingles that can be shared; those that can't be linked in a hot bucket go.

    In buckets of over ``hot`` members, a shingle that one member of all these buckets has is in no intersection.
    A document edited in many places of its own so drops out before it is paired with anything. The counts are
    one row for each shingle of the members; the sets of ids that repeat with other texts count as wholly shared.
    """
    crowd = members.where(F.col("size") > cfg.hot).select("id").distinct()
    sets = sets.join(crowd, "id", "left_semi")
    each = sets.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    own = each.where("c = 1").groupBy("id").agg(F.count("*").alias("own"))
    once = sets.groupBy("id").agg(F.count("*").alias("c")).where("c = 1").select("id")
    own = staged(own.join(once, "id", "left_semi"), "own")
    joined = members.join(own, "id", "left").withColumn("s", F.when(F.col("size") > cfg.hot, F.col("n") - F.coalesce("own", F.lit(0))).otherwise(F.col("n")))
    return joined.where(100 * F.col("s") >= cfg.percent * F.col("n")).select("bucket", "id", "n", "s")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links; only links between components are worked on."""
    ends = links
    for x in "ab":
        label = comp.select(F.col("id").alias(x), F.col("comp").alias("c"))
        ends = ends.join(label, x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    new = staged(components(ends), "merges")
    to = new.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    old = comp.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return old.unionByName(new.join(comp, "id", "left_anti"))


def near_duplicates(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents with equal word sequences form a class, and the smallest doc_id stands for it. Candidates are
    pairs of class representatives in a bucket whose set sizes, less the shingles that none but one of them has
    in large buckets, allow the similarity (_thinned; the bound is exact). A bucket doesn't emit its pairs: each
    member is paired with the member that has the fewest shingles of its own, which connects groups of copies.
    Buckets whose members are then in several components are compared inside tasks of bounded size (_group_links),
    which emit no more links than connect what is linked. So each pair that shares a bucket is ruled out, tested or
    connected in the end, and rows stay in proportion to members; only comparisons of bit planes inside a task grow
    with the square of a group whose members are alike but not linked.

    Links are confirmed on the full sets. Null and empty texts have no shingles, are linked with nothing and
    kept. A null doc_id is linked with nothing either and has a null component; it is kept. Rows that repeat
    a doc_id are one node and are all returned. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    sigs = staged(_signed(docs, cfg), "signatures")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    some = sigs.where("n_shingles > 0 AND id IS NOT NULL")
    classes = staged(some.groupBy("c1", "c2").agg(F.min("id").alias("rep")), "classes")
    reps = staged(some.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.col("n_shingles").alias("n"), "keys", "planes"), "representatives")
    entries = reps.select("id", "n", F.explode("keys").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(entries.join(shared, "bucket"), "members")
    planes = reps.select("id", "planes")
    sets = _sets(texts, members.select("id").distinct(), cfg)
    active = staged(_thinned(members, sets, cfg), "buckets")
    drop_staged(members)
    hub = active.groupBy("bucket").agg(F.min(F.struct(F.col("n") - F.col("s"), "id", "n", "s")).alias("h")).select("bucket", F.col("h.id").alias("hub"), F.col("h.n").alias("hn"), F.col("h.s").alias("hs"))
    met = active.join(staged(hub, "hubs"), "bucket").where((F.col("id") != F.col("hub")) & _possible(cfg, "n", "s", "hn", "hs"))
    links = _links(met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), sets, planes, cfg)
    comp = staged(components(links), "components")
    # buckets of members of several components, but for those of two, which have been compared
    labelled = active.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high AND size > 2").select("bucket")
    live = staged(labelled.join(mixed, "bucket", "left_semi").select("bucket", "id", "comp", "n"), "live")
    if not live.isEmpty():
        more = _group_links(live, sets, planes, cfg)
        if not more.isEmpty():
            comp = staged(_merged(comp, more), "components")
    drop_staged(live, active, sets, links, reps)
    named = classes.join(comp, classes.rep == comp.id, "left").select("c1", "c2", F.coalesce("comp", "rep").alias("comp"))
    found = sigs.join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, cfg: Config = Config(k=5, percent=80)) -> DataFrame:
    """The documents without those that are near copies of a smaller doc_id's component; all columns stay.

    Null and empty texts, rows with a null doc_id and rows that repeat a kept doc_id all stay; columns of any name
    do; an empty table gives an empty one.
    """
    return without(docs, near_duplicates(docs, cfg).where("NOT kept").select("doc_id"))
