"""Benchmark passages in documents, by CGK embedding (Chakraborty, Goldenberg, Koucky, 2016) and bit-sampling LSH.

Both sides are sequences of words: lower-cased A-Z, ASCII punctuation at a word's edges taken off. A window
of a document has as many words as an item. A random walk embeds a window so that edit distance becomes
Hamming distance; a bucket key samples some positions of the embedding; windows that share a key with an
item of their size are confirmed by exact edit distance. So are all windows that hold enough of an item's word
triples, which every window within the limit does: no case within the limit depends on the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpuslake.llm._base import ship, without
from corpuslake.llm._words import U64, Words, mix, pieces, roll

_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_OUT = "doc_id long, item_id long, distance int, item_words int, start_byte long, end_byte long, first_word long, n_windows long"


@dataclass(frozen=True)
class Config:
    """similarity: least share of an item's words that survives editing. walks * keys buckets of `sample`
    positions each; a window and an item that share `votes` buckets are compared. The keys of a walk that has
    lost step fail together, so buckets alone lose cases at the limit, most of all deletions in long items; windows
    that pass the bound of word triples are compared without them. min_words: shorter items are found where all
    their words occur in order, unchanged, whatever their length.
    block_bytes: items are sent to the workers in blocks of this size, so what is broadcast is bounded.
    """

    similarity: float = 0.8
    walks: int = 8
    keys: int = 8
    sample: int = 2
    votes: int = 3
    min_words: int = 8
    block_bytes: int = 16 << 20

    def edits(self, n):
        return np.floor((1 - self.similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def trimmed_words(column: pa.Array) -> Words:
    """Words without punctuation at the edges; words of punctuation alone go."""
    w = Words(column)
    starts, ends = w.starts.copy(), w.ends.copy()
    for side, at in ((1, starts), (-1, ends)):
        live = np.arange(len(at))
        while len(live):
            pos = at[live] if side == 1 else at[live] - 1
            live = live[(ends[live] > starts[live]) & _EDGE[w.raw[np.minimum(pos, len(w.raw) - 1)]]] if len(w.raw) else live[:0]
            at[live] += side
    keep = ends > starts
    changed = np.flatnonzero(keep & ((starts != w.starts) | (ends != w.ends)))
    hashes = w.hashes.copy()
    if len(changed):
        hashes[changed] = w.hash_spans(starts[changed], ends[changed])
    gone = np.concatenate([[0], np.cumsum(~keep)])
    w.first = w.first - gone[w.first]
    w.starts, w.ends, w.hashes = starts[keep], ends[keep], hashes[keep]
    return w


class Items:
    """Benchmark items and the buckets of their embeddings."""

    def __init__(self, rows: list[Row], cfg: Config):
        self.cfg = cfg
        w = trimmed_words(pa.array([r["text"] for r in rows], pa.large_string()))
        size = np.diff(w.first)
        use = np.flatnonzero(size >= cfg.min_words)
        self.ids = [rows[i]["item_id"] for i in use]
        # short items: by length, the ids and the sorted hashes of the whole sequence
        self.short: dict[int, tuple[np.ndarray, list[int]]] = {}
        for m in np.unique(size[(size > 0) & (size < cfg.min_words)]).tolist():
            own = np.flatnonzero(size == m)
            h = np.array([roll(w.hashes[w.first[i] : w.first[i + 1]], np.array([0, m]), m)[0][0] for i in own], U64)
            order = np.argsort(h, kind="stable")
            self.short[m] = (h[order], [rows[i]["item_id"] for i in own[order]])
        self.words = [w.hashes[w.first[i] : w.first[i + 1]] for i in use]
        self.size = size[use]
        self.lengths = np.unique(self.size)
        triples = [roll(x, np.array([0, len(x)]), 3)[0] for x in self.words]
        self.vocabulary = np.unique(np.concatenate(triples)) if len(use) else np.zeros(0, U64)
        pairs = [np.unique(t) for t in triples]
        holder = np.repeat(np.arange(len(use)), [len(t) for t in pairs])
        flat = np.concatenate(pairs) if len(use) else np.zeros(0, U64)
        order = np.argsort(flat, kind="stable")
        self.triples, self.holder = flat[order], holder[order]
        #: triples of an item that a window within the limit holds at least
        self.least = np.maximum(1, self.size - 2 - 3 * cfg.edits(self.size))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.vocabulary >> U64(44)).astype(np.int64)] = True
        rng = np.random.Generator(np.random.PCG64(40409))
        self.fractions = rng.random((cfg.walks, cfg.keys, cfg.sample))
        self.seeds = rng.integers(1, 1 << 63, cfg.walks).astype(U64)
        if len(use):
            flat = np.concatenate(self.words)
            starts = np.cumsum(self.size) - self.size
            own = np.arange(len(use))
            keys = np.concatenate(list(self.keys(flat, starts, starts + self.size, own, self.size)))
            order = np.argsort(keys, kind="stable")
            self.table, self.owner = keys[order], np.tile(own, cfg.walks * cfg.keys)[order]
            self.buckets = np.zeros(1 << 22, bool)
            self.buckets[(keys >> U64(42)).astype(np.int64)] = True

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these hashes of three successive words occur in an item."""
        out = self.bitmap[(hashes >> U64(44)).astype(np.int64)]
        some = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        out[some] = self.vocabulary[at] == hashes[some]
        return out

    def by_triples(self, triple: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first word) of all windows that hold `least` triples of an item; at: the places of triples to look at."""
        lo, hi = np.searchsorted(self.triples, triple[at], "left"), np.searchsorted(self.triples, triple[at], "right")
        times = hi - lo
        ends = np.cumsum(times)
        pick = np.repeat(lo - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)
        item, place = self.holder[pick], np.repeat(at, times)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        # the windows that hold the triples i to i + least - 1 of an item
        final = np.arange(len(item)) + self.least[item] - 1
        ok = np.flatnonzero(final < len(item))
        ok = ok[item[final[ok]] == item[ok]]
        low = np.maximum(0, place[final[ok]] - (self.size[item[ok]] - 3))
        some = np.flatnonzero(low <= place[ok])
        ok, low = ok[some], low[some]
        times = place[ok] - low + 1
        ends = np.cumsum(times)
        start = np.repeat(low - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.repeat(item[ok], times), start

    def embed(self, flat: np.ndarray, starts: np.ndarray, stops: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """The first steps of the embeddings of the sequences that begin at starts: steps x sequences.

        Step j writes the word under the pointer and moves on if bit j of that word's random bits is set; from
        stops on, it writes a fixed pad.
        """
        at = starts.copy()
        out = np.empty((steps, len(starts)), U64)
        for j in range(steps):
            inside = at < stops
            out[j] = np.where(inside, flat[np.minimum(at, len(flat) - 1)], U64(1))
            bits = mix(out[j] * U64(2 * (j // 64) + 1) + self.seeds[walk])
            at += inside & ((bits >> U64(j % 64)) & U64(1)).astype(bool)
        return out

    def keys(self, flat: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
        """Bucket keys of windows, one array for each walk and key. Window i has size[i] words from starts[row[i]].

        Samples are taken from the first 1.5 * size steps, which walks rarely leave the window in.
        """
        steps = 1 + 3 * int(size.max()) // 2
        for walk in range(self.cfg.walks):
            e = self.embed(flat, starts, stops, walk, steps)
            for k in range(self.cfg.keys):
                key = size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(walk * self.cfg.keys + k)
                for f in self.fractions[walk, k]:
                    key = mix(key ^ e[(f * 1.5 * size).astype(np.int64), row])
                yield key


def distances(item: np.ndarray, flat: np.ndarray, starts: np.ndarray, stops: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of item to the best prefix of each window flat[start:stop], and that prefix's length."""
    width = len(item) + most
    at = starts[:, None] + np.arange(width)
    window = np.where(at < stops[:, None], flat[np.minimum(at, len(flat) - 1)], U64(0))
    col = np.arange(width + 1)
    row = np.tile(col, (len(starts), 1))
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (window != w))
        row = np.minimum.accumulate(new - col, axis=1) + col
    row = np.where(col[None, :] <= (stops - starts)[:, None], row, 1 << 20)
    length = row.argmin(axis=1)
    return row[np.arange(len(row)), length], length


def search_short(w: Words, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item id, words, first word, windows) of the first window equal to each short item in each text."""
    for m, (table, ids) in items.short.items():
        h, offsets = roll(w.hashes, w.first, m)
        at = np.flatnonzero(np.isin(h, table))
        if not len(at):
            continue
        text = np.searchsorted(offsets, at, "right") - 1
        lo, hi = np.searchsorted(table, h[at], "left"), np.searchsorted(table, h[at], "right")
        found: dict[tuple[int, int], list[int]] = {}
        for p, t, a, z in zip(at.tolist(), text.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for i in range(a, z):
                found.setdefault((t, i), [int(w.first[t] + p - offsets[t]), 0])[1] += 1
        for (t, i), (first, n) in found.items():
            yield t, ids[i], m, first, n


def search(w: Words, items: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, distance, first word, stop word, windows) of the best window of each item in each text."""
    cfg = items.cfg
    if not len(w.hashes) or not len(items.lengths):
        return
    n = len(w.hashes)
    triple, _ = roll(w.hashes, np.array([0, n]), 3)
    sums = np.zeros(n + int(items.lengths[-1]) + 1, np.int64)
    known = items.known(triple)
    np.cumsum(known, out=sums[1 : len(triple) + 1])
    sums[len(triple) + 1 :] = sums[len(triple)]
    of = w.text_of_word()
    last = w.first[1:][of]
    units, sizes = [], []
    for m in map(int, items.lengths):
        # an edit takes at most three of an item's word triples from the window; fewer known triples can't be within the limit
        here = np.flatnonzero(sums[m - 2 : n + m - 2] - sums[:n] >= max(1, m - 2 - 3 * int(cfg.edits(m))))
        units.append(here)
        sizes.append(np.full(len(here), m))
    unit, size = np.concatenate(units), np.concatenate(sizes)
    inside = np.zeros(n + int(items.lengths[-1]) + 1, np.int64)
    np.add.at(inside, unit, 1)
    np.add.at(inside, unit + size, -1)
    item, start = items.by_triples(triple, np.flatnonzero(known & (np.cumsum(inside)[: len(triple)] > 0)))
    met = [np.unique(item.astype(np.int64) * n + start)]
    for a in range(0, len(unit), 50_000):
        u, s = unit[a : a + 50_000], size[a : a + 50_000]
        starts, row = np.unique(u, return_inverse=True)
        votes = []
        for key in items.keys(w.hashes, starts, last[starts], row, s):
            at = np.flatnonzero(items.buckets[(key >> U64(42)).astype(np.int64)])
            lo, hi = np.searchsorted(items.table, key[at], "left"), np.searchsorted(items.table, key[at], "right")
            times = hi - lo
            ends = np.cumsum(times)
            pick = np.repeat(lo - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)
            votes.append(items.owner[pick].astype(np.int64) * n + np.repeat(u[at], times))
        pair, count = np.unique(np.concatenate(votes), return_counts=True)
        met.append(pair[count >= cfg.votes])
    pair = np.stack(np.divmod(np.concatenate(met), n))
    for i in np.unique(pair[0]):
        starts = np.unique(pair[1][pair[0] == i])
        limit = int(cfg.edits(items.size[i]))
        best: dict[int, list[int]] = {}
        for a in range(0, len(starts), 4096):
            s = starts[a : a + 4096]
            d, length = distances(items.words[i], w.hashes, s, last[s], limit)
            for x in np.flatnonzero(d <= limit):
                t, now = int(of[s[x]]), [int(d[x]), int(s[x]), int(s[x] + length[x]), 1]
                old = best.get(t)
                best[t] = now if old is None else (now if now[:2] < old[:2] else old)[:3] + [old[3] + 1]
        for t, (d, a, b, k) in best.items():
            yield t, int(i), d, a, b, k


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A row for each document and benchmark item of which it holds a window within the edit limit.

    distance: words inserted, deleted or replaced; start_byte, end_byte: the best window in the text's UTF-8
    bytes (least distance, then first); first_word: its place among the words; n_windows: windows within the
    limit. Null and empty texts hold nothing, items without a word are skipped, repeated
    documents and items are each reported, other columns are ignored, empty tables give no rows. No shuffle:
    documents stream past blocks of items of a fixed size.
    """
    spark = docs.sparkSession
    ship(spark)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // cfg.block_bytes))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else bench.collect()
        items = Items(rows, cfg)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text", 4 << 20):
                    w = trimmed_words(part.column("text"))
                    ids = part.column("doc_id")
                    found = [(ids[t].as_py(), items.ids[i], d, int(items.size[i]), int(w.starts[a] - w.breaks[t]), int((w.ends[z - 1] if z > a else w.starts[a]) - w.breaks[t]), int(a - w.first[t]), k) for t, i, d, a, z, k in search(w, items)]
                    found += [(ids[t].as_py(), item, 0, m, int(w.starts[a] - w.breaks[t]), int(w.ends[a + m - 1] - w.breaks[t]), int(a - w.first[t]), k) for t, item, m, a, k in search_short(w, items)]
                    if found:
                        columns = list(zip(*found, strict=True))
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

        found = source.mapInArrow(run, _OUT)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The documents that hold no benchmark item; columns of any name stay.

    Null and empty texts and rows with a null doc_id stay; of rows that repeat a doc_id all go if one holds an item; an
    empty table gives an empty one, and an empty benchmark drops nothing.
    """
    return without(docs, contaminated(docs.where("doc_id IS NOT NULL"), benchmark, cfg).select("doc_id").distinct())
