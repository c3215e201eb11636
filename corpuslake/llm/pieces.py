"""Unigram encoding and decoding over a vocabulary of scored pieces: double-array trie and Viterbi, by batches.

The vocabulary comes from a public sentencepiece model file; its stored scores count as log scores and
nothing is trained. Text gets a space in front, spaces become the marker U+2581, characters that no piece
covers become byte pieces. No piece holds a marker after another character, so the best segmentation of a
text is that of its parts between single spaces, and each distinct part is segmented once for a slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm._base import ship
from corpuslake.llm._words import pieces as slices
from corpuslake.llm.token_count import segments

MARK = "▁"


class Seen:
    """Segmentations of parts that have come before, dropped when over `most` parts or `most_ids` ids."""

    def __init__(self, most: int = 300_000, most_ids: int = 3_000_000):
        self.most, self.most_ids = most, most_ids
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def make_room(self) -> None:
        if len(self.known) > self.most or len(self.ids) > self.most_ids:
            self.clear()

    def add(self, ids: np.ndarray, at: np.ndarray) -> None:
        self.at = np.concatenate([self.at, at[:-1] + len(self.ids)])
        self.counts = np.concatenate([self.counts, np.diff(at)])
        self.ids = np.concatenate([self.ids, ids])


class Vocabulary:
    """Pieces, scores and the trie. Bounded by the model file, so it may be sent to every worker.

    base, check, value: the double array; node s has child s' = base[s] + byte + 1 if check[s'] == s, and
    value[s'] is the piece that ends there, or -1.
    """

    def __init__(self, pieces: list[tuple[str, float, str]], unk: int = 0):
        """pieces: (text, log score, kind) by id; kind is normal, byte or other."""
        self.unk = unk
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.bytes_of = np.full(256, unk, np.int32)
        raw = []
        words: dict[bytes, int] = {}
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.bytes_of[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif kind == "normal":
                words[p.encode()] = i
                raw.append(p.replace(MARK, " ").encode())
            else:
                raw.append(b"" if i != unk else " ⁇ ".encode())
        self.fallback = bool((self.bytes_of != unk).all())
        self.unk_score = float(self.scores[list(words.values())].min() - 10) if words else -10.0
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.base, self.check, self.value = _double_array(words)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        return cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())], sp.unk_id())

    def matches(self, buf: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that start at positions `at` of buf and end by ends[position]: starts, stops, ids."""
        out = []
        node = np.zeros(len(at), np.int64)
        depth = 0
        while len(at):
            ok = at + depth < ends[at]
            at, node = at[ok], node[ok]
            nxt = self.base[node] + buf[at + depth] + 1
            ok = self.check[nxt] == node
            at, node = at[ok], nxt[ok]
            depth += 1
            hit = self.value[node] >= 0
            out.append((at[hit], at[hit] + depth, self.value[node[hit]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each part (markers in place), and n + 1 offsets.

        Ties go to the piece that starts first. All parts advance together, by the position of a piece's end.
        """
        sizes = np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        n = int(bounds[-1])
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64)
        buf = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)
        stop_of = bounds[1:][part]
        chars = np.flatnonzero((buf & 0xC0) != 0x80)
        width = np.diff(np.append(chars, n))
        start, stop, ids = self.matches(buf, stop_of, chars)
        single = np.zeros(n, bool)
        char_end = np.zeros(n, np.int64)
        char_end[chars] = chars + width
        single[start[stop == char_end[start]]] = True
        bare = chars[~single[chars]]
        start = np.concatenate([start, bare])
        stop = np.concatenate([stop, char_end[bare]])
        score = np.concatenate([self.scores[ids], np.full(len(bare), self.unk_score)])
        ids = np.concatenate([ids, np.full(len(bare), -1)])
        reach = stop - bounds[part[start]]
        order = np.lexsort((start, stop, reach))
        start, stop, score, ids, reach = start[order], stop[order], score[order], ids[order], reach[order]
        best = np.full(n + 1, -np.inf)
        best[bounds[:-1][sizes > 0]] = 0.0
        # a part's first position is the stop of the part before: its score is kept aside
        final_edge = np.full(n + 1, -1, np.int64)
        steps = np.flatnonzero(np.diff(reach, prepend=-1))
        for a, b in zip(steps, np.append(steps[1:], len(reach)), strict=True):
            s, e = start[a:b], stop[a:b]
            total = best[s] + score[a:b]
            new = np.flatnonzero(np.diff(e, prepend=-1))
            top = np.maximum.reduceat(total, new)
            group = np.cumsum(np.diff(e, prepend=-1) != 0) - 1
            first = np.minimum.reduceat(np.where(total == top[group], np.arange(b - a), b - a), new)
            at = e[new]
            final_edge[at] = first + a
            inside = at < stop_of[start[a:b][new]]
            best[at[inside]] = top[inside]
        chosen = []
        cur = bounds[1:][sizes > 0]
        low = bounds[:-1][sizes > 0]
        while len(cur):
            edge = final_edge[cur]
            chosen.append(edge)
            cur = start[edge]
            more = cur > low
            cur, low = cur[more], low[more]
        edges = np.concatenate(chosen)
        edges = edges[np.argsort(start[edges], kind="stable")]
        out, of = ids[edges], part[start[edges]]
        lost = out < 0
        if lost.any():
            times = np.where(lost & self.fallback, stop[edges] - start[edges], 1)
            at = np.repeat(np.cumsum(times) - times, times)
            byte = buf[np.repeat(start[edges], times) + (np.arange(int(times.sum())) - at)] if self.fallback else 0
            spread = np.repeat(lost, times)
            out, of = np.where(spread, self.bytes_of[byte] if self.fallback else self.unk, np.repeat(out, times)), np.repeat(of, times)
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(parts)))])

    def encode(self, texts: list[str], seen: Seen | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 offsets. An empty text has none. seen: parts segmented before."""
        seen = seen or Seen()
        seen.make_room()
        known = seen.known
        rows, lengths = [], []
        put, before = known.setdefault, len(known)
        for t in texts:
            own = segments(t) if t else []
            lengths.append(len(own))
            rows += [put(s, len(known)) for s in own]
        new = list(islice(known, before, None))
        if new:
            seen.add(*self.segment([(MARK + s.replace(" ", MARK)).encode("utf-8", "replace") for s in new]))
        index = np.array(rows, np.int64)
        counts = seen.counts[index] if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = seen.ids[np.repeat(seen.at[index] - (ends - counts), counts) + np.arange(total)] if total else np.zeros(0, np.int32)
        by_segment = np.concatenate([[0], ends])
        return flat, by_segment[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 bytes of all texts, and n + 1 byte offsets; markers are spaces and the one in front goes."""
        sizes = (self.raw_at[1:] - self.raw_at[:-1])[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        buf = self.raw[np.repeat(self.raw_at[ids] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.uint8)
        at = np.concatenate([[0], ends])[offsets].astype(np.int64)
        drop = at[:-1][at[1:] > at[:-1]]
        drop = drop[buf[drop] == 32]
        keep = np.ones(total, bool)
        keep[drop] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return buf[keep].tobytes(), at - gone[at]


def _double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for word, i in words.items():
        node = 0
        for c in word:
            nxt = tree[node].get(c)
            if nxt is None:
                nxt = len(tree)
                tree.append({})
                tree[node][c] = nxt
            node = nxt
        ends[node] = i
    size = 2 * len(tree) + 1024
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = bytearray(size)
    used[0] = 1
    place = {0: 0}
    low = hint = 1  # the first free place; where nodes of several children are tried first
    queue = [0]
    for node in queue:
        kids = tree[node]
        if not kids:
            continue
        codes = sorted(kids)
        low = used.find(0, low)
        at = max(codes[0] + 1, low if len(codes) == 1 else max(low, hint))
        tried = 0
        while True:
            at = used.find(0, at)
            if at < 0 or at + 258 >= len(used):
                grow = len(used)
                at = at if at >= 0 else grow
                used += bytearray(grow)
                base, check, value = (np.concatenate([x, np.full(grow, fill, np.int64)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
            b = at - codes[0] - 1
            if not any(used[b + c + 1] for c in codes):
                break
            at += 1
            tried += 1
        if len(codes) > 1 and tried > 32:
            hint = max(hint, b + codes[0] + 1)
        s = place[node]
        base[s] = b
        for c in codes:
            t = b + c + 1
            used[t] = 1
            check[t] = s
            value[t] = ends.get(kids[c], -1)
            place[kids[c]] = t
            queue.append(kids[c])
    room = np.full(258, -1, np.int64)
    return np.concatenate([base, room * 0]), np.concatenate([check, room]), np.concatenate([value, room])


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = True, check: bool = True) -> DataFrame:
    """docs with pieces (array<int>; only with_ids), n_pieces, pieces_crc32 (of little-endian int32 ids) and
    round_trip (decoding gives the text again; only with check).

    Null texts count as empty: no pieces. A marker character in a text decodes as a space, so round_trip is
    false there. Repeated rows are encoded alike; columns with those names are replaced; an empty table gives
    none. No shuffle; memory is bounded by a slice of 2 MB of text, or the longest text.
    """
    ship(docs.sparkSession)
    vocabulary = Vocabulary.load(model)
    added = [("pieces", T.ArrayType(T.IntegerType()))] * with_ids + [("n_pieces", T.LongType()), ("pieces_crc32", T.LongType())] + [("round_trip", T.BooleanType())] * check
    own = [c for c in docs.columns if c not in dict(added)]
    source = docs.select(*[F.col(f"`{c}`") for c in own])
    schema = T.StructType([*source.schema.fields, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, at = vocabulary.encode(texts, seen)
                columns = list(part.columns)
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
                columns.append(pa.array(np.diff(at), pa.int64()))
                raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                columns.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()))
                if check:
                    text, ends = vocabulary.decode(ids, at)
                    columns.append(pa.array([text[a:b] == t.encode("utf-8", "replace") for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *[n for n, _ in added]])

    return source.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model: str, column: str = "pieces", out: str = "decoded") -> DataFrame:
    """df with the decoded text of an array<int> column; null counts as no pieces; bytes that aren't UTF-8 become U+FFFD.

    Repeated rows are decoded alike; a column with the name of the output is replaced; an empty table gives an empty one.
    """
    ship(df.sparkSession)
    vocabulary = Vocabulary.load(model)
    own = [c for c in df.columns if c != out]
    source = df.select(*[F.col(f"`{c}`") for c in own])
    schema = T.StructType([*source.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(column).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            text, at = vocabulary.decode(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())], names=[*own, out])

    return source.mapInArrow(run, schema)
