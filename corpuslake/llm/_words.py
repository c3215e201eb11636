"""Word hashes of whole Arrow batches, without a Python object for each word.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Its 64-bit hash is a
polynomial of its bytes modulo 2**64, mixed; equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.ones(size, U64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U64(pow(base, done, 1 << 64))
                done *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most max_bytes of text in the column, or a single longer row."""
    _, offsets = text_buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = end


class Words:
    """The words of consecutive texts.

    hashes: uint64 for each word; starts, ends: byte offsets into raw; first: n + 1 word offsets, by text;
    breaks: n + 1 byte offsets, by text.
    """

    def __init__(self, column: pa.Array, lower: bool = True):
        raw, self.breaks = text_buffers(column)
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, U64)
            self.first = np.zeros(len(self.breaks), np.int64)
            return
        space = _IS_SPACE[raw]
        begins = np.empty(n, bool)
        begins[0] = True
        begins[1:] = space[:-1]
        inner = self.breaks[(self.breaks > 0) & (self.breaks < n)]
        begins[inner] = True
        begins &= ~space
        closes = np.empty(n, bool)
        closes[-1] = True
        closes[:-1] = space[1:]
        closes[inner - 1] = True
        closes &= ~space
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        self.hashes = self.hash_spans(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.breaks)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
        """Hashes of ascending byte ranges, in chunks of about that many bytes, so that the power tables stay small."""
        out = np.empty(len(starts), U64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            stop = max(at + 1, int(np.searchsorted(starts, low + chunk)))
            part = self.raw[low : int(ends[stop - 1])]
            up, down = _power_table(len(part) + 1)
            sums = np.empty(len(part) + 1, U64)
            sums[0] = 0
            np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=sums[1:])
            a, b = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = mix((sums[b] - sums[a]) * down[a])
            at = stop
        return out

    def text_of_word(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k successive words of one text, and n + 1 offsets by text; texts of fewer words have none."""
        return roll(self.hashes, self.first, k)


def roll(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    offsets = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=offsets[1:])
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, U64), offsets
    at = np.arange(total) + np.repeat(first[:-1] - offsets[:-1], counts)
    out = np.zeros(total, U64)
    for i in range(k):
        out = out * U64(0xD1342543DE82EF95) + hashes[at + i]
        out ^= out >> U64(29)
    return mix(out), offsets


def poly_runs(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As roll(), by prefix sums of a polynomial, so that the cost doesn't depend on k."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    offsets = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=offsets[1:])
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, U64), offsets
    up, down = _power_table(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    at = np.arange(total) + np.repeat(first[:-1] - offsets[:-1], counts)
    return mix((sums[at + k] - sums[at]) * down[at] + U64(k)), offsets
