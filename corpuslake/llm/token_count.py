"""Token counts of whole texts, by the sentencepiece library, in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm._base import ship
from corpuslake.llm._words import pieces

#: A single space between two characters that are neither a space nor the space marker. No piece of a
#: vocabulary with leading markers spans it, so the text's tokens are those of both sides; the space that
#: is dropped comes back as the library's dummy prefix of the right side.
SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_loaded: dict[str, object] = {}


def load(path: str):
    """The processor of a model file, once for each Python worker; checks that SAFE is safe for it."""
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        vocab = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not sp.is_control(i))
        inner = any("▁" in p.lstrip("▁") for p in vocab)
        a, b = sp.encode("a b"), sp.encode("a") + sp.encode("b")
        _loaded[path] = (sp, not inner and a == b and sp.encode("a  b") != a)
    return _loaded[path]


def segments(text: str) -> list[str]:
    """The parts of a text between safe boundaries."""
    parts = text.split(" ")
    return parts if "" not in parts and "▁" not in text else SAFE.split(text)


class Counter:
    """Counts tokens of texts; keeps the counts of up to `keep` short segments that it has seen."""

    def __init__(self, path: str, keep: int = 400_000, chunk_bytes: int = 1 << 18):
        self.sp, self.safe = load(path)
        self.known: dict[str, int] = {"": 0}
        self.keep, self.chunk_bytes = keep, chunk_bytes

    def lengths(self, texts: list[str]) -> list[int]:
        """Encodes in chunks of about equal bytes."""
        out: list[int] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < self.chunk_bytes):
                size += len(texts[end])
                end += 1
            out += map(len, self.sp.encode(texts[at:end], num_threads=1))
            at = end
        return out

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.lengths(texts)
        split = [segments(t) if t else [] for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known)) if split else []
        if len(known) + len(new) > self.keep:
            known.clear()
            known[""] = 0
            new = list(set().union(*split) - {""})
        known.update(zip(new, self.lengths(new), strict=True))
        get = known.__getitem__
        return [sum(map(get, s)) for s in split]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    No token is added for begin or end; special strings in a text are ordinary text, as the library has it by
    default; nothing is truncated. Null texts count as empty (no bytes, no tokens); repeated rows each get a
    row; other columns are ignored; an empty table gives none. Rows go to the library in slices of about
    equal bytes, and long texts are split at safe boundaries; no shuffle, and memory is bounded by a slice
    or the longest text.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pc.fill_null(pc.cast(pc.binary_length(part.column("text")), pa.int64()), 0), pa.array(counter.count(texts), pa.int64())],
                    names=["id", "n_bytes", "n_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
