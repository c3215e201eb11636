"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents; the last adds pieces, n_pieces, pieces_crc32 and round_trip. Extra columns of any name stay, texts
are taken whole, and an empty table gives an empty one in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslake.llm._base import staged, table
from corpuslake.llm.decontaminate import drop_contaminated
from corpuslake.llm.minhash import drop_near_duplicates
from corpuslake.llm.pieces import encode_pieces
from corpuslake.llm.quality import quality_filter
from corpuslake.llm.substring_dedup import drop_repeated_passages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and blank texts among them. Repeated rows are judged alike."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one of the smallest id.

    Null and empty texts, null ids and rows that repeat a kept id stay.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id holds are cut out; a document left without a word goes.

    Null and empty texts and null ids stay; of rows that repeat an id, those that hold the passage are cut.
    """
    return drop_repeated_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or within the edit limit, go; null and empty texts and null ids stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids; null and empty texts have none. Repeated rows are encoded alike."""
    import public_tokenizers

    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

#: SQL can't express MinHash candidates, chaining or the CGK walk; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
