"""The corpus pipeline: five stages from documents to packed sequences, each on all that the one before it kept.

Stages but the last return the columns of documents. A stage's result is written as Parquet and read again as the next one's
input, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm.common import remainder, stored, table
from tallyforge.llm.op02_simhash import drop_near_duplicates
from tallyforge.llm.op03_language import drop_unidentified
from tallyforge.llm.op05_packing import packed_pieces
from tallyforge.llm.op06_contamination import drop_contaminated
from tallyforge.llm.op10_substrings import drop_repeats


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin stay; null texts, texts without letters and narrow ones go."""
    return drop_unidentified(docs, docs.filter(remainder(F.col("doc_id"), 3) != 1))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are tied by a five-word Jaccard similarity of 0.8 or more, one stays: that with the smallest id."""
    return drop_near_duplicates(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that a document with a smaller id has in a window of 13 words; so do documents that lose every word."""
    return drop_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's shingles go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The ids lie packed in the shared folder."""
    return packed_pieces(docs)


STAGES = [
    ("language identification", identify_languages),
    ("near-duplicates", drop_copies),
    ("repeated passages", cut_passages),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Compression, fingerprints and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
