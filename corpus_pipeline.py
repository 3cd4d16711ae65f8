"""A corpus preparation pipeline of the llm operators.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Defined cases are those of the operators; copies are dropped by row, so null and repeated ids lose no text; rows with
null columns pass through, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textveil.llm import exact_dedup, packing, simhash, suffix_dedup, toxic_crf
from textveil.llm.common import swept, table, written
from textveil.llm.queries import tokenizer_file


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go."""
    return toxic_crf.keep_clean(docs, toxic_crf.learn(docs, table(spark, sf_dir, "labels"), toxic_crf.learnable()))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts exactly one row stays, one with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are alike exactly one row stays, one with the smallest doc_id.

    Alike: the fingerprints of their words are near, and those of their five-word shingles confirm a similarity of 0.8.
    """
    return simhash.keep_one(docs, words=1, radius=3, check=simhash.FIVE_WORDS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (and 200 bytes) that occur elsewhere too are cut from the texts."""
    return suffix_dedup.remove_repeats(docs, window=200, words=51)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: a row for each piece of a document."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("packing", packing_stage),
]

#: SQL can't express a trained tagger.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with swept(spark) as made:  # what a stage wrote for itself goes with it
            docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.pop()
    return docs
