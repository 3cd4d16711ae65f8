"""Exact duplicates by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical once every run of ASCII blanks is one space. Three rounds narrow the groups:
by length; by a hash of the first bytes among texts that share a length; by a full SHA-256 among texts that share
both. No round shuffles texts: the first scan passes on lengths and hashes, and each round pre-aggregates them before
its shuffle and keeps the keys of groups of two or more. Such keys are broadcast where they are few by count, so rows
that share a hot length are never gathered; beyond that they are joined by an equi-join of hashes, whose hot keys
adaptive execution splits.

keep_first() reads full content only for rows that outlive the first two rounds. exact_duplicates() has to return every
text's SHA-256, so its one scan takes that too, and the rounds pass it on for the surviving rows only.

Defined cases: a null text is empty, and empty texts equal each other; an empty table gives no rows; other columns,
whatever their names, pass through keep_first() and are ignored elsewhere. exact_duplicates() judges by doc_id: the
smallest of a group is kept, and rows that repeat it are marked kept with it. keep_first() drops by row: exactly one
row of each group stays, one with the smallest doc_id, or with none if the group has no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import BLANKS, KEY, bounded, one_of_each, only, row_key, written

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _sized(docs: DataFrame, prefix_chars: int, *own: Column) -> DataFrame:
    """The columns own, the normalised text, its bytes (n) and a hash of its beginning (head)."""
    rows = docs.select(F.struct(*own).alias("own"), normalised(F.col("text")).alias("text"))
    return rows.select("own.*", "text", F.octet_length("text").alias("n"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("head"))


def _shared_heads(keys: DataFrame) -> DataFrame:
    """n, head of two or more rows of keys (n, head): the rounds by length and by prefix."""
    spark = keys.sparkSession
    lengths = written(spark, keys.groupBy("n").agg(F.count("*").alias("rows")).where("rows > 1").select("n"), "exact-lengths")
    return written(spark, only(keys, lengths, ["n"]).groupBy("n", "head").agg(F.count("*").alias("rows")).where("rows > 1").select("n", "head"), "exact-heads")


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    spark = docs.sparkSession
    sized = _sized(docs, prefix_chars, F.col("doc_id").cast("long").alias("doc_id"))
    keys = written(spark, sized.select("doc_id", "n", "head", F.unhex(F.sha2("text", 256)).alias("full")), "exact-keys")
    alike = only(keys, _shared_heads(keys.select("n", "head")), ["n", "head"])
    groups = alike.groupBy("n", "full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(spark, groups.select("full", "keep_id", "group_size"), "exact-groups")
    return keys.join(bounded(groups), "full", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs with exactly one row of each group of equal texts, all columns as they were."""
    spark = docs.sparkSession
    keys = written(spark, _sized(docs, prefix_chars, F.lit(None).alias("none")).select("n", "head"), "exact-keys")
    rows = _sized(docs, prefix_chars, *row_key()).withColumn("full", F.sha2("text", 256)).drop("text")
    alike = only(rows, _shared_heads(keys), ["n", "head"])
    return one_of_each(docs, alike.select("n", "full", *KEY), ["n", "full"])
