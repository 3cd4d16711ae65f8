"""What the operators of this subpackage share: tables, the shared work folder, written stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python. Texts are long; small batches bound a worker's memory.
BATCH_ROWS = 512

#: ASCII white space, the only characters that the text contracts treat as blanks.
BLANKS = r"[\x20\x09-\x0D]+"

#: Key tables of up to this many rows (some tens of bytes each) are broadcast, after they are counted; larger ones are
#: joined by shuffle, with the same rows as a result.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session on one machine that names none (tests, a notebook) gets a folder of its own. A cluster's must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="textveil-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df, computed once into the shared folder: later readers survive the loss of any executor."""
    return written_at(spark, df, label)[0]


def written_at(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The same, with its path, for stages that are discarded once their successor is written."""
    path = new_path(spark, label)
    for held in _open:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_open: list[list[str]] = []


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, all stages written inside but those that the caller takes out of the list it gets."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [held for held in _open if held is not made]
        for path in made:
            discard(spark, path)


def only(rows: DataFrame, wanted: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """rows whose columns `on` are (left_semi) or aren't (left_anti) in wanted, which should be a written table.

    wanted holds the columns `on`, each combination once. Where it is small by count, rows aren't shuffled, so a hot
    key cannot gather them in one task. Else rows meet it by shuffle with the columns that they have, no more: an inner
    join, since a semi-join would be moved below what makes those columns from texts.
    """
    few = bounded(wanted)
    return rows.join(few, on, how) if few is not wanted or how != "left_semi" else rows.join(wanted, on).select(*rows.columns)


def bounded(wanted: DataFrame) -> DataFrame:
    """wanted, marked to be broadcast if it is small by count."""
    return F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stage that no later plan reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; a null text counts as empty.

    Other columns, whatever their names, are left behind before any join, so they cannot clash.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


KEY = ["d", "t", "u"]


def row_key() -> list[Column]:
    """d, t, u name a row by its doc_id and text (two hashes); a null doc_id counts as the largest, a null text as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u")]


def one_of_each(docs: DataFrame, members: DataFrame, group: list[str]) -> DataFrame:
    """docs with one row of each group, all columns as they were; rows that are no members stay.

    members: d, t, u and the columns of group, a row for each row. The row with the least doc_id stays, of equal ids
    that with the least hash of its text. Rows that share both are gathered, and the least as JSON stays: nothing
    depends on where a row lies.
    """
    spark = docs.sparkSession
    spots = written(spark, members.groupBy(*group, *KEY).agg(F.count("*").alias("times")), "spots")
    firsts = spots.groupBy(*group).agg(F.min(F.struct(*KEY)).alias("first"), F.sum("times").alias("rows")).where("rows > 1")
    marks = spots.join(firsts, group).select(*KEY, "times", (F.struct(*KEY) == F.col("first")).alias("stays"))
    marks = written(spark, marks.where("not stays or times > 1"), "marks")
    rows = docs.select(*row_key(), F.struct("*").alias("row"))
    kept = only(rows, marks.select(*KEY), KEY, "left_anti").select("row.*")
    repeated = marks.where("stays").select(*KEY)
    if repeated.isEmpty():
        return kept
    least = only(rows, repeated, KEY).groupBy(*KEY).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(least.select("row.*"))
