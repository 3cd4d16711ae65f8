"""The corpus view, row checks between two versions of a corpus, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("ID", "Author", "Text", "HS")


def corpus(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """row_idx, ID, Author, Text, HS of every document; HS is null where there is no label."""
    hs = labels.groupBy("doc_id").agg(F.max("toxic").cast("string").alias("HS"))
    rows = documents.select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("ID"), F.col("source").alias("Author"), F.coalesce("text", F.lit("")).alias("Text"))
    return rows.join(hs.withColumnRenamed("doc_id", "row_idx"), "row_idx", "left")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled by keys into a fixed number of parts. Parts that the planner chooses are sized by their bytes, which
    leaves too few of them where a row is small and the work on it is not."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def diff_rows(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("ID", "Author", "HS")) -> DataFrame:
    """row_idx, field, before, after for each preserved field that differs; field "row" where a row is on one side only."""
    a = before.select("row_idx", *(F.col(c).cast("string").alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    b = after.select("row_idx", *(F.col(c).cast("string").alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    both = a.join(b, "row_idx", "full")
    missing = F.col("in_a").isNull() | F.col("in_b").isNull()
    cells = [F.struct(F.lit("row").alias("field"), F.when(F.col("in_a"), "present").alias("before"), F.when(F.col("in_b"), "present").alias("after"), missing.alias("differs"))]
    for c in columns:
        differs = ~missing & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
        cells.append(F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after"), differs.alias("differs")))
    return both.select("row_idx", F.explode(F.array(*cells)).alias("cell")).where("cell.differs").select("row_idx", "cell.field", "cell.before", "cell.after")


class PreservationError(ValueError):
    """A column that must not change has changed."""


def assert_preserved(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("ID", "Author", "HS"), completed: int | None = None) -> None:
    """Raise with the first 20 differences, over rows below completed if given."""
    if completed is not None:
        before, after = (d.where(F.col("row_idx") < completed) for d in (before, after))
    found = diff_rows(before, after, columns).orderBy("row_idx", "field").limit(20).collect()
    if found:
        raise PreservationError("; ".join(f"row {r.row_idx}: {r.field} {r.before!r} -> {r.after!r}" for r in found))


def remaining(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows that no finished output holds yet."""
    return rows.join(done.select("row_idx").distinct(), "row_idx", "left_anti")


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """row_idx, ID, Author, HS, Text, x_priv: both versions side by side; raises if IDs or the number of rows differ."""
    problems = diff_rows(before, after, ("ID",)).limit(5).collect()
    if problems:
        raise PreservationError("; ".join(f"row {r.row_idx}: {r.field} {r.before!r} -> {r.after!r}" for r in problems))
    return before.select("row_idx", "ID", "Author", "HS", "Text").join(after.select("row_idx", F.col("Text").alias("x_priv")), "row_idx")
