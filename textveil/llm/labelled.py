"""A bounded sample of labelled texts, for the models of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, total_chars: int) -> list[tuple[str, int]]:
    """At most per_class whole texts of each class, in the order of a hash of their ids, of total_chars characters in all.

    usable: a condition on the labels' doc_id. A label that is null or neither 0 nor 1 is none, nor are two that
    disagree; equal texts count once. The rows are chosen by the labels alone, so documents are filtered as they are
    read, by a broadcast of at most 2 * per_class ids, and no text is shuffled. A first scan brings the chosen texts'
    lengths; they are taken whole, the classes in turns, while they fit into total_chars, and fetched by a second scan.
    The bounds are the same whatever the input; scoring reads every text in full.
    """
    known = labels.where(usable).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("labelled"), F.col(label).cast("int").alias("y"))
    known = known.where("y in (0, 1)").groupBy("labelled").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("labelled", "y")
    order = F.xxhash64("labelled")
    chosen = known.where("y = 0").orderBy(order, "labelled").limit(per_class).unionByName(known.where("y = 1").orderBy(order, "labelled").limit(per_class))
    ids = chosen.collect()  # at most 2 * per_class
    spark, rank = docs.sparkSession, {0: 0, 1: 0}
    place = {}
    for r in ids:
        place[r.labelled] = rank[r.y], r.y
        rank[r.y] += 1

    def scan(wanted: list, *columns: Column) -> list:
        if not wanted:
            return []
        rows = docs.select(F.col("doc_id").cast("long").alias("labelled"), F.coalesce("text", F.lit("")).alias("text"))
        return rows.join(F.broadcast(spark.createDataFrame(wanted, "labelled long, y int")), "labelled").select("labelled", "y", *columns).collect()

    left, taken = total_chars, []
    for r in sorted(scan(ids, F.length("text").alias("n")), key=lambda r: (place[r.labelled], r.n)):
        if r.n <= left:
            left -= r.n
            taken.append((r.labelled, r.y))
    texts: dict[str, int] = {}
    for r in sorted(scan(sorted(set(taken)), F.col("text")), key=lambda r: (place[r.labelled], r.text)):
        texts.setdefault(r.text, r.y)
    return list(texts.items())


def class_odds(labels: DataFrame, label: str, usable: Column) -> float:
    """Rows labelled 1 over rows labelled 0, of all that may be learnt from."""
    ones, zeros = labels.where(usable).agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    return ones / zeros if ones and zeros else 1.0
