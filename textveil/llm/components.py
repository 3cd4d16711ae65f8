"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is two shuffles of the links; each step's links are written to the shared folder, which cuts the lineage,
and the step's before are deleted.
A vertex with many links is never gathered: stars are formed with a minimum per vertex, pre-aggregated before the
shuffle, and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import discard, written_at


def components(links: DataFrame) -> DataFrame:
    """vertex, root (the smallest vertex reachable) for every vertex of links (a, b); vertices alone are not in it.

    Defined cases: links of a vertex to itself and repeated links change nothing; no links give no rows.
    """
    spark = links.sparkSession
    edges, path = written_at(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        large = _star(edges, both=True)
        edges, new_path = written_at(spark, _star(large, both=False).distinct(), "links")
        discard(spark, path)
        path = new_path
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).groupBy("vertex").agg(F.min("root").alias("root")).unionByName(
        edges.select(F.col("v").alias("vertex")).distinct().join(edges.select(F.col("u").alias("vertex")), "vertex", "left_anti").withColumn("root", F.col("vertex"))
    )


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link neighbours to the smallest of the neighbourhood: the larger ones (both) or the smaller ones and the vertex."""
    out = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if both:
        sided = out.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = sided.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        return sided.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v")
    least = out.groupBy("x").agg(F.min("y").alias("m"))
    joined = out.join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v")
    return joined.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
