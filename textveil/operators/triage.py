"""Routing of tokens before the rewrite: what carries the label is protected, what carries the author is sanitised."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.scores import keyword_share
from textveil.functions.text import CHUNK, alnum_key

# Classes of words that carry identity, in order of precedence, and their boost.
STYLE_CLASSES: tuple[tuple[str, tuple[str, ...], float], ...] = (
    ("2nd-person", ("you", "your", "yours", "youre", "yourself", "yall", "u", "ur"), 0.6),
    ("place-adverbial", ("here", "there", "downtown", "abroad", "home", "nearby", "uptown"), 0.4),
    ("time-adverbial", ("now", "today", "tonight", "tomorrow", "yesterday", "currently", "lately"), 0.4),
    ("discourse-particle", ("honestly", "literally", "basically", "actually", "frankly", "seriously", "lol", "lmao", "imo", "tbh", "fr", "ngl"), 0.5),
)
ROUTE = "row_idx", "start", "end", "token", "quadrant", "action", "boost", "reason"


def words(rows: DataFrame) -> DataFrame:
    """row_idx, place, start, end, token: the pieces of Text between blanks."""
    text = F.coalesce(F.col("Text"), F.lit(""))
    cut = F.arrays_zip(F.regexp_extract_all(text, F.lit(CHUNK), 0).alias("token"), F.transform(F.split(text, CHUNK, -1), F.length).alias("gap"))
    # a running sum of lengths without a quadratic fold: offsets come from a window over the row's own pieces
    pieces = rows.select("row_idx", F.posexplode(cut).alias("place", "piece")).select("row_idx", "place", F.col("piece.token").alias("token"), F.col("piece.gap").alias("gap"))
    before = F.sum(F.col("gap") + F.coalesce(F.length("token"), F.lit(0))).over(_row_window())
    placed = pieces.withColumn("end", before.cast("int")).where("token is not null")
    return placed.select("row_idx", "place", (F.col("end") - F.length("token")).alias("start"), "end", "token")


def _row_window():
    from pyspark.sql import Window

    return Window.partitionBy("row_idx").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)


def saliency_routes(rows: DataFrame, threshold: float = 0.15, score: Callable[[Column], Column] = keyword_share) -> DataFrame:
    """Tokens whose removal lowers the text's score by threshold or more: Q1, protect.

    score: a Column function. The text without a token has blanks of equal length in its place. Every token is tried,
    unless score says (score.additive) that a token which scores as a blank does alone changes no text's score.
    """
    additive = getattr(score, "additive", False)
    scored = rows.select("row_idx", F.coalesce("Text", F.lit("")).alias("Text")).withColumn("base", score(F.col("Text"))).where("base >= 0")
    if additive:
        # such a score is never below a blank's, so only texts above it by the threshold are cut
        scored = scored.where(F.col("base") - score(F.lit("")) >= threshold)
    found = words(scored if additive else rows).join(scored, "row_idx")
    if additive:
        found = found.where(score(F.col("token")) != score(F.lit("")))
    hidden = F.concat(F.substring("Text", F.lit(1), F.col("start")), F.repeat(F.lit(" "), F.length("token")), F.substring(F.col("Text"), F.col("end") + 1, F.length("Text")))
    drop = F.col("base") - score(hidden)
    return found.withColumn("drop", drop).where(F.col("drop") >= threshold).select(
        "row_idx", "start", "end", "token", F.lit("Q1").alias("quadrant"), F.lit("protect").alias("action"), F.lit(0.0).alias("boost"), F.lit("saliency").alias("reason")
    )


def style_words(rows: DataFrame, routed: DataFrame | None = None, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """row_idx, token, quadrant, action, boost, reason of style_routes: without places, so only words of a class are shuffled."""
    each = rows.select("row_idx", F.explode(F.regexp_extract_all(F.coalesce(F.col("Text"), F.lit("")), F.lit(CHUNK), 0)).alias("token"))
    known = [(w, c, float((boosts or {}).get(c, default))) for c, members, default in reversed(STYLE_CLASSES) for w in members]
    classes = {w: F.struct(F.lit(c).alias("class"), F.lit(b).alias("boost")) for w, c, b in known}
    each = each.withColumn("key", alnum_key(F.col("token"))).where(F.col("key").isin(*classes))
    if routed is not None:
        each = each.join(routed.select("row_idx", "token").distinct(), ["row_idx", "token"], "left_anti")
    named = each.distinct().withColumn("f", F.create_map(*(x for w, s in classes.items() for x in (F.lit(w), s)))[F.col("key")])
    return named.select("row_idx", "token", F.lit("Q2").alias("quadrant"), F.lit("sanitize").alias("action"), "f.boost", F.concat(F.lit("biber:"), F.col("f.class")).alias("reason"))


def default_routes(rows: DataFrame, threshold: float = 0.15, score: Callable[[Column], Column] = keyword_share) -> DataFrame:
    """What route_sets needs of both layers' routes."""
    first = saliency_routes(rows, threshold, score)
    return first.select("row_idx", "token", "quadrant", "action", "boost", "reason").unionByName(style_words(rows, first))


def style_routes(rows: DataFrame, routed: DataFrame | None = None, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """The first occurrence of each token of a style class that no earlier route has claimed: Q2, sanitize."""
    boosts = boosts or {}
    key = alnum_key(F.col("token"))
    name, boost = F.lit(None).cast("string"), F.lit(0.0)
    for c, members, default in reversed(STYLE_CLASSES):
        name = F.when(key.isin(*members), F.lit(c)).otherwise(name)
        boost = F.when(key.isin(*members), F.lit(float(boosts.get(c, default)))).otherwise(boost)
    found = words(rows).withColumn("class", name).where("class is not null").withColumn("boost", boost)
    if routed is not None:
        found = found.join(routed.select("row_idx", "token").distinct(), ["row_idx", "token"], "left_anti")
    first = found.groupBy("row_idx", "token").agg(F.min(F.struct("start", "end", "class", "boost")).alias("f"))
    return first.select("row_idx", "f.start", "f.end", "token", F.lit("Q2").alias("quadrant"), F.lit("sanitize").alias("action"), "f.boost", F.concat(F.lit("biber:"), F.col("f.class")).alias("reason"))


def route_sets(routes: DataFrame) -> DataFrame:
    """row_idx, protected, forced: alphanumeric keys of words to keep and of words to rewrite; protection wins."""
    keep = F.col("quadrant").isin("Q1", "Q3") | (F.col("action") == "protect")
    force = (F.col("action") == "sanitize") | (F.col("boost") > 0)
    key = alnum_key(F.col("token"))
    sets = routes.groupBy("row_idx").agg(F.array_sort(F.collect_set(F.when(keep, key))).alias("protected"), F.array_sort(F.collect_set(F.when(force, key))).alias("f"))
    return sets.select("row_idx", "protected", F.array_sort(F.array_except("f", "protected")).alias("forced"))


def no_routes(rows: DataFrame) -> DataFrame:
    """The router that routes nothing."""
    return rows.select("row_idx").limit(0).selectExpr("row_idx", "0 as start", "0 as end", "'' as token", "'' as quadrant", "'' as action", "0.0D as boost", "'' as reason")
