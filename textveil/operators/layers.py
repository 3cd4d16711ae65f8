"""The layers of a sentence-level run, each of which may be exchanged: route, boost, calibrate, rewrite.

A router maps rows (row_idx, Text) to routes; a prior maps rows and routes to further routes; an optimiser maps
development rows and settings to settings; a rewriter maps rows, settings and routes to (row_idx, Text, result, audit).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.config import SentenceConfig, TokenConfig
from textveil.functions import scores
from textveil.operators import reports, rewrite, triage

#: Rows in a batch at most.
BATCH_ROWS = 5000

Router = Callable[[DataFrame, SentenceConfig], DataFrame]
Prior = Callable[[DataFrame, DataFrame], DataFrame]
Optimizer = Callable[[DataFrame | None, TokenConfig, SentenceConfig], SentenceConfig]
Rewriter = Callable[[DataFrame, TokenConfig, SentenceConfig, DataFrame | None], DataFrame]


def saliency_router(score: Callable[[Column], Column] = scores.keyword_share) -> Router:
    return lambda rows, config: triage.saliency_routes(rows, config.saliency_threshold, score)


def no_router(rows: DataFrame, config: SentenceConfig) -> DataFrame:
    return triage.no_routes(rows)


def style_prior(rows: DataFrame, routes: DataFrame) -> DataFrame:
    return routes.unionByName(triage.style_routes(rows, routes))


def no_prior(rows: DataFrame, routes: DataFrame) -> DataFrame:
    return routes


def random_search(trials: int = 5, seed: int = 0) -> Optimizer:
    """The best of so many random settings on the development rows; without rows, the settings as they are."""

    def optimise(dev: DataFrame | None, tokens: TokenConfig, config: SentenceConfig) -> SentenceConfig:
        return config if dev is None else reports.calibrate(dev, tokens, config, trials, seed)[0]

    return optimise


def no_optimizer(dev: DataFrame | None, tokens: TokenConfig, config: SentenceConfig) -> SentenceConfig:
    return config


def sentence_rewriter(**options) -> Rewriter:
    """rewrite.rewrite() with options (proposer, score, encode, pruner, backend)."""
    return lambda rows, tokens, config, routes: rewrite.rewrite(rows, tokens, config, routes=routes, triage=False, **options)


@dataclass(frozen=True)
class Layers:
    router: Router = saliency_router()
    prior: Prior = style_prior
    optimizer: Optimizer = no_optimizer
    rewriter: Rewriter = sentence_rewriter()


#: Only the last layer does anything.
REWRITE_ONLY = Layers(no_router, no_prior)


def sanitize(rows: DataFrame, tokens: TokenConfig, config: SentenceConfig, layers: Layers = Layers(), dev: DataFrame | None = None) -> DataFrame:
    """row_idx, Text, result, audit: all layers in order. dev: development rows (row_idx, Text) for the optimiser."""
    rows = rows.select("row_idx", F.coalesce("Text", F.lit("")).alias("Text"))
    routes = layers.prior(rows, layers.router(rows, config))
    return layers.rewriter(rows, tokens, layers.optimizer(dev, tokens, config), routes)


def batch_rows(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """row_idx (the place in the list), Text of 1 to BATCH_ROWS texts given in memory."""
    if not 1 <= len(texts) <= BATCH_ROWS:
        raise ValueError(f"a batch has 1 to {BATCH_ROWS} rows, not {len(texts)}")
    return spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "row_idx long, Text string")


def derive_rows(done: DataFrame, terms: Sequence[str], label_scores: Callable[[Column], Column] | None = None) -> DataFrame:
    """row_idx, Text, x_priv, flagged, severity, category, confidence, band, status of done (row_idx, Text, result, audit).

    label_scores: a classifier's map of label to probability, which decides where it is given; else the proxies do: a
    text is flagged by a protected term or a keyword, and has no category. A flagged row is for review, another is ready.
    """
    if label_scores:
        rows = done.withColumn("_s", label_scores(F.col("Text"))).withColumn("_p", F.coalesce(F.try_element_at("_s", F.lit("toxicity")), F.lit(0.0)))
        severity, category = scores.label_severity(F.col("_s")), scores.label_category(F.col("_s"))
    else:
        hit = F.greatest(scores.lexicon_proxy(F.col("Text"), terms), scores.keyword_proxy(F.col("Text")))
        rows = done.withColumn("_p", F.greatest(scores.keyword_share(F.col("Text")), 0.5 * hit))
        severity, category = scores.severity(F.col("_p")), F.lit(None).cast("string")
    flagged = F.col("_p") >= 0.5
    return rows.select(
        "row_idx", "Text", F.col("result").alias("x_priv"), flagged.alias("flagged"), severity.alias("severity"), category.alias("category"),
        scores.confidence(F.col("_p")).alias("confidence"), scores.confidence_band(scores.confidence(F.col("_p"))).alias("band"), F.when(flagged, "review").otherwise("ready").alias("status"),
    )


def process(rows: DataFrame, tokens: TokenConfig, config: SentenceConfig, layers: Layers = Layers(), label_scores: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows' records and their overview. Blank rows go through no layer: they come back as they are."""
    rows = rows.select("row_idx", F.coalesce("Text", F.lit("")).alias("Text"))
    blank = F.trim(F.regexp_replace("Text", r"(?U)\s+", " ")) == ""
    done = sanitize(rows.where(~blank), tokens, config, layers).select("row_idx", "Text", "result")
    records = derive_rows(done.unionByName(rows.where(blank).withColumn("result", F.col("Text"))), tokens.terms, label_scores)
    return records, reports.batch_overview(records)


def privatize_text(spark: SparkSession, text: str, tokens: TokenConfig, config: SentenceConfig, layers: Layers = Layers(), row: int = 0) -> dict:
    """One text through all layers: result and audit."""
    found = sanitize(batch_rows(spark, [text]).withColumn("row_idx", F.lit(row).cast("long")), tokens, config, layers).first()
    return {"result": found.result, "audit": found.audit.asDict(recursive=True)}


def hate_rows(rows: DataFrame) -> DataFrame:
    """The rows labelled "1"."""
    return rows.where(F.col("HS") == "1")


def development_rows(rows: DataFrame) -> DataFrame:
    """row_idx, Text, Author, where the row's place stands in for a missing author."""
    author = F.nullif(F.col("Author"), F.lit("")) if "Author" in rows.columns else F.lit(None).cast("string")
    return rows.select("row_idx", "Text", F.coalesce(author, F.col("row_idx").cast("string")).alias("Author"))


def calibrated(config: SentenceConfig, overrides: dict[str, float]) -> SentenceConfig:
    """config with the optimiser's values in place of its own."""
    return replace(config, **overrides)
