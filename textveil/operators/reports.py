"""Aggregates over finished runs: batch overview, run statistics, ablations and calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.config import SentenceConfig, TokenConfig


def batch_overview(rows: DataFrame) -> DataFrame:
    """One row from (x_priv, flagged, severity, category, confidence, status): counts, share and histograms.

    The severity histogram always has its three keys; a missing category is "unassigned".
    """
    n, flagged = F.count("*"), F.count_if(F.col("flagged"))
    main = rows.agg(
        n.alias("rows"),
        flagged.alias("flagged"),
        F.when(n > 0, F.round(100.0 * flagged / F.when(n > 0, n), 1)).otherwise(0.0).alias("flagged_percent"),
        F.count_if(F.col("confidence") < 0.70).alias("low_confidence"),
        F.countDistinct(F.when(F.col("flagged"), F.col("x_priv"))).alias("clusters"),
        *(F.count_if(F.col("flagged") & (F.col("severity") == s)).alias(f"severity_{s}") for s in ("high", "medium", "low")),
    )
    groups = rows.where("flagged").groupBy(F.coalesce("category", F.lit("unassigned")).alias("k")).agg(F.count("*").alias("n"))
    states = rows.groupBy(F.col("status").alias("k")).agg(F.count("*").alias("n"))
    gathered = lambda d, name: d.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", "n"))), ",").alias(name))
    return main.crossJoin(gathered(groups, "categories")).crossJoin(gathered(states, "statuses"))


def run_statistics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rows, changed, fallback, their rates and the mean k_valid of rows (Text, result, fallback, k_valid)."""
    n = F.count("*")
    safe = lambda c: F.when(n > 0, c / F.when(n > 0, n)).otherwise(0.0)
    changed, fallback = F.count_if(F.col("Text") != F.col("result")), F.count_if(F.col("fallback"))
    return rows.groupBy(*keys).agg(
        n.alias("rows"), changed.alias("changed"), safe(changed).alias("changed_rate"), fallback.alias("fallback"), safe(fallback).alias("fallback_rate"), F.coalesce(F.avg("k_valid"), F.lit(0.0)).alias("avg_k_valid")
    )


# Code, what it leaves out, and the settings that do so.
ABLATIONS: tuple[tuple[str, str, Mapping[str, object], Mapping[str, object]], ...] = (
    ("A1", "no first budget", {"epsilon_split": 0.0}, {}),
    ("A2", "no protected terms", {}, {"terms": ()}),
    ("A3", "no hate floor", {"hate_floor_delta": 0.0}, {}),
    ("A4", "next to no budget", {"epsilon_total": 1e-9}, {}),
    ("A5", "plain sensitivity", {"use_refined_delta_u": False}, {}),
    ("A6", "meaning only", {"hate_floor_delta": 0.0, "tau_sem_min": 0.9}, {}),
    ("A7", "no pruning", {"tau_dup": 1.0}, {}),
    ("A8", "no meaning gate", {"tau_sem_min": 0.0}, {}),
    ("A9", "other proposer", {"proposer_input": "x_priv"}, {}),
)


def ablations(rows: DataFrame, tokens: TokenConfig, config: SentenceConfig) -> DataFrame:
    """code, description and run statistics of the baseline and of each variant, over all rows."""
    from textveil.operators.rewrite import rewrite

    out = None
    for code, what, sentence, token in (("A0", "baseline", {}, {}), *ABLATIONS):
        done = rewrite(rows, replace(tokens, **token), replace(config, **sentence), triage=False)
        done = done.select(F.lit(code).alias("code"), F.lit(what).alias("description"), "Text", "result", "audit.fallback", "audit.k_valid")
        out = done if out is None else out.unionByName(done)
    return run_statistics(out, ["code", "description"])


def best_trial(scored: DataFrame) -> DataFrame:
    """trial, mean_to, mean_u, mean_p, fallback_rate of the trial with the best mean (the first of equals)."""
    means = scored.groupBy("trial").agg(F.avg("to").alias("mean_to"), F.avg("u").alias("mean_u"), F.avg("p").alias("mean_p"), F.avg(F.col("fallback").cast("int")).alias("fallback_rate"))
    return means.orderBy(F.desc(F.round("mean_to", 9)), "trial").limit(1)


def trial_means(scored: DataFrame) -> DataFrame:
    """One row: mean_to, mean_u, mean_p, fallback_rate of a trial's rows; -1, 0, 0, 0 if there are none."""
    mean = lambda c, none: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(none))
    return scored.agg(mean("to", -1.0).alias("mean_to"), mean("u", 0.0).alias("mean_u"), mean("p", 0.0).alias("mean_p"), F.coalesce(F.avg(F.col("fallback").cast("int")), F.lit(0.0)).alias("fallback_rate"))


def counters(privatized: DataFrame) -> DataFrame:
    """One row: rows, rows with a rewritten token, rows whose text changed, of a token-level run."""
    rewritten = F.exists("token_log", lambda e: e["action"] == "rewritten")
    return privatized.agg(F.count("*").alias("rows"), F.count_if(rewritten).alias("rows_rewritten"), F.count_if(F.col("Text") != F.col("x_priv")).alias("rows_changed"))


def lexicon_state(terms: Sequence[str]) -> dict[str, int | bool]:
    from textveil.operators.lexicon import clean_terms

    n = len(clean_terms(terms))
    return {"terms": n, "loaded": n > 0}


SEARCH_SPACE = {"epsilon_total": (6.0, 24.0), "hate_floor_delta": (0.02, 0.20), "tau_sem_min": (0.30, 0.80)}


def sample_settings(trials: int, seed: int = 0) -> list[dict[str, float]]:
    import random

    rng = random.Random(seed)
    return [{k: rng.uniform(*v) for k, v in SEARCH_SPACE.items()} for _ in range(trials)]


def calibrate(rows: DataFrame, tokens: TokenConfig, config: SentenceConfig, trials: int = 5, seed: int = 0) -> tuple[SentenceConfig, list[dict]]:
    """Random search: the settings of the best trial and all trials' means. No rows: the settings as they are."""
    from textveil.functions.scores import keyword_share
    from textveil.functions.text import ngram_overlap
    from textveil.operators.evaluate import proxy_tradeoff
    from textveil.operators.rewrite import rewrite

    if rows.isEmpty():
        return config, []
    history: list[dict] = []
    best = config
    for trial, theta in enumerate(sample_settings(trials, seed)):
        tried = replace(config, **theta)
        done = rewrite(rows, tokens, tried, triage=False).select("Text", "result", "audit.fallback")
        before, after, overlap = keyword_share(F.col("Text")), keyword_share(F.col("result")), ngram_overlap(F.col("Text"), F.col("result"))
        scored = done.select(proxy_tradeoff(before, after, overlap).alias("to"), (after / F.greatest(before, F.lit(1e-9))).alias("u"), (1.0 - overlap).alias("p"), "fallback")
        means = trial_means(scored).first()
        if not history or means.mean_to > max(h["TO"] for h in history):
            best = tried
        history.append({"trial": trial, "theta": theta, "TO": means.mean_to, "U": means.mean_u, "P": means.mean_p, "fallback_rate": means.fallback_rate})
    return best, history
