"""Sentence-level rewriting: prune candidates, gate them in order, choose one by the exponential mechanism.

A row holds its candidates as an array, bounded by how many a proposer may give, so every step is row-local.
Candidates are structs (text, score fields as needed); proposers supply them as a column or by a join on row_idx.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.config import SentenceConfig, TokenConfig
from textveil.functions import dp
from textveil.functions import text as T
from textveil.functions.scores import keyword_share, term_skeletons
from textveil.operators import lexicon
from textveil.operators.backends import Backend, hash_backend
from textveil.operators.corpus import dealt
from textveil.operators.privatize import privatize_texts
from textveil.operators.triage import default_routes, route_sets


def hash_vector(text: Column, size: int = 32) -> Column:
    """A stand-in encoder: counts of hashed words, as an array of doubles."""
    slots = F.transform(F.regexp_extract_all(F.lower(text), F.lit(T.RUN), 0), lambda w: F.conv(F.substring(F.md5(w), 5, 4), 16, 10).cast("int") % F.lit(size))
    return T.let(slots, lambda found: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.size(found) - F.size(F.array_remove(found, i))).cast("double")))


def prune(items: Column, vector: Callable[[Column], Column], tau: float, most: int) -> Column:
    """Greedy: keep an item unless its cosine with one already kept is tau or more; stop at most."""
    kept = F.slice(items, 1, 0)
    return F.aggregate(
        items,
        kept,
        lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda k: dp.cosine(vector(k), vector(x)) >= tau), acc).otherwise(F.concat(acc, F.array(x))),
    )


def gate(candidate: Column, original: Column, skeletons: Column, p: Column, p_original: Column, cosine: Column, config: SentenceConfig) -> Column:
    """Name of the first gate that candidate fails; empty if it passes all. The dear one, quadratic in the lengths,
    comes last and is evaluated only for candidates that get there."""
    length = F.size(F.regexp_extract_all(candidate, F.lit(T.CHUNK), 0))
    long = F.lit(config.max_length_tokens > 0) & (length > config.max_length_tokens)
    return (
        F.when(candidate.isNull() | (F.trim(candidate) == ""), "empty")
        .when(~lexicon.spans_preserved(candidate, skeletons), "span")
        .when(p < p_original - config.hate_floor_delta, "hate_floor")
        .when((length < config.min_length_tokens) | long, "length")
        .when(cosine < config.tau_sem_min, "semantic")
        .when(T.edit_ratio_below(original, candidate, config.min_edit_ratio), "edit_ratio")
        .otherwise("")
    )


def gated(items: Column, original: Column, skeletons: Column, config: SentenceConfig, score: Callable[[Column], Column] = keyword_share, encode: Callable[[Column], Column] = hash_vector) -> Column:
    """array of (text, reject, p_hate, sem_cos, score) for an array of texts."""
    def one(c: Column, base: Column) -> Column:
        found = F.struct(c.alias("text"), score(c).alias("p"), dp.cosine(base["v"], encode(c)).alias("cos"))
        return T.let(found, lambda f: T.let(gate(f["text"], original, skeletons, f["p"], base["p"], f["cos"], config), lambda reject: detail(f, reject)))

    def detail(f: Column, reject: Column) -> Column:
        after = lambda *names: reject.isin(*names)
        return F.struct(
            f["text"].alias("text"),
            reject.alias("reject"),
            F.when(after("empty", "span"), 0.0).otherwise(f["p"]).alias("p_hate"),
            F.when(after("empty", "span", "hate_floor", "length"), 0.0).otherwise(f["cos"]).alias("sem_cos"),
            F.when(reject == "", f["cos"] - config.delta_u * f["p"] + (config.privacy_weight * T.edit_ratio(original, f["text"]) if config.privacy_weight else 0.0)).alias("score"),
        )

    return T.let(F.struct(score(original).alias("p"), encode(original).alias("v")), lambda base: F.transform(items, lambda c: one(c, base)))


def choose(details: Column, fallback: Column, original: Column, config: SentenceConfig, run_seed: str, row: Column) -> Column:
    """struct (text, k_valid, fallback, reason, probs): a draw among valid candidates; the only one; else the one with
    the best cosine (the first of equals); else fallback."""
    valid = F.filter(details, lambda d: d["reject"] == "")
    sensitivity = dp.refined_sensitivity(original) if config.use_refined_delta_u else F.lit(1.0)

    def decide(v: Column) -> Column:
        scores = F.transform(v, lambda d: dp.clip(d["score"], config.clip))

        def with_shares(p: Column) -> Column:
            best = F.array_max(F.transform(details, lambda d, i: F.struct(d["sem_cos"].alias("c"), (-i).alias("o"), d["text"].alias("text"))))["text"]
            n = F.size(v)
            drawn = F.get(v, dp.draw(p, dp.uniform(run_seed, row, F.lit(0))))["text"]
            return F.struct(
                F.when(n >= 2, drawn).when(n == 1, F.get(v, F.lit(0))["text"]).when(F.size(details) > 0, best).otherwise(fallback).alias("text"),
                n.alias("k_valid"),
                (n == 0).alias("fallback"),
                F.when(n > 0, "").when(F.size(details) > 0, "no_valid_candidates_best_effort").otherwise("no_candidates").alias("reason"),
                p.alias("probs"),
            )

        return T.let(dp.weights(scores, config.epsilon_2, sensitivity), with_shares)

    return T.let(valid, decide)


def select_rewrite(candidates: list[str], scores: list[float], epsilon: float, uniform: float, clip: float = 5.0, sensitivity: float | None = None) -> tuple[str, int]:
    """The same draw for one row on the driver; equal lengths and at least one candidate are required."""
    import math

    if not candidates or len(candidates) != len(scores):
        raise ValueError("as many scores as candidates, and at least one, are needed")
    bound = abs(clip)
    delta = 2 * bound if sensitivity is None else sensitivity
    delta = 1.0 if delta <= 0 else delta
    clipped = [max(-bound, min(bound, s)) for s in scores]
    raw = [math.exp((s - max(clipped)) * epsilon / (2 * delta)) for s in clipped]
    run = 0.0
    for i, x in enumerate(raw):
        run += x / sum(raw)
        if round(run, 9) > uniform:
            return candidates[i], i
    return candidates[-1], len(candidates) - 1


def propose_and_choose(rows: DataFrame, proposer: Callable[[Column, Column, int], Column], score: Callable[[Column], Column], config: SentenceConfig, run_seed: str, clip: float = 5.0) -> DataFrame:
    """row_idx, Text, result for rows (row_idx, Text): k proposals, each scored, one drawn; a text without any stays."""
    made = rows.select("row_idx", F.coalesce("Text", F.lit("")).alias("Text")).withColumn("_c", proposer(F.col("Text"), F.col("Text"), config.k_generate))
    shares = dp.weights(F.transform("_c", lambda c: dp.clip(score(c), clip)), config.epsilon_2, 2 * abs(clip))
    drawn = F.get(F.col("_c"), dp.draw(shares, dp.uniform(run_seed, F.col("row_idx"), F.lit(0))))
    return made.select("row_idx", "Text", F.when(F.size("_c") > 0, drawn).otherwise(F.col("Text")).alias("result"))


def table_proposals(x_priv: Column, text: Column, k: int) -> Column:
    """A stand-in proposer: the sanitised text, and the text with its last words left off, in k distinct forms."""
    pieces = F.regexp_extract_all(text, F.lit(T.CHUNK), 0)
    shorter = [F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - i, F.lit(0))), " ") for i in range(k - 1)]
    return F.slice(F.array_distinct(F.array(x_priv, *shorter)), 1, k)


def term_skeletons_of(canonical: Column) -> Column:
    """Skeletons of a text's protected terms: what its candidates must hold."""
    return F.filter(F.array_sort(F.array_distinct(F.transform(canonical, T.skeleton))), lambda s: F.length(s) >= 3)


#: From candidates (text, v: vector), the threshold and how many: those that stay.
Pruner = Callable[[Column, float, int], Column]


def greedy(items: Column, tau: float, most: int) -> Column:
    return prune(items, lambda x: x["v"], tau, most)


def keep_all(items: Column, tau: float, most: int) -> Column:
    """The pruner that prunes nothing."""
    return items


def rewrite(
    rows: DataFrame, tokens: TokenConfig, config: SentenceConfig, proposer: Callable[[Column, Column, int], Column] = table_proposals, triage: bool = True,
    score: Callable[[Column], Column] = keyword_share, encode: Callable[[Column], Column] = hash_vector, pruner: Pruner = greedy, backend: Backend = hash_backend, routes: DataFrame | None = None,
) -> DataFrame:
    """row_idx, Text, result, audit for rows (row_idx, Text): route, sanitise, propose, prune, gate, choose.

    proposer makes an array of candidates from (sanitised text, text, how many); config.proposer_input says whether it
    sees the raw text (the default) or the sanitised one. score and encode: a text's probability of hate and its vector, as
    Column functions made of Column expressions. routes: those of earlier layers; else, with triage, the default ones.
    """
    rows = dealt(rows.select("row_idx", F.coalesce("Text", F.lit("")).alias("Text")), "row_idx")
    canonical = lexicon.protected_terms(F.col("Text"), tokens.terms, tokens.max_gap)
    prepared = rows
    keep = force = None
    if triage and routes is None:
        routes = default_routes(rows, config.saliency_threshold, score)
    if routes is not None:
        prepared = rows.join(route_sets(routes), "row_idx", "left")
        none = F.array().cast("array<string>")
        keep, force = F.coalesce("protected", none), F.coalesce("forced", none)
    share = {k: (None if v is None else config.epsilon_1 if k == "content" else v) for k, v in tokens.epsilon.items()}
    from dataclasses import replace

    done = privatize_texts(prepared, replace(tokens, epsilon=share), keep, force, backend)
    done = done.withColumn("canonicals", canonical).withColumn("_skeletons", term_skeletons_of(canonical))
    if config.generation == "none":
        audit = F.struct(F.lit(True).alias("fallback"), F.lit("generation_disabled").alias("fallback_reason"), F.lit(0).alias("k_generated"), F.lit(0).alias("k_after_prune"), F.lit(0).alias("k_valid"))
        return done.select("row_idx", "Text", F.col("x_priv").alias("result"), audit.alias("audit"))
    source = F.col("Text") if config.proposer_input == "text" else F.col("x_priv")
    done = done.withColumn("_raw", proposer(F.col("x_priv"), source, config.k_generate))
    done = done.withColumn("_encoded", F.transform("_raw", lambda c: F.struct(c.alias("text"), encode(c).alias("v"))))
    done = done.withColumn("_pruned", F.transform(pruner(F.col("_encoded"), config.tau_dup, config.k_max_after_prune), lambda x: x["text"]))
    done = done.withColumn("_details", gated(F.col("_pruned"), F.col("Text"), F.col("_skeletons"), config, score, encode))
    done = done.withColumn("_chosen", choose(F.col("_details"), F.col("x_priv"), F.col("Text"), config, tokens.run_seed, F.col("row_idx")))
    audit = F.struct(
        F.col("_chosen.fallback").alias("fallback"),
        F.col("_chosen.reason").alias("fallback_reason"),
        F.size("_raw").alias("k_generated"),
        F.size("_pruned").alias("k_after_prune"),
        F.col("_chosen.k_valid").alias("k_valid"),
        F.lit(config.epsilon_total).alias("epsilon_total"),
        F.lit(config.epsilon_1).alias("epsilon_1"),
        F.lit(config.epsilon_2).alias("epsilon_2"),
        dp.refined_sensitivity(F.col("Text")).alias("delta_u"),
        F.col("canonicals").alias("protected_terms"),
        F.transform("_details", lambda d: F.struct(F.substring(d["text"], 1, 200).alias("text"), (d["reject"] == "").alias("valid"), d["reject"].alias("reject"), d["p_hate"].alias("p_hate"), d["sem_cos"].alias("sem_cos"))).alias("filter_details"),
        F.col("_chosen.probs").alias("selection_probs"),
    )
    return done.select("row_idx", "Text", F.col("_chosen.text").alias("result"), audit.alias("audit"))
